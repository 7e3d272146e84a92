"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find assignments, access keys and hexadecimal runs. The field tags words as the
beginning or the inside of a secret from their shapes, the words around them and two features of the
file; what it finds beyond the patterns is added under the kind ``tagged``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.llm import crf
from tidefeed.llm.text import blocks, ship

KINDS = ("assign", "access", "hex", "tagged")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: One of these is in every text, in lower case, that ASSIGN matches.
NAMES = ("passw", "secret", "token", "api")
CORE = re.compile(r"[A-Za-z0-9+/_=.~-]+")
#: Shortest secret that the field may add.
LEAST = 10
WORD = re.compile(r"\S+")
#: Pieces of which the filler words of the training rows are made.
SYLLABLES = ("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve "
             "ción ado eau ê oir ung schtz keit ß ü").split()
#: Words that say nothing of their neighbours.
COMMON = (*SYLLABLES, *crf.PROSE, "page")
#: The password in an address with a user.
CREDENTIAL = re.compile(r"://[^\s/:@]*:([^\s/@]+)@")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find; offsets are code points, ends exclusive."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def labelled_rows(n: int = 1000, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small training table: invented lines with and without secrets, word by word."""
    pick = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def word() -> str:
        if pick.random() < 0.5:
            return pick.choice(crf.PROSE)
        made = "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 5)))
        return pick.choice([made] * 6 + [made.capitalize(), made.upper(), made + ",", made + "."])

    def run(alphabet: str, low: int, high: int) -> str:
        return "".join(pick.choice(alphabet) for _ in range(pick.randint(low, high)))

    def harmless() -> str:
        """A word that looks like a secret and is none."""
        name = "".join(pick.choice(SYLLABLES[:23]) for _ in range(3))
        return pick.choice([
            lambda: "-".join(run("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
            lambda: f"https://{name}.org/{name}/{pick.randint(10, 9999)}?id={pick.randint(100, 99999)}&lang={name}",
            lambda: f"http://{name}.{name}.com:8080/{name}/{name}.html", lambda: f"postgres://db.{name}.org:5432/{name}",
            lambda: f"{pick.randint(0, 20)}.{pick.randint(0, 20)}.{pick.randint(0, 20)}-{name[:4]}.{pick.randint(0, 9)}",
            lambda: f"2024-05-{pick.randint(10, 28)}T10:{pick.randint(10, 59)}:33Z", lambda: f"{pick.randint(10, 23)}:{pick.randint(10, 59)}:07,{pick.randint(100, 999)}",
            lambda: f"{pick.choice(['', name[:3] + '-'])}{name}-{run('0123456789bcdfx', 8, 10)}-{run('0123456789bcdfx', 5, 5)}",
            lambda: f"https://{pick.choice(['www.', ''])}{name}.org/{pick.randint(1, 9)}/{name}/{name[:3]}.html#{name}.{name.title()}",
            lambda: f"https://{name}.com/{name.title()}/{name}-{name}/{pick.choice(['blob', 'tree'])}/v{pick.randint(1, 9)}.{pick.randint(0, 9)}/{name}_{name}.py",
            lambda: f"org.{name}.{name}:{name}-core_2.13:4.1.0", lambda: ":".join(run("0123456789abcdef", 2, 2) for _ in range(6)),
            lambda: f"{name}.{name.title()}{name.title()}.{name}()", lambda: f"{name}_{name}_{pick.randint(1, 99)}.tar.gz",
            lambda: f"/var/lib/{name}/{name}-{pick.randint(1, 99)}/{name}.log", lambda: f"{name.title()}{name.title()}{pick.randint(1, 9)}Test",
            lambda: f"{name.upper()}_{name.upper()}={pick.randint(1, 9999)}", lambda: f"user:{name}@{name}.com",
            lambda: f"git@{name}.org:{name}/{name}.git", lambda: f"10.{pick.randint(1000, 9999)}/{name}.{pick.randint(10000, 99999)}",
        ])()

    def plain() -> list[str]:
        out = []
        for _ in range(pick.randint(3, 7)):
            if pick.random() < 0.12:
                out.append(pick.choice(["{}", "{}", "{},", '"{}"', "({})"]).format(harmless()))
                continue
            roll = pick.random()
            number = str(pick.randint(1, 10 ** pick.randint(1, 6)))
            out.append(
                word() if roll < 0.7 else word() + pick.choice(["***", "###", "!!", "$$$", "&&&", "%%%"]) if roll < 0.8
                else pick.choice(["|", "=", "-", "(see", "it's", "e.g.", "{", "}", "==", "x", "+=", "/*", "#"]) if roll < 0.87
                else pick.choice([number, number + ".", f"{number}.{pick.randint(0, 9)}", f"v{number}", f"{pick.randint(1, 12)}:30",
                                  f"2024-0{pick.randint(1, 9)}-1{pick.randint(0, 9)}", f"({pick.randint(100, 999)})",
                                  f"{pick.randint(100, 999)}-{pick.randint(1000, 9999)}", f"+{pick.randint(1, 99)}",
                                  f"{word()}@{word()}.com", f"{pick.choice(SYLLABLES)}.{pick.randint(10, 99)}@mail{pick.randint(0, 9)}.{word()}.com",
                                  ".".join(str(pick.randint(0, 255)) for _ in range(4)),
                                  f"https://{word()}.org/{word()}", f"/usr/{word()}/{word()}.txt", f"{word()}_{word()}",
                                  f"{word()}-{word()}", f"{word()}({word()})", str(pick.randint(10**15, 10**16)), "BY-NC", "4.0.",
                                  f"get{word().title()}Of{word().title()}()"]))
        return out

    def secret() -> str:
        mixed = letters + letters.upper() + digits
        return pick.choice([
            lambda: run(mixed, 20, 44), lambda: "ghp_" + run(mixed, 36, 36), lambda: pick.choice(["sk_", "pk_", "rk_"]) + pick.choice(["live_", "test_"]) + run(mixed, 24, 24),
            lambda: "xoxb-" + run(digits, 11, 12) + "-" + run(mixed, 24, 24), lambda: "AIza" + run(mixed + "_-", 35, 35),
            lambda: "eyJ" + run(mixed, 17, 30) + ".eyJ" + run(mixed, 20, 40) + "." + run(mixed + "_-", 30, 43),
            lambda: run(mixed + "+/", 39, 39) + "=", lambda: run(letters + digits, 10, 16) + run(digits, 2, 3),
            lambda: run(digits + "abcdef", 32, 40), lambda: "glpat-" + run(mixed, 20, 20), lambda: "npm_" + run(mixed, 36, 36),
            lambda: "SG." + run(mixed + "_-", 22, 22) + "." + run(mixed + "_-", 43, 43), lambda: run(mixed + "!$%", 12, 16),
        ])()

    rows = []
    for i in range(n):
        before, after = plain(), plain()
        roll = i % 10
        if roll < 4:
            # Words that announce a secret, and none comes.
            lead = pick.choice([[], [], ["the", "key", "is"], ["password", "is"], ["token", "="], ["secret:"], ["login", "with"], ["Bearer"]])
            middle, tags = [*lead, *plain()], None
        elif i % 20 == 4:
            user = "".join(pick.choice(SYLLABLES[:23]) for _ in range(2))
            kind = pick.choice(["postgres", "mysql", "https", "amqp", "redis", "mongodb+srv"])
            middle = [f"{kind}://{user}:{secret()[:16]}@{user}.{pick.choice(['org', 'internal', 'com:5432', 'net'])}/{user}"]
            middle = [pick.choice(["{}", "{}", '"{}"', "'{}'", "url={}", "{},", "{}_url={}".replace("{}", user[:2], 1)]).format(*middle)]
            middle = pick.choice([[], ["url", "="], ["to"], [word()]]) + middle
            tags = ["O"] * (len(middle) - 1) + ["B"]
        elif i % 20 == 14:
            kind = pick.choice([["RSA", "PRIVATE"], ["PRIVATE"], ["EC", "PRIVATE"], ["OPENSSH", "PRIVATE"]])
            body = [run(letters + letters.upper() + digits + "+/", 64, 64) for _ in range(pick.randint(1, 3))]
            body.append(run(letters + letters.upper() + digits + "+/", 20, 40) + pick.choice(["", "=", "=="]))
            middle = ["-----BEGIN", *kind, "KEY-----", *body, "-----END", *kind, "KEY-----"]
            tags = ["O"] * (2 + len(kind)) + ["B"] + ["I"] * (len(body) - 1) + ["O"] * (2 + len(kind))
        else:
            lead = pick.choice([
                ["Authorization:", "Bearer"], ["token", "="], ["key", "is"], ["api", "key"], ["secret:"], ["export", "TOKEN", "="],
                ["password", "is"], ["client_secret", ":"], ["credential"], ["the", "token"], ["auth", "token:"], ["private", "key"],
                ["access", "key", "="], ["passphrase:"], ["with", "password"], ["login", "with"], ["-H", "Bearer"],
                ["login", "with", "Authorization:", "Bearer"], ["with", "Authorization:", "Bearer"], ["password", "is:"],
            ])
            shell = pick.random() < 0.15
            hidden = secret()
            if "_" in hidden[:9] or hidden[2:6].count(".") or hidden[:4] in ("AIza", "xoxb"):
                # Known by its own form, so it needs no word before it.
                lead = pick.choice([lead, [word()], [word().upper() + ":"], [word() + "("]])
            hidden = pick.choice(["{}", '"{}"', "'{}'", "{},", "{};", '"{}",', "{}.", "{})"]).format(hidden)
            if shell:
                lead, hidden = ["export"], word().upper() + "=" + secret()
            middle, tags = [*lead, hidden], ["O"] * len(lead) + ["B"]
            if roll == 9:
                middle, tags = [*middle, pick.choice(["and", "/", "then"]), secret()], [*tags, "O", "B"]
            elif roll == 8:
                middle, tags = [*middle, secret()], [*tags, "I"]
        tags = tags or ["O"] * len(middle)
        rows.append((before + middle + after, ["O"] * len(before) + tags + ["O"] * len(after)))
    return rows


@cache
def default_field() -> crf.Field:
    return crf.train(labelled_rows(), common=COMMON)


def _core(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The longest part of a word that can be a secret; of an address with a user, the password."""
    inside = CREDENTIAL.search(text, start, end)
    if inside:
        return inside.span(1)
    parts = [m.span() for m in CORE.finditer(text, start, end)]
    if not parts:
        return None
    first, last = max(parts, key=lambda p: p[1] - p[0])
    named = text.rfind("=", first, last - LEAST)
    return (named + 1 if named >= 0 else first), last


def _added(text: str, places, tags, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    words = [m.span() for m in WORD.finditer(text)]
    out = []
    for first, last in crf.spans(places, tags):
        a = _core(text, *words[first])
        b = _core(text, *words[last])
        least = 1 if CREDENTIAL.search(text, *words[first]) else LEAST
        if a and b and b[1] - a[0] >= least and not any(s < b[1] and a[0] < e for s, _, e in base):
            out.append((a[0], 3, b[1]))
    return out


SCHEMA = "array<struct<start: int, kind: string, end: int>>"
ARROW = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def find(docs: DataFrame, text: str = "text", field: crf.Field | None = None) -> Column:
    """A column of spans (start, kind, end), by start and then kind as in ``KINDS``.

    Offsets are code points, ends exclusive. Null and empty texts have none. A text is taken whole, in
    time that grows with its length; one longer than a block is a block of its own.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    @F.arrow_udf(SCHEMA)
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = crf.Tagger(shared.value)
        for column in columns:
            rows = []
            for _, part in blocks(column, 2 << 20):
                texts = [t or "" for t in part.to_pylist()]
                own = [base_spans(t) for t in texts]
                for i, places, tags in tagger.tags([t.split() for t in texts]):
                    own[i] = sorted(own[i] + _added(texts[i], places, tags, own[i]))
                rows.extend([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans] for spans in own)
            yield pa.array(rows, ARROW)

    return found(F.col(text))
