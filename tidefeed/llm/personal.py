"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, card numbers and international phone numbers. The
field tags names, street addresses, national numbers, local phone numbers and accounts from word
shapes and the words around them; what it finds beyond the patterns has the kind ``tagged``.
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

KINDS = ("email", "ip", "card", "phone", "tagged")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where digits begin, as one from later on would also do from there; so no run of digits
#: is tried at each of its places.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
WORD = re.compile(r"\S+")
#: Pieces of which the filler words of the training rows are made.
SYLLABLES = ("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve "
             "ción ado eau ê oir ung schtz keit ß ü").split()
#: Words that say nothing of their neighbours.
COMMON = (*SYLLABLES, *crf.PROSE, "page")
CORE = re.compile(r"\w.*\w|\w", re.DOTALL)


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of ``EMAIL``, found from their @ signs: a text of one long word stays cheap."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find; offsets are code points, ends exclusive."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                      if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                      if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def labelled_rows(n: int = 1000, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small training table: invented lines with and without personal data, word by word."""
    pick = random.Random(seed)

    def word() -> str:
        if pick.random() < 0.5:
            return pick.choice(crf.PROSE)
        made = "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 5)))
        return pick.choice([made] * 6 + [made.capitalize(), made.upper(), made + ",", made + "."])

    def name() -> str:
        return "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(2, 3))).capitalize()

    def digits(count: int) -> str:
        return "".join(pick.choice("0123456789") for _ in range(count))

    def plain() -> list[str]:
        out: list[str] = []
        for _ in range(pick.randint(3, 7)):
            roll = pick.random()
            if roll < 0.72:
                out.append(word())
            elif roll < 0.8:
                out.append(word() + pick.choice(["***", "###", "!!", "$$$", "&&&", "%%%"]))
            else:
                out += pick.choice([
                    ["|"], [digits(pick.randint(1, 6))], [digits(16)], [f"{digits(2)}.{digits(1)}"], ["version", "3."],
                    ["CC", "BY-NC", "4.0."], ["token", "=", f'"{digits(8)}ab{digits(6)}cd"'], [".".join(digits(2) for _ in range(4))],
                    [f"{word()}.{digits(2)}@mail{digits(1)}.{word()}.com"], [f"{word()}-{word()}"], ["2024-05-" + digits(2)],
                    ["Apache", "License,", "Version", "2.0."], [name() + ".", name()], [name(), word()], [f"{digits(2)}:{digits(2)}"],
                    ["+" + digits(1), f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["the", name()], [f"{digits(1)}%"],
                    [word().rstrip(",.") + ".", name()], [pick.choice(COMMON) + ".", name()], [pick.choice(COMMON), name()],
                    [pick.choice(COMMON) + ".", name(), name()],
                    # Headings and nouns in capitals, and signs after words that often announce something personal.
                    [word(), name(), name()], [word(), name(), name(), name()], [word(), word().title(), name(), word().title()],
                    ["call", word() + "):", name()], ["phone", word() + ")"], ["name", "=", word() + "()"], [f"({name()[:2]}{digits(2)};", name(), word()],
                    [f"{name()}/{digits(1)}.0"], [name() + ",", digits(2)], ["name:", word() + ","], ["at", word() + ".py:" + digits(2)],
                    [f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"],
                    [f"{digits(4)}-{digits(4)}"], [f"#{digits(6)}"], ["call", "for", word()], ["contact", "the", word()], ["lives", "in", name()],
                    ["born", "in", f"19{digits(2)}"], ["order", digits(8)], ["phone", "the", word()], [f"{digits(2)}/{digits(2)}/20{digits(2)}"],
                    [digits(2), name(), word()], ["at", digits(2) + ":" + digits(2)], ["patient", word()], ["number", digits(3)], [f"v{digits(1)}.{digits(1)}"], ["page", digits(3)], [name(), name(), word()],
                ])
        return out

    def item() -> tuple[list[str], list[str]]:
        """(words before, personal words)."""
        return pick.choice([
            lambda: ([pick.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Dear", "Herr", "Frau", "Señor", "Madame"])], [name(), name()]),
            lambda: ([pick.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau"])], [name()]),
            lambda: ([pick.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Prof.", "Señora"])], [name(), name()]),
            lambda: (["my", "name", "is"], [name(), name()]),
            lambda: ([pick.choice(["patient", "employee", "customer", "client", "contact"])], [name(), name()]),
            lambda: ([pick.choice(["contact", "patient", "employee", "customer", "Sincerely,", "Regards,", "colleague", "Patient:",
                                   "Name:", "name:"])], [name(), name()]),
            lambda: ([pick.choice(["at", "reach", "on", "number", "number:", "cell"])], [f"{digits(3)}-{digits(3)}-{digits(4)}"]),
            lambda: ([pick.choice(["SSN", "SSN:", "ssn", "social"])], [f"{digits(3)}-{digits(2)}-{digits(4)}"]),
            lambda: (["SSN", "is"], [f"{digits(3)}-{digits(2)}-{digits(4)}"]),
            lambda: ([pick.choice(["call", "phone", "tel", "Tel:", "phone:", "at", "mobile"])], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]),
            lambda: ([pick.choice(["call", "phone", "tel", "Tel:", "phone:", "mobile"])], [f"{digits(3)}-{digits(3)}-{digits(4)}"]),
            lambda: (["IBAN"], [pick.choice(["DE", "FR", "ES", "GB"]) + digits(20)]),
            lambda: (["IBAN:"], [pick.choice(["DE", "FR", "ES", "GB"]) + digits(2), digits(4), digits(4), digits(4), digits(4), digits(2)]),
            lambda: (["passport", pick.choice(["no.", "number", "no"])], [pick.choice("CLPX") + digits(8)]),
            lambda: (["born", "on"], [f"{digits(2)}/{digits(2)}/19{digits(2)}"]),
            lambda: (["lives", "at"], [digits(pick.randint(1, 3)), name(), pick.choice(["Street", "Road", "Avenue", "Lane"])]),
            lambda: (["address:"], [digits(pick.randint(1, 3)), name(), pick.choice(["Street", "St.", "Road", "Avenue"])]),
        ])()

    rows = []
    for i in range(n):
        before, after = plain(), plain()
        lead, own = item() if i % 2 else (plain(), [])
        if own and pick.random() < 0.3:
            own = [*own[:-1], own[-1] + pick.choice([".", ",", "!!", "###"])]
        tags = ["B"] + ["I"] * (len(own) - 1) if own else []
        rows.append((before + lead + own + after, ["O"] * (len(before) + len(lead)) + tags + ["O"] * len(after)))
    return rows


@cache
def default_field() -> crf.Field:
    return crf.train(labelled_rows(), common=COMMON)


def _added(text: str, places, tags, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    words = [m.span() for m in WORD.finditer(text)]
    out = []
    for first, last in crf.spans(places, tags):
        core = CORE.search(text, words[first][0], words[last][1])
        if core and not any(s < core.end() and core.start() < e for s, _, e in base):
            out.append((core.start(), 4, core.end()))
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
