"""A linear-chain conditional random field that tags the words of texts, in numpy.

Tags are outside, begin and inside. A word is seen through a short form of its shape, or as itself
if it is one of the words the training rows use as context; a tag also looks at the two words
before, the word after and two features of the whole text. It is trained on a small table of tagged
rows by maximum likelihood (forward-backward, L2 penalty) and decoded by Viterbi.

Long texts are mostly words that no neighbour could turn into a hit. Where a word's score for
outside leads by more than transitions can make up, outside is certain, and the chain falls apart
there into short runs; Viterbi works on all runs of a batch at once. The result is the best path of
the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUT, BEGIN, INSIDE = 0, 1, 2
TAGS = {"O": OUT, "B": BEGIN, "I": INSIDE}
NEVER = -1e4
#: Words around the tagged word that it looks at, itself first.
SEEN = (0, -1, -2, 1)
EDGES = (0.02, 0.1)
#: Words that a worker remembers, about 100 bytes each.
REMEMBERED = 200_000
TRAILING = ".,;:!?"
#: Ordinary words for the filler of training rows.
PROSE = """about after again all also an and are around as at back be because been before between both but by can come could
day der des die do down each el en est et every few first for from gave get give go good great had has have he her here him his
how if in into is it its just know large last les like little long look made make many may men mit more most much must my new no
not now of off on one only or other our out over people por que right said same see she should since small so some state still
such take than that the their them then there these they this those three through time to too two un under und une until up use
used very von was way we well were what when where which while who will with work would year years you your""".split()


class _Shape(dict):
    def __missing__(self, point: int) -> str:
        letter = chr(point)
        self[point] = out = "0" if letter.isdigit() else "A" if letter.isupper() else "a" if letter.isalpha() else letter
        return out


_SHAPE = _Shape()


def _bucket(n: int) -> int:
    return n if n < 5 else 5 if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 24 else 24 if n < 48 else 48


def short_form(word: str, context: frozenset[str]) -> tuple:
    """What the field sees of a word: itself if it is a context word, else its shape."""
    plain = word.rstrip(TRAILING) if word[-1] in TRAILING else word
    end = word[len(plain) :][:1]
    if plain.isalpha():
        low = plain.lower()
        if low in context:
            return ("word", low, end, plain.isupper())
        case = "a" if plain.islower() else "A" if plain.isupper() and len(plain) > 1 else "Aa" if plain.istitle() else "aA"
        return ("letters", case, min(len(plain), 13) // 4, end)
    shape = word.translate(_SHAPE)
    runs = [shape[0]]
    for letter in shape[1:]:
        if letter != runs[-1]:
            runs.append(letter)
    low = word.lower().strip("\"'`()[]{}<>,.;:=")
    name = low if low in context else ""
    core = max((part for part in shape.replace("A", "a").replace("0", "a").split() or [""]), key=len)
    hexadecimal = bool(low) and all(c in "0123456789abcdef" for c in low)
    digits = shape.count("0")
    capitals, smalls = shape.count("A"), shape.count("a")
    changes = sum(a != b and a in "aA0" and b in "aA0" for a, b in zip(shape, shape[1:], strict=False))
    return ("mixed", "".join(runs[:7]), _bucket(len(core)), _bucket(digits), _bucket(changes), hexadecimal,
            digits > 0 and smalls > 0, capitals > 0 and smalls > 0 and digits > 0, name)


def _named(form: tuple) -> list[str]:
    """Features of a short form."""
    kind = form[0]
    if kind == "word":
        return [f"w={form[1]}", f"w={form[1]}{form[2]}", f"k=word{form[2]}", f"up={form[3]}"]
    if kind == "letters":
        return [f"c={form[1]}", f"c={form[1]},{form[2]}", f"c={form[1]}{form[3]}", "k=letters"]
    _, runs, length, digits, changes, hexadecimal, both, all_three, name = form
    return [f"s={runs}", f"s={runs[:3]}", f"l={length}", f"d={digits}", f"x={changes}", f"h={hexadecimal},{length}",
            f"b={both},{length}", f"t={all_three},{length}", f"n={name}", "k=mixed", f"dl={digits},{length}"]


def text_features(forms: np.ndarray) -> list[int]:
    """Buckets of the shares of words with a digit or sign, and of words with = : or a brace."""
    return [int(np.searchsorted(EDGES, share)) for share in forms]


@dataclass
class Field:
    """Weights: by (feature, place) for each tag, of the two features of the text, of the changes."""

    words: dict[str, np.ndarray]
    texts: np.ndarray
    change: np.ndarray
    first: np.ndarray
    context: frozenset[str]


def _signs(word: str) -> tuple[bool, bool]:
    return not word.rstrip(TRAILING).isalpha(), any(c in word for c in "=:{}")


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 150, penalty: float = 0.02,
          rate: float = 0.15, common: tuple[str, ...] = ()) -> Field:
    """Fit a field to tagged rows: (words, tags), tags of O, B and I.

    Words that stand near tagged words several times are seen as themselves, but for ``common``.
    """
    used: dict[str, int] = {}
    for words, tags in rows:
        near = set()
        for i, tag in enumerate(tags):
            if tag != "O":
                near.update(range(max(0, i - 2), min(len(tags), i + 2)))
        for i in near:
            plain = words[i].lower().strip("\"'`()[]{}<>,.;:=")
            if tags[i] == "O" and plain.isalpha():
                used[plain] = used.get(plain, 0) + 1
    context = frozenset(word for word, n in used.items() if n >= 4 and word not in common)
    names: dict[str, int] = {}
    longest = max(len(words) for words, _ in rows)
    listed, gold, mask, shares = [], [], [], []
    for words, tags in rows:
        forms = [_named(short_form(word, context)) for word in words]
        row = []
        for i in range(longest):
            ids = []
            for place in SEEN:
                if i < len(words):
                    at = i + place
                    seen = forms[at] if 0 <= at < len(words) else ["edge"]
                    ids += [names.setdefault(f"{place}{name}", len(names)) for name in seen]
            row.append(ids)
        listed.append(row)
        gold.append([TAGS[tag] for tag in tags] + [0] * (longest - len(tags)))
        mask.append([True] * len(words) + [False] * (longest - len(words)))
        signs = np.array([_signs(word) for word in words], float)
        shares.append(text_features(signs.mean(0)))
    width = max(len(ids) for row in listed for ids in row)
    none = len(names)
    feats = np.array([[ids + [none] * (width - len(ids)) for ids in row] for row in listed])
    y, m = np.array(gold), np.array(mask)
    n = len(rows)
    last = m.sum(1) - 1
    texts = np.zeros((n, 2, len(EDGES) + 1))
    for i, (a, b) in enumerate(shares):
        texts[i, 0, a] = texts[i, 1, b] = 1
    theta = {"W": np.zeros((none + 1, 3)), "D": np.zeros((2, len(EDGES) + 1, 3)), "T": np.zeros((3, 3)), "F": np.zeros(3)}
    theta["T"][OUT, INSIDE] = theta["F"][INSIDE] = NEVER
    step = {k: np.zeros_like(v) for k, v in theta.items()}
    pace = {k: np.zeros_like(v) for k, v in theta.items()}
    one = np.eye(3)
    for turn in range(1, rounds + 1):
        score = theta["W"][feats].sum(2) + np.einsum("nab,abt->nt", texts, theta["D"])[:, None]
        score[:, 0] += theta["F"]
        ahead = np.zeros((n, longest, 3))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + theta["T"], axis=1)
        behind = np.zeros((n, longest, 3))
        for t in range(longest - 2, -1, -1):
            inner = np.logaddexp.reduce(theta["T"] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(m[:, t + 1, None], inner, 0)
        whole = np.logaddexp.reduce(ahead[np.arange(n), last], axis=1)
        chance = np.exp(ahead + behind - whole[:, None, None]) * m[:, :, None]
        off = (chance - one[y] * m[:, :, None])
        pair = np.exp(ahead[:, :-1, :, None] + theta["T"] + (score + behind)[:, 1:, None, :]
                      - whole[:, None, None, None]) * m[:, 1:, None, None]
        told = one[y[:, :-1]][..., None] * one[y[:, 1:]][:, :, None, :] * m[:, 1:, None, None]
        flat = feats.reshape(-1)
        spread = np.repeat(off.reshape(-1, 3), width, axis=0)
        grad = {
            "W": np.column_stack([np.bincount(flat, spread[:, k], none + 1) for k in range(3)]) / n + penalty / 10 * theta["W"],
            "D": np.einsum("nab,nt->abt", texts, off.sum(1)) / n + penalty * theta["D"],
            "T": (pair - told).sum((0, 1)) / n + penalty / 10 * np.where(theta["T"] > NEVER / 2, theta["T"], 0),
            "F": off[:, 0].sum(0) / n,
        }
        for k in theta:
            step[k] = 0.9 * step[k] + 0.1 * grad[k]
            pace[k] = 0.99 * pace[k] + 0.01 * grad[k] ** 2
            theta[k] -= rate * (step[k] / (1 - 0.9**turn)) / (np.sqrt(pace[k] / (1 - 0.99**turn)) + 1e-6)
        theta["W"][none] = 0
        theta["T"][OUT, INSIDE] = theta["F"][INSIDE] = NEVER
    words = {name: theta["W"][i] for name, i in names.items()}
    return Field(words, theta["D"], theta["T"], theta["F"], context)


class Tagger:
    """A field with the words it has met, for one worker."""

    def __init__(self, field: Field):
        self.field = field
        # The change to and from a tag; row 3 and column 3 stand for the edge of the text.
        change = np.zeros((4, 4))
        change[:3, :3] = field.change
        tags = (BEGIN, INSIDE)
        # What the changes around begin or inside can add over those around outside, at most ...
        self.lead = max(
            change[a, tag] + change[tag, b] - change[a, OUT] - change[OUT, b]
            for tag in tags for a in range(4) for b in (OUT, BEGIN, 3)
        )
        # ... and if inside follows, over outside with begin in place of that inside.
        self.chain = max(
            change[a, tag] + change[tag, INSIDE] + change[INSIDE, c] - change[a, OUT] - change[OUT, BEGIN] - change[BEGIN, c]
            for tag in tags for a in range(4) for c in range(4)
        )
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.forms: dict[tuple, int] = {}
        edge = np.concatenate([self._weights(["edge"], place) for place in SEEN])
        self.rows = np.zeros((1024, 3 * len(SEEN) + 2), np.float32)
        self.rows[0, : len(edge)] = edge
        self.used = 1

    def _weights(self, names: list[str], place: int) -> np.ndarray:
        zero = np.zeros(3)
        return sum((self.field.words.get(f"{place}{name}", zero) for name in names), zero)

    def _meet(self, word: str) -> int:
        form = (short_form(word, self.field.context), _signs(word))
        at = self.forms.get(form)
        if at is None:
            at = self.forms[form] = self.used
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            names = _named(form[0])
            self.rows[at] = np.concatenate([*(self._weights(names, place) for place in SEEN), form[1]])
            self.used += 1
        self.known[word] = at
        return at

    def tags(self, texts: list[list[str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For texts as lists of words: (text, places of words that are not outside, their tags)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        words = [word for text in texts for word in text]
        if not words:
            return []
        get = self.known.get
        ids = [get(word, -1) for word in words]
        where = np.array(ids, np.int64)
        for i in np.flatnonzero(where < 0).tolist():
            at = get(words[i], -1)
            where[i] = at if at >= 0 else self._meet(words[i])
        lengths = np.array([len(text) for text in texts])
        full = lengths > 0
        starts = np.cumsum(lengths)[full] - lengths[full]
        owner = np.repeat(np.arange(len(texts)), lengths)
        rows = self.rows
        score = rows[where, 0:3].astype(np.float64)
        edge = rows[0]
        for k, place in enumerate(SEEN[1:], 1):
            part = slice(3 * k, 3 * k + 3)
            other = np.empty_like(score)
            if place < 0:
                other[-place:] = rows[where[:place], part]
                for back in range(min(-place, len(words))):
                    at = starts[starts + back < len(words)]
                    other[at[owner[at] == owner[at + back]] + back] = edge[part]
            else:
                other[:-place] = rows[where[place:], part]
                other[np.append(starts[1:], len(words)) - 1] = edge[part]
            score += other
        shares = np.add.reduceat(rows[where, -2:], starts, axis=0) / lengths[full][:, None]
        bins = np.searchsorted(EDGES, shares)
        whole = self.field.texts[0][bins[:, 0]] + self.field.texts[1][bins[:, 1]]
        score += np.repeat(whole, lengths[full], axis=0)
        score[starts] += self.field.first
        margin = score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE])
        unsure = margin <= self.lead
        begins = score[1:, BEGIN] - score[1:, INSIDE]
        unsure[:-1] |= (owner[1:] == owner[:-1]) & (margin[:-1] + begins <= self.chain)
        found = self._decode(score, np.flatnonzero(unsure), owner)
        hits = np.flatnonzero(found)
        out = []
        if len(hits):
            base = np.cumsum(lengths) - lengths
            cuts = np.flatnonzero(np.diff(owner[hits])) + 1
            for part in np.split(hits, cuts):
                text = int(owner[part[0]])
                out.append((text, part - base[text], found[part]))
        return out

    def _decode(self, score: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Tags of all words: Viterbi over each run of neighbouring places in ``at``."""
        found = np.zeros(len(score), np.int8)
        if not len(at):
            return found
        change = self.field.change
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
        first = at[new]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        # Before a run stands an outside word, or the text begins; after it likewise.
        leads = (first > 0) & (owner[np.maximum(first - 1, 0)] == owner[first])
        best = score[first] + np.where(leads[:, None], change[OUT], 0.0)
        back = np.zeros((int(size.sum()), 3), np.int8)
        offset, live = 0, len(first)
        offsets, final = [0], best.copy()
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            options = best[:live, :, None] + change
            chosen = options.argmax(1)
            best = np.take_along_axis(options, chosen[:, None], 1)[:, 0] + score[first[:live] + t]
            back[offset : offset + live] = chosen
            offsets.append(offset)
            offset += live
            final[:live] = best
        after = first + size
        follows = (after < len(score)) & (owner[np.minimum(after, len(score) - 1)] == owner[first])
        tag = (final + np.where(follows[:, None], change[:, OUT], 0.0)).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            found[first[:live] + t] = tag[:live]
            if t:
                tag[:live] = back[offsets[t] + np.arange(live), tag[:live]]
        return found


def spans(places: np.ndarray, tags: np.ndarray) -> list[tuple[int, int]]:
    """(first word, last word) of each begin with its insides."""
    out: list[tuple[int, int]] = []
    for place, tag in zip(places.tolist(), tags.tolist(), strict=True):
        if tag == INSIDE and out and out[-1][1] == place - 1:
            out[-1] = (out[-1][0], place)
        else:
            out.append((place, place))
    return out
