"""Periodic runs of words: maximal stretches whose words repeat with a period, at least twice.

Runs are found from Lyndon roots. For both orders of the words, the longest Lyndon word that begins at
a place ends where the next smaller suffix begins; every run has such a root. Each root is extended to
both sides as far as its period holds. How far is a longest common extension: of suffixes by the suffix
tree of the text, of prefixes by that of its reversal. Both trees are built by Ukkonen's algorithm. The
tour through a tree keeps the depth of the lowest ancestor between neighbouring leaves, and a table of
range minima over it answers each extension in constant time.

A run of ``LEAST`` words or more holds a window of ``LEAST // 2`` words that stands again one period
on. So only stretches in which such windows repeat are put into trees; the rest of a text has no run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.llm.text import blocks, ship

#: Words of the shortest run; a run has at least two periods too.
LEAST = 12
#: Text bytes whose stretches share a pair of trees; a longer text is alone.
BLOCK = 1 << 20

_TIMES = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Words to whole numbers from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def suffix_tree(s: list[int]) -> tuple[list[dict[int, int] | None], list[int], list[int]]:
    """(children by first symbol, None for a leaf; start and end of the edge into each node), by Ukkonen.

    The last symbol must stand nowhere else. Leaves are made in the order of their suffixes.
    """
    n = len(s)
    children: list[dict[int, int] | None] = [{}]
    start, end, link = [0], [0], [0]
    node = edge = length = waiting = 0
    for i, symbol in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            own = children[node]
            child = own.get(s[edge])
            if child is None:
                own[s[edge]] = len(start)
                children.append(None)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                long = end[child] - start[child]
                if length >= long:
                    edge += long
                    length -= long
                    node = child
                    continue
                at = start[child]
                if s[at + length] == symbol:
                    if last and node:
                        link[last] = node
                    length += 1
                    break
                split = len(start)
                own[s[edge]] = split
                children.append({symbol: split + 1, s[at + length]: child})
                start.append(at)
                end.append(at + length)
                link.append(0)
                children.append(None)
                start.append(i)
                end.append(n)
                link.append(0)
                start[child] = at + length
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if not node and length:
                length -= 1
                edge = i - waiting + 1
            elif node:
                node = link[node]
    return children, start, end


class Extensions:
    """Longest common extensions of the suffixes of a text, and the order of its suffixes."""

    def __init__(self, s: list[int]):
        """``s`` ends with 0, which stands nowhere else and is below all other symbols."""
        self.children, start, end = suffix_tree(s)
        n = len(s)
        order, between = [], []
        pending = [(0, 0, 0)]
        low = n
        while pending:
            node, depth, above = pending.pop()
            if above < low:
                low = above
            own = self.children[node]
            if own is None:
                order.append(n - (depth + n - start[node]))
                between.append(low)
                low = n
            else:
                down = depth + end[node] - start[node]
                pending.extend([(own[symbol], down, down) for symbol in sorted(own, reverse=True)])
        self.order = order
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        # Minima over spans of 1, 2, 4, ... gaps; gap k is between the leaves k - 1 and k.
        self.minima = [np.array(between, np.int32)]
        while 2 << (len(self.minima) - 1) <= n:
            half = 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def turned(self) -> list[int]:
        """The suffixes in the order of the reversed alphabet; 0 stays the lowest symbol."""
        children, order, pending = self.children, [], [0]
        leaf = self._leaves()
        while pending:
            node = pending.pop()
            own = children[node]
            if own is None:
                order.append(leaf[node])
            else:
                pending.extend([own[symbol] for symbol in sorted(own) if symbol])
                if 0 in own:
                    pending.append(own[0])
        return order

    def _leaves(self) -> dict[int, int]:
        """Number of a leaf to its suffix: leaves are made in the order of their suffixes."""
        return {node: k for k, node in enumerate(node for node, own in enumerate(self.children) if own is None)}

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes a and b, which differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            table = self.minima[k]
            out[own] = np.minimum(table[low[own]], table[high[own] + 1 - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one to the right of lower rank; the length if there is none."""
    n = len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, rank[i]
        while j < n and rank[j] > own:
            j = out[j]
        out[i] = j
    return out


def runs(s: list[int], least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``s`` of at least ``least`` symbols, which are all above 0."""
    n = len(s)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    forward, backward = Extensions([*s, 0]), Extensions([*s[::-1], 0])
    begin, after = [], []
    for order in (forward.order, forward.turned()):
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n + 1)
        # The empty suffix is the lowest, so a place without a smaller suffix ends at the text's end.
        after.append(np.array(_next_smaller(rank.tolist())[:n]))
        begin.append(np.arange(n))
    i, j = np.concatenate(begin), np.concatenate(after)
    period = j - i
    right = forward.common(i, j)
    left = backward.common(n - i, n - j)
    first, length = i - left, period + left + right
    good = (length >= 2 * period) & (length >= least)
    return np.unique(np.column_stack([first[good], length[good], period[good]]), axis=0)


def repeating(ids: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """Places that a window of ``size`` symbols covers which stands again in the same part, in such a stretch.

    ``part`` numbers the texts, ascending. Places are looked over again until all windows of a stretch
    repeat inside that stretch.
    """
    place = np.arange(len(ids))
    while len(place) >= 2 * size:
        own, of = ids[place], part[place]
        hashed = of.astype(np.uint64) * _TIMES
        for k in range(size):
            hashed[: len(own) - size + 1] = (hashed[: len(own) - size + 1] ^ own[k : len(own) - size + 1 + k].astype(np.uint64)) * _TIMES
            hashed ^= hashed >> np.uint64(29)
        hashed = hashed[: len(own) - size + 1]
        whole = of[: len(hashed)] == of[size - 1 :]
        hashed, at = hashed[whole], np.flatnonzero(whole)
        order = np.argsort(hashed, kind="stable")
        same = hashed[order][1:] == hashed[order][:-1]
        twice = np.zeros(len(hashed), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept, old = place[covered], len(place)
        if not len(kept):
            return kept
        # A new part begins where places are not neighbours or the old part ends.
        opens = np.ones(len(kept), bool)
        opens[1:] = (np.diff(kept) > 1) | (np.diff(of[covered]) != 0)
        part = part.copy()
        part[kept] = np.cumsum(opens)
        place = kept
        if len(kept) == old:
            return kept
    return place[:0]


def block_runs(texts: list[list[int]], least: int = LEAST) -> list[np.ndarray]:
    """Rows (start, length, period) of each text, by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(chain.from_iterable(texts), np.int64, int(lengths.sum()))
    part = np.repeat(np.arange(len(texts)), lengths)
    first = np.cumsum(lengths) - lengths
    place = repeating(ids, part, least // 2)
    found = [np.zeros((0, 3), np.int64) for _ in texts]
    if not len(place):
        return found
    # All stretches in a row, with a symbol of its own between neighbours, which no run can hold.
    of = part[place]
    cut = np.flatnonzero((np.diff(place) > 1) | (np.diff(of) != 0)) + 1
    top = int(ids.max())
    s = np.insert(ids[place], cut, top + 1 + np.arange(len(cut)))
    origin = np.insert(place, cut, -1)
    got = runs(s.tolist(), least)
    at = origin[got[:, 0]]
    owner = part[at]
    got = np.column_stack([at - first[owner], got[:, 1], got[:, 2]])
    order = np.lexsort((got[:, 2], got[:, 0], owner))
    got, owner = got[order], owner[order]
    for text in np.unique(owner):
        found[text] = got[owner == text]
    return found


def collapsed(words: list[bytes], own: np.ndarray) -> bytes:
    """The words, with a space between, of which no run holds the word after its first period."""
    if not len(own):
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in own.tolist():
        kept[start + period : start + length] = False
    return b" ".join(compress(words, kept.tolist()))


RUNS = "array<struct<start: long, length: long, period: long>>"
ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, text: str | Column = "text", least: int = LEAST) -> Column:
    """A column (runs, collapsed) of the words ``[^\\x20\\x09-\\x0D]+`` of a text.

    ``runs`` has the number of the first word (from 0), the words and the smallest period of every run
    of at least ``least`` words and two periods, by start, then period. ``collapsed`` holds the words,
    with a space between, without those that repeat a run's first period. Null, empty and wordless
    texts have no run and an empty ``collapsed``. The column depends on the text alone, so repeated rows
    and ties get the same; memory grows with the longest text.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(f"struct<runs: {RUNS}, collapsed: string>")
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            every, texts = [], []
            for _, part in blocks(column, BLOCK):
                words = [(t or "").encode().split() for t in part.to_pylist()]
                number = _Numbers().__getitem__
                own = block_runs([list(map(number, w)) for w in words], least)
                for w, rows in zip(words, own, strict=True):
                    every.append([{"start": a, "length": b, "period": c} for a, b, c in rows.tolist()])
                    texts.append(collapsed(w, rows).decode())
            yield pa.StructArray.from_arrays([pa.array(every, ARROW), pa.array(texts, pa.string())], names=["runs", "collapsed"])

    return found(F.col(text) if isinstance(text, str) else text)
