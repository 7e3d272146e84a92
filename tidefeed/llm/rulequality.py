"""Quality classifier: a sparse ensemble of rules that runs as one Spark column.

Shallow boosted trees are grown on statistics of a bounded sample of labelled texts; every path from
a root is a rule, a conjunction of comparisons. A logistic regression with a lasso penalty keeps few
of the rules, and those are compiled into a column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.llm.text import boxed, spaced_words

#: Most labelled rows that are learned from, chosen by a hash of their ids.
SAMPLE = 12_000
TREES, DEPTH, BINS = 30, 3, 24
PENALTY = 0.002
ROUNDS = 200

STATISTICS = ("chars", "words", "word_length", "symbol_share", "mark_share", "upper_share", "digit_share",
              "letter_share", "distinct_share", "repeated_lines", "words_per_line", "longest_share")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_stat_*`` columns (double, never null); zeros for null and empty texts."""
    own = docs.withColumn("_whole", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", spaced_words(F.col("_whole")))
    own = own.withColumn("_lines", F.filter(F.split("_whole", "\n"), lambda line: F.length(F.trim(line)) > 0))
    chars, words, lines = F.length("_whole"), F.size("_words"), F.size("_lines")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace("_whole", pattern, ""))

    solid = F.length(F.array_join("_words", ""))
    longest = F.expr("array_max(transform(_lines, x -> length(x)))")
    values = {
        "chars": chars, "words": words, "word_length": share(solid, words),
        "symbol_share": share(chars - without(r"[#*$%&|<>{}\[\]\\^~_=+@]+"), chars),
        "mark_share": share(chars - without(r"[!?;:\"'()]+"), chars),
        "upper_share": share(chars - without(r"\p{Lu}+"), chars),
        "digit_share": share(chars - without(r"[0-9]+"), chars),
        "letter_share": share(chars - without(r"\p{L}+"), chars),
        "distinct_share": share(F.size(F.array_distinct("_words")), words),
        "repeated_lines": share(lines - F.size(F.array_distinct("_lines")), lines),
        "words_per_line": share(words, lines), "longest_share": share(longest, chars),
    }
    return own.withColumns({f"_stat_{name}": F.coalesce(values[name].cast("double"), F.lit(0.0)) for name in STATISTICS}).drop(
        "_whole", "_words", "_lines")


#: A comparison: statistic, whether it must be above, and the bound.
Test = tuple[str, bool, float]


@dataclass
class RuleEnsemble:
    """log odds = ``intercept`` + the weights of the rules whose tests all hold."""

    intercept: float
    rules: list[tuple[tuple[Test, ...], float]]

    def column(self) -> Column:
        """The probability of label 1 from the ``_stat_*`` columns."""
        odds = F.lit(float(self.intercept))
        for tests, weight in self.rules:
            holds = F.lit(True)
            for name, above, bound in tests:
                value = F.col(f"_stat_{name}")
                holds = holds & ((value > bound) if above else (value <= bound))
            odds = odds + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _grow(bins: np.ndarray, pull: np.ndarray, curve: np.ndarray, rows: np.ndarray, path: tuple, depth: int,
          found: list, out: np.ndarray) -> None:
    """One node: note its rule, set its rows' step, and split it where that gains most."""
    g, h = pull[rows].sum(), curve[rows].sum()
    out[rows] = g / (h + 1.0)
    if path:
        found.append(path)
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-3, -1, -1)
    for k in range(bins.shape[1]):
        left_g = np.cumsum(np.bincount(bins[rows, k], pull[rows], BINS))[:-1]
        left_h = np.cumsum(np.bincount(bins[rows, k], curve[rows], BINS))[:-1]
        gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), k, at)
    _, k, at = best
    if k < 0:
        return
    low = bins[rows, k] <= at
    for above, part in ((False, rows[low]), (True, rows[~low])):
        if len(part):
            _grow(bins, pull, curve, part, (*path, (k, above, at)), depth - 1, found, out)


def learn(values: np.ndarray, labels: np.ndarray, seed: int = 5, rounds: int = ROUNDS) -> RuleEnsemble:
    """Fit an ensemble to rows of ``STATISTICS`` and their labels (0 or 1); the weights in ``rounds`` steps."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(labels) < 2 or labels.min() == labels.max():
        return RuleEnsemble(prior if len(labels) else 0.0, [])
    cuts = [np.unique(np.quantile(values[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(values.shape[1])]
    bins = np.column_stack([np.searchsorted(cut, values[:, k], side="left") for k, cut in enumerate(cuts)])
    pick = np.random.default_rng(seed)
    odds, paths = np.full(len(labels), prior), []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-odds))
        chosen = np.sort(pick.choice(len(labels), max(2, len(labels) // 2), replace=False))
        step = np.zeros(len(labels))
        own: list = []
        _grow(bins, labels - chance, chance * (1 - chance), chosen, (), DEPTH, own, step)
        paths += own
        odds += 0.3 * step
    columns, kept, seen = [], [], set()
    for path in dict.fromkeys(paths):
        holds = np.ones(len(labels), bool)
        for k, above, at in path:
            holds &= (bins[:, k] > at) == above
        mark = holds.tobytes()
        if mark not in seen and 0 < holds.sum() < len(labels):
            seen.add(mark)
            columns.append(holds)
            kept.append(tuple((STATISTICS[k], above, float(cuts[k][at])) for k, above, at in path if at < len(cuts[k])))
    if not columns:
        return RuleEnsemble(prior, [])
    x = np.column_stack(columns).astype(np.float32)
    size = np.sqrt(x.mean(0) * (1 - x.mean(0)))
    x = (x - x.mean(0)) / size
    # Accelerated proximal steps; 0.25 bounds the curve of the logistic loss.
    vector = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        vector = x.T @ (x @ vector)
        vector /= np.linalg.norm(vector)
    rate = 1 / (0.25 * float(np.linalg.norm(x @ vector)) ** 2 / len(labels) + 0.25)
    weight, ahead, base, base_ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), prior, prior, 1.0
    for _ in range(rounds):
        off = (1 / (1 + np.exp(-(x @ ahead.astype(np.float32) + base_ahead))) - labels) / len(labels)
        new = ahead - rate * (x.T @ off.astype(np.float32))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        new_base = base_ahead - rate * off.sum()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / later * (new - weight)
        base_ahead = new_base + (t - 1) / later * (new_base - base)
        weight, base, t = new, new_base, later
    scaled = weight / size
    means = np.column_stack(columns).mean(0)
    rules = [(kept[i], float(scaled[i])) for i in np.flatnonzero(np.abs(weight) > 1e-6)]
    return RuleEnsemble(float(base - (scaled * means).sum()), rules)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> RuleEnsemble:
    """Learn from at most ``sample`` labelled documents, those with the least hashes of their ids.

    Rows with a null key or label are left out; of several labels of a document the largest counts.
    """
    chosen = (
        labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).dropna()
        .groupBy("_key").agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    )
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # At most ``sample`` pairs of numbers.
    joined = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
    columns = [f"_stat_{name}" for name in STATISTICS]
    found = statistics(joined, "_text").select("_key", "_label", *columns).toArrow()
    found = found.sort_by([(name, "ascending") for name in ["_key", *columns]])
    values = np.column_stack([found.column(name).to_numpy() for name in columns]) if len(found) else np.zeros((0, len(columns)))
    return learn(values, found.column("_label").to_numpy().astype(float))


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``; null and empty texts too.

    A column of that name is replaced; no other column matters.
    """
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c != name]
    return statistics(boxed(docs, text), "_text").select(*kept, model.column().alias(name))
