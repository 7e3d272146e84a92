"""Quality rules by host, with DataFrame functions only.

Each document is tested by plain rules. The share of failing documents of a host is shrunk towards
the share of all hosts by a beta prior that is fitted to the hosts' own shares; a host that still
fails too often is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.llm.text import checked_broadcast, spaced_words
from tidefeed.session import written

LEAST_WORDS = 50
#: Most words in repeated 3-word windows, of 100.
MOST_REPEATED = 50
#: Most symbols for 100 words, of a host's rule (not of the base).
MOST_SYMBOLS = 50
#: A host is rejected if its shrunken share of failing documents exceeds this.
MOST_FAILING = 0.5
SPACE = r"[\x20\x09-\x0D]"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) to every row.

    Null and empty texts have zeros. Windows are compared by a 64-bit hash of their three words.
    Columns of these names are replaced; columns ``_words``, ``_lines``, ``_windows``, ``_sorted`` and
    ``_twice`` of ``docs`` are left out.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    own = docs.withColumn("_words", spaced_words(whole)).withColumn("_lines", lines)
    # Where a 3-word window begins, its hash; the last two words begin none.
    hashes = F.expr("transform(slice(_words, 1, greatest(size(_words) - 2, 0)), "
                    "(w, i) -> xxhash64(w, _words[i + 1], _words[i + 2]))")
    own = own.withColumn("_windows", hashes)
    # Sorted with their places, equal windows stand side by side.
    own = own.withColumn("_sorted", F.expr(
        "if(size(array_distinct(_windows)) < size(_windows), "
        "sort_array(transform(_windows, (h, i) -> struct(h, i))), null)"))
    twice = F.expr(
        "flatten(filter(zip_with(slice(_sorted, 1, size(_sorted) - 1), slice(_sorted, 2, size(_sorted) - 1), "
        "(a, b) -> if(a.h = b.h, array(a.i, b.i), null)), x -> x is not null))")
    own = own.withColumn("_twice", twice)
    covered = F.expr("size(array_distinct(concat(_twice, transform(_twice, x -> x + 1), transform(_twice, x -> x + 2))))")
    columns = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.regexp_replace(whole, f"{SPACE}+", "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.col("_sorted").isNull(), 0).otherwise(covered),
    }
    return own.withColumns({name: value.cast("long") for name, value in columns.items()}).drop(
        "_words", "_lines", "_windows", "_sorted", "_twice")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rule_failed() -> Column:
    """The base rules, or too many symbols."""
    return base_failed() | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate): rate = (failed + a) / (n + a + b), from (host, bad boolean).

    a and b are fitted by moments to the hosts' shares, each host weighing as its documents do: the
    mean share, and a strength from the variance beyond what chance alone gives. With one host, or
    with shares that differ no more than by chance, the prior is as strong as the average host.
    """
    hosts = written(
        rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("failed")), "hosts")
    share = F.col("failed") / F.col("n")
    all_of = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"),
        F.sum(F.col("n") * share * share).alias("squares"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not all_of["n"]:
        return hosts.withColumn("rate", F.lit(0.0))
    total, mean, count = all_of["n"], all_of["failed"] / all_of["n"], all_of["hosts"]
    chance = mean * (1 - mean)
    spread = all_of["squares"] - total * mean * mean - (count - 1) * chance
    freedom = total - all_of["nn"] / total
    between = spread / freedom if freedom > 0 else 0.0
    strength = chance / between - 1 if between > 0 else total / count
    strength = min(max(strength, 1.0), total / count)
    a = mean * strength
    return hosts.withColumn("rate", (F.col("failed") + a) / (F.col("n") + strength))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text",
          most_failing: float = MOST_FAILING) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, the measures, base_failed, host_rate and kept.

    ``kept``: neither fails the base rules nor belongs to a rejected host. A null host is a host of
    its own. Repeated rows count as often as they are there. Columns beside the three are not read.
    """
    rows = written(
        measured(docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text")), "_text")
        .drop("_text").withColumn("base_failed", base_failed()).withColumn("_bad", rule_failed()),
        "rules",
    )
    rates = host_rates(rows.select("host", F.col("_bad").alias("bad")))
    rates = checked_broadcast(written(rates.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")), "rates"))
    joined = rows.join(rates, F.col("host").eqNullSafe(F.col("_host")))
    kept = ~F.col("base_failed") & (F.col("host_rate") <= most_failing)
    return joined.withColumn("kept", kept).drop("_host", "_bad")
