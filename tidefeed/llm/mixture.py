"""Mix sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document's key is -ln(u) / w: u is uniform, made of the document's id and text, and w its quality
weight; the smallest keys come first. Complete epochs of a source precede the fractional one, which
takes documents by key until the source's words are used up: a document that does not fit is passed
over, and further passes over the whole source fill what it left. The sums run over narrow cells of
the key, so a source with a third of all documents is ordered in many small pieces; what is taken
does not depend on the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.llm.text import checked_broadcast, spaced_words
from tidefeed.session import written

#: Weights of the sources in order of their names, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents in a cell of the key, about.
CELL = 2000
#: Times that the documents of a source are gone over.
PASSES = 5
#: The columns of a mix.
RESULT = ("doc_id", "size", "source_size", "target", "epochs", "taken")


def quality_weight(text: Column) -> Column:
    """0.25 to 1.25, the more of the text is letters, digits and spaces; 0.25 for an empty text."""
    length = F.length(text)
    odd = F.length(F.translate(text, "#*$%&|<>!{}[]\\^~", ""))
    return F.when(length > 0, 0.25 + odd / length).otherwise(F.lit(0.25))


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone; 52 bits of an MD5."""
    text = F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words to take of each source, from (source, source_size).

    ``share`` times all words are dealt by weight; a target stops at ``most`` times its source's
    size and what is over goes to the others by weight. If ``share`` exceeds ``most``, every source
    stops there. The level at which sources stop is a running sum over the sources in the order of
    size per weight, so no loop is needed. There is one row per source here.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_ratio = every.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(most)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    dealt = (
        sources.withColumn("_at", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(cycle, ((F.col("_at") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_ratio", cap / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_full", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_weight").over(every) - F.col("_used"))
        # What each unit of weight gets if all sources before this one stop at their caps.
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_left"))
        .withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.col("_level")))
        .withColumn("_final", F.first("_open", ignorenulls=True).over(
            by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.coalesce(F.least(cap, F.col("_weight") * F.col("_final")), cap)
    return dealt.select("source", "source_size", target.alias("target"))


def _place() -> Column:
    """A document's place in its source: equal keys by id, a null id last."""
    return F.struct(F.col("_rank"), F.col("doc_id").isNull().alias("_no_id"), F.col("doc_id"))


def _pass(sized: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` after one more pass over the documents of each source.

    A pass takes the documents that fit alone, by place, while their sum fits. So it takes all that
    fit up to some place, its end, and of those before the end none that is left fits later: the
    next pass starts there.
    """
    left = sized.join(checked_broadcast(state), F.col("source").eqNullSafe(F.col("_source"))).where(
        (F.col("size") <= F.col("_room")) & (F.col("_end").isNull() | (_place() > F.col("_end")))
    ).select("_source", "_room", "size", _place().alias("_place"), F.floor(F.col("_rank") * F.col("_cells")).alias("_cell"))
    cells = written(
        left.groupBy("_source", "_room", "_cell").agg(F.sum("size").alias("_words"), F.max("_place").alias("_last"))
        .withColumn("_upto", F.sum("_words").over(Window.partitionBy("_source").orderBy("_cell"))),
        "cells")
    # Only the cell in which the room ends is ordered.
    before = F.col("_upto") - F.col("_words")
    split = cells.where((F.col("_upto") > F.col("_room")) & (before <= F.col("_room"))).select(
        F.col("_source").alias("_s"), F.col("_cell").alias("_c"), before.alias("_before"))
    running = Window.partitionBy("_source").orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (
        left.join(checked_broadcast(split), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
        .withColumn("_sum", F.col("_before") + F.sum("size").over(running)).where(F.col("_sum") <= F.col("_room"))
    )
    taken = (
        cells.where(F.col("_upto") <= F.col("_room")).select("_source", "_words", "_last")
        .unionByName(ordered.select("_source", F.col("size").alias("_words"), F.col("_place").alias("_last")))
        .groupBy(F.col("_source").alias("_s")).agg(F.sum("_words").alias("_used"), F.max("_last").alias("_new"))
    )
    after = state.drop("_used").join(taken, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return written(after.select(
        *[c for c in state.columns if c not in ("_room", "_end", "_passes", "_used")],
        (F.col("_room") - F.coalesce("_used", F.lit(0))).alias("_room"), F.coalesce("_new", "_end").alias("_end"),
        F.concat("_passes", F.array(F.struct(F.col("_room").alias("room"), F.col("_new").alias("end")))).alias("_passes"),
        F.coalesce("_used", F.lit(0)).alias("_used"),
    ), "passes")


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, columns: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, epochs, taken and ``columns``.

    ``epochs`` is how often the mix has the document, ``taken`` = size * epochs. Documents without
    words are in no epoch's sum; they go with the complete epochs. A null source is a source, the
    last by name. Repeated rows are documents of their own with one key, so they are taken together
    or not at all; with equal keys the smaller id comes first. Other columns are not read. Of ``columns``
    those are left out whose names the result has already.
    """
    named = {f"_kept{i}": c for i, c in enumerate(columns) if c.lower() not in RESULT}
    sized = written(
        docs.select(
            *[F.col(c).alias(name) for name, c in named.items()],
            F.col(key).alias("doc_id"), F.col(source).alias("source"),
            F.size(spaced_words(F.col(text))).cast("long").alias("size"),
            unit(F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_u"),
            quality_weight(F.coalesce(F.col(text), F.lit(""))).alias("_w"),
        )
        # Rises with the key -ln(u) / w, and lies in (0, 1).
        .withColumn("_rank", 1 - F.exp(F.log("_u") / F.col("_w")))
        .drop("_u", "_w"),
        "mix",
    )
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    kind = sized.select(_place().alias("_place")).schema[0].dataType.simpleString()
    state = written(
        targets(total.select("source", "source_size"), weights, share, most)
        .withColumnRenamed("source", "_source")
        .join(total.select(F.col("source").alias("_name"), "_n"), F.col("_source").eqNullSafe(F.col("_name")))
        .withColumn("_whole", F.when(F.col("source_size") > 0,
                                     F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_cells", F.ceil(F.col("_n") / F.lit(CELL)))
        .select("_source", "source_size", "target", "_whole", "_cells", F.col("_rest").alias("_room"),
                F.lit(None).cast(kind).alias("_end"), F.array().cast(f"array<struct<room:double,end:{kind}>>").alias("_passes"),
                F.lit(0).cast("long").alias("_used")),
        "budgets",
    )
    for _ in range(PASSES):
        state = _pass(sized, state)
        if state.where("_used > 0").isEmpty():
            break
    more = F.coalesce(F.exists("_passes", lambda p: (F.col("size") <= p["room"]) & (_place() <= p["end"])), F.lit(False))
    return sized.join(checked_broadcast(state), F.col("source").eqNullSafe(F.col("_source"))).select(
        *[F.col(name).alias(c) for name, c in named.items()], "doc_id", "size", "source_size", "target",
        (F.col("_whole") + more.cast("int")).cast("long").alias("epochs"),
    ).withColumn("taken", F.col("size") * F.col("epochs"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with every row as often as the mix has it; all columns as they are.

    Rows with equal id, source and text are taken alike.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in (key, source, text)]
    named = docs.select(F.struct("*").alias("_row"), F.md5(F.concat_ws("\u0001", *parts)).alias("_name"),
                        F.col(key).alias("_key"), F.col(source).alias("_from"), F.col(text).alias("_text"))
    plan = mix(named, "_key", "_from", "_text", columns=("_name",), **options)
    times = written(plan.where("epochs > 0").groupBy("_name").agg(F.max("epochs").alias("_epochs")), "epochs")
    joined = named.select("_row", "_name").join(checked_broadcast(times), "_name")
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_epochs").cast("int"))).alias("_turn")).select("_row.*")
