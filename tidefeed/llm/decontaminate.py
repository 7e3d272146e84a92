"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark (13 words; an item of fewer words is one window) become a set of
hashes that is sent with the plan. Every window of every document is looked up in it inside the
row, without a shuffle, and a hit counts only if its words are in the set of windows too. Of a
benchmark with more than ``SET_LIMIT`` windows the hashes are broadcast as a table, 8 bytes a window,
which the hashes of a document's windows meet inside the task that reads it; only what they find is
confirmed by its words. Beyond ``HASH_LIMIT`` windows the hashes are shuffled, never the words. The
result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.llm.text import BROADCAST_ROWS, boxed, lower_ascii
from tidefeed.session import written

WINDOW = 13
#: Most distinct windows that are sent as a set; a window is about 100 bytes.
SET_LIMIT = 50_000
#: Most distinct windows whose hashes are broadcast; each takes about 60 bytes of an executor.
HASH_LIMIT = 4_000_000
#: A document is contaminated if its hit words are at least 1 / SHARE of its words.
SHARE = 20
NOT_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
HITS = "array<struct<place: int, n: int, gram: string>>"


def plain_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits and of non-ASCII characters; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{NOT_WORD}]+")
    return F.array_remove(parts, F.lit(""))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Stored table of distinct (item, n, gram): gram is the n words with a space between them."""
    words = (
        benchmark.select(F.col(item).alias("item"), plain_words(F.col(text)).alias("_words"))
        .where(F.size("_words") > 0)
        .withColumn("n", F.least(F.size("_words"), F.lit(size)))
    )
    at = F.explode(F.sequence(F.lit(0), F.size("_words") - F.col("n"))).alias("_at")
    return written(
        words.select("item", "n", "_words", at)
        .select("item", "n", F.expr("array_join(slice(_words, _at + 1, n), ' ')").alias("gram"))
        .distinct(),
        "windows",
    )


def with_hits(docs: DataFrame, known: DataFrame, text: str = "text", set_limit: int = SET_LIMIT,
              hash_limit: int = HASH_LIMIT) -> DataFrame:
    """Add ``_words`` (array) and ``_hits`` (array of place, n, gram) to every row of ``boxed`` ones.

    A null or wordless text has no words and no hits. Repeated rows get the same hits each.
    """
    own = docs.withColumn("_words", plain_words(F.col(text)))
    grams = known.select("n", "gram").distinct()
    if grams.limit(set_limit + 1).count() > set_limit:
        return _by_hash(own, written(grams, "grams"), hash_limit)
    lists: dict[int, list[str]] = {}
    for row in grams.collect():
        lists.setdefault(row.n, []).append(row.gram)
    # The same hash functions as on the documents, so run by Spark.
    hashed = grams.select("n", F.xxhash64(F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))).alias("hash"))
    hashes: dict[int, list[int]] = {}
    for row in hashed.distinct().collect():
        hashes.setdefault(row.n, []).append(row.hash)
    own = own.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    parts = []
    for n in sorted(lists):
        codes = ", ".join(f"{code}L" if code != -(1 << 63) else "-9223372036854775807L - 1L" for code in hashes[n])
        # Words hold no ASCII but letters and digits: nothing to escape.
        texts = ", ".join(f"'{gram}'" for gram in sorted(lists[n]))
        places = f"if(size(_hashes) >= {n}, sequence(0, size(_hashes) - {n}), cast(array() as array<int>))"
        found = f"filter({places}, i -> xxhash64(slice(_hashes, i + 1, {n})) IN ({codes}))"
        named = (f"transform({found}, i -> named_struct('place', i, 'n', {n}, "
                 f"'gram', array_join(slice(_words, i + 1, {n}), ' ')))")
        parts.append(f"filter({named}, h -> h.gram IN ({texts}))")
    every = ", ".join([f"cast(array() as {HITS})", *parts])
    return own.withColumn("_hits", F.expr(f"concat({every})")).drop("_hashes")


def _code(words: Column, n: Column | int) -> Column:
    """A 64-bit hash of ``n`` words; windows of different lengths have codes of their own."""
    return F.xxhash64(F.lit(n) if isinstance(n, int) else n, F.transform(words, lambda w: F.xxhash64(w)))


def _by_hash(own: DataFrame, grams: DataFrame, hash_limit: int) -> DataFrame:
    """``with_hits`` for any number of windows, from the stored table of (n, gram).

    The hashes of all windows of a text meet the known hashes, then the few places found are
    confirmed by their words. Equal word lists share their places.
    """
    keyed = own.withColumn("_digest", F.unhex(F.md5(F.array_join("_words", " "))))
    codes = grams.select(_code(F.split("gram", " "), F.col("n")).alias("_code")).distinct()
    if grams.limit(hash_limit + 1).count() <= hash_limit:
        codes = F.broadcast(codes)
    else:
        codes = codes.hint("shuffle_hash")
    places = []
    for row in grams.select("n").distinct().collect():  # At most one row per length up to a window's.
        n = row.n
        at = F.explode(F.expr(
            f"transform(sequence(0, size(_hashes) - {n}), i -> struct(i as place, xxhash64({n}, slice(_hashes, i + 1, {n})) as _code))"))
        places.append(
            keyed.where(F.size("_words") >= n)
            .select("_digest", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
            .select("_digest", at.alias("_at")).select("_digest", "_at.place", F.lit(n).alias("n"), "_at._code")
        )
    found = places[0]
    for part in places[1:]:
        found = found.unionByName(part)
    found = written(found.join(codes, "_code", "left_semi").select("_digest", "place", "n").distinct(), "places")
    gram = F.expr("inline(transform(_found, f -> struct(f.place, f.n, array_join(slice(_words, f.place + 1, f.n), ' ') as gram)))")
    texts = keyed.select("_digest", "_words").join(_per_text(found, ["place", "n"], "_found"), "_digest").dropDuplicates(["_digest"])
    # Hashes may collide; words may not.
    hits = written(texts.select("_digest", gram).join(grams, ["n", "gram"], "left_semi"), "confirmed")
    return keyed.join(_per_text(hits, ["place", "n", "gram"], "_hits"), "_digest", "left").drop("_digest").withColumn(
        "_hits", F.coalesce("_hits", F.array().cast(HITS)))


def _per_text(places: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Stored places as one sorted array for each text, at most one for each word and length.

    Broadcast if there are few places in all, so that texts need no shuffle to meet theirs.
    """
    lists = places.groupBy("_digest").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return F.broadcast(lists) if places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lists


def hit_places() -> Column:
    """The places (from 0) of the words inside any hit, of a row made by ``with_hits``."""
    return F.expr("array_distinct(flatten(transform(_hits, h -> sequence(h.place, h.place + h.n - 1))))")


def contaminated(share: int = SHARE) -> Column:
    hit = F.size(hit_places())
    return (hit > 0) & (hit * share >= F.size("_words"))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text", set_limit: int = SET_LIMIT,
           hash_limit: int = HASH_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted as text), contaminated.

    Items are found once for each distinct set of hit windows. Columns beside those named are not
    read. An empty benchmark hits nothing.
    """
    known = windows(benchmark, item, item_text)
    scanned = written(
        with_hits(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), known, "_text", set_limit, hash_limit)
        .select(
            "doc_id", F.size("_words").cast("long").alias("n_words"),
            F.size(hit_places()).cast("long").alias("n_hit"),
            F.coalesce(contaminated(), F.lit(False)).alias("contaminated"),
            F.expr("array_sort(array_distinct(transform(_hits, h -> h.gram)))").alias("_grams"),
        ),
        "hits",
    )
    hit = scanned.where("n_hit > 0").withColumn("_set", F.md5(F.array_join("_grams", "\n")))
    items = (
        hit.select("_set", "_grams").dropDuplicates(["_set"])
        .select("_set", F.explode("_grams").alias("gram"))
        .join(known.select("gram", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")), "gram")
        .groupBy("_set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    columns = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    return hit.join(items, "_set").select(columns).unionByName(
        scanned.where("n_hit = 0").withColumn("items", F.array().cast("array<string>")).select(columns))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """``docs`` without its contaminated rows; all columns as they are."""
    marked = with_hits(boxed(docs, text), windows(benchmark), "_text", set_limit).withColumn("_bad", contaminated())
    # A filter is not pushed below a row number, so the hits are looked for once per row.
    numbered = marked.withColumn("_number", F.monotonically_increasing_id())
    return numbered.where(~F.col("_bad") & (F.col("_number") >= 0)).select("_row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """``docs`` with the hit words taken out of the text, and what stood between them.

    Pieces of a text alternate between words and what separates them; a separator goes with the hit
    word before it. Rows without a hit keep their text as it is.
    """
    marked = with_hits(boxed(docs, text), windows(benchmark), "_text", set_limit).withColumn("_gone", hit_places())
    edge = f"(?<=[{NOT_WORD}])(?=[^{NOT_WORD}])|(?<=[^{NOT_WORD}])(?=[{NOT_WORD}])"
    pieces = marked.withColumn("_pieces", F.when(F.size("_gone") > 0, F.split("_text", edge)))
    lead = F.when(F.element_at("_pieces", 1).rlike(f"^[{NOT_WORD}]"), 1).otherwise(0)
    # One set difference: asking for each piece whether it is gone would take a long text's words squared.
    kept = pieces.withColumn("_lead", F.when(F.size("_gone") > 0, lead)).withColumn("_kept", F.expr("""
        concat(slice(_pieces, 1, _lead), flatten(transform(array_except(sequence(0, size(_words) - 1), _gone),
          i -> slice(_pieces, _lead + 2 * i + 1, 2))))"""))
    out = F.when(F.size("_gone") > 0, F.array_join("_kept", "")).otherwise(F.col("_text"))
    return kept.select(*[out.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
