"""The registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.llm import (
    decontaminate, hostrules, langid, mixture, nearcopies, personal, phrases, ppm, rulequality, runs, secretscan,
    tokenstore, vectors,
)
from tidefeed.llm.text import remainder, table
from tidefeed.session import new_folder


def _spans(spark: SparkSession, folder: str, scan, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", scan.find(docs).alias("_spans"))
    line = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    plain = "filter(_spans, s -> s.kind IN ({}))".format(", ".join(f"'{kind}'" for kind in base))
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(_spans, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(F.expr(line.format(plain)), 256).alias("base_sha256"),
        F.expr(line.format("_spans")).alias("spans"),
    )


def op1_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, folder, "documents"), size=2)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder, secretscan, secretscan.KINDS[:3])


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    counts = ppm.count(docs, ~F.col("held_out"))
    return ppm.score(docs, counts, columns=("doc_id", "held_out"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs, store = table(spark, folder, "documents"), new_folder(spark, "tokens")
    tokenstore.write_shards(docs, store, tokenstore.default_tokenizer())
    return tokenstore.read_back(spark, store).select(
        "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.language(docs, model).alias("_got")).select(
        "doc_id", "held_out", F.col("_got.lang").alias("lang_pred"), F.col("_got.score").alias("score"))


def op8_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return hostrules.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_rule_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = rulequality.fit(docs, table(spark, folder, "labels").where(~held_out))
    return rulequality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder, personal, personal.KINDS[:4])


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


#: A document whose hash ends in 0 repeats its words from the place ``a`` on with the period ``p``.
PLANTED = """element_at(transform(array(_words), w -> CASE WHEN size(w) = 0 THEN '' ELSE
  element_at(transform(array(named_struct('a', cast(_g % size(w) as int),
    'p', cast(1 + floor((size(w) - _g % size(w)) / (3 + _g % 8)) as int))),
    s -> array_join(transform(sequence(0, size(w) - 1), i -> element_at(w, 1 + if(i < s.a, i, s.a + (i - s.a) % s.p))), ' ')), 1)
  END), 1)"""


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hashed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    numbered = docs.select("doc_id", "text", hashed.alias("_h"), F.floor(hashed / 10).alias("_g"))
    planted = F.expr(PLANTED.replace("_words", r"array_remove(split(coalesce(text, ''), r'[\x20\x09-\x0D]+'), '')"))
    # A Python function takes no argument with a lambda in it; a row of its own keeps the text apart.
    texts = numbered.select("doc_id", F.explode(F.array(F.when(F.col("_h") % 10 == 0, planted).otherwise(F.col("text")))).alias("text"))
    found = texts.select("doc_id", runs.find(texts).alias("_got")).select("doc_id", "_got.runs", "_got.collapsed")
    best = F.expr("element_at(array_sort(transform(runs, r -> struct(-r.length as n, r.start, r.period, r.length))), 1)")
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    found = found.withColumn("_best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_near_copies": op1_near_copies,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_model": op3_language_model,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_store": op5_token_store,
    "op6_mix_sources": op6_mix_sources,
    "op7_language_id": op7_language_id,
    "op8_host_rules": op8_host_rules,
    "op9_rule_quality": op9_rule_quality,
    "op10_personal_data": op10_personal_data,
    "op11_phrases": op11_phrases,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_search": op13_vector_search,
}
