"""Time-ordered ids."""

import pytest
from pyspark.sql import functions as F

from tidefeed.functions import ulid as U
from tidefeed.operators import ids

DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def encode(value, width):
    return "".join(DIGITS[value >> 5 * i & 31] for i in range(width - 1, -1, -1))


def text_of(ms, hi, lo):
    return encode(ms, 10) + encode(hi, 8) + encode(lo, 8)


EDGES = [
    (0, 0, 0),
    (1, 31, 32),
    (1706659200000, 2**39, 2**40 - 1),
    (2**48 - 1, 2**40 - 1, 2**40 - 1),
]


def test_encode_parse_and_bytes(spark):
    frame = spark.createDataFrame(EDGES, "ms bigint, hi bigint, lo bigint").withColumn(
        "id", U.ulid("ms", "hi", "lo")
    )
    back = frame.select(
        "ms", "hi", "lo", "id", *[p.alias(f"p{i}") for i, p in enumerate(U.parts("id"))],
        U.to_bytes("ms", "hi", "lo").alias("b"),
    ).withColumn("from_b", U.from_bytes("b"))
    for row in back.collect():
        assert row.id == text_of(row.ms, row.hi, row.lo) == row.from_b
        assert (row.p0, row.p1, row.p2) == (row.ms, row.hi, row.lo)
        whole = (row.ms << 80) | (row.hi << 40) | row.lo
        assert bytes(row.b) == whole.to_bytes(16, "big")


def test_time_must_fit(spark):
    frame = spark.createDataFrame([(2**48,), (-1,)], "ms bigint")
    assert [r[0] for r in frame.select(U.ulid("ms", F.lit(0), F.lit(0))).collect()] == [None] * 2


@pytest.mark.parametrize("text, reason", [
    ("7ZZZZZZZZZZZZZZZZZZZZZZZZZ", ""),
    ("8ZZZZZZZZZZZZZZZZZZZZZZZZZ", "time"),
    ("01ARZ3NDEKTSV4RRFFQ69G5FA", "length"),
    ("01ARZ3NDEKTSV4RRFFQ69G5FAVV", "length"),
    ("01ARZ3NDEKTSV4RRFFQ69G5FAU", "character"),
    ("01ARZ3NDEKTSV4RRFFQ69G5FA-", "character"),
    ("oiarz3ndektsv4rrffq69g5fav", ""),
    (None, "null"),
])
def test_audit_reasons(spark, text, reason):
    frame = spark.createDataFrame([(text,)], "ulid string")
    assert ids.audit_ulids(frame).first().problem == reason


def test_aliases_decode_alike(spark):
    frame = spark.createDataFrame(
        [("0111111111000000000000000A",), ("oIlLi11111OoOoOoOoOo00000a",)], "ulid string"
    )
    rows = ids.audit_ulids(frame).collect()
    assert rows[0]["ms"] == rows[1]["ms"] and rows[0]["bytes_hex"] == rows[1]["bytes_hex"]


def test_monotonic_ids_carry_and_wrap(spark):
    # One instant starts two below a carry into the high half, one three below the very end.
    rows = [(100, n) for n in range(4)] + [(200, n) for n in range(4, 10)] + [(300, 10)]
    frame = spark.createDataFrame(rows, "timestamp bigint, ingest_seq bigint")
    top = 2**40 - 1
    start = (
        F.when(F.col("timestamp") == 200, top).otherwise(F.lit(5)),
        F.when(F.col("timestamp") == 200, top - 2).otherwise(F.lit(top - 1)),
    )
    got = ids.assign_monotonic_ulids(frame, start=start).orderBy("ingest_seq").collect()
    halves = [(r.hi40, r.lo40) for r in got]
    assert halves[:4] == [(5, top - 1), (5, top), (6, 0), (6, 1)]
    assert halves[4:10] == [(top, top - 2), (top, top - 1), (top, top), (0, 0), (0, 1), (0, 2)]
    assert [r.strict_ulid is None for r in got] == [False] * 7 + [True] * 3 + [False]
    assert all(r.ulid == text_of(r.timestamp, r.hi40, r.lo40) for r in got)


def test_strict_ids_never_go_back(spark):
    times = [100, 100, 90, 100, 101, 50, 51]
    frame = spark.createDataFrame([(t, n) for n, t in enumerate(times)], "timestamp bigint, ingest_seq bigint")
    got = ids.assign_monotonic_ulids(frame).orderBy("ingest_seq").collect()
    assert [r.strict_ulid is None for r in got] == [False, False, True, False, False, True, False]
    assert all(r.ulid is not None for r in got)


def test_ids_are_the_same_on_every_run(spark):
    frame = spark.range(100).select(F.col("id").alias("ingest_seq"), F.lit(5).alias("timestamp"))
    first = {r.ulid for r in ids.assign_ulids(frame).collect()}
    assert first == {r.ulid for r in ids.assign_ulids(frame.repartition(7)).collect()}
    assert len(first) == 100


def test_order_violations_across_slices(spark):
    # One user, so every slice boundary falls inside it; every 50th id goes back in time.
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ms = F.when(F.col("id") % 50 == 0, F.col("id") - 20).otherwise(F.col("id")) + 1000
        frame = spark.range(1000).select(
            F.lit("u").alias("user_id"), F.col("id").alias("ingest_seq"),
            U.ulid(ms, F.lit(1), F.lit(1)).alias("ulid"),
        )
        bad = ids.ulid_order_violations(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(r.ingest_seq for r in bad) == list(range(50, 1000, 50))
