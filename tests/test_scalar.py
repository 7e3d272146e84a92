"""Scalar expressions on literal edge values."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidefeed.functions import scalar as S


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


HASHES = {
    "": 0,
    "1": 49,
    "abc": 96354,
    "a:b": 97 * 961 + 58 * 31 + 98,
    "polygenelubricants": -2147483648,
    "é": 233,
    "\U0001F600": 0xD83D * 31 + 0xDE00,
    None: None,
}


def test_java_string_hash(spark):
    rows = [(k,) for k in HASHES]
    got = dict(values(spark, "s string", rows, "s", S.java_string_hash("s")))
    assert got == HASHES


@pytest.mark.parametrize(
    "buckets, key", [(1, "0-abc"), (6, "0-abc"), (10, "4-abc"), (100, "54-abc"), (1000, "354-abc")]
)
def test_salted_key(spark, buckets, key):
    assert values(spark, "s string", [("abc",)], S.salted_key("s", buckets)) == [(key,)]


def test_salt_of_the_smallest_hash(spark):
    rows = [("polygenelubricants",)]
    assert values(spark, "s string", rows, S.salt_bucket("s", 6)) == [(2147483648 % 6,)]


def test_row_key_orders_times_of_one_user(spark):
    times = [0, 1, 255, 256, 1706659200000, 2**62]
    rows = [("abc", t) for t in reversed(times)]
    frame = spark.createDataFrame(rows, "u string, t bigint")
    keyed = frame.withColumn("k", S.row_key("u", "t"))
    assert [r.t for r in keyed.orderBy("k").collect()] == times
    assert keyed.where("t = 256").first().k == b"0-abc:" + (256).to_bytes(8, "big")


def test_bytes_decode(spark):
    rows = [(b"\xff" * 8, b"\x80\x00\x00\x00", b"\x02", "é".encode()), (None, None, None, None)]
    got = values(
        spark, "l binary, i binary, b binary, s binary", rows,
        S.long_of("l"), S.int_of("i"), S.bool_of("b"), S.string_of("s"),
    )
    assert got == [(-1, -2147483648, True, "é"), (None, None, False, None)]


def test_times_on_both_sides_of_a_day(spark):
    rows = [(0,), (-1,), (86399999,), (86400000,), (1706659199999,)]
    got = values(spark, "t bigint", rows, S.day_of("t"), S.truncate_to_second("t"))
    assert got == [
        (dt.date(1970, 1, 1), 0),
        (dt.date(1969, 12, 31), -1000),
        (dt.date(1970, 1, 1), 86399000),
        (dt.date(1970, 1, 2), 86400000),
        (dt.date(2024, 1, 30), 1706659199000),
    ]


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.123456' AS ts")
        ms = S.epoch_ms(frame, "ts")
        row = frame.select(ms.alias("ms")).select("ms", S.day_of("ms").alias("d")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row == (1710037800123, dt.date(2024, 3, 10))


def test_durations(spark):
    rows = [(0,), (999,), (1000,), (61005,)]
    got = values(spark, "t bigint", rows, S.format_duration("t"))
    assert got == [("0.000",), ("0.999",), ("1.000",), ("61.005",)]


def test_hours_round_half_up(spark):
    rows = [(1026000, 0.29), (1025999, 0.28), (0, 0.0), (450000, 0.13)]
    frame = spark.createDataFrame(rows, "t bigint, hours double")
    assert frame.where(S.hours_between("t", F.lit(0)) != F.col("hours")).count() == 0
    text = frame.select(F.format_string("%.2f", S.hours_between("t", F.lit(0)))).collect()
    assert [r[0] for r in text] == ["0.29", "0.28", "0.00", "0.13"]


def test_json_objects(spark):
    texts = ['{"a":1}', ' \n{"a":1}', "{bad", "[1]", '"x"', "1", "null", "", None]
    got = values(spark, "s string", [(t,) for t in texts],
                 S.is_json_object("s"), S.lenient_json_object("s"), S.lenient_json_object("s", None))
    assert got[:2] == [(True, t, t) for t in texts[:2]]
    assert got[2:] == [(False, "{}", None)] * 7


def test_strict_json_fails(spark):
    frame = spark.createDataFrame([("[1]",)], "s string")
    with pytest.raises(Exception, match="not a JSON object"):
        frame.select(S.strict_json_object("s")).collect()


def test_json_integers(spark):
    texts = {
        '{"n":7}': 7, '{"n":"7"}': 7, '{"n":12.7}': 12, '{"n":"12.7"}': 12, '{"n":true}': 1,
        '{"n":"x"}': 0, '{"n":null}': 0, "{}": 0, "{bad": 0, '{"n":{"m":1}}': 0,
        '{"n":1706659200000}': 1706659200000, '{"n":-3.9}': -3,
    }
    got = dict(values(spark, "s string", [(t,) for t in texts], "s", S.json_integer("s", "$.n")))
    assert got == texts


def test_or_list(spark):
    rows = [("a", "a|b"), ("b", "a|b"), ("c", "a|b"), ("a|b", "a|b")]
    got = values(spark, "v string, l string", rows,
                 S.or_list_match("v", "a|b"), S.or_list_match("v", F.col("l")))
    assert got == [(True, True), (True, True), (False, False), (False, False)]


@pytest.mark.parametrize("text, good", [
    ("{}", True), (' {"a": [1, {"b": "}"}]}\n', True), ('{"a":1,"a":2}', True), ('{"a":"it\'s"}', True), ('{"a\\"\'":1}', True),
    ('{"a":1', False), ('{"a":1} x', False), ('{"a":1}]', False), ('{"a":1}}', False), ('{"a":1},{"b":2}', False),
    ('{"a":1}],[{}', False), ('{"a":1}} , {"b":{}', False), ('{"a":1},"b":2', False), ("{'a':1}", False), ("{bad", False),
    ("[1]", False), ("1", False), ("null", False), ("", False), (None, False)])
def test_json_objects(spark, text, good):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(S.is_json_object("t")).first()[0] is good


def test_long_json_is_kept(spark):
    long = spark.range(1).select(F.concat(F.lit('{"a":"'), F.expr("repeat('x', 104857600)"), F.lit('","b":7}')).alias("t"))
    got = long.select(S.is_json_object("t").alias("good"), F.length(S.lenient_json_object("t")).alias("n")).first()
    assert got.good and got.n == 104857600 + 14


def test_json_integers_of_repeated_names(spark):
    frame = spark.createDataFrame([('{"size":3,"size":"12.9","at":{"x":true}}',), ('{"size":3',), (None,)], "t string")
    assert [tuple(r) for r in frame.select(S.json_integer("t", "$.size"), S.json_integer("t", "$.at.x")).collect()] == [
        (12, 1), (0, 0), (0, 0)]


@pytest.mark.parametrize("text, size", [
    ('{"size": 7, "a":' + "[" * 1200 + "]" * 1200 + "}", 7),
    ('{"' + "n" * 60_000 + '": 1, "size": 7}', 7),
    ('{"x": ' + "9" * 1500 + ', "size": 7}', 7),
    ('{"a":' * 3000 + "1" + "}" * 3000, 0),
    ('{"x": -' + "9" * 1500 + '.5e+10, "size": 7, "t": [true, false, null, {"u": "\\u00e9"}]}', 7),
    ('{"size": 7, "s": "' + "é漢😀[{" * 20_000 + '", "d":' + '[{"k":' * 900 + "[]" + "}]" * 900 + "}", 7),
], ids=range(6))
def test_json_beyond_the_limits_of_the_reader(spark, text, size):
    """Whole objects keep their payload and are read; spoiled ones are still refused."""
    deep = max(text.rfind("]"), text.rfind("}", 0, -1))
    spoiled = [text[:-1], text + "}", text[:-1] + ",}", text + " {}", text[:deep] + text[deep + 1 :] if deep > 0 else "{", "[" + text + "]",
               text.replace('"', "'"), text.replace(":", " ", 1), text.replace("{", "{\x01", 1), '{"x": 0' + "9" * 1500 + "}",
               '{"x": ' + "9" * 1500 + " 1}", '{"a": "\\x' + "y" * 2000 + '"}', '{"x": ' + "9" * 1500 + "true}", '{": ' + "9" * 1500 + "}"]
    frame = spark.createDataFrame([(t,) for t in [text, *spoiled]], "t string")
    got = frame.select(S.is_json_object("t").alias("good"), S.lenient_json_object("t").alias("kept"), S.json_integer("t", "$.size").alias("n")).collect()
    assert (got[0].good, got[0].kept, got[0].n) == (True, text, size)
    assert [tuple(r) for r in got[1:]] == [(False, "{}", 0)] * len(spoiled)


def test_deep_json_is_walked_over_once(spark):
    """Not once for each level, which would take hours here."""
    deep = '{"a":' * 100_000 + "[]" + "}" * 100_000
    name = '{"' + "n" * 60_000 + '": ' + deep + "}"
    frame = spark.createDataFrame([(t,) for t in (deep, name, deep[:-1], deep + ",5", name + "}", name[:-1] + ',"_":1', name.replace(":", "", 1))], "t string")
    began = time.time()
    assert [r[0] for r in frame.select(S.is_json_object("t")).collect()] == [True, True, False, False, False, False, False]
    assert time.time() - began < 60
