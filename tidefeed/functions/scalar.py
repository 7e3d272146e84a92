"""Scalar expressions. Everything here is built from Spark's own functions, so it stays in
the JVM and inside the generated code wherever Spark generates code for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from tidefeed.schema import MS_PER_DAY, MS_PER_HOUR, MS_PER_SECOND, SALT_BUCKETS

ColumnOrName = Column | str


def as_column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_div(value: ColumnOrName, by: Column | int) -> Column:
    """The quotient of two whole numbers, cut towards zero."""
    divisor = F.lit(by).cast("bigint") if isinstance(by, int) else by
    return F.call_function("div", as_column(value), divisor)


# ---- time ---------------------------------------------------------------------------

def epoch_ms(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds of a timestamp column, rounded down.

    A zone-less timestamp is read as UTC whatever the session time zone is.
    """
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(
            f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00') div INTERVAL '0.001' SECOND"
        )
    return F.unix_millis(F.col(name))


def event_time(ms: ColumnOrName) -> Column:
    """The timestamp of an epoch-millisecond column."""
    return F.timestamp_millis(as_column(ms))


def floor_to(ms: ColumnOrName, width: int) -> Column:
    """``ms`` rounded down to a multiple of ``width``; right for negative values too."""
    return as_column(ms) - F.pmod(as_column(ms), F.lit(width).cast("bigint"))


def slice_number(ms: ColumnOrName, width: int) -> Column:
    """Number of the ``width``-wide slice of the time line that ``ms`` falls in."""
    return whole_div(floor_to(ms, width), width)


def day_of(ms: ColumnOrName) -> Column:
    """The UTC day of an epoch-millisecond column, independent of the session time zone."""
    return F.date_from_unix_date(slice_number(ms, MS_PER_DAY).cast("int"))


def truncate_to_second(ms: ColumnOrName) -> Column:
    return floor_to(ms, MS_PER_SECOND)


def format_duration(ms: ColumnOrName) -> Column:
    """Milliseconds as ``seconds.mmm``."""
    ms = as_column(ms).cast("bigint")
    return F.format_string("%d.%03d", whole_div(ms, MS_PER_SECOND), ms % MS_PER_SECOND)


def hours_between(later_ms: ColumnOrName, earlier_ms: ColumnOrName) -> Column:
    """Distance in hours, rounded half up to two decimals."""
    return F.round((as_column(later_ms) - as_column(earlier_ms)) / F.lit(float(MS_PER_HOUR)), 2)


# ---- hashed, salted and binary keys ---------------------------------------------------

def java_string_hash(text: ColumnOrName) -> Column:
    """The JVM's ``String.hashCode``: s[0]*31^(n-1) + ... + s[n-1] over UTF-16 units, as int.

    The sum runs modulo 2^32 in a bigint, so ANSI overflow checks never fire. A character
    outside the basic plane counts as its two surrogates.
    """
    wrap = 1 << 32

    def add(acc: Column, unit: Column) -> Column:
        return (acc * 31 + unit) % wrap

    def step(acc: Column, point: Column) -> Column:
        over = point - 0x10000
        pair = add(
            add(acc, F.shiftright(over, 10) + 0xD800), over.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        )
        return F.when(point < 0x10000, add(acc, point)).otherwise(pair)

    points = F.transform(F.split(as_column(text), ""), lambda c: F.ascii(c).cast("bigint"))
    total = F.aggregate(points, F.lit(0).cast("bigint"), step)
    return F.when(total >= wrap // 2, total - wrap).otherwise(total).cast("int")


def salt_bucket(key: ColumnOrName, buckets: int = SALT_BUCKETS) -> Column:
    return F.abs(java_string_hash(key) % buckets)


def salted_key(key: ColumnOrName, buckets: int = SALT_BUCKETS) -> Column:
    """``<salt>-<key>`` with the salt padded to the width of the largest one."""
    width = len(str(max(buckets - 1, 0)))
    return F.concat(
        F.lpad(salt_bucket(key, buckets).cast("string"), width, "0"), F.lit("-"), as_column(key)
    )


def big_endian(value: ColumnOrName) -> Column:
    """A bigint as its 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(as_column(value)), 16, "0"))


def row_key(
    user: ColumnOrName, ms: ColumnOrName, buckets: int = SALT_BUCKETS
) -> Column:
    """``<salt>-<user>:`` followed by the 8 big-endian bytes of the time.

    Binary columns compare byte by byte, unsigned, so rows of one user sort by time.
    """
    prefix = F.concat(salted_key(user, buckets), F.lit(":")).cast("binary")
    return F.concat(prefix, big_endian(ms))


def string_of(value: ColumnOrName) -> Column:
    return F.decode(as_column(value), "UTF-8")


def long_of(value: ColumnOrName) -> Column:
    """Signed big-endian bigint; null in, null out."""
    return F.conv(F.hex(as_column(value)), 16, -10).cast("bigint")


def int_of(value: ColumnOrName) -> Column:
    """Signed big-endian 4-byte int; null in, null out."""
    unsigned = F.conv(F.hex(as_column(value)), 16, 10).cast("bigint")
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned).cast("int")


def bool_of(value: ColumnOrName) -> Column:
    """Any byte but zero is true; null is false."""
    return F.coalesce(as_column(value) != F.lit(b"\x00"), F.lit(False))


# ---- JSON -----------------------------------------------------------------------------

#: Spark's JSON reader refuses nesting beyond 1,000, numbers beyond 1,000 digits and names beyond
#: 50,000 characters; a text of this length or less can hold none of them.
SURELY_READ = 1_000
LONGEST_NAME = 50_000
#: Options of the JSON reader that lift its limits, but for the one on names.
ANY_SIZE = {option: str((1 << 31) - 1) for option in ("maxNestingDepth", "maxNumLen", "maxStringLen")}
#: And those that hold it to the JSON grammar.
STRICT = {option: "false" for option in ("allowSingleQuotes", "allowNonNumericNumbers")}
_OBJECT = StructType([])


def _is_json_object_of_any_size(text: Column) -> Column:
    """Whether the text is a JSON object, by a reader without limits that walks over it once and keeps nothing.

    Strings too long for a name are read as empty ones. Every string is looked at in its turn, so that
    none is taken to begin where another ends; what is not a string token stays, and is refused.
    """
    unit = r'(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))'
    short = F.when(F.length(text) > LONGEST_NAME, F.regexp_replace(
        text, rf'"{unit}{{{LONGEST_NAME},}}+"|"({unit}*+)"', '"$1"')).otherwise(text)
    listed = F.from_json(F.concat(F.lit("["), short, F.lit("]")), ArrayType(_OBJECT), ANY_SIZE | STRICT)
    named = F.from_json(F.concat(F.lit('{"_":'), short, F.lit("}")), MapType(StringType(), _OBJECT), ANY_SIZE | STRICT)
    return F.coalesce((F.size(listed) == 1) & (F.size(named) == 1), F.lit(False))


def is_json_object(text: ColumnOrName) -> Column:
    """True for text that is one well-formed JSON object and nothing else; never null.

    Repeated names are allowed, the last of them counts. The text is read as the only member of an
    array and of an object, so that no bracket in it can close more than it opened; names and strings
    need double quotes. What the reader may have refused for its size is read without limits: no text is
    too long, too deeply nested, and no name or number in it too long.
    """
    text = as_column(text)
    opens = F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    listed = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    named = F.size(F.json_object_keys(F.concat(F.lit('{"_":'), text, F.lit("}")))) == 1
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    quoted = F.when(F.contains(text, F.lit("'")), F.contains(bare, F.lit("'"))).otherwise(False)
    read = F.coalesce(listed & named & ~quoted, F.lit(False))
    large = F.when(F.length(text) > SURELY_READ, _is_json_object_of_any_size(text)).otherwise(False)
    return F.when(F.coalesce(opens, F.lit(False)), F.when(read, True).otherwise(large)).otherwise(False)


def lenient_json_object(text: ColumnOrName, default: str | None = "{}") -> Column:
    """The text where it is a JSON object, else ``default``: the row is kept either way."""
    return F.when(is_json_object(text), as_column(text)).otherwise(F.lit(default).cast("string"))


def strict_json_object(text: ColumnOrName) -> Column:
    """The text where it is a JSON object; anything else fails the query."""
    text = as_column(text)
    problem = F.concat(F.lit("not a JSON object: "), F.coalesce(text, F.lit("null")))
    return F.when(is_json_object(text), text).otherwise(F.raise_error(problem).cast("string"))


def json_integer(text: ColumnOrName, path: str) -> Column:
    """The number at ``path`` ($.name, or $.name.name), fractions cut off.

    0 where it is missing or not a number, and where the text is not a JSON object. Numeric
    strings and booleans count as numbers; of a repeated name the last counts.
    """
    names = path.removeprefix("$.").split(".")
    schema: StructType | StringType = StringType()
    for name in reversed(names):
        schema = StructType([StructField(name, schema)])
    text = as_column(text)
    # The reader takes no longer names, and none of those is in the path.
    named = F.when(F.length(text) > LONGEST_NAME, F.regexp_replace(
        text, rf'"(?:[^"\\]|\\.){{{LONGEST_NAME},}}+"([ \t\r\n]*+:)', '""$1')).otherwise(text)
    value = F.from_json(F.when(is_json_object(text), named), schema, ANY_SIZE)
    for name in names:
        value = value[name]
    flag = F.when(value == "true", 1).when(value == "false", 0).cast("bigint")
    through_double = value.try_cast("double").try_cast("bigint")
    return F.coalesce(flag, value.try_cast("bigint"), through_double, F.lit(0).cast("bigint"))


def normalize_record(df: DataFrame, schema: StructType, *keep: str) -> DataFrame:
    """Every row through JSON into ``schema``: unknown and null fields go.

    Columns in ``keep`` pass beside the record.
    """
    record = F.from_json(F.to_json(F.struct("*")), schema)
    return df.select(*keep, record.alias("record")).select(*keep, "record.*")


# ---- lists ----------------------------------------------------------------------------

def or_list_match(value: ColumnOrName, choices: ColumnOrName) -> Column:
    """True where ``value`` is one of the ``a|b|c`` choices.

    Choices given as a string become an IN list, which reaches the Parquet scan.
    """
    if isinstance(choices, str):
        return as_column(value).isin(choices.split("|"))
    return F.array_contains(F.split(choices, r"\|"), as_column(value))
