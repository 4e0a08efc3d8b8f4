"""Column functions. All but :func:`json_numbers` are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import jsontokens

# These decide results and must not drift.
MICROS_THRESHOLD = 100_000_000_000_000  # epoch numbers below this magnitude are milliseconds
TS_MS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
NULL_TEXT = "NULL"
# A line of the public text exposition format: a name, label pairs in braces whose quoted values may
# hold anything, a number, and perhaps a time.
LABEL_PAIR = r'([a-zA-Z_]\w*)\s*=\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_PAIRS = LABEL_PAIR.replace("([a-zA-Z_]", "(?:[a-zA-Z_]").replace('"([^', '"(?:[^')
_READING = r"[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|(?i:inf(?:inity)?|nan))"
METRIC_LINE = (
    r"^([a-zA-Z_:][\w:]*)"
    rf"(?:\s*\{{\s*((?:{_PAIRS}\s*,?\s*)*)\}}\s*|\s+)"
    rf"({_READING})(?:\s+[-+]?\d+)?$"
)
# "T" or a blank between date and time, 0 to 6 fraction digits; or an instant that ends in "Z"
TIMESTAMP_TEXT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{0,6})?|T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z)$"
)
SHORT_WHOLE_TEXT = r"^[-+]?[0-9]{1,18}$"  # always fits a long
WHOLE_TEXT = r"^[-+]?[0-9]{1,19}$"
NUMBER_TEXT = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def floor_div(value: Column, by: int | Column) -> Column:
    """Whole-number division rounding down, negatives too; never through a double."""
    n = (by if isinstance(by, Column) else F.lit(by)).cast("bigint")
    return F.call_function("div", value - F.pmod(value, n), n)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def micros_to_timestamp(micros: Column) -> Column:
    """Zone-less timestamp from epoch microseconds; negatives count back from the epoch."""
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def number_to_timestamp(value: Column, unit: str | None = None) -> Column:
    """Epoch number to zone-less timestamp: milliseconds below the threshold, else microseconds."""
    if unit not in (None, "ms", "us"):
        raise ValueError(f"unit must be ms or us, not {unit!r}")
    if unit == "us":
        micros = value
    elif unit == "ms":
        micros = value * 1000
    else:
        micros = F.when(F.abs(value) < MICROS_THRESHOLD, value * 1000).otherwise(value)
    return micros_to_timestamp(micros)


def text_to_long(text: Column) -> Column:
    """Any numeric text to a whole number, fractions cut towards zero; null if not a number.

    Patterns decide which cast applies: a failing ``try_cast`` costs ten times a match.
    """
    return F.when(text.rlike(SHORT_WHOLE_TEXT), text.try_cast("bigint")).when(
        text.rlike(NUMBER_TEXT), text.try_cast("decimal(38,9)").try_cast("bigint")
    )


def text_to_timestamp(text: Column, unit: str | None = None) -> Column:
    """Epoch number or date text to a zone-less timestamp; null for anything else."""
    return F.when(text.rlike(TIMESTAMP_TEXT), text.try_cast("timestamp_ntz")).when(
        text.rlike(WHOLE_TEXT), number_to_timestamp(text.try_cast("bigint"), unit)
    )


def coerce_timestamp(value: Column, dtype: T.DataType, unit: str | None = None) -> Column:
    """Bring a column of any accepted type to a zone-less timestamp; null where it cannot be."""
    if isinstance(dtype, T.TimestampNTZType):
        return value
    if isinstance(dtype, T.TimestampType):
        return micros_to_timestamp(F.unix_micros(value))
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return number_to_timestamp(value.cast("bigint"), unit)
    if isinstance(dtype, T.StringType):
        return text_to_timestamp(value, unit)
    raise TypeError(f"cannot read a timestamp from {dtype.simpleString()}")


def coerce_whole(value: Column, dtype: T.DataType, target: str) -> Column:
    """Any number to ``bigint`` or ``int``; null where it is not a number or does not fit."""
    if isinstance(dtype, T.StringType):
        value = text_to_long(value)
    elif isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = value.try_cast("bigint")
    elif not isinstance(dtype, T.IntegralType):
        raise TypeError(f"cannot read a number from {dtype.simpleString()}")
    return value.try_cast(target)


def to_float(value: Column) -> Column:
    """Number or numeric text to double; anything else, booleans too, to null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def padded_key(prefix: str, number: Column, width: int = 12) -> Column:
    """``prefix`` and the number, zero-padded but never cut."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def ms_text(ts: Column) -> Column:
    """Timestamp text cut (not rounded) to milliseconds."""
    return F.date_format(ts, TS_MS_FORMAT)


def ms_text_from_text(text: Column) -> Column:
    """Timestamp text with its fraction cut or padded to three digits."""
    head, fraction = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    padded = F.concat(head, F.lit("."), F.rpad(fraction, 3, "0"))
    return F.when(F.contains(text, F.lit(".")), padded).otherwise(F.concat(text, F.lit(".000")))


def cell_text(column: Column, dtype: T.DataType) -> Column:
    """One output cell: NULL for null, milliseconds for timestamps, plain text otherwise."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        shown = ms_text(column)
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit(NULL_TEXT))


def tsv_line(df: DataFrame) -> Column:
    """All columns of ``df`` as one tab-joined line."""
    return F.concat_ws("\t", *[cell_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])


def metric_key(name: Column) -> Column:
    """Lower-case letters and digits of a metric name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def pressure_indicator(explicit: Column, flag: Column, busy: Column) -> Column:
    """Share of time under pressure in [0, 1]; the first signal that says something wins."""
    share = clamp(explicit / 1000.0)
    return (
        F.when(explicit.isNotNull() & (share > 0), share)
        .when(flag > 0, clamp(flag))
        .when(busy.isNotNull(), clamp(busy / 1000.0))
        .when(explicit.isNotNull() | flag.isNotNull(), F.lit(0.0))
    )


def alignment_ms(value: Column, name: Column) -> Column:
    """Alignment time in milliseconds; one metric family reports nanoseconds."""
    return F.when(F.endswith(metric_key(name), F.lit("checkpointalignmenttime")), value / 1e6).otherwise(value)


def labels_map(raw: Column) -> Column:
    """``k="v",…`` to a map, escapes resolved; what is no label pair is dropped.

    A repeated label keeps its last value.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all(raw, F.lit(LABEL_PAIR), F.lit(1)).alias("key"),
        F.regexp_extract_all(raw, F.lit(LABEL_PAIR), F.lit(2)).alias("value"),
    )

    def plain(value: Column) -> Column:
        for text, stands_for in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\x00", "\\")):
            value = F.replace(value, F.lit(text), F.lit(stands_for))
        return value

    later = F.filter(
        pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    )
    return F.map_from_entries(F.transform(later, lambda p: F.struct(p["key"], plain(p["value"]))))


def json_depth(text: Column) -> Column:
    """How deep brackets nest in JSON text, strings left out."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, bracket: Column) -> Column:
        move = F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        now = state["now"] + move
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.coalesce(F.aggregate(steps, start, step, lambda state: state["most"]), F.lit(0))


#: Tokens of JSON text.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]|[^\s\[\]{},:"]++'
_LEAF = "struct<path:string,last:string,number:double>"


def json_numbers(text: Column) -> Column:
    """Every number of JSON text, numbers in strings included, as ``(path, last, number)`` in order.

    Spark decides what is JSON; its tokens are read once, on one row alone, to any depth (:mod:`jsontokens`, a
    batch of rows at a time). Text that is no JSON, or null, has no numbers.
    """

    @F.arrow_udf(f"array<{_LEAF}>")
    def numbers(texts: pa.Array) -> pa.Array:
        return jsontokens.number_lists(texts)

    return numbers(F.when(F.try_parse_json(text).isNotNull(), text))


def _plain_number(token: Column) -> Column:
    """One text for one number: no exponent, no zeros at the end, where 20 digits before and 18 after the
    point hold it exactly; else as it came.
    """
    exact = token.try_cast("decimal(38,18)")
    same = exact.cast("double") == token.try_cast("double")
    text = F.when(exact == 0, F.lit("0")).otherwise(F.regexp_replace(exact.cast("string"), r"\.?0+$", ""))
    return F.when(F.coalesce(same, F.lit(False)), text).otherwise(token)


def canonical_json(text: Column) -> Column:
    """JSON with keys sorted at every level, no blanks, and equal numbers and strings written alike.

    Lists keep their order. Null for text that is no JSON or names a key twice.
    """
    parsed = F.to_json(F.try_parse_json(text))
    tokens = F.regexp_extract_all(parsed, F.lit(JSON_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), _plain_number(t)).otherwise(t)), "")


def state_path(path: Column) -> Column:
    """``file:/x`` to ``file:///x``; other paths as they are."""
    return F.regexp_replace(path, r"^file:/(?!//)", "file:///")


def checkpoint_number(path: Column) -> Column:
    """The N of a trailing ``chk-N`` path part, else null."""
    return F.regexp_extract(F.trim(path), r"(?:^|/)chk-([0-9]+)$", 1).try_cast("bigint")


def last_json_object(text: Column) -> Column:
    """The last line of ``text`` that is a JSON object, else the span from the last ``{`` on."""
    lines = F.filter(
        F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(line)),
        lambda line: F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}")),
    )
    span = F.nullif(F.regexp_extract(text, r"(?s)(\{[^{]*\})[^}]*$", 1), F.lit(""))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), span)


def summary_int(summary: Column, key: str) -> Column:
    """Whole number from a string map; absent or null counts as 0."""
    return F.coalesce(F.try_element_at(summary, F.lit(key)).try_cast("bigint"), F.lit(0).cast("bigint"))
