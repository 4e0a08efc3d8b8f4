"""Envelopes to change rows: validation, coercion, one-to-many decode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import scalars as S
from changeflow.schemas import CHANGELOG_COLUMNS, CURRENT_COLUMNS, ORDER_FIELDS, POSITION_COLUMNS

# Envelope operations and the row kinds and names they become.
HANDLED_OPS = ("c", "r", "u", "d")
UPDATE_BEFORE, DELETE = "-U", "-D"  # beside "+I" and "+U"

_FILE_NO = "IF(source.file IS NULL, 0L, try_cast(substring_index(source.file, '.', -1) AS bigint))"
_ROW = "coalesce(CAST(source.row AS int), 0)"


def log_position() -> list[Column]:
    """``_file, _seq, _row`` of a change from ``source``: file number, offset, row of the event.

    The three order changes as they are, so each may take any value its type holds. Log files are named
    ``<base>.<number>``. Without a file name there is one log, file 0, and the offset may
    be negative (snapshot rows come before the log).
    """
    return [F.expr(_FILE_NO).alias("_file"), F.expr("source.pos").alias("_seq"), F.expr(_ROW).alias("_row")]


def has_position() -> Column:
    """Whether ``source`` names a place in its log."""
    return F.expr(f"source.pos IS NOT NULL AND (source.file IS NULL OR ({_FILE_NO} >= 0 AND source.pos >= 0 AND {_ROW} >= 0))")


def position_order(changes: DataFrame, image: bool = True) -> Column:
    """What the changes of a key are ordered by, from the position columns that ``changes`` has."""
    names = [c for c in (*POSITION_COLUMNS, *(["_img"] if image else [])) if c in changes.columns]
    return F.struct(*names)


def _image_types(df: DataFrame, name: str) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema[name].dataType.fields}


def _coerced(image: Column, field: str, target: str, dtype: T.DataType) -> Column:
    """One image field in its table type; null if it cannot be read."""
    if target == "timestamp_ntz":
        return S.coerce_timestamp(image[field], dtype)
    if target in ("bigint", "int"):
        return S.coerce_whole(image[field], dtype, target)
    return image[field]


def _unreadable(df: DataFrame, name: str) -> list[tuple[str, Column]]:
    """For each required field of an image, the condition that it is absent or unreadable."""
    types, image = _image_types(df, name), F.col(name)
    return [
        (field, _coerced(image, field, target, types[field]).isNull())
        for field, target in ORDER_FIELDS
    ]


def _corrupt(df: DataFrame) -> Column:
    if "_corrupt_record" in df.columns:
        return F.col("_corrupt_record")
    return F.lit(None).cast("string")


def _malformed(df: DataFrame) -> Column:
    """Text that is no JSON, or a JSON object some field of which could not be read."""
    text = _corrupt(df)
    is_object = F.startswith(F.ltrim(text), F.lit("{"))
    return text.isNotNull() & (is_object | F.try_parse_json(text).isNull())


def is_ignored(envelopes: DataFrame) -> Column:
    """Values that are no change records at all, such as a null or a bare number."""
    known = F.coalesce(F.col("op").isin(*HANDLED_OPS), F.lit(False))
    return ~_malformed(envelopes) & F.col("source").isNull() & ~known


def is_good(envelopes: DataFrame) -> Column:
    """Envelopes that decode without loss. Kept to null checks: it runs for every record."""

    def whole(image: str) -> Column:
        types = _image_types(envelopes, image)
        plain = [f for f, target in ORDER_FIELDS if types[f].simpleString() == target]
        ok = F.expr(" AND ".join(f"{x} IS NOT NULL" for x in [image, *[f"{image}.{f}" for f in plain]]))
        for field, target in ORDER_FIELDS:
            if field not in plain:
                ok = ok & _coerced(F.col(image), field, target, types[field]).isNotNull()
        return ok

    before = F.when(F.expr("op IN ('u', 'd')"), whole("before")).otherwise(True)
    after = F.when(F.expr("op IN ('c', 'r', 'u')"), whole("after")).otherwise(True)
    known = F.expr("coalesce(op IN ('c', 'r', 'u', 'd'), false)")
    return known & _corrupt(envelopes).isNull() & before & after & F.coalesce(has_position(), F.lit(False))


def reject_reason(envelopes: DataFrame) -> Column:
    """Why an envelope cannot be decoded; null for good and for ignored ones."""
    op, source = F.col("op"), F.col("source")
    known = F.coalesce(op.isin(*HANDLED_OPS), F.lit(False))

    def bad_field(image: str) -> Column:
        return F.coalesce(
            *[F.when(bad, F.lit(f"bad {name} in {image}")) for name, bad in _unreadable(envelopes, image)]
        )

    needs_before, needs_after = op.isin("u", "d"), op.isin("c", "r", "u")
    before, after = F.col("before"), F.col("after")
    return F.coalesce(
        F.when(needs_before & before.isNotNull(), bad_field("before")),
        F.when(needs_after & after.isNotNull(), bad_field("after")),
        F.when(_malformed(envelopes), F.lit("malformed record")),
        F.when(
            ~known & source.isNotNull(),
            F.concat_ws(" ", F.lit("unsupported operation"), op),
        ),
        F.when(needs_before & before.isNull(), F.lit("missing before image")),
        F.when(needs_after & after.isNull(), F.lit("missing after image")),
        F.when(known & ~F.coalesce(has_position(), F.lit(False)), F.lit("no usable log position")),
    )


def good_envelopes(envelopes: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Envelopes fit to decode. ``fail`` stops the job at the first bad one."""
    good = is_good(envelopes)
    if mode == "quarantine":
        return envelopes.filter(good)
    if mode != "fail":
        raise ValueError(f"mode must be quarantine or fail, not {mode!r}")
    stop = F.raise_error(F.coalesce(reject_reason(envelopes), F.lit("bad envelope")))
    keep = F.when(good, F.lit(True)).when(is_ignored(envelopes), F.lit(False))
    return envelopes.filter(keep.otherwise(stop.cast("boolean")))


def rejects(envelopes: DataFrame) -> DataFrame:
    """The envelopes that cannot be decoded, as they came, each with its reason."""
    whole = F.to_json(F.struct("op", "ts_ms", "before", "after", "source"))
    return envelopes.filter(~is_good(envelopes) & ~is_ignored(envelopes)).select(
        reject_reason(envelopes).alias("reject_reason"),
        "op",
        *log_position(),
        F.coalesce(_corrupt(envelopes), whole).alias("raw"),
    )


def _image_row(envelopes: DataFrame) -> list[Column]:
    """The eight table columns of ``image``. Called once per plan, after the fan-out."""
    types = _image_types(envelopes, "after")
    return [
        F.col(f"image.{field}")
        if types[field].simpleString() == target
        else _coerced(F.col("image"), field, target, types[field]).alias(field)
        for field, target in ORDER_FIELDS
    ]


# The rows an operation gives: constants, so the fan-out copies nothing but references.
_KINDS = """CASE op
    WHEN 'u' THEN array(named_struct('kind', '-U', 'operation', 'update_before', 'img', 0Y),
                        named_struct('kind', '+U', 'operation', 'update_after', 'img', 1Y))
    WHEN 'd' THEN array(named_struct('kind', '-D', 'operation', 'delete', 'img', 0Y))
    WHEN 'c' THEN array(named_struct('kind', '+I', 'operation', 'insert', 'img', 1Y))
    ELSE array(named_struct('kind', '+I', 'operation', 'snapshot', 'img', 1Y)) END"""


def changelog_rows(good: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Good envelopes to the full changelog: an update gives two rows, before then after.

    ``keep`` names columns that stand beside the envelopes and go along.

    The fan-out explodes constant lists of row kinds; images are picked and coerced behind it,
    so that code exists once however many rows an operation gives.
    """
    rows = good.selectExpr(*keep, "before", "after", "ts_ms", "source", f"explode({_KINDS}) AS k")
    picked = rows.selectExpr(*keep, "IF(k.img = 0, before, after) AS image", "ts_ms", "source", "k")
    return picked.select(
        *keep,
        *_image_row(good),
        F.expr("k.kind AS cdc_row_kind"),
        F.expr("k.operation AS cdc_operation"),
        F.expr("ts_ms AS source_ts_ms"),
        *log_position(),
        F.expr("k.img AS _img"),
    )


def decode(envelopes: DataFrame, mode: str = "quarantine", keep: Sequence[str] = ()) -> DataFrame:
    """Envelopes to the changelog."""
    return changelog_rows(good_envelopes(envelopes, mode), keep)


def decode_upserts(
    envelopes: DataFrame, mode: str = "quarantine", rekey: str = "reference"
) -> DataFrame:
    """Only what the keyed table needs: one row per envelope, update-before images never built.

    ``rekey="strict"`` also deletes the old key of an update that changes the key; by default
    the old key stays, because update-before rows do not reach the keyed table.
    """
    if rekey not in ("reference", "strict"):
        raise ValueError(f"rekey must be reference or strict, not {rekey!r}")
    good = good_envelopes(envelopes, mode)
    rows = good.selectExpr("IF(op = 'd', before, after) AS image", "op", "ts_ms", "source")
    if rekey == "strict":
        moved = good.filter("op = 'u' AND before.order_id <> after.order_id")
        rows = rows.unionByName(moved.selectExpr("before AS image", "'d' AS op", "ts_ms", "source"))
    return rows.select(
        *_image_row(envelopes),
        F.expr("CASE op WHEN 'd' THEN '-D' WHEN 'u' THEN '+U' ELSE '+I' END AS cdc_row_kind"),
        F.expr(
            """CASE op WHEN 'd' THEN 'delete' WHEN 'u' THEN 'update_after' WHEN 'c' THEN 'insert'
                    ELSE 'snapshot' END AS cdc_operation"""
        ),
        F.expr("ts_ms AS source_ts_ms"),
        *log_position(),
        F.expr("CAST(IF(op = 'd', 0, 1) AS tinyint) AS _img"),
    )


def drop_update_before(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("cdc_row_kind") != UPDATE_BEFORE)


def current_rows(changes: DataFrame) -> DataFrame:
    """The eight business columns; the kind is kept for the upsert."""
    return changes.select(*CURRENT_COLUMNS, "cdc_row_kind")


def audit_rows(changes: DataFrame) -> DataFrame:
    """The eleven audit columns: every change is an inserted row, its kind is plain data."""
    return changes.select(*CHANGELOG_COLUMNS)
