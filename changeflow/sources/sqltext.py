"""SQL statements as text: what they change, as envelopes.

Spark's own parser reads ``INSERT``, ``UPDATE``, ``DELETE`` and ``TRUNCATE``; the tables here are
never changed in place, so the parsed statement becomes the change envelopes that a source log would carry.
Conditions, values and queries stay Spark expressions, subqueries and other views included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from changeflow.operators import decode, state
from changeflow.schemas import CURRENT_COLUMNS, ORDER_FIELDS
from changeflow.session import run_dir
from changeflow.sources import statements

TYPES = dict(ORDER_FIELDS)


def _column(spark: SparkSession, expression) -> Column:
    return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _target(table) -> tuple[str, str | None]:
    """Name and alias of the table a statement changes."""
    alias = None
    if table.getClass().getSimpleName() == "SubqueryAlias":
        alias, table = table.alias(), table.child()
    return table.multipartIdentifier().mkString("."), alias


def _named(names: list[str], known: set[str]) -> None:
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")


def _inserted(spark: SparkSession, plan) -> DataFrame:
    if plan.overwrite() or not plan.partitionSpec().isEmpty():
        raise ValueError("only plain INSERT INTO is a change of rows")
    query = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.query()), spark)
    given = plan.userSpecifiedCols()
    names = [given.apply(i) for i in range(given.size())] or CURRENT_COLUMNS
    _named(names, set(CURRENT_COLUMNS))
    if len(names) != len(query.columns):
        raise ValueError(f"{len(names)} columns, {len(query.columns)} values")
    rows = query.toDF(*names)
    return rows.select(*[(F.col(c) if c in names else F.lit(None)).cast(TYPES[c]).alias(c) for c in CURRENT_COLUMNS])


def envelopes_of(spark: SparkSession, text: str, first_seq: int = 0, ts_ms: int = 0, file: str | None = None) -> DataFrame:
    """The envelopes of one statement. The table it names is a view or table of the session that holds the
    eight current columns; it is read as it stands.

    An ``INSERT`` may name some columns only; the others are null, which decoding rejects where the
    table needs a value. Any other kind of statement is an error.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    kind = plan.getClass().getSimpleName()
    if kind not in ("InsertIntoStatement", "UpdateTable", "DeleteFromTable", "TruncateTable"):
        raise ValueError(f"not INSERT, UPDATE, DELETE or TRUNCATE: {text}")
    if kind == "InsertIntoStatement":
        return statements.insert(_inserted(spark, plan), first_seq, ts_ms, file)
    name, alias = _target(plan.table())
    rows = spark.table(name).select(*CURRENT_COLUMNS).alias(alias or name.split(".")[-1])
    if kind == "TruncateTable":
        return statements.truncate(rows, first_seq, ts_ms, file)
    if kind == "DeleteFromTable":
        return statements.delete(rows, _column(spark, plan.condition()), first_seq, ts_ms, file)
    held, changes = plan.assignments(), {}
    for i in range(held.size()):
        column = held.apply(i).key().nameParts().last()
        _named([column], set(CURRENT_COLUMNS))
        changes[column] = _column(spark, held.apply(i).value()).cast(TYPES[column])
    where = _column(spark, plan.condition().get()) if plan.condition().isDefined() else F.lit(True)
    return statements.update(rows, where, changes, first_seq, ts_ms, file)


def run_script(spark: SparkSession, texts: list[str], view: str, ts_ms: int = 0) -> DataFrame:
    """The envelopes of several statements on the view ``view``, each of which sees what those before it changed.

    Statement ``n`` has log file ``statement.n`` (from 1), so positions order the changes of the whole script. The
    table before the script, each statement's envelopes and the table after it are written once; at the end the view
    shows the last of them.
    """
    log = run_dir(spark, "script")
    spark.table(view).select(*CURRENT_COLUMNS).write.parquet(f"{log}/tables/0")
    spark.read.parquet(f"{log}/tables/0").createOrReplaceTempView(view)
    for n, text in enumerate(texts, 1):
        at = f"{log}/envelopes/statement={n}"
        envelopes_of(spark, text, ts_ms=ts_ms, file=f"statement.{n}").write.parquet(at)
        before = spark.table(view).select(*CURRENT_COLUMNS)
        base = before.select(
            "*", F.lit("+I").alias("cdc_row_kind"), F.lit("snapshot").alias("cdc_operation"), F.lit(ts_ms).cast("bigint").alias("source_ts_ms"),
            F.lit(0).cast("bigint").alias("_file"), F.lit(0).cast("bigint").alias("_seq"), F.lit(0).alias("_row"), F.lit(1).cast("tinyint").alias("_img"),
        )
        changes = decode.decode(spark.read.parquet(at))
        state.current_state(base.unionByName(changes)).write.parquet(f"{log}/tables/{n}")
        spark.read.parquet(f"{log}/tables/{n}").createOrReplaceTempView(view)
    return spark.read.parquet(f"{log}/envelopes")
