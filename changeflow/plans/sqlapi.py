"""Plain Spark SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions import scalars as S
from changeflow.streaming.table import ChangeTable

CURRENT_VIEW, CHANGELOG_VIEW, SOURCE_VIEW = "orders_current", "orders_changelog", "orders_source"

# Prefixes of output lines that are not results, and the failure classes by name.
NOISE = ("WARNING:", "SLF4J:", "log4j:WARN")
FAILURE_CLASSES = (
    "task-crash",
    "checkpoint-restore",
    "jobmanager-restart",
    "savepoint-restore",
    "sink-commit-fault",
)


def register(spark: SparkSession, table: ChangeTable, source: DataFrame | None = None) -> None:
    """Make the tables known to SQL under their names."""
    table.current().createOrReplaceTempView(CURRENT_VIEW)
    table.changelog().createOrReplaceTempView(CHANGELOG_VIEW)
    if source is not None:
        source.createOrReplaceTempView(SOURCE_VIEW)


def sql(spark: SparkSession, query: str | None) -> DataFrame:
    """Run one statement; results stay typed."""
    if not query or not query.strip():
        raise ValueError(
            f"a query is required, for example: SELECT * FROM {CURRENT_VIEW} ORDER BY order_id"
        )
    return spark.sql(query)


def tsv(df: DataFrame) -> DataFrame:
    """Rows as tab-joined lines."""
    return df.select(S.tsv_line(df).alias("line"))


def write_tsv(df: DataFrame, path: str) -> None:
    tsv(df).write.text(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows; a row with another number of fields stops the job."""
    return spark.read.csv(path, schema=schema, sep="\t", mode="FAILFAST", nullValue=S.NULL_TEXT)


def clean_lines(lines: DataFrame, column: str = "value", prefixes: tuple[str, ...] = NOISE) -> DataFrame:
    """Output lines without blanks and without lines that start with a noise prefix."""
    text = F.col(column)
    noisy = F.lit(False)
    for prefix in prefixes:
        noisy = noisy | F.startswith(text, F.lit(prefix))
    return lines.filter(text.rlike(r"\S") & ~noisy)


def table_parts(identifier: str, catalog: str, database: str) -> tuple[str, str, str]:
    """``t``, ``db.t`` or ``cat.db.t`` to its three parts."""
    parts = identifier.split(".")
    if not all(parts) or len(parts) > 3:
        raise ValueError(f"not a table name of one to three parts: {identifier}")
    return tuple([catalog, database][: 3 - len(parts)] + parts)
