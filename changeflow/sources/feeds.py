"""Change feeds derived from tables, order generators and scenario builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions import scalars as S
from changeflow.functions.windows import previous_row

# Order states, the generator's first instant and its ranges.
STATUSES = ("created", "paid", "packed", "shipped", "delivered")
BASE_TS = "TIMESTAMP_NTZ'2026-01-01 00:00:00'"
MAX_CUSTOMERS = 10_000
AMOUNT_FLOOR = 100
AMOUNT_SPAN = 250_000
CUSTOMER_SPAN = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _statuses() -> Column:
    return F.array(*[F.lit(s) for s in STATUSES])


def _position(seq: Column, file: Column | None = None) -> Column:
    name = F.lit(None) if file is None else file
    return F.struct(name.cast("string").alias("file"), seq.alias("pos"), F.lit(0).alias("row"))


def envelopes(
    rows: DataFrame, op: Column, ts_ms: Column, before: Column, after: Column, seq: Column, file: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Envelope rows whose images are built once.

    A plain projection would be folded into every predicate that looks into an image, and build
    the image again for each field. Exploding a list of one keeps it a value.
    """
    envelope = F.struct(
        op.alias("op"),
        ts_ms.alias("ts_ms"),
        before.alias("before"),
        after.alias("after"),
        _position(seq, file).alias("source"),
    )
    return rows.select(*carry, F.inline(F.array(envelope)))


def orders_feed(orders: DataFrame) -> DataFrame:
    """Up to four envelopes per order row: create, two updates, delete. No shuffle."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    last = (
        F.when(status == "O", 0).when(status != "P", 1).when(key % 3 == 0, 3).otherwise(2).alias("last")
    )
    base_ms = S.floor_div(S.epoch_micros(F.col("o_orderdate")), 1000)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    steps = orders.select(
        key,
        "o_custkey",
        base_ms.alias("base_ms"),
        cents.alias("cents"),
        S.padded_key("order-", key).alias("business_key"),
        F.explode(F.sequence(F.lit(0), last)).alias("k"),
    )

    def image(k: Column) -> Column:
        return F.struct(
            F.col("o_orderkey").alias("order_id"),
            F.col("business_key"),
            (F.col("o_orderkey") * 4 + k).alias("event_id"),
            F.col("o_custkey").alias("customer_id"),
            F.element_at(_statuses(), k + 1).alias("status"),
            (F.col("cents") + 100 * k).alias("amount_cents"),
            (F.col("base_ms") + 1000 * k).alias("updated_at"),
            F.lit(42).alias("seed"),
        )

    k = F.col("k")
    now, prior = image(k), image(k - 1)
    seq = F.col("o_orderkey") * 4 + k
    return envelopes(
        steps,
        op=F.when(k == 0, "c").when(k == 3, "d").otherwise("u"),
        ts_ms=F.col("base_ms") + 1000 * k + 250,
        before=F.when(k > 0, prior),
        after=F.when(k < 3, now),
        seq=seq,
    )


def events_feed(events: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Deep histories: one key per user, ``error`` deletes, the next event creates again."""
    slim = events.select(
        "user_id",
        "event_id",
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        S.epoch_micros(F.col("ts")).alias("micros"),
    )
    extra = {"hot_rows": hot_rows} if hot_rows else {}
    linked = previous_row(
        slim, "user_id", "event_id", ["event_id", "event_type", "cents", "micros"], **extra
    )

    def image(event_id: Column, kind: Column, cents: Column, micros: Column) -> Column:
        return F.struct(
            F.col("user_id").alias("order_id"),
            S.padded_key("user-", F.col("user_id")).alias("business_key"),
            event_id.alias("event_id"),
            F.col("user_id").alias("customer_id"),
            kind.alias("status"),
            cents.alias("amount_cents"),
            micros.alias("updated_at"),
            F.lit(7).alias("seed"),
        )

    prev = F.col("prev")
    live = prev.isNotNull() & (prev["event_type"] != "error")
    error = F.col("event_type") == "error"
    now = image(F.col("event_id"), F.col("event_type"), F.col("cents"), F.col("micros"))
    prior = image(prev["event_id"], prev["event_type"], prev["cents"], prev["micros"])
    return envelopes(
        linked.filter(~error | live),
        op=F.when(error, "d").when(live, "u").otherwise("c"),
        ts_ms=S.floor_div(F.col("micros"), 1000),
        before=F.when(live, prior),
        after=F.when(~error, now),
        seq=F.col("event_id"),
    )


def snapshot_feed(rows: DataFrame) -> DataFrame:
    """The initial read of a source table: one ``r`` envelope per row, before any log position."""
    image = F.struct(*rows.columns)
    return envelopes(
        rows,
        op=F.lit("r"),
        ts_ms=F.lit(None).cast("bigint"),
        before=F.when(F.lit(False), image),
        after=image,
        seq=F.lit(-1).cast("bigint"),
    )


def seeded_orders(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``n`` orders, the same for the same seed, made in parallel."""
    if n < 1:
        raise ValueError("n must be positive")
    return seeded_rows(spark.range(1, n + 1), "id", seed, min(n, MAX_CUSTOMERS))


def seeded_rows(numbers: DataFrame, column: str, seed: int, customers: int = MAX_CUSTOMERS) -> DataFrame:
    """One order per number, drawn from it and the seed alone.

    Draws are digits of an MD5 sum, which other engines compute alike.
    """
    number = F.col(column)

    def draw(salt: int, span: int) -> Column:
        digest = F.md5(F.concat_ws(":", number.cast("string"), F.lit(str(seed)), F.lit(str(salt))).cast("binary"))
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(span).cast("bigint"))

    return numbers.select(
        number.alias("order_id"),
        S.padded_key("order-", number).alias("business_key"),
        number.alias("event_id"),
        (draw(1, customers) + 1).alias("customer_id"),
        F.element_at(_statuses(), (draw(2, len(STATUSES)) + 1).cast("int")).alias("status"),
        (draw(3, AMOUNT_SPAN) + AMOUNT_FLOOR).alias("amount_cents"),
        S.add_seconds(F.expr(BASE_TS), number).alias("updated_at"),
        F.lit(seed).alias("seed"),
    )


def sequence_orders(
    numbers: DataFrame,
    number: str,
    *,
    base_event_id: int,
    prefix: str,
    customer_base: int,
    amount_base: int,
    seed: int,
) -> DataFrame:
    """One order per running number, every field a plain function of it."""
    i = F.col(number).cast("bigint")
    event_id = i + base_event_id
    return numbers.select(
        event_id.alias("order_id"),
        S.padded_key(prefix, event_id).alias("business_key"),
        event_id.alias("event_id"),
        (i % CUSTOMER_SPAN + customer_base).alias("customer_id"),
        F.element_at(_statuses(), (i % len(STATUSES)).cast("int") + 1).alias("status"),
        (i + amount_base).alias("amount_cents"),
        S.add_seconds(F.expr(BASE_TS), i).alias("updated_at"),
        F.lit(seed).alias("seed"),
    )


def write_orders(rows: DataFrame, path: str, rows_per_file: int = 1_000) -> None:
    """Bulk load in files of at most ``rows_per_file`` rows."""
    rows.write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)


# Statement lists of the scenarios: (operation, row number within the scenario).
# Update event ids are the original + UPDATE_OFFSET; scenarios are SCENARIO_STRIDE ids apart.
SCENARIOS = {
    "smoke": (("c", 1), ("c", 2), ("u", 1), ("u", 2), ("d", 1)),
    "crash": (("c", 1), ("c", 2), ("c", 3), ("c", 4), ("u", 1), ("u", 2), ("d", 1)),
    "restore": (("c", 1), ("c", 2), ("c", 3), ("u", 1), ("u", 2), ("d", 1), ("c", 4)),
}
UPDATE_OFFSET = 1_000
SCENARIO_STRIDE = 10_000
EXPECTED_CHANGELOG_ROWS = {"smoke": 7, "crash": 9, "restore": 9}


def scenario_feed(instances: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Envelopes of insert, update and delete statements; one run per (scenario_id, kind) row.

    ``carry`` names columns of a run that its envelopes take along.

    The step lists are literals, so the feed is a narrow projection however many runs there are.
    """

    def steps(kind: str) -> Column:
        return F.array(
            *[
                F.struct(F.lit(op).alias("op"), F.lit(n).alias("n"), F.lit(pos).alias("step"))
                for pos, (op, n) in enumerate(SCENARIOS[kind])
            ]
        )

    plan = F.when(F.col("kind") == "smoke", steps("smoke"))
    plan = plan.when(F.col("kind") == "crash", steps("crash"))
    plan = plan.when(F.col("kind") == "restore", steps("restore"))
    others = [c for c in carry if c != "scenario_id"]
    rows = instances.select("scenario_id", *others, F.explode(plan).alias("s")).select("scenario_id", *others, "s.*")
    rows = rows.withColumn("order_id", F.col("scenario_id") * SCENARIO_STRIDE + F.col("n"))
    rows = rows.withColumn("business_key", S.padded_key("scenario-", F.col("order_id")))
    order_id = F.col("order_id")

    def image(updated: Column) -> Column:
        bump = F.when(updated, UPDATE_OFFSET).otherwise(0)
        return F.struct(
            order_id,
            F.col("business_key"),
            (order_id + bump).alias("event_id"),
            F.col("scenario_id").alias("customer_id"),
            F.when(updated, STATUSES[1]).otherwise(STATUSES[0]).alias("status"),
            (order_id * 10 + bump).alias("amount_cents"),
            (order_id + bump).alias("updated_at"),
            F.lit(1).alias("seed"),
        )

    op = F.col("op")
    return envelopes(
        rows,
        op=op,
        ts_ms=order_id + F.col("step"),
        before=F.when(op != "c", image(op == "d")),
        after=F.when(op != "d", image(op == "u")),
        seq=F.col("scenario_id") * 16 + F.col("step"),
        carry=carry,
    )
