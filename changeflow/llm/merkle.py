"""Merkle manifests of a table: a digest for every row, group and table, and a proof for each row.

Rows are leaves. Nodes of a level carry consecutive numbers; a node's siblings have numbers that
follow from its own, so each level is a self-join of its nodes by computed number: the node in slot
zero of a run of eight is joined with the nodes one to seven places on, and emits the parent. On the
way back the same joined rows hand every child what stands left and right of it, level by level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import saved, table
from changeflow.llm.order import key_text, numbered

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string,alone:boolean>"


def digest(*texts: Column) -> Column:
    """Lowercase hex sha256 of the texts one after another."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the text's UTF-8 length, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes ``(tree, place, n, h)`` of one level joined with their siblings: ``(tree, first, n, h0 … h7)``.

    ``n`` is the number of nodes of the tree on this level. Each place is a key of its own run, so a
    tree with most of the rows spreads like any other.
    """
    slot = F.pmod(F.col("place"), F.lit(FAN))
    runs = nodes.where(slot == 0).select("tree", F.col("place").alias("first"), "n", F.col("h").alias("h0"))
    for s in range(1, FAN):
        sibling = nodes.where(slot == s).select("tree", (F.col("place") - s).alias("first"), F.col("h").alias(f"h{s}"))
        runs = runs.join(sibling, ["tree", "first"], "left")
    return runs


def _parents(runs: DataFrame) -> DataFrame:
    whole = F.concat_ws("", *[f"h{s}" for s in range(FAN)])
    return runs.select(
        "tree",
        (F.col("first") / FAN).cast("long").alias("place"),
        F.ceil(F.col("n") / FAN).cast("long").alias("n"),
        F.when(F.col("n") == 1, F.col("h0")).otherwise(digest(whole)).alias("h"),
    )


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The joined runs of every level, from the leaves on, and the one node left of each tree.

    Trees of one node wait unchanged until the largest is done. Each level is written once.
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels = []
    while most > 1:
        levels.append(saved(_runs(nodes), "runs"))
        nodes = _parents(levels[-1])
        most = -(-most // FAN)
    return levels, nodes


def _child_step(slot: Column) -> Column:
    """What stands before and after the node in ``slot`` among the siblings of a joined run."""
    side = lambda keep: F.concat_ws("", *[F.when(keep(s), F.col(f"h{s}")) for s in range(FAN)])
    return F.struct(
        side(lambda s: F.lit(s) < slot).alias("before"),
        side(lambda s: F.lit(s) > slot).alias("after"),
        (F.col("n") == 1).alias("alone"),
    )


def _descend(runs: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of all nodes of a level: ``(tree, place, steps, …)``, from those of the level above."""
    held = runs.withColumn("place", (F.col("first") / FAN).cast("long")).join(above, ["tree", "place"])
    slots = F.filter(F.array(*[F.when(F.col(f"h{s}").isNotNull(), F.lit(s)) for s in range(FAN)]), lambda s: s.isNotNull())
    kept = [c for c in above.columns if c not in ("tree", "place", "steps")]
    return (
        held.withColumn("slot", F.explode(slots))
        .select(
            "tree",
            (F.col("first") + F.col("slot")).alias("place"),
            F.concat(F.array(_child_step(F.col("slot"))), "steps").alias("steps"),
            *kept,
        )
    )


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the leaves' parents' children, down to (not into) the lowest level."""
    for runs in reversed(levels[1:]):
        tops = saved(_descend(runs, tops), "paths")
    return tops


def manifest(
    docs: DataFrame,
    altered: Column | None = None,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
) -> DataFrame:
    """``(id, group, leaf, given_leaf, subroot, root, steps)`` for every row of ``docs``.

    A leaf is the digest of ``fields`` in order, each ``-`` if null, else its UTF-8 length, ``:`` and
    its value. Rows of one group stand by id (null first; rows of one id by leaf); runs of eight become
    one digest, the last run of a level with what it has, until one node is left, the group's subroot.
    Subroots, by group (null first, then UTF-8 bytewise), give the root the same way. ``steps`` lists,
    from the leaf up, what stands before and after a node among its siblings, and whether its tree had
    only this node on that level. ``given_leaf`` is the leaf with the texts ``altered``
    gives in place of ``text`` (the leaf itself by default), for :func:`folded`.

    A group of one row is its own subroot; a table of one group has its subroot as root. Equal rows
    are leaves of their own. Other columns of ``docs`` play no part. An empty table gives no rows.
    """
    leaf = digest(*[framed(F.col(c)) for c in fields])
    given = leaf if altered is None else digest(*[framed(altered if c == "text" else F.col(c)) for c in fields])
    leaves = docs.select(
        key_text(group_col).alias("tree"),
        F.col(id_col).alias("id"),
        F.col(group_col).alias("group"),
        leaf.alias("leaf"),
        F.nullif(given, leaf).alias("given_leaf"),
    )
    leaves = saved(numbered(leaves, ["id", "leaf"], "place", ["tree"]), "leaves")
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    nodes = leaves.select("tree", "place", F.col("leaf").alias("h")).join(sizes, "tree")
    levels, subroots = _climb(nodes)
    subroots = saved(subroots.select("tree", F.col("h").alias("subroot")), "subroots")

    over = saved(numbered(subroots, ["tree"], "place"), "subroots").withColumn("over", F.lit(""))
    trees = subroots.count()
    above, root = _climb(over.select(F.col("over").alias("tree"), "place", F.lit(trees).cast("long").alias("n"), F.col("subroot").alias("h")))
    tops = root.select("tree", "place", F.array().cast(f"array<{STEP}>").alias("steps"), F.col("h").alias("root"))
    tops = _paths(above, tops)
    if above:
        tops = _descend(above[0], tops)
    tops = saved(
        over.join(tops.withColumnRenamed("tree", "over"), ["over", "place"])
        .select("tree", F.lit(0).cast("long").alias("place"), "steps", "root", "subroot"),
        "tops",
    )
    paths = _paths(levels, tops)
    if not levels:
        return leaves.join(paths, ["tree", "place"]).select(*_columns(F.col("steps")))
    first = F.col("place") - F.pmod(F.col("place"), F.lit(FAN))
    held = levels[0].withColumn("place", (F.col("first") / FAN).cast("long")).join(paths, ["tree", "place"]).drop("place")
    mine = leaves.withColumn("first", first)
    slot = F.pmod(F.col("place"), F.lit(FAN))
    steps = F.concat(F.array(_child_step(slot)), "steps")
    return mine.join(held, ["tree", "first"]).select(*_columns(steps))


def _columns(steps: Column) -> list:
    return ["id", "group", "leaf", F.coalesce("given_leaf", "leaf").alias("given_leaf"), "subroot", "root", steps.alias("steps")]


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(
        steps,
        leaf,
        lambda h, s: F.when(s["alone"], h).otherwise(digest(s["before"], h, s["after"])),
    )


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings of the steps, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    found = manifest(table(spark, sf_dir, "documents"), lowered)
    found = found.withColumn("folded_root", folded(F.col("given_leaf"), F.col("steps")))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
