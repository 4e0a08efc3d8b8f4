"""Near-duplicate vectors by NN-descent over cosine similarity.

Sorted random projections give each vector its first neighbours. Rounds of local joins then
compare the neighbours of a vector with each other, forward and reverse, and keep the best. What a
list has no room for still counts: whatever is compared at once also emits links that span its
groups. All vectors of a group that the links hold together are compared in blocks. An audit compares a bounded number of vectors with all others; while too few
of their links were found, in large groups or elsewhere, more projections are drawn. If that does
not help, each label is compared in blocks as a whole.

Two vectors linked to a third differ from each other by at most twice the angle of a link, so
pairs beyond that angle are no use as neighbours and are not kept: most lists are short.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.llm.common import emitted, ready, rows, saved, table
from changeflow.llm.graph import components

SIMILAR = 0.93
#: Neighbours of a list at first, and after it was found full of links.
LIST, ENLARGED = 8, 16
#: Projection tables of one draw, vectors that should share a cell, vectors compared at once.
TABLES, CELL, BLOCK = 10, 96, 256
#: Rounds of local joins at most; they end when under this share of the lists' entries is new.
ROUNDS, STILL = 6, 0.002
#: Vectors of the audit in large groups and elsewhere, share of a vector's links it must find, and
#: draws before all is compared.
AUDITED, ELSEWHERE, RECALL, DRAWS = 256, 1024, 0.97, 4

#: Rounding of similarities in single precision.
SLACK = 1e-5

PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64()), ("span", pa.bool_())])
PAIRS_DDL = "u long, v long, sim double, span boolean"


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it can't be compared."""
    if not vector or None in vector:
        return None
    out = np.array(vector, np.float64)
    top = np.abs(out).max() if np.isfinite(out).all() else 0.0
    if not top:
        return None
    out /= top
    return out / np.sqrt(out @ out)


def _units(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, vec, dim)``; vec is null where nothing may link."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("vec", pa.binary()), ("dim", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for id_, label, vector in rows(batch, "id", "label", "vector"):
                own = None if label is None else unit(vector)
                record = (id_, label, None, None) if own is None else (id_, label, own.tobytes(), len(own))
                for values, v in zip(out, record, strict=True):
                    values.append(v)
            if batch.num_rows:
                yield emitted(schema, out)

    picked = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")
    )
    return picked.mapInArrow(run, "id long, label string, vec binary, dim int")


def _grouped(keys: list[str], make: Callable[[pa.Table], pa.RecordBatch | None]):
    """Applies ``make`` to each run of rows with equal keys; the input is sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            held = held.combine_chunks()
            cuts = _cuts(held, keys)
            for a, b in zip(cuts, cuts[1:-1], strict=False):
                out = make(held.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out
            held = held.slice(cuts[-2])
        if held is not None:
            out = make(held)
            if out is not None and out.num_rows:
                yield out

    return run


def _cuts(some: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(some.num_rows, bool)
    new[0] = True
    for key in keys:
        values = some[key].combine_chunks()
        values = values.dictionary_encode().indices.to_numpy() if pa.types.is_string(values.type) else values.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return [*np.flatnonzero(new).tolist(), some.num_rows]


def _matrix(some: pa.Table, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in some["vec"].to_pylist()])


def _projected(reps: DataFrame, draw: int, bits: int) -> DataFrame:
    """Every vector in one cell of each table, with a value that sorts the cell."""
    schema = pa.schema(
        [("space", pa.string()), ("table", pa.int32()), ("cell", pa.int64()), ("at", pa.float64()), ("rep", pa.int64()), ("vec", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            some = pa.Table.from_batches([batch])
            dims = some["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = some.filter(pa.array(dims == dim))
                vectors = _matrix(own, np.float64)
                small = [v.tobytes() for v in vectors.astype(np.float32)]
                for t in range(TABLES):
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng([draw, t, dim]).standard_normal((dim, bits + 1))
                    seen = vectors @ planes[t, dim]
                    cell = (seen[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    n = len(vectors)
                    yield pa.RecordBatch.from_arrays(
                        [own["space"].combine_chunks(), pa.array(np.full(n, t, np.int32)), pa.array(cell), pa.array(seen[:, bits]),
                         own["rep"].combine_chunks(), pa.array(small, pa.binary())],
                        schema=schema,
                    )

    ddl = "space string, table int, cell long, at double, rep long, vec binary"
    return reps.select("space", "dim", "rep", "vec").mapInArrow(run, ddl)


def _spanning(sims: np.ndarray, similar: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together all that links hold together; ones in doubt between groups are all named."""
    near = sims >= similar + slack
    group = np.arange(len(sims))
    seen = np.zeros(len(sims), bool)
    row, column = [], []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        todo = [] if seen[start] else [start]
        seen[start] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen).tolist()
            seen[new], group[new] = True, start
            row += [i] * len(new)
            column += new
            todo += new
    a, b = np.nonzero(np.triu(np.abs(sims - similar) < slack, 1))
    apart = group[a] != group[b]
    return np.concatenate([row, a[apart]]).astype(np.int64), np.concatenate([column, b[apart]]).astype(np.int64)


def _best(names: np.ndarray, vectors: np.ndarray, least: np.ndarray | float, keep: int, similar: float) -> pa.RecordBatch | None:
    """Each row's best partners among the others, at least as similar as asked for, and spanning links."""
    if len(names) < 2:
        return None
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -2.0)
    if keep < len(names) - 1:
        top = np.argpartition(-sims, keep, axis=1)[:, :keep]
        row = np.repeat(np.arange(len(names)), top.shape[1])
        column = top.ravel()
    else:
        row, column = np.nonzero(sims > -2.0)
    value = sims[row, column]
    good = value >= (least[row] if isinstance(least, np.ndarray) else least)
    a, b = _spanning(sims, similar, SLACK)
    if not good.any() and not len(a):
        return None
    row, column = np.concatenate([row[good], a]), np.concatenate([column[good], b])
    span = np.arange(len(row)) >= len(row) - len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(names[row]), pa.array(names[column]), pa.array(sims[row, column].astype(np.float64)), pa.array(span)], schema=PAIRS
    )


def _cells(floor: float, similar: float):
    def make(some: pa.Table) -> pa.RecordBatch | None:
        parts = []
        for at in range(0, some.num_rows, BLOCK):
            part = some.slice(at, BLOCK)
            got = _best(part["rep"].to_numpy(), _matrix(part, np.float32), floor, LIST, similar)
            if got is not None:
                parts.append(got)
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A cell may be any size: it is worked off in blocks as it comes.
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
            cuts = _cuts(held, ["space", "table", "cell"])
            done = cuts[-2]
            done += (held.num_rows - done) // BLOCK * BLOCK
            for a, b in zip(cuts, [*cuts[1:-1], done], strict=False):
                out = make(held.slice(a, b - a)) if b > a else None
                if out is not None:
                    yield out
            held = held.slice(done)
        if held is not None and held.num_rows:
            out = make(held)
            if out is not None:
                yield out

    return run


def _merged(pairs: DataFrame, full: DataFrame | None) -> DataFrame:
    """The best entries of each list, and spanning links that are on none; lists that were full of links may grow."""
    best = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("span").alias("span"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    size = F.lit(LIST)
    if full is not None:
        best = best.join(full.withColumn("grown", F.lit(True)), "u", "left")
        size = F.when(F.col("grown"), F.lit(ENLARGED)).otherwise(size)
    ranked = best.withColumn("listed", rank <= size)
    return ranked.where("listed OR span").select("u", "v", "sim", "span", "listed")


def _listed(merged: DataFrame) -> DataFrame:
    """The entries of the lists, as pairs."""
    return merged.where("listed").select("u", "v", "sim", F.lit(False).alias("span"))


def _full(lists: DataFrame, similar: float) -> DataFrame:
    """Owners of lists that hold nothing but links, as many as fit."""
    return lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).where(
        (F.col("n") >= LIST) & (F.col("least") >= similar)
    ).select("u")


def _descend(lists: DataFrame, reps: DataFrame, similar: float, floor: float) -> tuple[DataFrame, list[DataFrame]]:
    """Rounds of local joins until the lists stand still: the lists, and what each round found."""
    seen = []
    small = saved(reps.select("rep", "small"), "vectors")
    for _ in range(ROUNDS):
        full = saved(_full(lists, similar), "full")
        # Reverse entries, a bounded number for each vector: first among sixteenths, then of all.
        pick = F.xxhash64("u", "v")
        part = F.pmod(F.xxhash64("u"), F.lit(16))
        reverse = lists.withColumn("part", part).withColumn(
            "n", F.row_number().over(Window.partitionBy("v", "part").orderBy(pick))
        ).where(F.col("n") <= LIST)
        reverse = reverse.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(pick))).where(F.col("n") <= LIST)
        members = lists.select(F.col("u").alias("centre"), F.col("v").alias("rep")).union(
            reverse.select(F.col("v").alias("centre"), F.col("u").alias("rep"))
        ).distinct()
        # A list with room takes any neighbour above the floor; a filled one must be bettered.
        worst = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"))
        worst = worst.join(full.withColumn("grown", F.lit(True)), "u", "left").select(
            F.col("u").alias("rep"),
            F.when(F.col("n") >= F.when(F.col("grown"), ENLARGED).otherwise(LIST), F.col("least")).otherwise(F.lit(floor)).alias("least"),
        )
        met = members.join(small.join(worst, "rep", "left"), "rep").select(
            "centre", "rep", F.col("small").alias("vec"), F.coalesce("least", F.lit(floor)).alias("least")
        )

        def local(some: pa.Table) -> pa.RecordBatch | None:
            return _best(some["rep"].to_numpy(), _matrix(some, np.float32), some["least"].to_numpy(), ENLARGED, similar)

        joined = met.repartition("centre").sortWithinPartitions("centre", "rep").mapInArrow(_grouped(["centre"], local), PAIRS_DDL)
        seen.append(saved(_merged(lists.union(joined), full), "lists"))
        after = _listed(seen[-1])
        fresh = after.join(lists, ["u", "v"], "left_anti").count()
        lists = after
        if fresh <= STILL * after.count():
            break
    return lists, seen


def _dealt(reps: DataFrame, group: DataFrame) -> DataFrame:
    """The vectors of each group, dealt to pairs ``(a, b)`` of blocks."""
    sized = group.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    member = reps.select("rep", "vec", "weight").join(group, reps.rep == group.node).join(sized, "root")
    n = F.ceil(F.col("m") / F.lit(BLOCK))
    own = F.pmod(F.xxhash64("rep"), F.col("n"))
    return member.withColumn("n", n).withColumn("own", own).select(
        "root", "rep", "vec", "weight", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    ).select(
        "root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "vec", "weight"
    )


def _whole(reps: DataFrame, similar: float) -> DataFrame:
    """``(a, b)``: links that span all groups, from comparing everything in blocks."""

    def meet(some: pa.Table) -> pa.RecordBatch:
        names, left = some["rep"].to_numpy(), some["own"].to_numpy() == some["a"][0].as_py()
        vectors = _matrix(some, np.float64)
        if left.all():
            sims = vectors @ vectors.T
            np.fill_diagonal(sims, -2.0)
        else:
            sims = np.full((len(names), len(names)), -2.0)
            sims[np.ix_(left, ~left)] = vectors[left] @ vectors[~left].T
            sims = np.maximum(sims, sims.T)
        a, b = _spanning(sims, similar, 1e-12)
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

    keys = ["root", "a", "b"]
    dealt = _dealt(reps, reps.select(F.col("rep").alias("node"), F.col("space").alias("root")))
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(_grouped(keys, meet), "a long, b long")


def _blocks(reps: DataFrame, group: DataFrame, similar: float) -> DataFrame:
    """``(rep, linked)``: how many vectors each one links to within its group, compared in blocks."""

    def meet(some: pa.Table) -> pa.RecordBatch | None:
        a, own = some["a"][0].as_py(), some["own"].to_numpy()
        names, weight = some["rep"].to_numpy(), some["weight"].to_numpy()
        left = own == a
        vectors = _matrix(some, np.float64)
        if some["b"][0].as_py() == a:
            near = vectors @ vectors.T >= similar
            np.fill_diagonal(near, False)
            counts = near @ weight
        else:
            near = vectors[left] @ vectors[~left].T >= similar
            counts = np.empty(len(names), np.int64)
            counts[left], counts[~left] = near @ weight[~left], near.T @ weight[left]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts.astype(np.int64))], names=["rep", "linked"])

    keys = ["root", "a", "b"]
    met = _dealt(reps, group).repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(_grouped(keys, meet), "rep long, linked long")
    return met.groupBy("rep").agg(F.sum("linked").alias("linked"))


def _audit(reps: DataFrame, group: DataFrame, similar: float) -> float:
    """Share found of a vector's links, on average over a bounded number of vectors.

    They are compared with all others. Vectors of large groups have many links and would outvote
    the rest, so both kinds are averaged for themselves; the lower share counts.
    """
    sized = group.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    placed = reps.join(group, reps.rep == group.node, "left").join(sized, "root", "left")
    placed = placed.withColumn("large", F.coalesce(F.col("m") > ENLARGED, F.lit(False)))
    drawn = [placed.where(of).orderBy(F.xxhash64("vec"), "rep").limit(n) for of, n in (("large", AUDITED), ("NOT large", ELSEWHERE))]
    asked = drawn[0].union(drawn[1]).select("rep", "space", "vec", "large").toArrow()
    if not asked.num_rows:
        return 1.0
    large = set(asked.filter(asked["large"])["rep"].to_pylist())
    spaces, names = np.array(asked["space"].to_pylist(), object), asked["rep"].to_numpy()
    raw = asked["vec"].to_pylist()
    shared = reps.sparkSession.sparkContext.broadcast(
        {s: (names[spaces == s], np.stack([np.frombuffer(raw[i], np.float64) for i in np.flatnonzero(spaces == s)])) for s in set(spaces)}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.Table.from_batches([batch])
            own = np.array(some["space"].to_pylist(), object)
            for space in set(own) & set(shared.value):
                part = some.filter(pa.array(own == space))
                queries, vectors = shared.value[space]
                theirs = part["rep"].to_numpy()
                row, column = np.nonzero(_matrix(part, np.float64) @ vectors.T >= similar)
                other = theirs[row] != queries[column]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[column][other]), pa.array(theirs[row][other])], names=["u", "v"]
                )

    true = saved(reps.select("space", "rep", "vec").mapInArrow(run, "u long, v long"), "audit")
    left, right = group.select(F.col("node").alias("u"), F.col("root").alias("ru")), group.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    found = true.join(left, "u", "left").join(right, "v", "left")
    told = found.groupBy("u").agg(F.avg(F.coalesce(F.col("ru") == F.col("rv"), F.lit(False)).cast("double")).alias("share")).collect()
    shares = [[r["share"] for r in told if (r["u"] in large) == kind] for kind in (True, False)]
    return min((sum(x) / len(x) for x in shares if x), default=1.0)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    similar: float = SIMILAR,
    report: dict | None = None,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row, links within equal labels only.

    Vectors that are null, empty, zero, hold a null or non-finite component, or have no label link
    with nothing; so do vectors of different lengths. Equal vectors of a label link with each
    other and are compared once. Repeated ids are vectors of their own; rows without an id are
    linked but never name a group. ``report`` receives the audited recall of the last draw, and whether
    all was compared because it was too low.
    """
    spark = ready(vectors.sparkSession)
    units = saved(_units(vectors, id_col, vector_col, label_col), "units")
    space = F.concat_ws(":", "dim", "label")
    valid = units.where(F.col("vec").isNotNull()).withColumn("space", space)
    reps = valid.groupBy("space", "dim", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least_id"))
    reps = saved(reps.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    group = lists = None
    seen: list[DataFrame] = []
    largest = reps.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, largest / CELL))))
    floor = 2 * similar * similar - 1 if similar > 0.5 else -1.0
    narrow = reps.withColumn("small", _narrowed(reps))
    for draw in range(DRAWS if largest > 1 else 0):
        dealt = _projected(reps, draw, bits)
        keys = ["space", "table", "cell", "at"]
        cells = dealt.repartitionByRange(*keys, "rep").sortWithinPartitions(*keys, "rep").mapInArrow(_cells(floor, similar), PAIRS_DDL)
        fresh = saved(cells, "cells")
        seen.append(saved(_merged(fresh if lists is None else lists.union(fresh), None), "lists"))
        lists, found = _descend(_listed(seen[-1]), narrow, similar, floor)
        seen += found
        # Whatever was found counts, also what better entries have pushed out of a list since.
        close = reduce(DataFrame.union, seen).where(F.col("sim") >= similar - 1e-4).select(F.col("u").alias("a"), F.col("v").alias("b"))
        group = saved(components(_verified(close, reps, similar)), "groups")
        recall = _audit(reps, group, similar)
        if report is not None:
            report.update(recall=recall, draws=draw + 1, whole=recall < RECALL and draw + 1 == DRAWS)
        if recall >= RECALL:
            break
    else:
        if group is not None:
            group = saved(components(_verified(_whole(reps, similar), reps, similar)), "groups")
    if group is None:
        group = spark.createDataFrame([], "node long, root long")
    linked = _blocks(reps, group, similar)
    named = reps.join(group, reps.rep == group.node, "left").withColumn("root", F.coalesce("root", "rep"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    per_rep = named.join(names, "root").join(linked, "rep", "left").select(
        F.col("space").alias("_space"),
        F.col("vec").alias("_vec"),
        (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        "component_id",
    )
    out = units.withColumn("space", F.when(F.col("vec").isNotNull(), space))
    out = out.join(per_rep, (F.col("space") == F.col("_space")) & (F.col("vec") == F.col("_vec")), "left")
    component = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _narrowed(reps: DataFrame):
    """The vectors in single precision, as bytes."""

    @F.arrow_udf("binary")
    def narrow(vec: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in vec.to_pylist()], pa.binary())

    return narrow("vec")


def _verified(close: DataFrame, reps: DataFrame, similar: float) -> DataFrame:
    """Pairs whose similarity in double precision is a link."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([bool(np.frombuffer(x) @ np.frombuffer(y) >= similar) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])

    pairs = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = reps.select(F.col("rep").alias("a"), F.col("vec").alias("va"))
    right = reps.select(F.col("rep").alias("b"), F.col("vec").alias("vb"))
    return pairs.join(left, "a").join(right, "b").where(linked("va", "vb")).select("a", "b")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")
