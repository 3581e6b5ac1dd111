"""Exact top-k by inner product as a Voronoi kNN join.

Vectors get one more coordinate that gives all of them the same length, which makes the
largest inner products the nearest neighbours.  A bounded set of pivots cuts the space in
cells.  Each cell is summarised by the distances of its nearest members to its pivot; from
these summaries every query gets an upper bound for its k-th distance, and by the triangle
inequality a ring around each pivot outside of which nothing can matter.  Queries are
grouped by cell (a group holds at most ``group`` queries); a group's ring is the union of
its queries' rings, and only data inside it is replicated to the group.  Tasks hold one
group and one block of data, stream the data and return k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import arrow_rows, drop_tables, hash_sample, one_row_per_id, shared_table
from missive.session import ship_package

PIVOTS = 64
GROUP = 512          # queries that one task holds
BLOCK = 1 << 15      # data rows that one task streams past its queries


def usable(vector: Column) -> Column:
    """No null vector, no null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """List column to rows of ``dim`` numbers; shorter vectors end in zeros."""
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == dim).all():
        return flat.reshape(len(col), dim)
    out = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    off = np.arange(0, rows.size + 1, rows.shape[1] if rows.shape[1] else 1, dtype=np.int32)[:len(rows) + 1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(rows.ravel()))


def _distances(x: np.ndarray, square: np.ndarray, pivots: np.ndarray, lift: np.ndarray, of_query: bool, top: float) -> np.ndarray:
    """Distances to the pivots in the lifted space (``lift``: the pivots' own last
    coordinate, ``square``: squared lengths, ``top``: the common squared length)."""
    own = np.zeros(len(x)) if of_query else np.sqrt(np.maximum(top - square, 0.0))
    length = square if of_query else np.full(len(x), top)
    return np.sqrt(np.maximum(length[:, None] + top - 2 * (x @ pivots.T + own[:, None] * lift[None, :]), 0.0))


def _assign(pivots: np.ndarray, lift: np.ndarray, top: float, dim: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            d = _distances(x, (x * x).sum(1), pivots, lift, False, top)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), b.column(1)],
                                             names=["id", "cell", "radius", "v"])
    return run


def _rings(pivots: np.ndarray, lift: np.ndarray, top: float, dim: int, near: np.ndarray, k: int):
    """Queries to (id, cell, low[], high[], v): per cell the radii that can matter."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            d = _distances(x, (x * x).sum(1), pivots, lift, True, top)
            upper = np.sort((d[:, :, None] + near[None, :, :]).reshape(len(x), -1), axis=1)[:, k]   # k others and itself
            slack = 1e-7 * (np.sqrt(top) + 1) + 1e-3 * (top > 0)      # rounding can never lose a tie
            upper = upper[:, None] + slack
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.argmin(1).astype(np.int32)), _lists(d - upper), _lists(d + upper), b.column(1)],
                                             names=["id", "cell", "low", "high", "v"])
    return run


def _solve(dim: int, k: int):
    """Rows sorted by (group, block, query first, id) to the k best rows per query and task."""
    def run(batches):
        task, qid, qv, best, who = None, [], [], None, None

        def flush():
            nonlocal best, who
            if best is None or not qid:
                return None
            ok = np.isfinite(best)
            q = np.repeat(np.array(qid, np.int64), ok.sum(1))
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(who[ok]), pa.array(best[ok])], names=["query_id", "id", "score"])

        for b in batches:
            groups, blocks = (b.column(c).to_numpy() for c in (0, 1))
            is_data, ids, x = b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4), dim)
            cut = np.flatnonzero((np.diff(groups) != 0) | (np.diff(blocks) != 0) | (np.diff(is_data) != 0)) + 1
            for a, e in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)]))):
                if e == a:
                    continue
                if (groups[a], blocks[a]) != task:
                    done = flush()
                    if done is not None:
                        yield done
                    task, qid, qv, best = (groups[a], blocks[a]), [], [], None
                if not is_data[a]:
                    qid += ids[a:e].tolist()
                    qv.append(x[a:e])
                    continue
                if not qid:
                    continue
                if best is None:
                    q, own = np.concatenate(qv), np.array(qid, np.int64)
                    best, who = np.full((len(qid), k), -np.inf), np.zeros((len(qid), k), np.int64)
                score = q @ x[a:e].T
                score[own[:, None] == ids[None, a:e]] = -np.inf
                cols = np.flatnonzero((score > best[:, -1:]).any(0))     # later rows have larger ids: ties lose
                if cols.size:
                    s = np.concatenate([best, score[:, cols]], axis=1)
                    w = np.concatenate([who, np.broadcast_to(ids[a:e][cols], (len(qid), cols.size))], axis=1)
                    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    best, who = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
        done = flush()
        if done is not None:
            yield done
    return run


def exact_top_k(data: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
                pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score) of the k largest inner products of each query row with
    every other row; ties to the smaller id.

    ``is_query`` (an expression on the id column) picks the queries.  Vectors that are null
    or hold a null or non-finite component take no part; shorter vectors count as ending
    in zeros.  Rows of one id are one row; a null id takes no part.  Scores are exact for
    whole-number components (sums below 2^53).  Fewer than k rows are returned if there
    are fewer candidates; an empty table gives no row.
    """
    spark = data.sparkSession
    ship_package(spark)
    arrow_rows(spark, rows=4096)
    vec = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    vec = one_row_per_id(shared_table(vec.where(F.col("id").isNotNull() & usable(F.col("v"))), "tk-vectors"), "id")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    row = vec.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("top")).first()
    schema = "query_id long, id long, score double"
    if row["n"] == 0:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dim, top = int(row["dim"]), float(row["top"])
    chosen = hash_sample(vec, "id", int(row["n"]), pivots).collect()                # a bounded set
    p = np.zeros((len(chosen), dim))
    for i, r in enumerate(chosen):
        p[i, :len(r["v"])] = r["v"]
    lift = np.sqrt(np.maximum(top - (p * p).sum(1), 0.0))
    cells = shared_table(vec.mapInArrow(_assign(p, lift, top, dim), "id long, cell int, radius double, v array<double>"), "tk-cells")
    nearest = Window.partitionBy("cell").orderBy("radius", "id")
    near = np.full((len(chosen), k + 1), np.inf)
    for r in (cells.select("cell", "radius", "id").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).collect()):
        near[r["cell"], r["r"] - 1] = r["radius"]                                 # pivots x (k + 1) numbers
    asked = vec.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    rings = shared_table(asked.mapInArrow(_rings(p, lift, top, dim, near, k), "id long, cell int, low array<double>, high array<double>, v array<double>"), "tk-rings")
    # groups of neighbouring cells with at most about ``group`` queries; larger cells are split
    names, at, held = [], 0, 0
    order = np.argsort(p @ p[0], kind="stable").tolist()
    per = {r["cell"]: r["count"] for r in rings.groupBy("cell").count().collect()}
    for c in order:
        n = per.get(c, 0)
        if held and held + n > group:
            at, held = at + 1, 0
        parts = max(1, -(-n // group))
        names.append((c, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    names = spark.createDataFrame(names, "cell int, g long, parts int")
    rings = rings.join(F.broadcast(names), "cell").withColumn("g", F.col("g") + F.pmod(F.xxhash64("id"), F.col("parts").cast("long"))).drop("parts")
    bounds = (rings.select("g", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "b"))
              .groupBy("g", "cell").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")))
    bounds = shared_table(bounds, "tk-bounds")
    blocks = max(1, -(-int(row["n"]) // block))
    needed = (cells.join(bounds, "cell").where("radius >= low AND radius <= high")
              .select("g", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(1).alias("is_data"), "id", "v"))
    queries = rings.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(0).alias("is_data"), "id", "v")
    tasks = needed.unionByName(queries).repartition("g", "block").sortWithinPartitions("g", "block", "is_data", "id")
    found = shared_table(tasks.mapInArrow(_solve(dim, k), schema), "tk-found")
    drop_tables(cells, bounds)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"))
