"""Order-dependent folds, cut into independent segments.

A limiter or breaker decision depends on every earlier decision of its key, so some
sequential fold is unavoidable.  What Spark can do is cut each key's timeline where the
state provably resets (an idle gap longer than every expiry), and fold the pieces in
parallel with ``mapInArrow`` over sorted partitions.  Finding the cuts needs "previous time of the same key",
computed in time bins so that few or hot keys still spread over many tasks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from missive.operators.ordering import binned_running
from missive.session import materialize

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def micros(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(x.cast("timestamp"))


def previous_time(df: DataFrame, key: str, t_us: str, order: list[str], bin_us: int = HOUR_US,
                  out: str = "_prev") -> DataFrame:
    """Time of the previous row of the same key along ``order`` (first sort key ``t_us``).

    Inside a (key, bin) partition ``lag`` answers; the first row of a bin takes the
    latest time of the earlier bins (exclusive prefix ``max`` over the small bin table).
    """
    x = df.withColumn("_b", F.floor(F.col(t_us) / F.lit(bin_us)).cast("bigint"))
    bins = x.groupBy(key, "_b").agg(F.max(t_us).alias("_bmax"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(key, "_b", F.max("_bmax").over(wb).alias("_before"))
    w = Window.partitionBy(key, "_b").orderBy(*order)
    y = x.withColumn("_lag", F.lag(t_us).over(w)).join(bins, [key, "_b"], "left")
    return y.withColumn(out, F.coalesce(F.col("_lag"), F.col("_before"))).drop("_b", "_lag", "_before")


def segment_by_gap(df: DataFrame, key: str, t_us: str, order: list[str], gap: Column,
                   out: str = "_seg", bin_us: int = HOUR_US) -> DataFrame:
    """Number the segments of each key's timeline.

    A segment starts where ``gap`` (a predicate over ``_prev`` and the row) is true or at
    the key's first row; there the folded state is provably empty, so segments fold
    independently.  ``out`` is the running count of starts (binned, no per-key window).
    """
    bin_ = F.floor(F.col(t_us) / F.lit(bin_us))
    p = previous_time(df, key, t_us, order, bin_us)
    p = p.withColumn("_start", (F.col("_prev").isNull() | gap).cast("int"))
    p = binned_running(p, [key], [F.col(c) for c in order], bin_, F.col("_start"), "sum", out)
    return p.withColumn(out, F.col(out).cast("bigint")).drop("_prev", "_start")


def segment_by_bins(df: DataFrame, key: str, t_us: str, reset_us: int, out: str = "_seg") -> DataFrame:
    """Number pieces of each key's timeline that an idle time of ``reset_us`` or more parts.

    Times fall into bins of ``reset_us``; an empty bin is such a pause, so every run of
    adjacent bins with rows is a piece.  All is done on the table of bins, and the rows learn
    their piece by one join.  Rows without a time are a piece of their own (null)."""
    d = df.withColumn("_rb", F.floor(F.col(t_us) / F.lit(reset_us)).cast("bigint"))
    bins = d.where("_rb IS NOT NULL").select(F.struct(F.col(key).alias("k")).alias("_kk"), (F.col("_rb") * reset_us).alias("_at")).distinct()
    bins = materialize(bins, "time_bins")        # read by each step of the numbering: the rows are scanned for it once
    seg = segment_by_gap(bins, "_kk", "_at", ["_at"], (F.col("_at") - F.col("_prev")) > reset_us, out, bin_us=reset_us * 1000)
    seg = seg.select(F.col("_kk.k").alias("_k"), F.floor(F.col("_at") / F.lit(reset_us)).cast("bigint").alias("_bk"), out)
    seg = materialize(seg, "time_pieces")        # of known size: a small one is broadcast, and the rows stay where they are
    return d.join(seg, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_rb") == F.col("_bk")), "left").select(*df.columns, out)


def _extend(schema, extra):
    """A new schema: ``schema`` plus (name, type) fields (never mutate a frame's schema)."""
    from pyspark.sql import types as T
    names = {"boolean": T.BooleanType(), "double": T.DoubleType(), "string": T.StringType(),
             "long": T.LongType(), "int": T.IntegerType(), "timestamp_ntz": T.TimestampNTZType()}
    return T.StructType(list(schema.fields) + [T.StructField(n, names[t], True) for n, t in extra])


def _values(column) -> list:
    """An Arrow column as Python values; a missing number is NaN, which no comparison holds for."""
    import pyarrow as pa
    if column.null_count == 0 and not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_primitive(column.type) else column.to_pylist()
    out = column.to_pylist()
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        out = [float("nan") if x is None else x for x in out]
    return out


def _changes(batch, group_cols: list[str]) -> list[int]:
    """The rows of an Arrow batch whose group is not that of the row before (row 0 left out)."""
    import pyarrow.compute as pc
    new = None
    for c in group_cols:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
        differ = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        new = differ if new is None else pc.or_(new, differ)
    return [i + 1 for i in pc.indices_nonzero(new).to_pylist()]


def stream_fold(df: DataFrame, group_cols: list[str], order_cols: list[str], inputs: list[str],
                init, step, extra: list[tuple[str, str]], num_partitions: int | None = None,
                only: str | None = None, keep: list | None = None, skip=None) -> DataFrame:
    """Run a per-group state machine over rows in order, without ever holding a group.

    Rows are hash-partitioned on ``group_cols`` and sorted inside partitions (the sort
    spills to disk as needed); ``mapInArrow`` then streams batches through the
    machine, resetting the state where the group changes.  Only the group columns and
    ``inputs`` become Python values, all others pass as they are.  Memory is one batch plus
    one state, however large a group is; a group's rows stay in one task because its
    decisions are sequential.  ``step(state, *inputs)`` returns one value per ``extra``
    output column.  ``only``: the name of a boolean one of these, to return just the rows
    where it is true, or ``"last"``, the last row of each group.  ``keep``: the columns to
    return beside the group's, the inputs and ``extra`` (all if not given), names or columns
    made of them; the others are left out once the rows are sorted.  ``skip(state, columns, i,
    end)``, unless ``only`` is ``"last"``: the first row from ``i`` on, ``end`` if none, that
    may change the state or, with ``only``, be returned, and the ``extra`` values that all the
    rows before it have; ``step`` is not called for these.
    """
    import pyarrow as pa
    from missive.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the fields of a struct one by one: cheaper to compare than the struct, in the same order
    fields = {f.name: f.dataType.names for f in df.schema.fields if isinstance(f.dataType, T.StructType)}
    along = [x for c in order_cols for x in ([F.col(c)[f] for f in fields[c]] if c in fields else [F.col(c)])]
    d = df.repartition(n, *group_cols).sortWithinPartitions(*group_cols, *along)
    if keep is not None:
        named = {*group_cols, *inputs, *[c for c in keep if isinstance(c, str)]}
        d = d.select(*[c for c in d.columns if c in named], *[c for c in keep if not isinstance(c, str)])
    schema = _extend(d.schema, extra)
    columns = d.columns
    names = [e[0] for e in extra]
    kinds = {"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "long": pa.int64(),
             "int": pa.int32(), "timestamp_ntz": pa.timestamp("us")}
    types = [kinds[t] for _n, t in extra]

    def run(it):
        cur = None
        state = None
        held = None                                # the last row of the group that may go on
        for batch in it:
            if batch.num_rows == 0:
                continue
            key = lambda i: tuple(batch.column(c)[i].as_py() for c in group_cols)
            starts = _changes(batch, group_cols)
            ends = [i - 1 for i in starts]         # rows that end a group inside the batch
            if key(0) != cur:
                if held is not None and only == "last":
                    yield held
                starts = [0, *starts]
            cur = key(batch.num_rows - 1)
            outs, at, i = [], [], 0                # results, and their rows where not all are stepped through
            cols = [_values(batch.column(c)) for c in inputs]
            rows = zip(*cols)
            for end in [*starts, batch.num_rows]:  # up to each start the group before goes on
                if skip is None:
                    outs += [step(state, *x) for x in itertools.islice(rows, end - i)]
                    i = end
                while i < end:
                    j, same = skip(state, cols, i, end)
                    if only is None:
                        outs += [same] * (j - i)
                    if (i := j) < end:
                        outs.append(step(state, *[c[i] for c in cols]))
                        at.append(i)
                        i += 1
                state = init() if end < batch.num_rows else state
            if only is not None:                   # the other rows go no further
                at = at or range(len(outs))
                picked = ends + [len(outs) - 1] if only == "last" else [j for j, v in enumerate(outs) if v[names.index(only)]]
                batch = batch.take(pa.array([at[j] for j in picked], pa.int64()))
                outs = [outs[j] for j in picked]
            out = pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array([v[j] for v in outs], type=t, from_pandas=True) for j, t in enumerate(types)], names=columns + names)
            if only == "last":
                held = out.slice(out.num_rows - 1)
                yield out.slice(0, out.num_rows - 1)
            else:
                yield out
        if held is not None:
            yield held

    return d.mapInArrow(run, schema)
