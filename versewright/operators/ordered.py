"""What depends on the order of all rows, without one task for all of them or for a key.

Rows are dealt out by ranges of the order and sorted inside each partition, so a key's rows, however many, may lie in
several partitions. Each partition is worked through alone, and leaves what it knows of its first rows open: how many
rows are before it, which value was carried over its border, in which state its first key goes on. One row a
partition then tells the next ones, which the driver strings together, and the open rows are settled by a join with as
many rows as there are partitions. Each operator costs one shuffle and one table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

#: What monotonically_increasing_id() has of a row's place inside its partition.
_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """df in order, over partitions by range: each row's partition is ``__part``, its place in it ``__at``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return d.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))


def _few(df: DataFrame, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A table of a row for each partition at most."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def numbered(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "row_no", parts: int | None = None) -> DataFrame:
    """df with the number of each row in the order, from 1, over the whole table or within each value of some columns.

    The order must be total where numbers are to be the same each time; rows that are equal in it are numbered as they
    come. Values of ``within`` may be null; any one of them may hold most of the rows. No rows give no rows.
    """
    t = stored(ranged(df, [*[F.col(c).asc() for c in within], *order], parts), "ordered")
    counts = t.groupBy("__part", *within).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    if within:
        before = F.sum("n").over(Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("n")
        c = counts.select(F.col("__part").alias("__p"), *[F.col(w).alias(f"__w{i}") for i, w in enumerate(within)], "__first", "__before")
        on = t["__part"] == c["__p"]
        for i, w in enumerate(within):
            on = on & t[w].eqNullSafe(c[f"__w{i}"])
    else:
        rows, total = [], 0
        for part, n, first in sorted(map(tuple, counts.collect())):  # one row a partition
            rows.append((part, first, total))
            total += n
        c = _few(df, rows, T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__first", T.LongType()), T.StructField("__before", T.LongType())]))
        on = t["__part"] == c["__p"]
    return t.join(c, on).select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name))


def _starts(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a key begins in a batch (a null key begins at each row), and the last key. last: that of the batch before; without
    one it isn't known whether the first row begins a key."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    first = tuple(batch.column(k)[0].as_py() for k in keys)
    new[0] = None in first or (last is not None and first != last)
    for k in keys:
        c = batch.column(k)
        if n > 1:
            new[1:] |= np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True))
    return new, tuple(batch.column(k)[n - 1].as_py() for k in keys)


def carried(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column], name: str, inclusive: bool = True, parts: int | None = None) -> DataFrame:
    """df with the last value of a column that isn't null, among the rows of its key up to this one (inclusive) or before it.

    The value is null before the first one, and for rows with a null key. The order should be total, as in numbered().
    """
    return all_carried(df, [(value, name, inclusive)], keys, order, parts)


def all_carried(df: DataFrame, values: Sequence[tuple[str, str, bool]], keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """carried() for several columns at once; values: (column, name, inclusive) of each."""
    columns, many = df.columns, range(len(values))
    d = ranged(df.withColumns({f"__v{j}": F.col(v) for j, (v, _, _) in enumerate(values)}), [*[F.col(k).asc() for k in keys], *order], parts)
    schema = T.StructType([*d.schema.fields, *[T.StructField(f"__open{j}", T.BooleanType()) for j in many], *[T.StructField(f"__to{j}", d.schema[f"__v{j}"].dataType) for j in many]])
    inclusive = [x for _, _, x in values]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, opened = None, [None] * len(inclusive), [True] * len(inclusive)  # opened: still in the key that the partition begins with, without a value so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new, last = _starts(batch, keys, last)
            at, unknown, taken = np.arange(n), [], []
            begun = np.maximum.accumulate(np.where(new, at, -1))
            for j, own_too in enumerate(inclusive):
                v = batch.column(f"__v{j}")
                source = up_to = np.maximum.accumulate(np.where(np.asarray(pc.is_valid(v)), at, -1))
                if not own_too:
                    source = np.r_[-1, source[:-1]]
                own = (source >= 0) & (source >= begun)
                before = (begun < 0) & ~own  # what the batches before, or the partitions before, carry over
                pool = pa.concat_arrays([v, held[j] if held[j] is not None else pa.nulls(1, v.type)])
                taken.append(pool.take(pa.array(np.where(own, source, n), mask=~(own | before))))
                unknown.append(pa.array(before & opened[j]))
                if up_to[-1] >= 0 and up_to[-1] >= begun[-1]:
                    held[j], opened[j] = v.slice(int(up_to[-1]), 1), False
                elif begun[-1] >= 0:
                    held[j], opened[j] = None, False
            yield pa.RecordBatch.from_arrays([*batch.columns, *unknown, *taken], schema.names)

    t = stored(d.mapInArrow(fill, schema), "carried")
    key = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    ends = t.groupBy("__part").agg(F.max(F.struct("__at", *key)).alias("last"), *[F.max_by(F.struct(*key, F.col(f"__v{j}").alias("v")), F.when(F.col(f"__v{j}").isNotNull(), F.col("__at"))).alias(f"full{j}") for j in many])
    rows, end, found = [], None, [None] * len(values)
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # one row a partition
        rows.append((r["__part"], *(end or (None,) * len(keys)), *found))
        now = tuple(r["last"])[1:]
        for j in many:
            full = r[f"full{j}"]
            if full is not None and tuple(full)[:-1] == now:
                found[j] = full["v"]
            elif now != end:
                found[j] = None
        end = now
    fields = [T.StructField("__p", T.IntegerType()), *[T.StructField(f"__k{i}", d.schema[k].dataType) for i, k in enumerate(keys)], *[T.StructField(f"__found{j}", d.schema[f"__v{j}"].dataType) for j in many]]
    c = _few(df, rows, T.StructType(fields))
    same, keyed = F.lit(True), F.lit(True)
    for i, k in enumerate(keys):
        same, keyed = same & (F.col(k) == F.col(f"__k{i}")), keyed & F.col(k).isNotNull()
    settled = [F.when(keyed, F.when(F.col(f"__open{j}"), F.when(same, F.col(f"__found{j}"))).otherwise(F.col(f"__to{j}"))).alias(name) for j, (_, name, _) in enumerate(values)]
    return t.join(c, t["__part"] == c["__p"]).select(*columns, *settled)


def floored(df: DataFrame, value: str, dim: DataFrame, start: str, keys: Sequence[str] = (), name: str = "floor", parts: int | None = None) -> DataFrame:
    """df with the greatest start of its key that is no more than the value: a merge of both sides in one order.

    Null before the first start, for a null value and for a null key. Nothing is broadcast but a row a partition; a key
    or a value may hold most rows, or all starts. Starts that are null or there twice count as none and one.
    """
    rows = df.select("*", F.col(value).alias("__order"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__salt"))
    starts = dim.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("__order")).distinct()
    starts = starts.select("*", F.col("__order").alias("__start"), F.lit(0).alias("__kind"), F.lit(-1).cast("long").alias("__salt"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    # among equal rows any order will do; the salt only lets a frequent one be parted
    out = carried(both, "__start", keys, [F.col("__order").asc_nulls_first(), F.col("__kind").asc(), F.col("__salt").asc()], name, parts=parts)
    return out.where("__kind = 1").select(*df.columns, F.when(F.col("__order").isNotNull(), F.col(name)).alias(name))


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[Column], symbol: str, step: Callable[[int, int], tuple[int, int]], many: int, start: int = 0, name: str = "output", parts: int | None = None) -> DataFrame:
    """df with the output of a finite automaton at each row of its key: step(state, symbol) is (state after it, output); states
    are 0 to many - 1.

    A prefix scan of transition functions: while a partition doesn't know in which state its first key goes on, it keeps
    the map from each state at its border to the state now, and to each row's output; maps of partitions compose on the
    driver. A null symbol changes nothing and gives null. The order should be total, as in numbered(); a null key equals
    another.
    """
    columns = df.columns
    d = ranged(df, [*[F.col(k).asc() for k in keys], *order], parts)
    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([*d.schema.fields, T.StructField("__out", kind), T.StructField("__then", kind)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache(step)
        begun, last = False, None
        now: list[int] = list(range(many))  # by the state at the border, or one state
        for batch in batches:
            outs, then = [], []
            for key, s in zip(zip(*(batch.column(k).to_pylist() for k in keys)) if keys else ((),) * batch.num_rows, batch.column(symbol).to_pylist()):
                if begun and key != last:
                    now = [start]
                begun, last = True, key
                if s is None:
                    outs.append([None] * len(now))
                else:
                    both = [known(x, s) for x in now]
                    now = [x for x, _ in both]
                    outs.append([y for _, y in both])
                then.append(now)
            if outs:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outs, pa.list_(pa.int32())), pa.array(then, pa.list_(pa.int32()))], schema.names)

    t = stored(d.mapInArrow(scan, schema), "scanned")
    key = F.struct(F.col("__at"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ends = t.groupBy("__part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max(F.struct("__at", "__then"))["__then"].alias("then"))
    rows, end, state = [], None, start
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # one row a partition
        entry = state if end is not None and tuple(r["first"])[1:] == end else start
        rows.append((r["__part"], entry))
        state = r["then"][entry] if tuple(r["first"])[1:] == tuple(r["last"])[1:] else r["then"][0]
        end = tuple(r["last"])[1:]
    c = _few(df, rows, T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__entry", T.IntegerType())]))
    own = F.get("__out", F.when(F.size("__out") == many, F.col("__entry")).otherwise(F.lit(0)))
    return t.join(c, t["__part"] == c["__p"]).select(*columns, own.alias(name))
