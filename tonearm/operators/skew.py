"""Per-key results with evenly spread work: exact offset chunking.

Rows are range-partitioned by key and order, so that a key fills whole partitions of its own or parts of neighbouring ones.
Each partition numbers its rows within their keys in one pass and is written once; of its counts only those of its first and
its last key matter to others, and their prefix sums over the partitions give each partition the offset of its first key.
Numbers cut each key into chunks of equal size, every chunk yields states that hold their boundary rows, and the states of a
key are merged in order. Rows are shuffled once, no task holds more than a partition's rows of a key, however hot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.storage import cut

#: A key of more rows than this, and than the same share of all rows, counts as hot; so there are at most HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def _clean(df: DataFrame, *names: str) -> None:
    if taken := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are used by the operator; rename them first")


def hot_keys(df: DataFrame, keys: Sequence[str], total: int, floor: int = HOT_ROWS) -> DataFrame:
    """(keys, __rows, __bound) of the keys with more rows than floor and than a HOT_SHARE-th of total, the rows of df: at most
    HOT_SHARE keys, whatever the data. __bound is the larger of the two. Counts are summed in the map tasks first.
    """
    bound = max(floor, -(-total // HOT_SHARE))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.where(F.col("__rows") > bound).withColumn("__bound", F.lit(bound).cast("bigint"))


def join_unique(
    df: DataFrame, table: DataFrame, key: str | Sequence[str], how: str = "left", floor: int = HOT_ROWS, null_safe: bool = False
) -> DataFrame:
    """df joined to a table that has each key once, without a task for all rows of a hot key: the at most HOT_SHARE hot keys'
    rows of the table are broadcast, the other rows meet in a shuffle in which no key has more than the bound.

    df should be a scan (a cut table), as its keys are counted first. Null keys match nothing, or, null_safe, each other. The
    columns of df come first, then those of the table without its keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in table.columns if c not in keys]
    named = table.select(*(F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)), *rest)

    def same(own: Sequence[str], prefix: str, safe: bool) -> Column:
        out = F.lit(True)
        for i, k in enumerate(own):
            out = out & (F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) if safe else F.col(k) == F.col(f"{prefix}{i}"))
        return out

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, same(keys, "__j", null_safe), how).select(*df.columns, *rest)

    total = df.count()
    if total <= floor:
        return met(df, named.hint("merge"))
    counted = df if null_safe else df.dropna(subset=keys)
    hot = cut(hot_keys(counted, keys, total, floor).select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys))), "hot")
    marked = df.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), same(keys, "__h", True), "left").select(*df.columns, "__hot")
    few = named.join(F.broadcast(hot), same([f"__j{i}" for i in range(len(keys))], "__h", True), "left_semi")
    return met(marked.where("__hot"), F.broadcast(few)).unionByName(met(marked.where("__hot is null"), named.hint("merge")))


def salted_join(a: DataFrame, b: DataFrame, key: str, floor: int = HOT_ROWS) -> DataFrame:
    """The inner join of two tables by a key that may be hot on both sides. The rows of a key that is hot on a side are spread
    there over as many salts as its measured number needs, and met by copies of the other side's rows, so that no task has
    more than a bounded part of a key's rows. Hot keys are at most HOT_SHARE a side.

    Both should be scans (cut tables), as their keys are counted first; the names of their other columns must differ.
    """
    sizes = a.count(), b.count()
    if max(sizes) <= floor:
        return a.join(b, key)
    per: dict = {}
    for side, (rows, total) in enumerate(zip((a, b), sizes)):
        for r in hot_keys(rows.where(F.col(key).isNotNull()), [key], total, floor).collect():
            per.setdefault(r[key], [1, 1])[side] = -(-r["__rows"] // r["__bound"])
    if not per:
        return a.join(b, key)
    fields = [a.schema[key], T.StructField("__na", T.IntegerType()), T.StructField("__nb", T.IntegerType())]
    table = F.broadcast(a.sparkSession.createDataFrame([(k, *n) for k, n in per.items()], T.StructType(fields)))
    left, right = (t.join(table, key, "left").fillna(1, ["__na", "__nb"]) for t in (a, b))
    own = lambda df, n: F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if c != key)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.withColumn("__sa", own(a, "__na")).withColumn("__sb", every("__nb")).drop("__na", "__nb")
    right = right.withColumn("__sb", own(b, "__nb")).withColumn("__sa", every("__na")).drop("__na", "__nb")
    return left.join(right, [key, "__sa", "__sb"]).drop("__sa", "__sb")


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays of one type differ; nulls, and NaNs, are equal to each other."""
    if pa.types.is_nested(a.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    if pa.types.is_null(a.type):
        return np.zeros(len(a), bool)
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    if pa.types.is_floating(a.type):
        same = pc.and_(same, pc.equal(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _in_partition(keys: int, lagged: Sequence[int], running: Sequence[int], names: list[str]):
    """Adds to sorted rows, whose first columns are the keys, their number within key and partition, the values of the lagged
    columns in the row of the key before them, and the sums of the running columns up to them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        run, sums = 0, [0.0] * len(running)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = last is None
            before = []
            for i in range(b.num_columns):
                if i < keys or i in lagged:
                    c = b.column(i)
                    first = c.slice(0, 1) if last is None else last.column(i)
                    before.append((i, pa.concat_arrays([first, c.slice(0, n - 1)])))
            for i, prev in before:
                if i < keys:
                    new |= _differs(b.column(i), prev)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            number = np.where(start >= 0, at - start + 1, at + 1 + run)
            gone = pa.array(new)
            held = dict(before)
            lags = [pc.if_else(gone, pa.scalar(None, b.column(i).type), held[i]) for i in lagged]
            totals = []
            for j, i in enumerate(running):
                x = pc.fill_null(b.column(i).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(x)
                first = np.maximum(start, 0)
                total = upto - np.where(start >= 0, upto[first] - x[first], -sums[j])
                totals.append(pa.array(total))
                sums[j] = float(total[-1])
            run, last = int(number[-1]), b.slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number.astype(np.int64)), *lags, *totals], names)

    return rows


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], number: str = "row_no", lagged: Sequence[str] = (), running: Sequence[str] = ()
) -> DataFrame:
    """All rows of df with their exact number (bigint from 1) within their key by the order.

    running: columns whose sum (double, nulls as 0) over the key's rows up to and with each is added as __sum_<column>.

    lagged: columns whose value in the partition's row of the key before is added as __lag_<column> (null where there is none),
    with the partition, __pid, and the row's number in it, __local. Null keys form a group like any other. Rows that tie in the order
    are numbered by a hash of their columns, and rows that are the same in every column in any order, each once, so that a
    recomputed task can at most swap what can't be told apart. An empty df gives an empty result. The rows are written once to
    the shared folder, since the partitions must not change between counting and numbering; the offsets are a row a partition.
    """
    _clean(df, number, "__pid", "__before", "__hash", "__tie", "__local", *(f"__lag_{c}" for c in lagged), *(f"__sum_{c}" for c in running))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)
    content = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if "map<" not in kinds[c]))
    by = [*(F.col(k).asc() for k in keys), *order, F.col("__hash"), F.col("__tie")]
    tied = df.withColumns({"__hash": content, "__tie": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__pid", F.spark_partition_id())
    cols = [*keys, *(c for c in df.columns if c not in keys), "__pid"]
    ranged = ranged.select(*(F.col(f"`{c}`") for c in cols))
    schema = T.StructType([*ranged.schema.fields, T.StructField("__local", T.LongType())])
    for c in lagged:
        schema = schema.add(T.StructField(f"__lag_{c}", df.schema[c].dataType))
    sums = [f"__sum_{c}" for c in running]
    for c in sums:
        schema = schema.add(T.StructField(c, T.DoubleType()))
    local = _in_partition(len(keys), [cols.index(c) for c in lagged], [cols.index(c) for c in running], schema.fieldNames())
    rows = cut(ranged.mapInArrow(local, schema), "rows")
    offsets = _offsets(rows, keys, sums)
    first = F.lit(True)
    for i, k in enumerate(keys):
        first = first & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(F.broadcast(offsets), "__pid", "left")
    open_ = F.coalesce(first, F.lit(False))
    joined = joined.withColumn(number, F.col("__local") + F.when(open_, F.coalesce("__before", F.lit(0))).otherwise(0))
    joined = joined.withColumns({c: F.col(c) + F.when(open_, F.coalesce(f"__before{c}", F.lit(0.0))).otherwise(0.0) for c in sums})
    extra = ["__pid", "__local", *(f"__lag_{c}" for c in lagged)] if lagged else []
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), number, *extra, *sums)


def _offsets(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(__pid, __k0.., __before, __before<sum>..): of the partitions whose first key began in an earlier one, that key, its rows
    before and their sums.
    """
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    ends = F.struct(*named, F.col("__local").alias("n"), *sums)
    per = rows.groupBy("__pid").agg(F.min(ends).alias("a"), F.max(ends).alias("z")).orderBy("__pid").collect()
    out, open_key, held = [], (), [0] * (1 + len(sums))

    def same(a: tuple, z: tuple) -> bool:
        return len(a) == len(z) and all(x == y or (x != x and y != y) for x, y in zip(a, z))

    for r in per:
        a, z, last = tuple(r.a)[: len(keys)], tuple(r.z)[: len(keys)], tuple(r.z)[len(keys) :]
        before = held if same(a, open_key) else [0] * len(held)
        if before[0]:
            out.append((r["__pid"], *a, before[0], *map(float, before[1:])))
        open_key, held = z, [x + (y if same(a, z) else 0) for x, y in zip(last, before)]
    fields = [T.StructField("__pid", T.IntegerType())]
    fields += [T.StructField(f"__k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)]
    fields += [T.StructField("__before", T.LongType()), *(T.StructField(f"__before{c}", T.DoubleType()) for c in sums)]
    return rows.sparkSession.createDataFrame(out, T.StructType(fields))


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk_rows: int = 50_000, lagged: Sequence[str] = ()) -> DataFrame:
    """Rows of df with row_no within their key and chunk_no, the number of their equal-sized chunk of the key (from 0)."""
    _clean(df, "chunk_no")
    return number_rows(df, keys, order, lagged=lagged).withColumn("chunk_no", F.floor((F.col("row_no") - 1) / chunk_rows))


def ordered_stats(
    df: DataFrame,
    key: str,
    order: str,
    value: str | None = None,
    amount: str | None = None,
    chunk_rows: int = 50_000,
) -> DataFrame:
    """Per key, over its rows by order: n_rows, n_chunks, first_at, last_at, max_gap (largest step of a numeric order),
    and, if asked for, n_changes (times that value differs from that of the row before) and total_amount.

    Each chunk yields a state in each partition that it touches, summed in the map tasks; a state holds its boundary rows, so
    that steps and changes across states are counted when the states of a key are merged in order. Null order values come
    first and make no gap; null keys form a group; null values are equal to each other.
    """
    names = {"__key": key, "__at": order, "__value": value, "__amount": amount}
    named = df.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items() if c))
    rows = chunks(named, ["__key"], [F.col("__at").asc_nulls_first()], chunk_rows, ["__at", "__value"] if value else ["__at"])
    inner = (F.col("__local") > 1) & ((F.col("row_no") - 1) % chunk_rows > 0)
    rows = rows.withColumn("__gap", F.when(inner, F.col("__at") - F.col("__lag___at")))
    state = [
        F.count(F.lit(1)).alias("n"),
        F.min("__at").alias("first_at"),
        F.max("__at").alias("last_at"),
        F.max("__gap").alias("gap"),
        F.min("row_no").alias("first_no"),
    ]
    if value:
        rows = rows.withColumn("__changed", (inner & ~F.col("__lag___value").eqNullSafe(F.col("__value"))).cast("bigint"))
        state += [
            F.sum("__changed").alias("changes"),
            F.min_by(F.struct("__value"), "row_no").alias("first_value"),
            F.max_by(F.struct("__value"), "row_no").alias("last_value"),
        ]
    if amount:
        state.append(F.sum("__amount").alias("amount"))
    states = rows.groupBy("__key", "chunk_no", "__pid").agg(*state)
    along = Window.partitionBy("__key").orderBy("first_no")
    states = states.withColumn("bridge", F.col("first_at") - F.lag("last_at").over(along))
    out = [
        F.sum("n").alias("n_rows"),
        F.count_distinct("chunk_no").alias("n_chunks"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.greatest(F.max("gap"), F.max("bridge")).alias("max_gap"),
    ]
    if value:
        turned = (F.col("first_no") > 1) & ~F.lag("last_value").over(along).eqNullSafe(F.col("first_value"))
        states = states.withColumn("turned", turned.cast("bigint"))
        out.append((F.sum("changes") + F.sum("turned")).alias("n_changes"))
    if amount:
        out.append(F.sum("amount").alias("total_amount"))
    done = states.groupBy("__key").agg(*out)
    if key in done.columns:
        raise ValueError(f"the key {key!r} has the name of a result; rename it first")
    return done.withColumnRenamed("__key", key)


def dominant_keys(df: DataFrame, key: str, order: str, share: float, chunk_rows: int = 50_000) -> DataFrame:
    """Keys that hold at least the share of all rows of df, with n_rows. Rows with a null key count in the whole only."""
    total = df.count()
    per_key = ordered_stats(df.where(F.col(key).isNotNull()), key, order, chunk_rows=chunk_rows)
    return per_key.where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select(key, "n_rows")
