"""Seeded choices by md5 rank, and an exact dense row index.

Every random decision in the engine is a function of (seed, row key,
position): ``md5(concat_ws(':', seed, key, tag, pos))``. The value does not
depend on partitioning, task retries or executor loss, and the same string is
produced by DuckDB, so random operators keep an exact SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanweave.constants import DEFAULT_SEED


def sql_str(x) -> str:
    """A SQL string literal."""
    return "'" + str(x).replace("'", "''") + "'"


def md5_sql(seed, *parts: str) -> str:
    """SQL text of the md5 rank of (seed, parts...); parts are SQL expressions."""
    items = [sql_str(seed)] + [f"cast({p} as string)" for p in parts]
    return f"md5(concat_ws(':', {', '.join(items)}))"


def md5_rank(seed=DEFAULT_SEED, *parts) -> Column:
    """md5 rank as a Column; ``parts`` are column names, Columns or literals."""
    cols = [F.lit(str(seed))]
    for p in parts:
        c = p if isinstance(p, Column) else F.col(p)
        cols.append(c.cast("string"))
    return F.md5(F.concat_ws(":", *cols))


def uniform_sql(n: str, seed, *parts: str) -> str:
    """Uniform integer in [0, n) from the first 32 bits of the md5 rank."""
    return f"pmod(cast(conv(substr({md5_sql(seed, *parts)}, 1, 8), 16, 10) as bigint), {n})"


def uniform(n, seed=DEFAULT_SEED, *parts) -> Column:
    h = md5_rank(seed, *parts)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(n) if not isinstance(n, Column) else n)


def _materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared checkpoint folder.

    Row numbers come from partition ids and positions, and the offsets are
    computed in a second branch over the same rows; both branches must see
    one and the same range partitioning (the range bounds are sampled and
    may differ between two evaluations or after an executor loss), so the
    numbered rows are written once and both branches read them.
    """
    from spanweave.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dense_index(df: DataFrame, order_cols: list, name: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Exact 0-based global row index in ``order_cols`` order (see ``_dense_index_rows``).

    Wide rows are not numbered directly: one row per distinct key is range-partitioned and
    checkpointed with its number of rows, and the first index of each key joins back null-safely.
    Rows that share a key (nulls are a key too) take consecutive indexes, so no row is lost or
    multiplied; which of them comes first is settled by the other columns' hash.
    """
    from pyspark.sql.window import Window
    extra = [c for c in df.columns if c not in order_cols]
    if not extra:
        return _dense_index_rows(df, order_cols, name, num_partitions)
    keys = df.groupBy(*order_cols).agg(F.count(F.lit(1)).alias("_sw_copies"))
    keys = _dense_index_rows(keys, order_cols, name, num_partitions, weight="_sw_copies").toDF(
        *[f"_sw_k{i}" for i in range(len(order_cols))], "_sw_copies", name)
    same = [F.col(c).eqNullSafe(F.col(f"_sw_k{i}")) for i, c in enumerate(order_cols)]
    # every row has its key; an outer join never broadcasts the wide side
    d = df.join(keys, on=same, how="left")
    if keys.where("_sw_copies > 1").limit(1).count():
        d = d.withColumn(name, F.col(name) + F.row_number().over(
            Window.partitionBy(*order_cols).orderBy(F.xxhash64(F.to_json(F.struct(*extra))))) - 1)
    return d.select(*df.columns, name)


def _dense_index_rows(df: DataFrame, order_cols: list, name: str = "idx",
                      num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Attach an exact 0-based global row index in ``order_cols`` order.

    ``row_number() over (order by ...)`` without a partition moves every row
    to one task. Instead: range-partition on the (total) order, sort inside
    each partition, number rows locally, count rows per partition (a table of
    at most ``num_partitions`` rows), turn the counts into offsets and
    broadcast them back. The only wide step is the range shuffle, which
    splits hot key ranges because the order is total.
    ``order_cols`` must make the order total (end with a unique key). With ``weight`` a row
    takes that many indexes and gets the first of them.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = (df.repartitionByRange(n, *order_cols)
               .sortWithinPartitions(*order_cols)
               .withColumn("_sw_pid", F.spark_partition_id())
               .withColumn("_sw_mid", F.monotonically_increasing_id()))
    from pyspark.sql.window import Window
    # local position = id minus the partition's base (pid << 33)
    local = local.withColumn("_sw_pos", F.col("_sw_mid") - F.shiftleft(F.col("_sw_pid").cast("bigint"), 33))
    local = _materialize(local)
    if weight:
        before = Window.partitionBy("_sw_pid").orderBy("_sw_mid").rowsBetween(Window.unboundedPreceding, -1)
        local = local.withColumn("_sw_pos", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    counts = local.groupBy("_sw_pid").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_sw_n"))
    offsets = counts.withColumn(
        "_sw_off",
        F.coalesce(F.sum("_sw_n").over(Window.orderBy("_sw_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("_sw_pid", "_sw_off")
    out = local.join(F.broadcast(offsets), "_sw_pid")
    return out.withColumn(name, F.col("_sw_off") + F.col("_sw_pos")).drop("_sw_pid", "_sw_mid", "_sw_pos", "_sw_off")


def group_dense_index(df: DataFrame, group_cols: list, order_cols: list, name: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """0-based index inside each group in ``order_cols`` order, without one task per group.

    Range-partition on (group, order), number rows locally, then add for every
    (partition, group) the rows of the same group in earlier partitions. The
    offset table has about (#groups + #partitions) rows and is joined on
    (partition, group); AQE broadcasts it when it is small. A group holding a
    third of all rows is spread over many range partitions.
    """
    from pyspark.sql.window import Window
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_cols) + list(order_cols)
    local = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
               .withColumn("_sw_pid", F.spark_partition_id())
               .withColumn("_sw_mid", F.monotonically_increasing_id()))
    local = _materialize(local)
    pg = local.groupBy("_sw_pid", *group_cols).agg(F.min("_sw_mid").alias("_sw_min"),
                                                   F.count(F.lit(1)).alias("_sw_n"))
    w = Window.partitionBy(*group_cols).orderBy("_sw_pid").rowsBetween(Window.unboundedPreceding, -1)
    pg = pg.withColumn("_sw_before", F.coalesce(F.sum("_sw_n").over(w), F.lit(0)))
    # a null group is a group like any other
    pg = pg.select("_sw_pid", *group_cols, "_sw_min", "_sw_before").toDF(
        "_sw_p", *[f"_sw_g{i}" for i in range(len(group_cols))], "_sw_min", "_sw_before")
    same = [F.col("_sw_pid") == F.col("_sw_p")] + [F.col(c).eqNullSafe(F.col(f"_sw_g{i}")) for i, c in enumerate(group_cols)]
    out = local.join(pg, on=same)
    return out.withColumn(name, F.col("_sw_before") + F.col("_sw_mid") - F.col("_sw_min")).select(*df.columns, name)


def running_scan(df: DataFrame, group_cols: list, order_cols: list, value: Column, how, name: str,
                 num_partitions: int | None = None, upto: bool = True) -> DataFrame:
    """Running aggregate ``how`` (``F.max``, ``F.sum``, ...) of ``value`` inside each group in ``order_cols`` order,
    without one task per group.

    Two levels: rows are range-partitioned on (group, order) and scanned inside each (partition, group); what earlier
    partitions of the same group hold, one row for each (partition, group), is scanned on its own and
    joined back. A group of any size is spread over many tasks. ``upto=False`` leaves the row itself out; the
    first row of a group then has null. Null groups are groups; the order must be total inside a group.
    """
    from pyspark.sql.window import Window
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_cols) + list(order_cols)
    local = _materialize(df.withColumn("_sw_v", value).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                           .withColumn("_sw_pid", F.spark_partition_id()))
    part = ["_sw_pid", *group_cols]
    ends = local.groupBy(*part).agg(how("_sw_v").alias("_sw_part"))
    before = Window.partitionBy(*group_cols).orderBy("_sw_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_sw_before", how("_sw_part").over(before)).drop("_sw_part").toDF(
        "_sw_p", *[f"_sw_g{i}" for i in range(len(group_cols))], "_sw_before")
    inside = Window.partitionBy(*part).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
    same = [F.col("_sw_pid") == F.col("_sw_p")] + [F.col(c).eqNullSafe(F.col(f"_sw_g{i}")) for i, c in enumerate(group_cols)]
    out = local.withColumn("_sw_here", how("_sw_v").over(inside)).join(ends, on=same, how="left")
    return out.withColumn(name, _merge(how, F.col("_sw_before"), F.col("_sw_here"))).select(*df.columns, name)


def _merge(how, a: Column, b: Column) -> Column:
    """Two parts of a running aggregate as one."""
    if how is F.sum:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if how is F.max:
        return F.greatest(a, b)
    if how is F.min:
        return F.least(a, b)
    raise ValueError("a running aggregate is a sum, a maximum or a minimum")
