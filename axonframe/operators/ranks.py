"""Ranks and exact quantiles without a task that holds a whole group or column: range partitions are counted, and few of them are read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.shared import fresh, stored


def ranked(df: DataFrame, key: str, *order: Column, rank: str = "rank", size: str = "size") -> DataFrame:
    """df with each row's place in its key's group by order (from 1), and the group's size; null is a key like others.

    Rows are dealt by range of key and order, so that a hot group lies in many partitions; each adds the group's rows in
    the partitions before it, known from one count for each key and partition. The ranges are written down once: made
    again, they could fall elsewhere.
    """
    place, part, of, at = (fresh(n, df) for n in ("place", "part", "of", "at"))
    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn(place, F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn(part, F.shiftright(place, 33)), "ranged")
    runs = ranged.groupBy(F.col(key).alias(of), F.col(part).alias(at)).agg(F.min(place).alias("first_place"), F.count(F.lit(1)).alias("run"))
    ahead = Window.partitionBy(of).orderBy(at)  # as many rows as the group has partitions
    runs = runs.select(of, at, "first_place", F.coalesce(F.sum("run").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_before"), F.sum("run").over(Window.partitionBy(of)).alias("run_all"))
    joined = ranged.join(runs, F.col(key).eqNullSafe(F.col(of)) & (F.col(part) == F.col(at)))
    return joined.select(*df.columns, (F.col(place) - F.col("first_place") + F.col("run_before") + 1).alias(rank), F.col("run_all").alias(size))


def quantiles(df: DataFrame, columns, at) -> DataFrame:
    """One row: an array of exact quantiles for each column, interpolated between the two nearest values; nulls don't count, NaN is the greatest value, and a column without values gives nulls.

    Equal values are counted together before they are dealt by range of column and value. The counts of the partitions
    tell which of them hold the asked ranks; those alone are read a second time, and two values for each rank are left.
    """
    columns, at = list(columns), [float(q) for q in at]
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles lie between 0 and 1")
    stacked = df.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("column", "value")).where("value IS NOT NULL")
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    runs = ranged.groupBy(F.col("column").alias("of"), F.col("part").alias("in_part")).agg(F.sum("n").alias("run"))
    by_part = Window.partitionBy("of").orderBy("in_part")  # one row for each range partition
    runs = runs.withColumns({"run_before": F.coalesce(F.sum("run").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("run").over(Window.partitionBy("of"))})
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(q).alias("q")) for i, q in enumerate(at)))).alias("a")
    ranks = runs.select("of", "in_part", "run", "run_before", "total", asked).withColumn("exact", F.col("a.q") * (F.col("total") - 1))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("upper"), F.floor("exact").alias("rank")), F.struct(F.lit(1).alias("upper"), F.ceil("exact").alias("rank")))).alias("s")
    ranks = ranks.select("of", "in_part", "run_before", F.col("run"), F.col("a.i").alias("i"), "exact", sides).select("of", "in_part", "run_before", "run", "i", "exact", "s.upper", "s.rank")
    # No more rows than two for each column and quantile.
    ranks = stored(ranks.where((F.col("rank") >= F.col("run_before")) & (F.col("rank") < F.col("run_before") + F.col("run"))), "ranks")
    some = ranks.select("of", "in_part", "run_before").distinct()
    held = ranged.join(F.broadcast(some), (F.col("column") == F.col("of")) & (F.col("part") == F.col("in_part")))
    running = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # within one range partition
    upto = held.select("column", "part", "value", (F.col("run_before") + F.sum("n").over(running)).alias("upto"), "n")
    found = upto.join(F.broadcast(ranks), (F.col("column") == F.col("of")) & (F.col("part") == F.col("in_part")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    pairs = found.groupBy("column", "i").agg(F.max(F.when(F.col("upper") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("upper") == 1, F.col("value"))).alias("high"), F.max("exact").alias("exact"))
    share = F.col("exact") - F.floor("exact")
    value = F.when(share == 0, F.col("low")).otherwise(F.col("low") * (1 - share) + F.col("high") * share)
    row = pairs.agg(*(F.max(F.when((F.col("column") == c) & (F.col("i") == i), value)).alias(f"v{c}_{i}") for c in range(len(columns)) for i in range(len(at))))
    return row.select(*(F.array(*(F.col(f"v{c}_{i}") for i in range(len(at)))).alias(name) for c, name in enumerate(columns)))


def running_before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with out: the sum of value over all rows before each one, by order (nulls of value count nothing). Range partitions are summed; each adds the sums before it to those of its own rows."""
    part, of = fresh("part", df), fresh("of", df)
    ranged = stored(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn(part, F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(F.col(part).alias(of)).agg(F.sum(value).alias("run"))
    before = sums.select(of, F.coalesce(F.sum("run").over(Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_before"))  # one row for each range partition
    own = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = ranged.withColumn(out, own).join(F.broadcast(before), F.col(part) == F.col(of))
    return held.select(*(c for c in df.columns if c != out), (F.col(out) + F.col("run_before")).alias(out))
