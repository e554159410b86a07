"""Domain tables, as projections of general star-schema tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIN = "2024-01-15 00:00:00"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def annotations(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "duplicate").when(F.col("o_orderstatus") == "O", "ok")
        return self.table("orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("root_id"), status.alias("status"), F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("price"))

    def hierarchy(self) -> DataFrame:
        side = F.when(F.col("p_size") % 3 == 0, "L").when(F.col("p_size") % 3 == 1, "R")
        columns = {"root_id": "p_partkey", "hemilineage": "p_brand", "superclass": "p_type", "class": "p_brand"}
        brand = F.when(F.col("p_brand") != "Brand#1", F.col("p_brand"))
        return self.table("part").select(*[F.col(c).alias(n) for n, c in columns.items()], F.col("p_size").cast("string").alias("subclass"), F.lit("x").alias("subsubclass"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("instance"), brand.alias("type"), side.alias("side"))

    def synapses(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("pre_root"), F.col("l_partkey").alias("post_root"))

    def nuclei(self) -> DataFrame:
        position = F.concat_ws(",", F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 3), F.col("l_linenumber"))
        return self.table("lineitem").select((F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("id"), F.nullif(F.col("l_orderkey"), F.lit(7)).alias("pt_root_id"), F.when(F.col("l_partkey") % 11 != 0, position).alias("pt_position"), F.col("l_extendedprice").alias("volume"))

    def chunks(self) -> DataFrame:
        """One level-2 chunk per row of lineitem that is the least of its key."""
        rows = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"), F.struct("l_extendedprice", "l_partkey", "l_suppkey")).alias("r"))
        r = lambda c: F.col("r")[c]
        return rows.select(
            F.col("l_orderkey").alias("root_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l2_id"), (r("l_quantity") * 10).alias("rep_coord_nm_x"), r("l_suppkey").cast("double").alias("rep_coord_nm_y"), (F.col("l_linenumber") * 45.0).alias("rep_coord_nm_z"),
            r("l_extendedprice").alias("area_nm2"), (r("l_quantity") - 2).alias("size_nm3"), F.nullif(r("l_quantity"), F.lit(7.0)).alias("max_dt_nm"), (r("l_extendedprice") / 3).alias("mean_dt_nm"), r("l_discount").alias("pca_val_0"), r("l_tax").alias("pca_val_2"),
        )

    def log(self) -> DataFrame:
        who = F.when(F.col("user_id") % 4 == 0, "auto").when(F.col("user_id") % 4 == 1, "Cambridge lab").when(F.col("user_id") % 4 == 2, "Wei lab")
        e, n = F.col("event_id"), F.lit(",")
        sink = F.when(e % 7 == 0, F.lit("NA")).otherwise(F.concat(e % 10, n, e % 11, n, e % 12, n, e % 13, n, e % 14, n, e % 15))
        source = F.when(e % 5 != 0, F.concat(e % 16, n, e % 17, n, e % 18))
        return self.table("events").select(e.cast("int").alias("operation_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("user"), who.alias("user_affiliation"), F.col("event_type").alias("status"), sink.alias("sink_coords"), source.alias("source_coords"))

    def history(self) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("user_id").alias("supervoxel_id"), F.col("event_id").alias("root_id"), F.col("ts").cast("timestamp").alias("valid_from"), F.lead(F.col("ts").cast("timestamp")).over(order).alias("valid_to"))

    def neurons(self) -> DataFrame:
        side = F.expr("element_at(array('l', 'R', 'x', 'U', 'm'), cast(c_nationkey % 5 + 1 as int))")
        return self.table("customer").select(F.col("c_custkey").alias("root_id"), F.col("c_custkey").alias("_id"), F.nullif(side, F.lit("x")).alias("side"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 10.0).alias("y"), F.lit(5.0).alias("z"))

    def skeletons(self) -> DataFrame:
        """A tree per customer: the customer's orders in order of their keys, each below the one of half its number."""
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        rows = self.table("orders").select(F.col("o_custkey").alias("root_id"), rank.alias("node_id"), (F.col("o_orderkey") % 1000).cast("double").alias("x"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("y"), F.length("o_orderpriority").cast("double").alias("z"), F.lit(1.0).alias("w"))
        parent = F.when(F.col("node_id") == 1, -1).otherwise(F.floor(F.col("node_id") / 2)).cast("int")
        return rows.select("root_id", "node_id", parent.alias("parent_id"), "x", "y", "z", "w")


#: The same projections for SQL, as common table expressions.
CTE = {
    "annotations": "SELECT o_orderkey AS _id, o_custkey AS root_id, CASE o_orderstatus WHEN 'F' THEN 'duplicate' WHEN 'O' THEN 'ok' END AS status, o_orderpriority AS class, o_totalprice AS price FROM orders",
    "hierarchy": "SELECT p_partkey AS root_id, p_brand AS hemilineage, p_type AS superclass, p_brand AS class, p_size::VARCHAR AS subclass, 'x' AS subsubclass, CASE WHEN p_size > 25 THEN p_name END AS instance, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS type, CASE WHEN p_size % 3 = 0 THEN 'L' WHEN p_size % 3 = 1 THEN 'R' END AS side FROM part",
    "nuclei": "SELECT l_partkey * 100 + l_suppkey % 100 AS id, nullif(l_orderkey, 7) AS root_id, CASE WHEN l_partkey % 11 <> 0 THEN concat_ws(',', l_quantity::INT, l_suppkey % 3, l_linenumber) END AS position, l_extendedprice AS volume FROM lineitem",
    "chunks": """SELECT l_orderkey AS root_id, l_orderkey * 10 + l_linenumber AS l2_id, l_quantity * 10 AS rep_coord_nm_x, l_suppkey::DOUBLE AS rep_coord_nm_y, l_linenumber * 45.0::DOUBLE AS rep_coord_nm_z,
        l_extendedprice AS area_nm2, l_quantity - 2 AS size_nm3, nullif(l_quantity, 7.0::DOUBLE) AS max_dt_nm, l_extendedprice / 3 AS mean_dt_nm, l_discount AS pca_val_0, l_tax AS pca_val_2
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1""",
    "features": """SELECT root_id, l2_id, ln(1 + CASE WHEN area_nm2 > 0 THEN area_nm2 WHEN area_nm2 <= 0 THEN 0 END) AS log_area, ln(1 + CASE WHEN size_nm3 > 0 THEN size_nm3 WHEN size_nm3 <= 0 THEN 0 END) AS log_size,
        ln(1 + CASE WHEN max_dt_nm > 0 THEN max_dt_nm WHEN max_dt_nm <= 0 THEN 0 END) AS log_max_dt, ln(1 + CASE WHEN mean_dt_nm > 0 THEN mean_dt_nm WHEN mean_dt_nm <= 0 THEN 0 END) AS log_mean_dt, CASE WHEN pca_val_0 > 0 THEN pca_val_2 / pca_val_0 END AS roundness, pca_val_0, rep_coord_nm_x FROM chunks""",
    "log": """SELECT event_id::INT AS operation_id, ts AS timestamp, user_id AS user, CASE user_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'Cambridge lab' WHEN 2 THEN 'Wei lab' END AS user_affiliation, event_type AS status FROM events""",
    "history": "SELECT user_id AS supervoxel_id, event_id AS root_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events",
    "neurons": "SELECT c_custkey AS root_id, c_custkey AS _id, nullif(['l', 'R', 'x', 'U', 'm'][c_nationkey % 5 + 1], 'x') AS side, c_acctbal AS x FROM customer",
    "skeletons": """SELECT root_id, node_id, CASE WHEN node_id = 1 THEN -1 ELSE (node_id // 2)::INT END AS parent_id, x, y, z FROM (SELECT o_custkey AS root_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS node_id,
        (o_orderkey % 1000)::DOUBLE AS x, floor(o_totalprice / 1000)::DOUBLE AS y, length(o_orderpriority)::DOUBLE AS z FROM orders)""",
}
_NEEDS = {"features": ("chunks",)}


def with_tables(*names: str) -> str:
    order: list[str] = []
    for n in names:
        order += [m for m in (*_NEEDS.get(n, ()), n) if m not in order]
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " "
