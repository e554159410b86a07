"""Importance resampling towards a target: word n-grams from a position table, hashed to buckets, weighed and drawn.

posexplode gives a row for each word; lead() over a document's positions puts the following words beside it, so that each
row holds the n-grams that begin there, of all orders. Texts are dealt by row before they are exploded: the windows need
no further shuffle, and what is dealt is each text once. The buckets of all positions are written down; counting them and
joining their gains reads numbers only. Gains are one row for each bucket, whatever the size of the corpus.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.llm.common import written

BUCKETS, ORDERS, SEED = 10_000, 3, 42
#: Documents with fewer words are never drawn; so many of a hundred others are.
MIN_WORDS, DRAWN = 20, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else unchanged."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def positions(rows: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """rows(row, doc_id, text) -> (row, doc_id, b1, b2, ..): a row for each word, with the buckets of the n-grams of each order that begin there, null where the text ends before; one row of nulls for a text without words."""
    words = F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0))
    dealt = rows.repartition("row").select("row", "doc_id", F.posexplode_outer(words).alias("pos", "word"))
    order = Window.partitionBy("row").orderBy("pos")
    table = dealt.select("row", "doc_id", F.col("word").alias("w1"), *(F.lead("word", k).over(order).alias(f"w{k + 1}") for k in range(1, orders)))
    gram = lambda k: F.concat(*[x for i in range(1, k + 1) for x in (F.lit(" "), F.col(f"w{i}"))][1:])
    return table.select("row", "doc_id", *(F.pmod(F.crc32(F.encode(gram(k), "UTF-8")), F.lit(buckets)).cast("int").alias(f"b{k}") for k in range(1, orders + 1)))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def _features(table: DataFrame) -> DataFrame:
    return table.select("row", "doc_id", F.col("b1").isNotNull().alias("word"), F.posexplode(F.array(*(c for c in table.columns if c[0] == "b"))).alias("order", "bucket"))


def bucket_counts(table: DataFrame) -> DataFrame:
    """(bucket, n) of a table of positions; at most as many rows as there are buckets."""
    return _features(table).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets: floor(1000 ln of the ratio of smoothed shares), from two tables of bucket_counts."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("of"))
    named = [df.select(F.col("bucket").alias(f"{x}_bucket"), F.col("n").alias(x)) for x, df in (("s", corpus), ("t", target))]
    both = every.join(F.broadcast(named[0]), F.col("of") == F.col("s_bucket"), "left").join(F.broadcast(named[1]), F.col("of") == F.col("t_bucket"), "left")
    totals = [F.broadcast(df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"all_{x}"))) for x, df in (("s", corpus), ("t", target))]
    real = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (real("t") + 1) * (real("all_s") + buckets) / ((real("s") + 1) * (real("all_t") + buckets))
    return both.join(totals[0]).join(totals[1]).select(F.col("of").alias("gain_bucket"), F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row per row of docs: the sum of its features' gains."""
    table = written(positions(_rows(docs, id_col, text_col), orders, buckets), "positions")
    asked = written(bucket_counts(positions(_rows(target, target_id, target_text), orders, buckets)), "target")
    gain = written(gains(bucket_counts(table), asked, buckets), "gains")
    met = _features(table).join(F.broadcast(gain), F.col("bucket") == F.col("gain_bucket"), "left")
    per_row = met.groupBy("row", "doc_id").agg(F.count_if(F.expr("order = 0 AND word")).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return per_row.select("doc_id", "n_words", "n_features", "weight")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel value) drawn by the id; a null id is drawn like an empty one."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = DRAWN, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (from 1; null if not drawn).

    Drawn are floor(percent N / 100) of the N documents with min_words words or more: the highest scores, ties to the
    smaller id, null ids last, repeated rows in any order among themselves. Null and empty texts have no feature, weight
    zero and are not drawn; an empty table gives no rows; an empty target gains nothing anywhere but by its smoothing.
    Other columns are ignored, whatever their names. Ranks are sums over range partitions: no task orders all rows.
    """
    scored = weighed(docs, target, id_col, text_col, target_id, target_text, orders, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= min_words
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = scored.withColumn("able", fit.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("of_part")).agg(F.count(F.lit(1)).alias("size"), F.sum("able").alias("able_rows"))
    ahead = Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    starts = sizes.select("of_part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"), F.floor(F.sum("able_rows").over(Window.partitionBy()) * percent / 100).alias("most"))
    rank = F.col("before") + F.col("place") - F.shiftleft(part, 33) + 1
    joined = placed.join(F.broadcast(starts), part == F.col("of_part"))
    return joined.select("doc_id", "n_features", "weight", "score", F.when((F.col("able") == 1) & (rank <= F.col("most")), rank).alias("rank"))
