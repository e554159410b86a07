"""Exact duplicates by content-defined chunk recipes, with DataFrame functions alone.

A text is cut where its own bytes say so, so that equal passages give equal chunks wherever they stand. Each chunk's
content is moved once, to check that its 128-bit identifier stands for one content only. From then on a document is its
ordered list of identifiers; texts are equal when the lists are, and no text moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import fresh, texts_of, with_groups, written

MIN_CHUNK, MAX_CHUNK = 256, 4096


def _bytes_class(modulus: int, remainder: int) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b % modulus == remainder) + "]"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Array of chunks: `least` to `most` bytes up to the first place where four bytes fall in fixed residue classes. Concatenated, they are the text (its UTF-8 bytes, one character each)."""
    cut = (_bytes_class(4, 1) + _bytes_class(8, 4)) * 2
    pattern = f"(?s).{{{least},{most}}}?{cut}|.{{1,{most}}}"
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(pattern), F.lit(0))


def _identifiers() -> list:
    """From short to long: 128 bits as two longs, then the digest as four. The next is taken where two contents share one."""
    part = lambda c, i: F.conv(F.substring(F.sha2(c, 256), 16 * i + 1, 16), 16, -10).cast("long")
    return [lambda c: F.array(F.xxhash64(c), F.xxhash64(F.lit(1), c)), lambda c: F.array(*(part(c, i) for i in range(4)))]


def verified_identifier(texts: DataFrame, identifiers: list | None = None):
    """The first identifier under which no two different chunks of the table meet. Chunks are merged before they are shuffled, so a chunk that many documents share is not hot. At 10 ** 11 chunks the first has a collision with probability 2e-17, so that contents move once."""
    for identify in identifiers or _identifiers():
        distinct = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(identify(F.col("chunk")).alias("key"), "chunk").distinct()
        shared = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if shared.isEmpty():
            return identify
    raise ValueError("two different chunks share every identifier")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, no change made; null is the empty text. Of equal texts the largest doc_id stays.
    Null ids lose to others (keep_id is null where all are); rows that share id and text are indistinguishable and are
    kept or dropped together. An empty table gives no rows. Other columns are ignored, whatever their names. Recipes are
    written once to the shared folder and grouped there; the copies of a hot text are dealt over all partitions.
    """
    texts = texts_of(docs, id_col, text_col)
    identify = verified_identifier(texts)
    recipe = F.flatten(F.transform(chunks(F.col("text")), identify))
    listed = written(texts.select("doc_id", recipe.alias("recipe"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")), "recipes")
    groups = listed.groupBy(F.col("recipe").alias("group_recipe")).agg(F.max("doc_id").alias("top_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = with_groups(listed, groups, {"recipe": "group_recipe"}, "n", listed.count(), "doc_id")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, all columns, whatever their names. Ids name documents here: of rows that share an id all stay if one does. A null id stays where its whole group has none; a null text is empty. An empty table stays empty."""
    name = fresh(docs, "keep")
    keep = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(F.col(name)), "left_semi")
