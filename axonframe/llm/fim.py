"""Fill-in-the-middle order of texts, with Spark SQL functions alone: one pass, nothing is shuffled.

regexp_extract_all cuts a text into lines, conv and substring of sha2 give two cuts and the form, slice and array_join
build prefix, middle and suffix. The sentinels split an output into its three parts again, which restores the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import fresh

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
UNITS = r"[^\n]*\n|[^\n]+"


def _drawn(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits, as an unsigned number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _check(sentinels: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none may be empty, or overlap itself or another."""
    overlap = any(a[k:] and b.startswith(a[k:]) for a in sentinels for b in sentinels for k in range(1, len(a)))
    if not all(sentinels) or len(set(sentinels)) < 3 or overlap or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("sentinels must be three different texts of which none holds the beginning of another")


def with_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS, whole: bool = False) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output): every text in lines, cut in three, and arranged; whole: also row, all columns of df.

    form: plain where the text is empty or holds a sentinel, or is drawn with probability 1 - rate / 100; else spm with
    probability spm_rate / 100 and psm for the rest. A null text is empty; a null id is drawn like an empty one; an empty
    table gives no rows; repeated rows are arranged alike. A text of one line is cut before or behind it.
    """
    _check(sentinels)
    p, s, m = map(F.lit, sentinels)
    doc_id, text = df[id_col].cast("long"), F.coalesce(df[text_col].cast("string"), F.lit(""))
    row = [F.struct(*(df[c].alias(c) for c in df.columns)).alias("row")] if whole else []
    kept = ["row"] * whole + ["doc_id", "text", "n", "form"]
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    docs = df.select(*row, doc_id.alias("doc_id"), text.alias("text"), digest.alias("digest"), F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)).alias("units"))
    docs = docs.select("*", F.size("units").cast("long").alias("n"), *(_drawn(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)))
    places = [F.pmod(F.col(h), F.col("n") + 1).cast("int") for h in ("h1", "h2")]
    plain = (F.col("n") == 0) | F.contains("text", p) | F.contains("text", s) | F.contains("text", m) | (F.pmod("h3", F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < spm_rate, "spm").otherwise("psm")
    docs = docs.select("*", form.alias("form"), F.least(*places).alias("a"), F.greatest(*places).alias("b"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, size), ""))
    docs = docs.select(*kept, part(F.lit(0), F.col("a")).alias("prefix"), part(F.col("a"), F.col("b") - F.col("a")).alias("middle"), part(F.col("b"), F.col("n").cast("int") - F.col("b")).alias("suffix"))
    arranged = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return docs.withColumn("output", arranged)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from. The first sentinel opens it, and each other one is met once."""
    _check(sentinels)
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(order)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with its texts arranged (a null one becomes empty) and the form added as fim_form, or a free name like it; all other columns stay. Nulls and options are those of with_forms."""
    made = with_forms(docs, id_col, text_col, whole=True, **options)
    columns = [F.col("output").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return made.select(*columns, F.col("form").alias(fresh(docs, "fim_form")))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars (code points; null where plain), output_sha256, restored_sha256. Nulls and options are those of with_forms."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    made = with_forms(docs, id_col, text_col, **options).select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "output")
    back = restored(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
