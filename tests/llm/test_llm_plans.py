import re

import pytest

from axonframe.llm import queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_runs_no_python(spark):
    assert not re.search("Python|Pandas|Arrow", plan(queries.op2_chunk_dedup(spark, SF)))


@pytest.mark.parametrize("name", ["op1_token_orc", "op2_chunk_dedup", "op4_suffix_trees", "op5_best_fit_packing", "op6_secrets", "op8_simhash"])
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", plan(queries.QUERIES[name](spark, SF)))


def test_texts_alone_are_read(spark):
    text = plan(queries.op6_secrets(spark, SF))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_orc_files_hold_indexes_and_skip_by_id(spark, tmp_path):
    from axonframe.llm import token_orc

    path = str(tmp_path / "tokens")
    token_orc.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path)
    one = token_orc.read_tokens(spark, path).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in plan(one) and one.count() == 1
    jvm = spark.sparkContext._jvm
    files = [f for f in tmp_path.joinpath("tokens").iterdir() if f.suffix == ".orc"]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getNumberOfRows() > 0 and reader.getRowIndexStride() == 1000
    kinds = [s.getKind().toString() for stripe in reader.getStripes() for s in reader.rows().readStripeFooter(stripe).getStreamsList()] if hasattr(reader.rows(), "readStripeFooter") else []
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)
    few = spark.createDataFrame([(i, "some words") for i in range(50)] + [(10**9 + i, "other words") for i in range(50)], "doc_id long, text string")
    token_orc.write_tokens(few, str(tmp_path / "few"))
    high = token_orc.read_tokens(spark, str(tmp_path / "few")).where("doc_id >= 1000000000")
    assert high.count() == 50
