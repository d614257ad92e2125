"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from parlance.catalog import queries
from parlance.operators import glossary, retrieval
from parlance.sources import tables

FOLDER = "/root/testdata/sf0.001"
# streams run when they are built; their plans are those of the written files
BATCH = sorted(n for n in queries() if not n.startswith("st"))


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_workspace_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2, "x"), (2, 3, "y")], "workspace_id int, n int, unused string").write.parquet(str(tmp_path / "t"))
    text = plan(tables.scan(spark, str(tmp_path / "t"), [1], ["workspace_id", "n"]))
    assert "PushedFilters: [In(workspace_id, [1])" in text or "EqualTo(workspace_id,1)" in text
    assert "ReadSchema: struct<workspace_id:int,n:int>" in text


def test_partition_pruning(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 3)], "workspace_id int, n int").write.partitionBy("workspace_id").parquet(str(tmp_path / "t"))
    assert "PartitionFilters: [isnotnull(workspace_id" in plan(tables.scan(spark, str(tmp_path / "t"), [1]))


def test_top_terms_are_cut_before_the_shuffle(spark):
    from parlance.catalog.inputs import Inputs

    text = plan(glossary.top_terms(Inputs(spark, FOLDER)["fx_glossary"]), "simple")
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")     # partial and final
    assert text.rindex("WindowGroupLimit") > text.index("Exchange")             # the partial one is below


def test_document_labels_need_no_shuffle(spark):
    from parlance.operators import chunking, documents

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.lit(1).alias("workspace_id"), "text")
    classified = documents.classify(documents.with_blocks(rows, r"\n+"))
    assert "Exchange" not in plan(classified, "simple")
    assert "Exchange" not in plan(chunking.chunk_documents(classified), "simple")


def test_scope_column_filters_inside_the_search(spark):
    chunks = spark.createDataFrame([(i, i % 3, 1, [float(i), 1.0]) for i in range(9)], "chunk_id bigint, document_id bigint, workspace_id bigint, embedding array<double>")
    asked = chunks.filter("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), "workspace_id", "embedding", F.array(F.lit(2).cast("bigint")).alias("scope"))
    assert {r.document_id for r in retrieval.nearest(asked, chunks, 5).collect()} == {2}
