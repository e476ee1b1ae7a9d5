"""The stream of words over documents that are one file or a folder of files."""

import pytest

import __spark_entry__ as contract

TEXTS = ["to be or not", "to be", "be it so"]


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_wordcount_reads_a_file_and_a_folder(spark, tmp_path, files):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = tmp_path / "documents.parquet"
    if files:
        docs.repartition(files).write.parquet(str(path))
    else:
        docs.toPandas().to_parquet(path)
    docs.write.parquet(str(tmp_path / "others.parquet"))
    got = contract.queries()["stream_wordcount"](spark, str(tmp_path)).collect()
    assert {r["word"]: r["count"] for r in got} == {"to": 2, "be": 3, "or": 1, "not": 1, "it": 1, "so": 1}
