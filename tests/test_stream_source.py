"""The submission stream reads a table that is one file, and one that is a folder of files."""

import __spark_entry__ as entry


def test_submissions_of_a_file_and_of_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id bigint, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "many" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for folder in ("many", "one"):
        assert entry.queries()["m3_dedupe_submissions"](spark, str(tmp_path / folder)).count() == 5
