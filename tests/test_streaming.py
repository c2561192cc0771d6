"""Pages that arrive in files, batch by batch, against the same pages at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from webquarry.operators import relations, technical
from webquarry.streaming.ingest import audit_stream, page_stream


def test_stream_of_pages_has_the_issues_of_the_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        audit_stream(page_stream(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = technical.page_issues(relations.parse_pages(pages))
    key = lambda df: sorted(map(tuple, df.select("page_id", "code", "severity").collect()))
    assert key(got) == key(want) and got.select(F.count_distinct("batch")).first()[0] == 3
