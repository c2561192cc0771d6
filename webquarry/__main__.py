"""``python -m webquarry TARGET``: audits a table of pages (Parquet) or a site snapshot (JSON)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.audit import Options, audit_sites, json_lines, markdown_lines, write_reports
from .sources import snapshots


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="webquarry", description=__doc__)
    parser.add_argument("target")
    parser.add_argument("--format", choices=["json", "markdown"], default="json")
    parser.add_argument("--threshold", type=float, default=0.7)
    parser.add_argument("--skill", choices=["technical", "trust", "engagement"], action="append")
    parser.add_argument("--max-pages", type=int, help="judge only the pages that a crawl from each homepage visits, at most so many")
    parser.add_argument("--max-depth", type=int, default=2, help="clicks from the homepage that the crawl goes")
    parser.add_argument("--output", help="folder for the reports, a folder for each site in it; else they are printed")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("webquarry").getOrCreate()
    pages = snapshots.pages(snapshots.read(spark, given.target)) if given.target.endswith(".json") else spark.read.parquet(given.target)
    audit = audit_sites(pages, Options(confidence_threshold=given.threshold, skills=tuple(given.skill or ("technical", "trust", "engagement")), max_pages=given.max_pages, max_depth=given.max_depth))
    if given.output:
        write_reports(audit, given.output, given.format)
    else:
        for row in (json_lines if given.format == "json" else markdown_lines)(audit).orderBy("site", "section", "place").toLocalIterator():
            print(row.line)


if __name__ == "__main__":
    main()
