"""One schema for all findings, and the operators on them: filter, validate, deduplicate, rank, count, score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from .numbering import numbered

COLUMNS = ["site", "ord", "skill", "id", "category", "title", "severity", "confidence", "evidence", "affected_urls", "action_summary", "action_priority"]


def lookup(table: dict[str, object], key: Column, kind: str) -> Column:
    """A value of a small fixed table; null for keys that it lacks."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key).cast(kind)


def rank(severity: Column) -> Column:
    return F.coalesce(lookup(lex.SEVERITY_RANK, severity, "int"), F.lit(0))


def order(skill: int, rule: int, page: Column | None = None, part: Column | None = None) -> Column:
    """The place of a finding among those of its site."""
    zero = F.lit(0).cast("long")
    return F.struct(F.lit(skill).alias("skill"), F.lit(rule).cast("long").alias("rule"), (page if page is not None else zero).cast("long").alias("page"), (part if part is not None else zero).cast("long").alias("part"))


def made(rows: DataFrame, ord_: Column, skill: str, id_: Column | str, category: str, title: Column | str, severity: Column | str, confidence: Column | float, evidence: Column, urls: Column, action: Column | str) -> DataFrame:
    """Findings from the rows of a rule."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    columns = dict(ord=ord_, skill=lit(skill), id=lit(id_), category=lit(category), title=lit(title), severity=lit(severity), confidence=lit(confidence).cast("double"), evidence=evidence, affected_urls=urls, action_summary=lit(action), action_priority=lit(severity))
    return rows.select("site", *[c.alias(k) for k, c in columns.items()]).select(*COLUMNS)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def confident(findings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Drops findings below the threshold; technical ones are always kept."""
    return findings.filter((F.col("category") == "technical") | (F.col("confidence") >= threshold))


def distinct_within_skill(findings: DataFrame) -> DataFrame:
    """Of findings of a site with equal id, category and set of URLs, the first."""
    key = F.array_join(F.array_sort(F.array_distinct("affected_urls")), "\n")
    best = Window.partitionBy("site", "id", "category", key).orderBy("ord")
    technical = findings.filter("category = 'technical'")
    return findings.filter("category <> 'technical'").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n").unionByName(technical)


def validated(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings that have evidence, id and title and name a known page, or share a part of a URL with the least one.

    ``known``: ``site, url``.  Each URL of a finding is looked up by a join; URLs are compared in lower case without
    slashes at the end.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    sound = findings.filter((F.length(F.trim("evidence")) >= 5) & (F.col("id") != "") & (F.col("title") != ""))
    rows = sound.withColumn("_url", F.explode_outer("affected_urls"))
    keys = known.select("site", bare(F.col("url")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    least = known.groupBy("site").agg(F.min(F.lower("url")).alias("_least"))
    met = rows.withColumn("_key", bare(F.col("_url"))).join(keys, ["site", "_key"], "left").join(least, "site", "left")
    near = F.contains(F.lower("_url"), F.col("_least")) | F.contains(F.col("_least"), F.lower("_url"))
    ok = F.bool_or(F.coalesce(F.col("_known"), near, F.lit(False)) | F.col("_url").isNull() | F.col("_least").isNull())
    names = [c for c in COLUMNS if c not in ("site", "ord")]
    return met.groupBy("site", "ord", "id").agg(ok.alias("_ok"), *[F.first(c).alias(c) for c in names if c != "id"]).filter("_ok").select(*COLUMNS)


#: Characters of the pieces by which a text that is surely no part of what is joined is told.
_PIECE = 16


def joined_evidence(texts: Iterable[str | None]) -> str | None:
    """Different texts joined by bars in order; one that is a part of what is joined before it is left out.

    Pieces of what is joined are marked in bits.  A text with an unmarked piece is no part of it, and only others are searched
    for, so that the time grows with the length of the texts and not with its square.
    """
    some = list(dict.fromkeys(texts))
    if None in some:
        return None
    marks = bytearray(4 * sum(map(len, some)) + 1)
    size = 8 * len(marks)
    spots = lambda x: (hash(x[i : i + _PIECE]) % size for i in range(len(x) - _PIECE, -1, -1))
    whole, fresh = "", []
    tail = ""
    for e in some:
        if tail:
            if all(marks[k >> 3] >> (k & 7) & 1 for k in spots(e)):
                whole, fresh = "".join([whole, *fresh]), []
                if e in whole:
                    continue
            e = f" | {e}"
        fresh.append(e)
        tail += e
        for k in spots(tail):
            marks[k >> 3] |= 1 << (k & 7)
        tail = tail[1 - _PIECE :]
    return "".join([whole, *fresh])


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding for each (id, category) of a site, equivalent ids of two skills being one.

    The first gives id, title and action; severity (and the action's priority) and confidence are the greatest;
    URLs are united in order; evidence is joined unless a part of what is there.
    """
    # Evidence of a site may be long, so batches are small.
    findings.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))

    @F.pandas_udf("string")
    def joined(texts):  # noqa: ANN001, ANN202
        return texts.map(joined_evidence)

    id_, category = lookup({k: v[0] for k, v in lex.EQUIVALENT.items()}, F.col("id"), "string"), lookup({k: v[1] for k, v in lex.EQUIVALENT.items()}, F.col("id"), "string")
    keyed = findings.withColumns({"_id": F.coalesce(id_, "id"), "_category": F.coalesce(category, "category"), "_rank": rank(F.col("severity"))})
    first = lambda c: F.min_by(c, "ord").alias(c)
    all_ = F.array_sort(F.collect_list(F.struct("ord", "affected_urls", "evidence")))
    merged = keyed.groupBy("site", "_id", "_category").agg(
        F.min("ord").alias("ord"), first("skill"), first("id"), first("category"), first("title"), first("action_summary"), first("action_priority"),
        F.min_by("_rank", "ord").alias("_first_rank"), F.max("_rank").alias("_rank"), F.max_by("severity", "_rank").alias("severity"), F.max("confidence").alias("confidence"), all_.alias("_all"),
    )
    evidence = joined(F.transform("_all", lambda x: x["evidence"]))
    urls = F.array_distinct(F.flatten(F.transform("_all", lambda x: x["affected_urls"])))
    priority = F.when(F.col("_rank") > F.col("_first_rank"), F.col("severity")).otherwise(F.col("action_priority"))
    return merged.withColumns({"evidence": evidence, "affected_urls": urls, "action_priority": priority}).select(*COLUMNS)


def ranked(findings: DataFrame) -> DataFrame:
    """Adds ``place`` within the site: severity, then confidence, falling; then order."""
    by = findings.withColumns({"_rank": -rank(F.col("severity")), "_sure": -F.col("confidence")})
    return numbered(by, ["site"], ["_rank", "_sure", "ord"], "place").drop("_rank", "_sure")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in lex.SEVERITY_RANK])


def score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    lost = sum((F.coalesce(c, F.lit(0)) * F.lit(lex.DEDUCTION[k]) for c, k in ((critical, "critical"), (high, "high"), (medium, "medium"), (low, "low"))), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - lost)), 1)


def grade(value: Column) -> Column:
    out = F.lit("F")
    for least, letter in reversed(lex.GRADES):
        out = F.when(value >= least, letter).otherwise(out)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """Adds ``overall_score`` (0 to 100) and ``grade`` to severity counts."""
    return counts.withColumn("overall_score", score(*[F.col(k) for k in ("critical", "high", "medium", "low")])).withColumn("grade", grade(F.col("overall_score")))


def overall_status(statuses: Column) -> Column:
    """From the statuses of the skills: error if all failed, partial_failure if some did."""
    failed = F.size(F.filter(statuses, lambda s: F.lower(s).rlike("fail|error")))
    return F.when((failed == F.size(statuses)) & (failed > 0), "error").when(failed > 0, "partial_failure").otherwise("success")
