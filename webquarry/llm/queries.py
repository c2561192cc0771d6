"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    # A record that could not be verified shows no digest.
    found = round_trip(table(spark, sf_dir, "pages"))
    return found.withColumn("payload_digest", F.when(F.col("verified"), F.col("payload_digest"))).drop("verified")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import Similarity, classes

    return classes(table(spark, sf_dir, "documents"), Similarity(width=4, least=85, of=100))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import perplexity

    return perplexity(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def _merkle_sql(levels: int = 8, upper: int = 4) -> str:
    """The manifest, level by level: right for groups of up to 8 ** levels rows, and 8 ** upper groups."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    letters = "list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {letters}), lambda c, b: {bits}), 4294967295)"
    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
    row = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"l AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(lowered)} END AS changed FROM documents)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS c, row_number() OVER () AS r FROM l)",
        "t0 AS (SELECT g, i, c, leaf AS h FROM n)",
    ]
    up = "SELECT {g}, i // 8 AS i, (any_value(c) + 7) // 8 AS c, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {of} GROUP BY {g}, i // 8"
    parts += [f"t{k + 1} AS ({up.format(g='g', of=f't{k}')})" for k in range(levels)]
    parts.append(f"u0 AS (SELECT 'all' AS o, g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS c, h FROM t{levels})")
    parts += [f"u{k + 1} AS ({up.format(g='o', of=f'u{k}')})" for k in range(upper)]
    step = (
        "SELECT r, any_value(p.g) AS g, any_value(p.i) // 8 AS i, CASE WHEN any_value(n.c) = 1 THEN any_value(cur) ELSE sha256(string_agg(CASE WHEN n.i = p.i THEN cur ELSE n.h END, '' ORDER BY n.i)) END AS cur, "
        "any_value(proof) || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> p.i), '') AS proof FROM {p} p JOIN {n} n ON {on} AND n.i // 8 = p.i // 8 GROUP BY r"
    )
    parts.append("p0 AS (SELECT r, g, i, coalesce(changed, leaf) AS cur, '' AS proof FROM n)")
    parts += [f"p{k + 1} AS ({step.format(p=f'p{k}', n=f't{k}', on='n.g = p.g')})" for k in range(levels)]
    parts.append(f"q0 AS (SELECT r, p.g, u0.i, cur, proof FROM p{levels} p JOIN u0 ON u0.g = p.g)")
    parts += [f"q{k + 1} AS ({step.format(p=f'q{k}', n=f'u{k}', on='true')})" for k in range(upper)]
    return f"""WITH {", ".join(parts)}
        SELECT n.doc_id, n.leaf, s.h AS subroot, u.h AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = u.h AS verified
        FROM n JOIN q{upper} q USING (r) JOIN t{levels} s ON s.g = n.g, u{upper} u"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_fingerprints": op4_fingerprints,
    "op5_warc": op5_warc,
    "op6_html_extraction": op6_html_extraction,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_language_model": op10_language_model,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": r"""
        WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, row_number() OVER () AS r FROM documents),
        iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
        i AS (SELECT item_id, least(5, len(ws)) AS w, unnest(list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda k: array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ')))) AS g FROM iw WHERE len(ws) > 0),
        n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
        v AS (SELECT DISTINCT w FROM i),
        d AS (SELECT DISTINCT r, doc_id, w, unnest(list_transform(range(1, len(ws) - w + 2), lambda k: array_to_string(ws[k:k + w - 1], ' '))) AS g FROM dw, v WHERE len(ws) >= w),
        m AS (SELECT d.r, d.doc_id, i.item_id, count(*) AS s FROM d JOIN i ON d.g = i.g AND d.w = i.w GROUP BY ALL)
        SELECT m.doc_id, m.item_id, CAST(n.n AS INTEGER) AS n_item_shingles, CAST(m.s AS INTEGER) AS n_shared, m.s / n.n AS containment
        FROM m JOIN n USING (item_id) WHERE m.s >= 0.8 * n.n""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                   ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS ss
            FROM w),
        c AS (SELECT list_sort(ss) AS ss, min(doc_id) AS rep, len(any_value(ss)) AS n FROM s WHERE len(ss) > 0 GROUP BY 1),
        x AS (SELECT rep, n, unnest(ss) AS g FROM c),
        o AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i
              FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
        e AS (SELECT a, b FROM o WHERE 100 * i >= 85 * (n + m - i)),
        both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(v, u) AS (SELECT rep, rep FROM c UNION SELECT r.v, b.b FROM r JOIN both_ways b ON b.a = r.u),
        l AS (SELECT v, min(u) AS component_id FROM r GROUP BY 1)
        SELECT s.doc_id, CAST(len(s.ss) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
        FROM s LEFT JOIN c ON len(s.ss) > 0 AND c.ss = list_sort(s.ss) LEFT JOIN l ON l.v = c.rep""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op12_merkle_manifest": _merkle_sql(),
}
