"""One query per operator over its whole table, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import binary_ids, collocations, contamination, jaccard, language, line_index, lm, mixing, private_data, quality, substrings, vector_codes, warc
from palimpsest.llm.tables import lean

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return binary_ids.ids_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_report(table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_report(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compression_report(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.line_report(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_ngram_jaccard, op2_decontamination, op3_substring_dedup, op4_warc, op5_language_id, op6_token_ids, op7_private_data, op8_lm_scores, op9_mix_sources, op10_quality_rules, op11_vector_codes, op12_line_dedup, op13_collocations)}

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _vector_codes_sql(rounds: int = 4) -> str:
    """Plain search: all distances to all entries, in doubles that hold whole numbers exactly."""
    steps = [r"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        d AS (SELECT max(len(v)) // 4 AS w FROM kept),
        p AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1 : (part + 1) * w] AS x FROM kept, d, range(4) t(part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
          WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, min(x) AS x, min({{'d': d, 'entry': entry}}) AS best FROM (
          SELECT vec_id, p.part, entry, x, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
          FROM p JOIN b{k} b ON b.part = p.part) GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (
          SELECT part, best.entry AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, d, range(1, 1 + w) t(i) GROUP BY ALL) GROUP BY part, entry),
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""WITH {", ".join(steps)},
        h AS (SELECT sha256(string_agg(s, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (
          SELECT part, entry, array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',') AS s FROM b{rounds})),
        e AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM e JOIN kept ON kept.vec_id = e.vec_id, h"""


ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS x FROM p),
        d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest FROM h),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to FROM m""",
    "op9_mix_sources": rf"""
        WITH rows AS (
          SELECT doc_id, source, {WORDS}::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
        w AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
              FROM rows GROUP BY source),
        l AS (SELECT *, s * 3 / weight AS stops,
                (sum(s) OVER () - coalesce(sum(s * 3) OVER (ORDER BY s * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY s * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        n AS (SELECT *, row_number() OVER (ORDER BY stops, source NULLS LAST) AS nth FROM l),
        o AS (SELECT *, min(CASE WHEN stops > level THEN nth END) OVER () AS k FROM n),
        t AS (SELECT source, s, CASE WHEN k IS NULL OR nth < k THEN CAST(s * 3 AS DOUBLE)
                ELSE (SELECT level FROM o z WHERE z.nth = z.k) * weight END AS target FROM o),
        g AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), s * 3) AS wanted FROM t),
        p AS (SELECT *, CASE WHEN s > 0 THEN wanted // s ELSE 0 END AS passes, greatest(1, CAST(ceil(s / 65536) AS BIGINT)) AS blocks FROM g),
        d AS (SELECT r.*, p.s, p.target, p.passes, p.wanted - p.passes * p.s AS rest,
                CAST('0x' || substr(r.key, 1, 12) AS BIGINT) % p.blocks AS block
              FROM rows r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
        c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY block, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
        SELECT doc_id, size, s AS source_size, target,
          CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_line_dedup": r"""
        WITH l AS (SELECT doc_id, i, list_extract(string_split(coalesce(text, ''), chr(10)), i) AS line
              FROM documents, range(1, 1 + len(string_split(coalesce(text, ''), chr(10)))) t(i)),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keeper <> doc_id)::BIGINT AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN s ON s.key = k.key GROUP BY doc_id""",
    "op13_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM w, range(1, 6) a(m), range(1, len(ws) - m + 2) b(i)),
        f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
        c AS (SELECT lang, m, phrase, f AS a, k, array_to_string(ws[1 : k], ' ') AS lp, array_to_string(ws[k + 1 :], ' ') AS rp FROM f, range(1, 5) t(k) WHERE k < m),
        s AS (SELECT c.lang, c.m, c.phrase, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
              FROM c JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp),
        b AS (SELECT lang, m, phrase, a, n, min({'score': score, 'k': k, 'l': l, 'r': r}) AS best FROM s GROUP BY ALL),
        o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND f.f >= b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
        q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank FROM o)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, best.l::BIGINT AS l, best.r::BIGINT AS r, n::BIGINT AS n, best.score::BIGINT AS score FROM q WHERE rank <= 2000""",
}
