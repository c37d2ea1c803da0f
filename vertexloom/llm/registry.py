"""The queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import contamination, exact, langid, licenses, mixing, packing, phrases, pii, quality, simhash, tokens, urlrules, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.url_verdicts(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(_read(spark, sf_dir, "documents"))
    by_pass = [F.col("positions")[p].alias(name) for p, name in enumerate(("position", "second_position"))]
    return mixing.in_training_order(plan.select("doc_id", "size", "source_size", "target", "taken", *by_pass))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "licenses", "n_notices", "notices")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.benchmark_overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "score", "threshold", "accepted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_packing": op13_packing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Phrases of one to five words in pieces of words, a row for each occurrence.
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS m, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM w WHERE len(ws) >= {k})"
    for k in range(1, 6)
)

SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM t""",
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(doc_id::varchar, '')) AS o,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size
            FROM documents),
        s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
        w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight,
                     2 * source_size AS room, sum(source_size) OVER () AS all_size FROM r),
        f AS (SELECT *, (all_size::double * 1.5::double - coalesce(sum(room) OVER (
                             ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
                        / sum(weight) OVER (ORDER BY room / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
              FROM w),
        t AS (SELECT source, source_size, rank, least(room::double, max(l) OVER () * weight) AS target FROM f),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS b
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        k AS (SELECT *, greatest(least(round(target)::bigint - b, size), 0) AS first,
                        greatest(least(round(target)::bigint - source_size - b, size), 0) AS second FROM p),
        due AS (SELECT *, b / target AS d, (b + source_size) / target AS d2 FROM k)
        SELECT doc_id, size, source_size, target, (first + second)::bigint AS taken,
               CASE WHEN first > 0 THEN CASE rank % 3
                   WHEN 0 THEN (sqrt(2.25::double + -2.0::double * d) - 1.5::double) / -1.0::double
                   WHEN 1 THEN d
                   ELSE (sqrt(0.25::double + 2.0::double * d) - 0.5::double) / 1.0::double END END AS position,
               CASE WHEN second > 0 THEN CASE rank % 3
                   WHEN 0 THEN (sqrt(2.25::double + -2.0::double * d2) - 1.5::double) / -1.0::double
                   WHEN 1 THEN d2
                   ELSE (sqrt(0.25::double + 2.0::double * d2) - 0.5::double) / 1.0::double END END AS second_position
        FROM due""",
    "op4_url_filter": r"""
        WITH s AS (
            SELECT page_id, coalesce(url, '') AS url,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM s),
        p AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        f AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
              FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id)
        SELECT p.page_id, host, path, f.rule,
               coalesce(f.v, CASE WHEN regexp_matches(url, '\bspam-?\w*[.-]', 'i') OR regexp_matches(url, '\bspam-farm\b', 'i')
                   OR regexp_matches(url, '\b(online-)?casino\b', 'i') OR regexp_matches(url, '\bporn\w*', 'i')
                   OR regexp_matches(url, '[?&]redirect=https?:', 'i') OR regexp_matches(url, '\.exe([?#]|$)', 'i')
                   THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN f USING (page_id)""",
    "op12_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS ({_GRAMS}),
        t AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
        c AS (SELECT lang, m, phrase, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        s AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n, ((1000::hugeint * c.a * t.n) // (l.a::hugeint * r.a))::bigint AS score
              FROM c JOIN t USING (lang)
              JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
              JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, a, array_to_string(string_split(phrase, ' ')[o:o + z - 1], ' ') AS inner_phrase
              FROM (SELECT *, unnest(range(1, m - z + 2)) AS o FROM (SELECT *, unnest(range(2, m)) AS z FROM f WHERE m > 2))),
        x AS (SELECT lang, inner_phrase, max(a) AS longer FROM i GROUP BY lang, inner_phrase),
        o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
              FROM b LEFT JOIN x ON x.lang = b.lang AND x.inner_phrase = b.phrase WHERE x.longer IS NULL OR 100 * x.longer < 100 * b.a)
        SELECT lang, rank, phrase, a, l, r, n::bigint AS n, score FROM o WHERE rank <= 2000""",
}
