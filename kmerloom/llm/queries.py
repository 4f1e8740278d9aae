"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import decontaminate, fim, langid, linecrf, linededup, mixing, packing, puquality, sharding, simhash, tokencount, warc, whitening
from kmerloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("sig")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_line_dedup,
        op3_language_id,
        op4_karmarkar_karp_sharding,
        op5_simhash_near_dedup,
        op6_benchmark_decontamination,
        op7_packing,
        op8_quality_classifier,
        op9_token_counts,
        op10_warc_zip,
        op11_embedding_whitening,
        op12_source_mixing,
        op13_fill_in_middle,
    )
}

#: Line templates by strings instead of hashes; everything else has no SQL form and is tested against brute force.
_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, text, pos, line,
         list_filter(regexp_split_to_array(regexp_replace(line, '(^|[\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '\1<*>', 'g'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS t
  FROM (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), sized AS (SELECT *, len(t) AS n, len(t) - 3 AS m FROM lines WHERE len(t) >= 3 OR length(array_to_string(t, ' ')) >= 50
), signed AS (
  SELECT doc_id, text, pos, n, -1 AS span, t[:3] AS lead, array_to_string(t[4:], ' ') AS rest FROM sized
  UNION ALL
  SELECT doc_id, text, pos, n, i, t[:3], array_to_string(t[4:3 + m * i // 4], ' ') || ' <> ' || array_to_string(t[4 + m * (i + 1) // 4:], ' ')
  FROM sized, range(4) AS r(i) WHERE n >= 12
), counted AS (
  SELECT n, span, lead, rest, count(*) AS docs FROM (SELECT DISTINCT doc_id, n, span, lead, rest FROM signed)
  GROUP BY ALL HAVING count(*) >= 3
), taken AS (
  SELECT * FROM signed JOIN counted USING (n, span, lead, rest)
  QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY docs DESC, span) = 1
), dropped AS (
  SELECT doc_id, pos FROM taken QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY n, span, lead, rest)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL), '') AS kept
  FROM lines l LEFT JOIN dropped d USING (doc_id, pos) GROUP BY l.doc_id
)
SELECT doc_id, n_lines, length(kept) AS kept_chars, md5(kept) AS text_md5 FROM kept
"""

#: Targets in closed form: by rising bound over weight, sources reach their bound until the level of the rest is below it.
_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source
), weighed AS (
  SELECT source, s, no % 3 AS schedule, CASE no % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, 3e0 * s AS most, sum(s) OVER () AS total FROM sources
), ranked AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed
), bounded AS (SELECT *, most * rest <= w * (total - before) AS above FROM ranked
), level AS (SELECT coalesce(sum(most) FILTER (WHERE above), 0) AS spent, sum(w) FILTER (WHERE NOT above) AS open_w FROM bounded
), targets AS (
  SELECT source, s, schedule, w, CASE WHEN above THEN most ELSE w * (total - spent) / open_w END AS target FROM bounded, level
), placed AS (
  SELECT d.doc_id, d.source, d.size, t.s, t.schedule, t.w, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, w * b / target AS y, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM placed
), counted AS (
  SELECT *, greatest(0, least(size, budget - b)) + greatest(0, least(size, budget - s - b)) + greatest(0, least(size, budget - 2 * s - b)) AS taken FROM taken
)
SELECT doc_id, source, size, s AS source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN y <= 0 THEN 0e0 WHEN schedule = 0 THEN 2e0 * y / (8e0 + sqrt(greatest(64e0 + -12e0 * y, 0e0)))
                                     WHEN schedule = 1 THEN 2e0 * y / (2e0 + sqrt(4e0)) ELSE 2e0 * y / sqrt(4e0 * y) END END AS position
FROM counted
"""

_FILL_IN_MIDDLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), hashed AS (
  SELECT doc_id, text, l, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS b,
         CAST('0x' || h[25:32] AS BIGINT) % 100 AS kind FROM lines
), cuts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN kind < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(l[1:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS s FROM hashed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM cuts
"""

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": _LINE_DEDUP, "op12_source_mixing": _MIXING, "op13_fill_in_middle": _FILL_IN_MIDDLE}
