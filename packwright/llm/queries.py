"""The ten queries over their whole tables, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import chat, decontam, html_extract, langid, media, ngram_join, packing, quality, token_output, url_filter
from packwright.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as text: from-to, joined by commas."""
    found = chat.format_preferences(table(spark, sf_dir, "conversations"))
    said = lambda mask: F.array_join(F.transform(mask, lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s["to"].cast("string"))), ",").alias(mask)
    return found.select(*[said(c) if c.endswith("_mask") else c for c in found.columns])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_decontaminate, op3_quality, op4_language, op5_packing, op6_html, op7_media, op8_urls, op9_tokens, op10_chat)}


def _glob_regex(glob: str) -> str:
    return glob.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")


def _urls_sql() -> str:
    ranked = sorted(url_filter.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked)
    globs = " OR ".join(f"regexp_full_match(host || path, '{_glob_regex(g)}')" for g in url_filter.BLOCK_GLOBS)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/.*$') AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM s"""


_CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, conv_id // 2 AS pair_id FROM t),
p AS (
  SELECT pair_id, max(CASE WHEN conv_id % 2 = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN conv_id % 2 = 1 THEN conv_id END) AS rejected_id FROM n GROUP BY pair_id),
d AS (
  SELECT pair_id, i, max(CASE WHEN conv_id % 2 = 0 THEN role || chr(0) || text END) IS DISTINCT FROM max(CASE WHEN conv_id % 2 = 1 THEN role || chr(0) || text END) AS differs
  FROM n GROUP BY pair_id, i),
k AS (
  SELECT pair_id, coalesce(min(CASE WHEN differs THEN i END), max(i) + 1) - 1 AS n_shared FROM d GROUP BY pair_id),
m AS (
  SELECT n.*, n_shared, sum(CASE WHEN i > n_shared THEN length(line) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS ends FROM n JOIN k USING (pair_id)),
c AS (
  SELECT conv_id, coalesce(string_agg(CASE WHEN i <= n_shared THEN line END, '' ORDER BY i), '') AS prompt,
         coalesce(string_agg(CASE WHEN i > n_shared THEN line END, '' ORDER BY i), '') AS completion,
         coalesce(string_agg(CASE WHEN i > n_shared AND role = 'assistant' THEN CAST(ends - 11 - length(text) AS BIGINT) || '-' || CAST(ends - 1 AS BIGINT) END, ',' ORDER BY i), '') AS mask
  FROM m GROUP BY conv_id)
SELECT p.pair_id, p.chosen_id, p.rejected_id, CAST(n_shared AS BIGINT) AS n_prompt_turns, coalesce(a.prompt, '') AS prompt,
       a.completion AS chosen_completion, a.mask AS chosen_mask, b.completion AS rejected_completion, b.mask AS rejected_mask
FROM p JOIN k USING (pair_id) LEFT JOIN c a ON a.conv_id = p.chosen_id LEFT JOIN c b ON b.conv_id = p.rejected_id"""


def oracle_sql() -> dict[str, str]:
    return {"op8_urls": _urls_sql(), "op10_chat": _CHAT_SQL}
