"""The subpackage's registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.llm import ctw, decontaminate, lines, mixing, neardup, quality, substrings, tokens, toxicity, urls
from lumenfold.llm.common import table

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def op1_substring_dedup(spark, d):
    out = substrings.dedup(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL1 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
g AS (
  SELECT doc_id, i, list_slice(words, i, i + 19) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
s AS (
  SELECT doc_id, list(i) AS at, CAST(sum(least(20, coalesce(nxt - i, 20))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(0, 20)) AS k)),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(s.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)"""


def op2_url_filter(spark, d):
    return urls.judge_urls(table(spark, d, "pages"))


SQL2 = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f"""


def op3_minhash_neardup(spark, d):
    return neardup.classes(table(spark, d, "documents"))


def op4_token_counts(spark, d):
    return tokens.count_tokens(table(spark, d, "documents"))


def op5_ctw_score(spark, d):
    return ctw.score(table(spark, d, "documents"))


def op6_decontaminate(spark, d):
    found = decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return decontaminate.verdicts(found)


SQL6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, list_slice(words, i, i + n - 1) AS gram
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
    FROM (SELECT *, least(13, len(words)) AS n FROM b WHERE len(words) > 0))),
dw AS (
  SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, gram)),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op7_line_dedup(spark, d):
    out = lines.drop_lines(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL7 = """
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
b AS (SELECT k, min(doc_id) AS first_id FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10),
m AS (SELECT t.doc_id, t.pos, t.line, t.text, b.k IS NOT NULL AND t.doc_id <> b.first_id AS gone FROM t LEFT JOIN b USING (k))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (gone) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL
    ELSE sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) END AS text_sha256
FROM m GROUP BY doc_id, text"""


def op8_toxicity(spark, d):
    docs = table(spark, d, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))
    return out.select(
        "doc_id",
        (toxicity.bucket_of("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def op9_quality_rules(spark, d):
    out = quality.judge(table(spark, d, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL9 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
g AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
s AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (
  SELECT doc_id, text, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS lines,
    len(string_split(text, chr(10))) AS n_lines, coalesce(s.n, 0) AS n_repeat_words FROM w LEFT JOIN s USING (doc_id)),
b AS (
  SELECT doc_id, text, n_lines, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
    OR 2 * (length(text) - length(replace(text, '!!', '!'))) > n_words) AS kept FROM b"""


def op10_mix_sources(spark, d):
    return mixing.mix(table(spark, d, "documents"))


_QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, SQL1),
    "op2_url_filter": (op2_url_filter, SQL2),
    "op3_minhash_neardup": (op3_minhash_neardup, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_ctw_score": (op5_ctw_score, None),
    "op6_decontaminate": (op6_decontaminate, SQL6),
    "op7_line_dedup": (op7_line_dedup, SQL7),
    "op8_toxicity": (op8_toxicity, None),
    "op9_quality_rules": (op9_quality_rules, SQL9),
    "op10_mix_sources": (op10_mix_sources, None),
}


def queries() -> dict:
    """Query functions by name."""
    import corpus_pipeline

    return {k: fn for k, (fn, _) in _QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
