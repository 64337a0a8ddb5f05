"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import (
    chat_format,
    decontaminate,
    exact_dedup,
    html_text,
    line_dedup,
    lm_scoring,
    near_dedup,
    quality_rules,
    quality_trees,
    repeats,
    resample,
    sentencepieces,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("group", "text_id")


def op2_sentencepiece(spark, sf_dir):
    return sentencepieces.encode_sampled(_table(spark, sf_dir, "documents"), digests=True)


def op3_quality_classifier(spark, sf_dir):
    return quality_trees.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark, sf_dir):
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.rate_texts(_table(spark, sf_dir, "documents")).drop("cleaned")


def op7_line_dedup(spark, sf_dir):
    out = line_dedup.drop_boilerplate_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("cleaned").cast("long").alias("kept_chars"), F.sha2("cleaned", 256).alias("kept_sha256"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    turns = chat_format.with_probe(_table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.windows(turns))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).drop("label")


def op12_exact_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("text_sha256"))
    return exact_dedup.exact_duplicates(docs).drop("text")


def op13_resampling(spark, sf_dir):
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_sentencepiece,
        op3_quality_classifier,
        op4_lm_scoring,
        op5_html_extraction,
        op6_quality_rules,
        op7_line_dedup,
        op8_decontamination,
        op9_suffix_dedup,
        op10_chat_format,
        op11_vector_codes,
        op12_exact_dedup,
        op13_resampling,
        pipeline,
    )
}

_WS = r"[\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _vector_rounds() -> str:
    """Assignment and averages of every round, then the last assignment, as common tables c1, c2, ... and last."""
    near = "SELECT r, x.part, min({{'d': list_inner_product(c, c) - 2 * list_inner_product(y, c), 'j': j}}) AS m, any_value(y) AS y FROM x JOIN c{0} ON x.part = c{0}.part GROUP BY r, x.part"
    out = []
    for k in range(vector_codes.ROUNDS):
        out.append(f"a{k} AS MATERIALIZED ({near.format(k)})")
        out.append(
            f"s{k} AS (SELECT part, j, list(floor(s / n) ORDER BY i) AS c FROM (SELECT part, m.j AS j, i, sum(y[i]::HUGEINT)::DOUBLE AS s, count(*) AS n "
            f"FROM (SELECT part, m, y, unnest(range(1, len(y) + 1)) AS i FROM a{k}) GROUP BY part, m.j, i) GROUP BY part, j)"
        )
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.j, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} ON c{k}.part = s{k}.part AND c{k}.j = s{k}.j)")
    return ",\n".join([*out, f"last AS MATERIALIZED ({near.format(vector_codes.ROUNDS)})"])


ORACLE = {
    "op6_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS lines FROM d),
f AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
  list_filter(lines, lambda x: length(regexp_replace(x, '{_WS}+', '', 'g')) > 0 AND (
    length(x) - length(regexp_replace(x, '{quality_rules.SYMBOLS}', '', 'g')) > {quality_rules.SYMBOL_SHARE}::DOUBLE * length(regexp_replace(x, '{_WS}+', '', 'g'))
    OR (len(string_split_regex(x, '{quality_rules.SHOUT}')) > 2 AND {quality_rules.SHOUTS} * (len(string_split_regex(x, '{quality_rules.SHOUT}')) - 1) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
    OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {quality_rules.REPEATS} AND {quality_rules.DISTINCT} * len(list_distinct(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) <= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
    OR NOT regexp_matches(x, '[\p{{L}}\p{{N}}]') OR regexp_matches(lower(x), '{_quoted(quality_rules.NAVIGATION)}') OR regexp_matches(lower(x), '{_quoted(quality_rules.BOILERPLATE)}'))) AS failed FROM w),
p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
s AS (SELECT f.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(failed)::BIGINT AS n_failed_lines, length(regexp_replace(array_to_string(failed, ''), '{_WS}+', '', 'g')) AS lost
  FROM f LEFT JOIN c ON f.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= {quality_rules.LOSS_SHARE} * word_chars) AS kept, n_failed_lines FROM s""",
    "op7_line_dedup": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, source, unnest(list_distinct(list_transform(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')),
  lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')))) AS line FROM d),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
c AS (SELECT k.source, line FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source GROUP BY k.source, line, pages
  HAVING count(*) >= {line_dedup.LEAST} AND count(*) > {line_dedup.RATIO}::DOUBLE * pages),
b AS (SELECT source, list(line) AS common FROM c GROUP BY source),
x AS (SELECT doc_id, lines, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines, coalesce(common, []) AS common
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
y AS (SELECT doc_id, len(full_lines)::BIGINT AS n_lines,
  len(list_filter(full_lines, lambda x: list_contains(common, regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'))))::BIGINT AS n_dropped,
  array_to_string(list_filter(lines, lambda x: NOT (regexp_matches(x, '[^\x20\x09-\x0D]') AND list_contains(common, regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')))), chr(10)) AS cleaned FROM x)
SELECT doc_id, n_lines, n_dropped, length(cleaned)::BIGINT AS kept_chars, sha256(cleaned) AS kept_sha256 FROM y""",
    "op10_chat_format": rf"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 1) + 3 AS tokens,
  length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<\|(?:turn|text|end|im_start|im_end|endoftext)\|>|</?s>|<</?SYS>>|\[/?INST\]')) AS chars FROM t0),
s AS (SELECT *, row_number() OVER w AS pos, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, (upto - tokens) // {chat_format.BUDGET // 2} AS win, 23 + length(role) + chars AS cost FROM s),
o AS (SELECT conv_id, win, min(upto - tokens) AS opened FROM v GROUP BY conv_id, win),
h AS (SELECT DISTINCT o.conv_id, o.win, v.pos, v.cost FROM o JOIN v ON o.conv_id = v.conv_id AND v.win < o.win
  AND ((v.pos = 1 AND v.role = 'system') OR (v.win = o.win - 1 AND o.opened - v.upto + v.tokens <= {chat_format.BUDGET // 4}))),
z AS (SELECT conv_id, sum(n) AS formatted_chars FROM (SELECT conv_id, sum(cost) AS n FROM v GROUP BY conv_id UNION ALL SELECT conv_id, sum(cost) FROM h GROUP BY conv_id
  UNION ALL SELECT conv_id, 7 * count(*) FROM o GROUP BY conv_id) GROUP BY conv_id)
SELECT v.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars)::BIGINT AS formatted_chars
FROM v JOIN z ON v.conv_id = z.conv_id GROUP BY v.conv_id""",
    "op11_vector_codes": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda z: floor({vector_codes.SCALE} * z::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT r, vec_id, part, x[part * (len(x) // {vector_codes.PARTS}) + 1 : (part + 1) * (len(x) // {vector_codes.PARTS})] AS y
  FROM (SELECT *, unnest(range({vector_codes.PARTS})) AS part FROM v)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v QUALIFY j < {vector_codes.ENTRIES}),
c0 AS MATERIALIZED (SELECT part, j, y AS c FROM x JOIN f USING (r)),
{_vector_rounds()},
e AS (SELECT r, string_agg(format('{{:02x}}', m.j), '' ORDER BY part) AS code, sum(m.d + list_inner_product(y, y))::BIGINT AS error FROM last GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda z: z::BIGINT), ','), ',' ORDER BY part, j)) AS digest FROM c{vector_codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN e USING (r) CROSS JOIN h""",
    "op12_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)""",
    "op13_resampling": rf"""
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
a AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS MATERIALIZED (SELECT row_number() OVER () AS r, kind, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM a),
f AS MATERIALIZED (SELECT r, kind, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || x[i : i + 1])::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % {resample.BUCKETS} AS b
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)) CROSS JOIN t),
n AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + {resample.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + {resample.BUCKETS})::DOUBLE))) AS gain FROM n),
m AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE kind = 0 GROUP BY r),
k AS (SELECT doc_id, len(ws) >= {resample.LEAST} AS may, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN m USING (r) WHERE kind = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (may) OVER () AS total FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {resample.SHARE} * total // 100 THEN place END AS rank FROM o""",
}
