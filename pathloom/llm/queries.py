"""Queries over the driver's tables, each a thin cover of one operator with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, langid, licenses, line_dedup, negatives, packing, quality, simhash, substring_fm, suffix_dedup, token_counts, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_substring_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_fm.dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op4_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept_bytes")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"), piece_model_path())


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_fm_index, op3_simhash_components, op4_line_winnowing, op5_curve_packing, op6_license_index, op7_suffix_sort_dedup, op8_quality_rules, op9_warc_derivatives, op10_decontamination, op11_embedding_whitening, op12_hard_negatives, op13_token_counts)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_TEMPLATES = ", ".join(f"({n}, '{label}', {words!r}, {must!r})" for n, label, words, must in [(n, a, w, [" ".join(q) + f"@{p}" for p, q in m]) for n, a, w, m in licenses._template_rows(licenses.TEMPLATES)])

ORACLES = {
    "op4_line_winnowing": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
all_lines AS (SELECT doc_id, l[p] AS line, p FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d)),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM all_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
next AS (SELECT doc_id, i, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, n, lead(n, 1) OVER w AS nb
         FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, 3 AS k, [line, b, c] AS s FROM next WHERE c IS NOT NULL UNION ALL SELECT doc_id, i, 2, [line, b] FROM next WHERE b IS NOT NULL AND n + nb >= 50
        UNION ALL SELECT doc_id, i, 1, [line] FROM next WHERE n >= 50),
rep AS (SELECT doc_id, i, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM win),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM rep WHERE again),
gone AS (SELECT lines.doc_id, lines.p, lines.i, hit.i IS NOT NULL AS cut FROM lines LEFT JOIN hit ON lines.doc_id = hit.doc_id AND lines.i = hit.i),
kept AS (SELECT a.doc_id, count(g.p) AS n_lines, count(*) FILTER (coalesce(cut, false)) AS n_removed_lines, string_agg(line, chr(10) ORDER BY a.p) FILTER (NOT coalesce(cut, false)) AS k
         FROM all_lines a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY 1)
SELECT doc_id, n_lines, n_removed_lines, sha256(coalesce(k, '')) AS kept_sha256 FROM kept""",
    "op6_license_index": rf"""
WITH t(t, label, tw, must) AS (VALUES {_TEMPLATES}),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
x AS (SELECT doc_id, w[i + 1] AS w, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
tx AS (SELECT t, tw[p + 1] AS w, p FROM (SELECT t, tw, unnest(range(0, len(tw))) AS p FROM t)),
df AS (SELECT tw.w, count(DISTINCT doc_id) AS f FROM (SELECT DISTINCT w FROM tx) tw LEFT JOIN x ON x.w = tw.w GROUP BY 1),
picked AS (SELECT * FROM (SELECT t, w, f, row_number() OVER (PARTITION BY t ORDER BY f, w) AS r FROM (SELECT DISTINCT t, w FROM tx) JOIN df USING (w)) WHERE r <= 3),
post AS (SELECT t, w, p, f, least(2, count(DISTINCT w) OVER (PARTITION BY t)) AS need FROM tx JOIN picked USING (t, w)),
cand AS (SELECT doc_id, t, i - p AS s FROM x JOIN post USING (w) GROUP BY doc_id, t, i - p, need HAVING count(DISTINCT w) >= need),
scored AS (SELECT c.doc_id, c.t, c.s, count(x.i) / count(*)::DOUBLE AS score FROM cand c JOIN tx ON tx.t = c.t LEFT JOIN x ON x.doc_id = c.doc_id AND x.i = c.s + tx.p AND x.w = tx.w GROUP BY 1, 2, 3),
must AS (SELECT t, string_split(split_part(m, '@', 1), ' ') AS q, CAST(split_part(m, '@', 2) AS INT) AS p FROM (SELECT t, unnest(must) AS m FROM t)),
good AS (SELECT doc_id, label, score FROM scored s JOIN t USING (t) JOIN d USING (doc_id)
         WHERE score >= 0.8 AND NOT EXISTS (SELECT 1 FROM must WHERE must.t = s.t AND (s.s + must.p < 0 OR list_slice(d.w, s.s + must.p + 1, s.s + must.p + len(q)) IS DISTINCT FROM q))),
own AS (SELECT doc_id, list(DISTINCT label) AS own, max(score) AS best FROM good GROUP BY 1),
y AS (SELECT doc_id, w, i, lag(w, 1) OVER o AS b1, lag(w, 2) OVER o AS b2 FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
base AS (SELECT doc_id, CASE WHEN b1 IN ('mit', 'apache') THEN i - 1 ELSE i - 2 END AS s, CASE WHEN b1 IN ('mit', 'apache') THEN b1 ELSE 'gpl' END AS label FROM y
         WHERE w = 'license' AND (b1 IN ('mit', 'apache') OR (b1 = 'public' AND b2 = 'general'))),
bl AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(own, [])))), ',') AS labels, coalesce(best, 0.0) AS score
FROM d LEFT JOIN bl USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op2_substring_fm_index": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) > 1 AS again FROM win),
words AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
marked AS (SELECT words.*, coalesce(max(CAST(again AS INT)) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
           FROM words LEFT JOIN rep ON words.doc_id = rep.doc_id AND words.i = rep.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM marked GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_suffix_sort_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(CASE WHEN i - p > 200 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
         FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep)) GROUP BY doc_id, g),
sums AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY 1),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM (SELECT * FROM runs UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.s, q.b AS nb, q.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY q.s DESC, q.b) AS k FROM p JOIN s q ON q.a = p.a AND NOT q.same AND 50 * p.s <= 100 * q.s AND 100 * q.s <= 95 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(k AS INT) AS rank, nb AS negative_id, s AS positive_score, ns AS negative_score FROM n WHERE k <= 3""",
}
