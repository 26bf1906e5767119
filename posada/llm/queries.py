"""The registered queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, filter_audit, html_extract, jaccard_join, language_id, pii, quality, secrets, spotsigs, suffix_tree_lm, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.vocabulary_path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_spotsigs": op6_spotsigs,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_pii": op9_pii,
    "op10_html": op10_html,
    "op11_filter_audit": op11_filter_audit,
    "op12_language_id": op12_language_id,
    "op13_vector_codes": op13_vector_codes,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codes_sql(rounds: int = 4) -> str:
    """Parts of vectors as integer lists, then one step for each assignment and each update of the codebooks."""
    nearest = lambda k: f"""a{k} AS MATERIALIZED (SELECT vec_id, label, p, arg_min(e, d * 256 + e) AS e, min(d) AS d, any_value(v) AS v FROM (
  SELECT x.vec_id, x.label, x.p, b.e, x.v, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN b{k} b ON b.p = x.p) GROUP BY vec_id, label, p)"""  # noqa: E731
    update = lambda k: f"""m{k} AS (SELECT p, e, i, floor(sum(c)::DECIMAL(38, 0) / count(*))::BIGINT AS c FROM (SELECT p, e, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY p, e, i),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM m{k} GROUP BY p, e) u ON u.p = b.p AND u.e = b.e)"""  # noqa: E731
    steps = [s for k in range(rounds) for s in (nearest(k), update(k))] + [nearest(rounds)]
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM kept, range(4) r(p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256) f USING (vec_id)),
{",".join(chr(10) + s for s in steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


_WORDS = lambda pattern: f"list_filter(string_split_regex({_LOWER}, '{pattern}'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS('[\\x20\\x09-\\x0D]+')} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS e FROM d),
x AS (SELECT doc_id, len(e) AS n, unnest(e) AS v FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p WHERE 100 * c >= 85 * (n + m - c) UNION ALL SELECT v, u FROM p WHERE 100 * c >= 85 * (n + m - c)),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.u)
SELECT s.doc_id, len(e)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) m ON m.u = s.doc_id""",
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS('[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS('[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
k AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i:i + 9], ' '))) AS v FROM b WHERE len(w) > 0),
o AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k)),
h AS (SELECT o.doc_id, o.i, o.n, k.item_id FROM o JOIN d USING (doc_id) JOIN k ON k.n = o.n AND k.v = array_to_string(d.w[o.i:o.i + o.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS s UNION ALL SELECT s || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(s, x)),
p AS (SELECT s AS filter_order, step::INT AS step, s[step] AS x, s[1:step - 1] AS before FROM o, range(1, 6) r(step) WHERE length(s) = 5),
m AS (SELECT part, filter_order, step, x, n, good, toxic, contains(failed, x) AS fails, failed = x AS alone,
  coalesce(len(list_intersect(string_split(failed, ''), string_split(before, ''))), 0) = 0 OR failed = '' OR before = '' AS there FROM c, p),
g AS (SELECT part, filter_order, step, x, sum(CASE WHEN there AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN there AND fails THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN NOT there AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN there AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN there AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g""",
    "op13_vector_codes": _codes_sql(),
}
