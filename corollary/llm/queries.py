"""The numbered queries: each applies its operator to a whole table with production parameters and
returns the operator's rows, or digests of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import pii

    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import secrets

    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import near_dup

    return near_dup.linked(table(spark, sf_dir, "documents"), k=2, percent=80)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w
), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON a = doc_id
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import html_text

    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import quality

    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, net).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files pass from the writer to the reader as a column; neither sees the other's state."""
    from corollary.llm import media

    files = media.stored(table(spark, sf_dir, "documents"))
    return media.described(files, keep=["n_bytes"]).drop("error")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import substring

    return substring.removed(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE least < doc_id),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import bpe

    got = bpe.round_trip(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text is rebuilt from output and form alone."""
    from corollary.llm import fim

    got = fim.transformed(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), r AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, length(array_to_string(u[1 : least(h1 % (n + 1), h2 % (n + 1))], ''))::BIGINT AS a, length(array_to_string(u[1 : greatest(h1 % (n + 1), h2 % (n + 1))], ''))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), s AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS x FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import licenses

    return licenses.scanned(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    """Phrases by their places, templates by comparing every block with every one."""
    from corollary.llm.licenses import PERCENT, PHRASES, TEMPLATES

    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT doc_id, k, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
phrases(phrase, label, size) AS (VALUES {phrases}),
places AS (
  SELECT k, label, unnest(list_filter(range(0, len(ws)), lambda i: array_to_string(ws[i + 1 : i + size], ' ') = phrase)) AS place
  FROM w, phrases WHERE len(list_intersect(ws, string_split(phrase, ' '))) = size
), base AS (
  SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY k
), blocks AS (
  SELECT k, list_distinct(list_filter(string_split_regex(block, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS b
  FROM (SELECT k, unnest(string_split_regex(t, '[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n')) AS block FROM d)
), templates AS (SELECT label, list_distinct(string_split(text, ' ')) AS t FROM (VALUES {templates}) v(label, text)),
met AS (
  SELECT k, label, len(list_intersect(b, t))::DOUBLE / len(t) AS containment FROM blocks, templates
  WHERE 100 * len(list_intersect(b, t)) >= {PERCENT} * len(t)
), own AS (SELECT k, list(DISTINCT label) AS own, max(containment) AS best FROM met GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN own USING (k)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corollary.llm import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's rules alone, which SQL can say too."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PII_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones
  FROM d
)
SELECT doc_id, len(emails)::BIGINT AS n_email,
  len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0))::BIGINT AS n_ip,
  len(list_filter(cards, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(x)), lambda i:
    CASE WHEN i % 2 = 0 THEN x[length(x) - i]::INTEGER ELSE 2 * x[length(x) - i]::INTEGER - (CASE WHEN x[length(x) - i]::INTEGER > 4 THEN 9 ELSE 0 END) END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda x: length(x) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM m
"""


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's rules alone, likewise."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRETS_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '(NAMES)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex
FROM d
""".replace("NAMES", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_secrets, op3_near_dup, op4_html, op5_packing, op6_quality, op7_topk, op8_media, op9_substring, op10_bpe, op11_fim, op12_licenses, op13_hard_negatives, pii_base, secrets_base)}
ORACLE_SQL: dict[str, str] = {"op3_near_dup": OP3_SQL, "op7_topk": OP7_SQL, "op9_substring": OP9_SQL, "op11_fim": OP11_SQL, "op12_licenses": _op12_sql(), "op13_hard_negatives": OP13_SQL, "pii_base": PII_BASE_SQL, "secrets_base": SECRETS_BASE_SQL}
