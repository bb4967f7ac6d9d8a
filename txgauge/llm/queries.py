"""The thin contract queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgauge.llm import bpe, content_sort, knn_join, lang_id, mixing, pii, simhash, suffix_index, token_counts, url_reputation
from txgauge.llm.common import table

RULES: tuple[url_reputation.Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP1 = """
WITH e AS (
  SELECT vec_id, embedding, row_number() OVER () AS own, greatest(max(len(embedding)) OVER (), 1) AS width FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, own, list_resize(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)), width, 0::DOUBLE) AS v FROM e),
s AS (
  SELECT q.vec_id AS query_id, q.own, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM v q, v x
  WHERE q.vec_id % 100 = 0 AND q.own <> x.own),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    return url_reputation.judge_urls(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def _shrunk(prior: str, post: str) -> str:
    """The posterior al, be of the rows of prior (n, bad, pa, pb)."""
    return f"""{post}_ AS (SELECT *, (pa - bad) / (pa - bad + pb - (n - bad)) AS m, 1 / (pa - bad + pb - (n - bad) + 1) AS own FROM {prior}),
{post}r AS (SELECT coalesce(least(0.5::DOUBLE, greatest(0.001::DOUBLE, sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0))), 0.5::DOUBLE) AS rho FROM {post}_ WHERE n > 0),
{post} AS (SELECT *, bad + c * m AS al, n - bad + c * (1 - m) AS be FROM (SELECT *, 1 / (rho + (1 - rho) * own) - 1 AS c FROM {post}_, {post}r))"""


OP2 = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
said AS (
  SELECT doc_id, max(CASE WHEN toxic > 0 OR quality <= 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN said ON page_id = doc_id GROUP BY host),
k AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS site, regexp_matches(site, '^[0-9]+(\.[0-9]+){{3}}$|^\[') AS ip,
         split(site, '.') AS parts, array_to_string(parts[-2:], '.') AS two,
         two IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.kr', 'com.br', 'com.cn', 'co.in', 'co.nz', 'co.za') AS sl,
         CASE WHEN ip THEN 'ip' WHEN sl THEN two ELSE parts[-1] END AS suffix, CASE WHEN ip THEN site WHEN sl THEN array_to_string(parts[-3:], '.') ELSE two END AS domain FROM h),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM k GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
s0 AS (SELECT s.*, t.bad + 0.5::DOUBLE AS pa, t.n - t.bad + 0.5::DOUBLE AS pb FROM s, (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM s) t),
{_shrunk('s0', 's1')},
d0 AS (SELECT d.*, al AS pa, be AS pb FROM d JOIN s1 USING (suffix)),
{_shrunk('d0', 'd1')},
h0 AS (SELECT k.host, k.n, k.bad, al AS pa, be AS pb FROM k JOIN d1 USING (domain)),
{_shrunk('h0', 'h1')},
v AS (SELECT host, CASE WHEN al / (al + be) - 1.645::DOUBLE * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS own FROM h1)
SELECT page_id, p.host, path,
  CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE own END AS verdict
FROM p JOIN v USING (host)
"""


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    n = (F.octet_length("token_ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, source, size, length(t)::DOUBLE AS n, length(regexp_replace(t, '[^\p{L}]', '', 'g'))::DOUBLE AS letters, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 13))::BIGINT AS h FROM d),
k AS (
  SELECT doc_id, source, size, -ln((h + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / greatest(0.02::DOUBLE,
    least(1::DOUBLE, letters / (0.8::DOUBLE * greatest(n - size, 1))) * CASE WHEN n / greatest(size, 1) - 1 BETWEEN 3 AND 12 THEN 1::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN size < 20 THEN 0.5::DOUBLE ELSE 1::DOUBLE END) AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3 * sum(size)::DOUBLE AS cap, sum(sum(size)) OVER ()::DOUBLE AS words FROM k GROUP BY source),
o AS (SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
c AS (SELECT *, cap <= w * level AS capped FROM o),
g AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, w * ((words - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER ())) END AS target,
    CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs, target - epochs * source_size AS rest FROM c),
r AS (SELECT k.*, g.* EXCLUDE (source), sum(size) OVER (PARTITION BY k.source ORDER BY key) AS cum FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
e AS (
  SELECT source, arg_min(key, (off, key)) AS last FROM (SELECT source, key, abs(cum - rest) AS off FROM r WHERE rest > 0 UNION ALL SELECT source, -1, rest FROM g WHERE rest > 0) GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN key <= last THEN 1 ELSE 0 END))::BIGINT AS taken FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""


def op7_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_index.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = lang_id.identify(docs.select("doc_id", "text"), lang_id.learn(docs))
    return out.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {f.__name__: f for f in (op1_knn_join, op2_url_reputation, op3_content_sort, op4_bpe, op5_simhash, op6_mixing, op7_suffix_index, op8_pii, op9_lang_id, op10_token_counts)}
#: Tokenizers, 64-bit XXH, compression and iterated scores are not SQL's, and all windows of 200 bytes take it too long:
#: the other queries are tested against libraries or brute force.
ORACLES = {"op1_knn_join": OP1, "op2_url_reputation": OP2, "op3_content_sort": OP3, "op6_mixing": OP6}
