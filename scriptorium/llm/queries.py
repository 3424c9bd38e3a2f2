"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table

#: The vocabulary that op8_tokens counts by.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLES["op10_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.mixing import digest, mix

    return digest(mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query
def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


@query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.warc import archive

    return archive(table(spark, sf_dir, "pages"))


ORACLES["op6_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, unnest(generate_series(0, 7)) AS k FROM (SELECT DISTINCT h FROM p)),
v AS (SELECT h, k, (strpos('0123456789ABCDEF', substr(h, 5 * k + 1, 1)) - 1) * 65536 + (strpos('0123456789ABCDEF', substr(h, 5 * k + 2, 1)) - 1) * 4096
  + (strpos('0123456789ABCDEF', substr(h, 5 * k + 3, 1)) - 1) * 256 + (strpos('0123456789ABCDEF', substr(h, 5 * k + 4, 1)) - 1) * 16
  + (strpos('0123456789ABCDEF', substr(h, 5 * k + 5, 1)) - 1) AS x FROM g),
c AS (SELECT h, k, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1) AS s FROM v),
d AS (SELECT h, string_agg(s, '' ORDER BY k) AS payload_digest FROM c GROUP BY h),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN d USING (h) JOIN f USING (h)
"""


@query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.urls import judge

    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
