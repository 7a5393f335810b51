"""Registered queries of this subpackage: each operator over its whole table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.llm.embeddings import near_embeddings
from timberline.llm.jaccard import similar_documents
from timberline.llm.line_runs import line_dedup
from timberline.llm.packing import pack_documents
from timberline.llm.pii import find_pii
from timberline.llm.quality import quality_rules
from timberline.llm.quality_sql import RULES_SQL
from timberline.llm.ranked_search import ranked_search
from timberline.llm.secret_scan import find_secrets
from timberline.llm.suffix_trees import drop_repeated_passages
from timberline.llm.tokens import count_tokens, encode_documents
from timberline.llm.urls import FILTER_SQL, url_filter
from timberline.llm.whitening import whiten

EMBEDDINGS_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
ok AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
),
reach AS (
  SELECT DISTINCT a AS node, a AS seen FROM link
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON reach.seen = link.a
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n_links FROM link GROUP BY a) n ON e.vec_id = n.a
LEFT JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON e.vec_id = c.node
"""

PASSAGES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
wins AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
),
again AS (SELECT k FROM wins GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM wins SEMI JOIN again USING (k)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

SEARCH_SQL = r"""
WITH term AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
asked AS (
  SELECT DISTINCT item_id, unnest(
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM term WHERE len(w) > 0),
held AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM term) SEMI JOIN asked USING (t) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY t),
gain AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt))) AS g FROM held JOIN weight USING (t), corpus),
score AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(g) AS BIGINT) AS score FROM gain JOIN asked USING (t) GROUP BY item_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql.strip()
        return plan

    return register


@query("op1_embeddings", EMBEDDINGS_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return near_embeddings(table(spark, sf, "embeddings"), threshold=0.93)


@query("op2_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(table(spark, sf, "documents"), "word_bpe_49k.json", keep=False)


@query("op3_secrets")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(table(spark, sf, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), "byte_bpe_50k.json", limit=1024)


@query("op5_jaccard")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return similar_documents(table(spark, sf, "documents"), size=5, percent=80)


@query("op6_quality", RULES_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(table(spark, sf, "documents"))


@query("op7_pii")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return find_pii(table(spark, sf, "documents"))


@query("op8_urls", FILTER_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter(table(spark, sf, "pages"), table(spark, sf, "labels"))


@query("op9_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), "byte_bpe_50k.json", window=2048, end_id=1)


@query("op10_line_runs")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup(table(spark, sf, "documents"), min_words=50)


@query("op11_passages", PASSAGES_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf, "documents"), window=35, digest=True)


@query("op12_search", SEARCH_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), top=10)


@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"), most=8)
