"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import op03_bpe
from sitelens.llm.op01_vptree import nearest
from sitelens.llm.op02_resampling import resample
from sitelens.llm.op04_cdc import repeated_documents, repeated_spans
from sitelens.llm.op05_pii import pseudonymise
from sitelens.llm.op06_templates import leaks
from sitelens.llm.op07_html import extract_main_text
from sitelens.llm.op08_simhash import simhash_groups
from sitelens.llm.op09_warc import archive_round_trip
from sitelens.llm.op10_lines import line_report


#: For the query only; real runs bring a key of their own.
PSEUDONYM_KEY = b"for the query only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_bpe.digests(op03_bpe.round_trip(_table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, _table(spark, sf_dir, "labels")).select("doc_id", "log_ratio", "log_weight", "sample_key")


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"))


def op4_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_documents(repeated_spans(_table(spark, sf_dir, "documents")))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vptree": op1_vptree,
    "op2_resampling": op2_resampling,
    "op3_bpe": op3_bpe,
    "op4_cdc": op4_cdc,
    "op5_pii": op5_pii,
    "op6_templates": op6_templates,
    "op7_html": op7_html,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_lines": op10_lines,
}

#: Products are summed from the first component to the last, as the operator does. The tables that SQL answers on hold so few
#: vectors that the trees are searched exactly.
_NEAREST_SQL = """WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_WARC_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f"""

#: The others hash texts or follow chains of links, which SQL can't; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_vptree": _NEAREST_SQL, "op9_warc": _WARC_SQL}
