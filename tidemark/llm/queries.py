"""The queries of this package for `__spark_entry__.py`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import binary, contamination, html_text, jaccard, lines, packing, quality, rules, runs, secrets, spelling, topk, warc
from tidemark.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"), path="source")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), checksums=True)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), words=3, numerator=90, denominator=100)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lines.decisions(documents, lines.build_index(documents)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_planted_repetition(table(spark, sf_dir, "documents")))
    found = found.withColumn("longest", runs.longest_run(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"longest.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(runs.spelled(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *rules.STATISTICS, "base_failed", "kept", "posterior")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"), variant=spelling.with_slips)
    return found.select("word", "n", "n_near", "form", "form_n", "root")


_LINES = """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents
), line AS (
    SELECT doc_id, place, held[place] AS line,
        translate(trim(held[place], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM split, unnest(range(1, len(held) + 1)) AS places(place)
), frequent AS (
    SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT line.*, frequent.key IS NOT NULL AND doc_id <> keeper AS gone FROM line LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_TOPK = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS numbers
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.numbers, c.numbers), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM usable AS q JOIN usable AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.numbers) = len(q.numbers)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WARC = """
WITH payload AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), first AS (
    SELECT html, min(page_id) AS first FROM payload WHERE payload_bytes >= 100 GROUP BY html
)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM payload LEFT JOIN first USING (html)
"""

_QUERIES = (
    op1_warc, op2_benchmark_decontamination, op3_quality_classifier, op4_secret_scan, op5_best_fit_packing,
    op6_exact_topk, op7_token_files, op8_html_extraction, op9_ngram_jaccard_join, op10_line_dedup,
    op11_periodic_runs, op12_quality_rules, op13_spelling_variants,
)
QUERIES = {query.__name__: query for query in _QUERIES}
ORACLES = {"op1_warc": _WARC, "op6_exact_topk": _TOPK, "op10_line_dedup": _LINES}
