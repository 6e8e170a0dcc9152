"""The driver's tables seen as an archive: documents, pages and lines with derived, deterministic columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text

#: Lines on a page.
LINES = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    year = F.when(F.col("doc_id") % 17 == 0, None).otherwise((1800 + F.col("doc_id") % 146).cast("int"))
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.concat_ws("-", "source", "doc_id").alias("title"), year.alias("year"))


def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, document_id, page_index, line_order, text, confidence, bbox, doc_id, n."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    page, order = F.expr(f"n div {LINES}").cast("int"), (F.col("n") % LINES).cast("int")
    top = 20 + 60 * order
    return lines.select(
        F.format_string("%d-%04d-%04d", "doc_id", page, order).alias("line_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        page.alias("page_index"), order.alias("line_order"), "text",
        confidence(F.col("doc_id"), F.col("n")).alias("confidence"),
        F.struct(F.lit(10).alias("x1"), top.alias("y1"), (10 + 8 * F.least(F.length("text"), F.lit(120))).alias("x2"), (top + 40).alias("y2")).alias("bbox"),
        "doc_id", "n",
    )


def archive_pages(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """document_id, page_index, doc_id, lines: the pages whole, ``line(text, n, doc_id)`` giving the structs of their lines."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.transform(F.split("text", "\n", -1), lambda t, n: line(t, n, F.col("doc_id"))).alias("lines"))
    last = F.floor((F.size("lines") - 1) / LINES).cast("int")
    pages = F.transform(F.sequence(F.lit(0), last), lambda p: F.slice("lines", p * LINES + 1, F.lit(LINES)))
    one = lines.where("lines is not null").select("doc_id", F.posexplode(pages).alias("page_index", "lines"))
    return one.select(F.col("doc_id").cast("string").alias("document_id"), "page_index", "doc_id", "lines")


def confidence(doc_id: Column, n: Column) -> Column:
    return (30 + (doc_id * 31 + n * 17) % 70) / 100.0


def indexed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their search form."""
    return archive_lines(spark, sf_dir).withColumn("normalized", text.normalize(F.col("text")))


#: The same lines in DuckDB's SQL.
LINES_SQL = f"""
  SELECT doc_id, n, text, doc_id || '-' || lpad((n // {LINES})::VARCHAR, 4, '0') || '-' || lpad((n % {LINES})::VARCHAR, 4, '0') AS line_id,
    doc_id::VARCHAR AS document_id, (n // {LINES})::INT AS page_index, (n % {LINES})::INT AS line_order,
    (30 + (doc_id * 31 + n * 17) % 70) / 100.0::DOUBLE AS confidence,
    10 AS x1, 20 + 60 * (n % {LINES})::INT AS y1, 10 + 8 * least(length(text), 120)::INT AS x2, 60 + 60 * (n % {LINES})::INT AS y2
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)"""
DOCUMENTS_SQL = """
  SELECT doc_id, doc_id::VARCHAR AS document_id, source || '-' || doc_id AS title,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (1800 + doc_id % 146)::INT END AS year FROM documents"""
