"""Storage operations as transformations of snapshot tables: replace, overlay, upsert, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text


def replace_by_key(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` without the keys that ``new`` has, and ``new``: a document saved again leaves nothing of its old self."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def remove(child: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a child table whose parent is not removed."""
    return child.join(parents.select(*key).distinct(), key, "left_anti")


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last event of each key, by one map-side combined maximum."""
    last = F.max(F.struct(*order, *values)).alias("e")
    return events.groupBy(key).agg(last).select(key, *(F.col(f"e.{c}").alias(c) for c in [*order, *values]))


def unknown_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of lines that are not there."""
    return edits.join(lines.select("line_id"), "line_id", "left_anti")


def corrected(lines: DataFrame, edits: DataFrame, known: bool = False) -> DataFrame:
    """Lines (line_id, text, normalized) under their latest edit (line_id, seq, new_text); alternatives stay.

    An edit of an unknown line is a KeyError; ``known`` says that there are none, and nothing is looked up.
    """
    if not known:
        lost = [r["line_id"] for r in unknown_edits(lines, edits).select("line_id").limit(5).collect()]
        if lost:
            raise KeyError(f"unknown lines: {lost}")
    last = text.compose(edits.groupBy("line_id").agg(F.max_by("new_text", "seq").alias("__new")), "__new")
    joined = lines.join(last, "line_id", "left")
    new = F.trim("__new")
    out = joined.withColumn("manually_corrected", F.col("__new").isNotNull())
    out = out.withColumn("text", F.coalesce(new, F.col("text")))
    return out.withColumn("normalized", F.when(F.col("__new").isNull(), F.col("normalized")).otherwise(text.normalize(new))).drop("__new")


def valid_vectors(vectors: DataFrame, edits: DataFrame) -> DataFrame:
    """Embeddings of lines without an edit since; corrected lines are encoded anew."""
    return vectors.join(edits.select("line_id").distinct(), "line_id", "left_anti")


def reindexed(index: DataFrame, lines: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of the changed lines rebuilt."""
    from quillmark.operators import lexical

    ids = changed.select("line_id").distinct()
    return index.join(ids, "line_id", "left_anti").unionByName(lexical.postings(lines.join(ids, "line_id", "left_semi")).select(*index.columns))


def entities(mentions: DataFrame) -> DataFrame:
    """One row for each (line_id, text, label), the last by ``seq``."""
    rank = F.row_number().over(Window.partitionBy("line_id", "text", "label").orderBy(F.desc("seq")))
    return mentions.withColumn("__r", rank).where("__r = 1").drop("__r")


def aliases(pairs: DataFrame) -> DataFrame:
    """Normalised (canonical, alias) pairs, each once."""
    pairs = text.compose(pairs, "canonical", "alias")
    return pairs.select(text.normalize(F.col("canonical")).alias("canonical"), text.normalize(F.col("alias")).alias("alias")).where("canonical <> '' and alias <> ''").distinct()


def alias_variants(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """``names`` with each ``variant`` of their column name: itself and both sides of every alias pair it is part of."""
    keyed = names.join(pairs, names["name"] == pairs["canonical"]).unionByName(names.join(pairs, names["name"] == pairs["alias"]))
    found = keyed.select(*names.columns, F.explode(F.array("canonical", "alias")).alias("variant"))
    return found.unionByName(names.withColumn("variant", F.col("name"))).distinct()


def line_context(lines: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Every line with its document's title and year and its page's columns."""
    return lines.join(pages, ["document_id", "page_index"]).join(documents.select("document_id", "title", "year"), "document_id")


def list_documents(documents: DataFrame) -> DataFrame:
    """Documents, the newest first, then by title."""
    return documents.orderBy(F.desc("created_at"), "title")


def rows(spark, sql: str, parameters: dict | list | None = None) -> DataFrame:
    """Any query over registered tables, with parameters marked ``:name`` or ``?``."""
    return spark.sql(sql, args=parameters)
