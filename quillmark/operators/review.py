"""Paid second readings of uncertain pages: which pages ask for one, what an answer says, how it is kept.

The service is not bundled: ``fetch`` maps a page's row to the answer's content
and its cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillmark.operators import recognition

#: The expected error from which a page is read again, and an answer's confidence if it gives none.
UNCERTAIN, UNSAID = 0.10, 0.5
#: Warnings of a page.
UNAVAILABLE = "Optionale Cloud-Prüfung war nicht verfügbar"
FOUND = "Cloud-Zweitlesung vorhanden (%s, $%.4f)"

ANSWERS = "page string, content string, cost double"


def task(hint: Column) -> Column:
    """The kind of model that a script asks for."""
    return F.when(hint.isin("handschrift", "auto"), "handwriting").otherwise("print")


def wanted(pages: DataFrame) -> DataFrame:
    """Pages (expected_cer, line_count) that ask for a second reading."""
    return pages.where((F.col("expected_cer") > UNCERTAIN) & (F.col("line_count") > 0))


#: Pages called in one task, one after the other, where no call's greatest cost is known or none fits any more.
STEP = 256


def _said(fetch: Callable[[Row], tuple[str, float]], row: Row) -> tuple[str | None, float]:
    """An answer and its cost; nothing after a RuntimeError, ValueError or OSError, other errors surface."""
    try:
        content, cost = fetch(row)
    except (RuntimeError, ValueError, OSError):
        return None, 0.0
    return content, float(cost)


def settled(costs: list[tuple[str, float]], spent: float, budget: float) -> tuple[float, set[str], str | None]:
    """What is spent after calls (page, cost) in order; the pages whose cost exceeded the budget, which are not counted;
    and the page from which on nothing was to be called any more, if there is one."""
    over: set[str] = set()
    for page, cost in costs:
        if spent >= budget:
            return spent, over, page
        if spent + cost > budget:
            over.add(page)
        else:
            spent += cost
    return spent, over, None


def ask(pages: DataFrame, fetch: Callable[[Row], tuple[str, float]], budget: float, place: str, most: float | None = None, calls: int | None = None) -> DataFrame:
    """page, content, cost of every page (``page`` is unique): answers within a budget, as if called one after the other in the order of ``page``.

    Nothing is called once the budget is spent; an answer that exceeds it is
    discarded and not counted. Content is null without an answer. ``most`` is the
    greatest cost of a call. As many of the next pages as can be paid for at that
    cost are called at once, in ``calls`` tasks; then their true costs are settled
    and the next ones follow. Where none can be paid for at that cost, or ``most``
    is not known, the next ``STEP`` pages are called in one task, one after the
    other. With a ``most`` that a cost exceeds the answers are the same, but calls
    may have been made that would not have been.

    Calls run on the executors, so ``fetch`` has to be sent to them; a lost task
    calls again. Answers are written below ``place``; the driver sees pages' names
    and costs of one round.
    """
    if most is not None and most < 0:
        raise ValueError("a call's greatest cost is not below zero")
    spark, spent, last = pages.sparkSession, 0.0, None
    rounds: list[DataFrame] = []
    while spent < budget:
        left = pages if last is None else pages.where(F.col("page") > last)
        size = None if most == 0 else int((budget - spent) // most) if most else 0
        alone = size == 0
        keys = left.select("page").where("page is not null")
        keys = keys if size is None else keys.orderBy("page").limit(size or STEP)
        upper = keys.agg(F.max("page")).collect()[0][0]
        if upper is None:
            break
        some = left.where(F.col("page") <= upper)
        some = some.coalesce(1).sortWithinPartitions("page") if alone else some.repartition(calls or spark.sparkContext.defaultParallelism, "page")
        some.mapInPandas(_caller(fetch, spent if alone else None, budget), ANSWERS).write.mode("overwrite").parquet(f"{place}/{len(rounds)}")
        told = spark.read.schema(ANSWERS).parquet(f"{place}/{len(rounds)}")
        costs = [(r["page"], r["cost"]) for r in told.where("cost > 0").select("page", "cost").orderBy("page").collect()]
        spent, over, end = settled(costs, spent, budget)
        kept = told if end is None else told.where(F.col("page") < end)
        rounds.append(kept.join(spark.createDataFrame([(p,) for p in sorted(over)], "page string"), "page", "left_anti") if over else kept)
        last = upper
    answers = spark.createDataFrame([], ANSWERS)
    for one in rounds:
        answers = answers.unionByName(one)
    return pages.select("page").join(answers, "page", "left").select("page", "content", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def _caller(fetch: Callable[[Row], tuple[str, float]], spent: float | None, budget: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Calls every page, or, given what is spent already, one after the other until the budget is spent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paid = spent
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                if paid is not None and paid >= budget:
                    break
                row = Row(**dict(zip(batch.columns, values, strict=True)))
                content, cost = _said(fetch, row)
                if paid is not None and paid + cost <= budget:
                    paid += cost
                out.append((row["page"], content, cost))
            yield pd.DataFrame(out, columns=["page", "content", "cost"])

    return run


def readings(answers: DataFrame) -> DataFrame:
    """Adds available, text, confidence and notes of the JSON object in ``content``; what is no object is unavailable."""
    held = F.try_parse_json("content")
    whole = F.coalesce(F.schema_of_variant(held).startswith("OBJECT"), F.lit(False))
    sure = F.try_variant_get(held, "$.confidence", "double")
    said = F.try_variant_get(held, "$.text", "string")
    return answers.select(
        "*", whole.alias("available"), F.when(whole, F.regexp_replace(F.coalesce(said, F.lit("")), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).alias("text"),
        F.when(whole, recognition.clamp(F.coalesce(sure, F.lit(UNSAID)), 0.0, 1.0)).alias("confidence"),
        F.when(whole, F.coalesce(F.try_variant_get(held, "$.notes", "string"), F.lit(""))).alias("notes"),
    )


def news(read: DataFrame, local: DataFrame) -> DataFrame:
    """``read`` (page, available, text) with ``differs``: whether it says something else than ``local`` (page, local_text)."""
    return read.join(local, "page").withColumn("differs", F.col("available") & (F.col("text") != "") & (F.col("text") != F.col("local_text")))


def annotated(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines (page, line_order, alternatives) with the differing readings (page, differs, text, model, confidence) on line 0."""
    new = found.where("differs").select("page", F.lit(0).alias("line_order"), F.struct("text", "model", "confidence").alias("__new"))
    joined = lines.join(new, ["page", "line_order"], "left")
    more = F.when(F.col("__new").isNull(), F.col("alternatives")).otherwise(F.concat("alternatives", F.array("__new")))
    return joined.withColumn("alternatives", more).select(*lines.columns)


def warned(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages (page, warnings) with what became of their second reading (page, available, differs, model, cost)."""
    said = F.when(~F.col("available"), F.lit(UNAVAILABLE)).when(F.col("differs"), F.format_string(FOUND, "model", "cost"))
    joined = pages.join(found.select("page", said.alias("__said")), "page", "left")
    more = F.when(F.col("__said").isNull(), F.col("warnings")).otherwise(F.concat("warnings", F.array("__said")))
    return joined.withColumn("warnings", more).select(*pages.columns)
