"""What surrounds text recognition: geometry, grouping, scores, the choice of a reading, warnings, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# ------------------------------------------------------------ geometry


def boundary_box(points: Column, width: Column, height: Column) -> Column:
    """Padded extent of a text boundary (array of structs x, y) within its page."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    px = F.greatest(F.lit(5), F.floor(height / 500))
    py = F.greatest(F.lit(4), F.floor(F.least(y2 - y1, F.floor(height / 300)) / 10))
    return _cut(x1 - px, y1 - py, x2 + px, y2 + py, width, height)


def baseline_box(points: Column, width: Column, height: Column) -> Column:
    """Box around a baseline: more room above than below."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    px = F.greatest(F.lit(8), F.floor(height / 300))
    above, below = F.greatest(F.lit(20), F.floor(height / 85)), F.greatest(F.lit(10), F.floor(height / 180))
    return _cut(F.array_min(xs) - px, F.array_min(ys) - above, F.array_max(xs) + px, F.array_max(ys) + below, width, height)


def _cut(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The box within the page as struct x1, y1, x2, y2; null if nothing of it is left."""
    a, b = F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1)
    c, d = F.least(width, x2), F.least(height, y2)
    box = F.struct(a.cast("int").alias("x1"), b.cast("int").alias("y1"), c.cast("int").alias("x2"), d.cast("int").alias("y2"))
    return F.when((c > a) & (d > b), box)


def wide_enough(box: Column, width: Column) -> Column:
    """Whether a detected box can be a line of text."""
    return (box["x2"] - box["x1"] >= F.greatest(F.lit(20), F.floor(width / 100))) & (box["y2"] - box["y1"] >= 8)


def said(words: Column) -> Column:
    """Those of an array of words (structs word, text, …) that are not blank, by their numbers."""
    return F.sort_array(F.filter(words, lambda w: F.trim(w["text"]) != ""))


def sureness(words: Column) -> Column:
    """Mean confidence of an array of words: of those not negative, of 100, or 0."""
    sure = F.filter(words, lambda w: w["confidence"] >= 0)
    total = F.aggregate(sure, F.lit(0.0), lambda s, w: s + w["confidence"])
    return F.when(F.size(sure) > 0, clamp(total / F.greatest(F.lit(1), F.size(sure)) / 100, 0.0, 1.0)).otherwise(0.0)


def lines_of_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words (keys, block, par, line, word, text, confidence, x1, y1, x2, y2) as lines in reading order.

    Blank words are left out; confidence is the mean of those not negative, of 100, or 0.
    Words that a reader gives line by line, as rows (keys, block, par, line, words: array of structs
    word, text, confidence, x1, y1, x2, y2), are not exchanged; only their lines are.
    """
    if "words" in words.columns:
        kept = words.withColumn("words", said(F.col("words"))).where(F.size("words") > 0)
        edge = lambda f, c: f(F.transform("words", lambda w: w[c])).alias(c)
        out = kept.select(
            *keys, "block", "par", "line", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), sureness(F.col("words")).alias("confidence"),
            edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2"),
        )
    else:
        kept = words.where(F.trim("text") != "")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")
        mean = F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))) / 100
        out = kept.groupBy(*keys, "block", "par", "line").agg(
            joined.alias("text"), clamp(F.coalesce(mean, F.lit(0.0)), 0.0, 1.0).alias("confidence"),
            F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        )
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("y1", "x1", "block", "par", "line")) - 1
    return out.withColumn("line_order", order)


# ------------------------------------------------------------ variants and models


def variant_quality(d: Column) -> Column:
    """Score of an image variant from its diagnostics struct."""
    light = 1 - F.least(F.abs(d["brightness"] - 0.78) / 0.78, F.lit(1.0))
    clipped = 1 - F.least(d["clipped_dark"] + d["clipped_light"], F.lit(1.0))
    return 0.35 * light + 0.30 * clipped + 0.20 * F.least(d["contrast"], F.lit(1.0)) + 0.15 * d["sharpness"]


def preflight(variants: DataFrame, page: list[str], limit: int = 2) -> DataFrame:
    """The original and the best others of each page, ``limit`` in all. Needs name, position, quality."""
    order = [F.desc(F.col("name") == "original"), F.desc("quality"), "position"]
    return variants.withColumn("choice", F.row_number().over(Window.partitionBy(*page).orderBy(*order))).where(F.col("choice") <= limit)


def model_keys(year: Column, hint: Column) -> Column:
    """Recognition models in order for a year and a kind of script."""
    keys = lambda *k: F.array(*map(F.lit, k))
    return (
        F.when(hint.isin("druck", "schreibmaschine"), F.array().cast("array<string>"))
        .when(year < 1500, keys("trocr-medieval"))
        .when(year < 1800, keys("trocr-kurrent-early"))
        .when(year.isNull() | (year <= 1945), keys("trocr-kurrent-19", "trocr-kurrent-early"))
        .otherwise(keys("trocr-modern"))
    )


# ------------------------------------------------------------ candidates


def coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up the lines (text, y1, y2) of each candidate: text, mean confidence, coverage of the page.

    ``rows`` carries page_height and line_order besides the keys and confidence. Candidates that come
    whole, as rows (keys, page_height, lines: array of structs line_order, text, confidence, y1, y2 and
    the counts of ``text.quality_counts``), are not exchanged, and get their language too.
    """
    if "lines" in rows.columns:
        kept = rows.where(F.size("lines") > 0).withColumn("text", F.array_join(F.transform(F.sort_array("lines"), lambda x: x["text"]), "\n"))
        total = lambda c, zero: F.aggregate(F.transform("lines", lambda x: x[c]), F.lit(zero), lambda s, x: s + F.coalesce(x, F.lit(zero)))
        rated = F.size(F.filter("lines", lambda x: x["confidence"].isNotNull()))
        one = kept.select(
            *keys, "page_height", "text", F.size("lines").alias("lines"), F.when(rated > 0, total("confidence", 0.0) / F.greatest(F.lit(1), rated)).alias("confidence"),
            F.array_min(F.transform("lines", lambda x: x["y1"])).alias("top"), F.array_max(F.transform("lines", lambda x: x["y2"])).alias("bottom"),
            text.quality_of_lines(F.col("text"), total("useful", 0), total("repeated", 0), F.forall("lines", lambda x: F.coalesce(x["blank"], F.lit(True)))).alias("language"),
        )
    else:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_order", "text"))), lambda x: x["text"]), "\n")
        one = rows.groupBy(*keys, "page_height").agg(
            joined.alias("text"), F.count("*").alias("lines"), F.avg("confidence").alias("confidence"), F.min("y1").alias("top"), F.max("y2").alias("bottom")
        )
    h = F.col("page_height")
    length = F.least(F.length("text") / F.greatest(F.lit(120.0), h / 8), F.lit(1.0))
    count = F.least(F.col("lines") / F.greatest(F.lit(8.0), h / 145), F.lit(1.0))
    span = F.least(F.greatest(F.lit(0.0), (F.col("bottom") - F.col("top")).cast("double")) / F.greatest(0.82 * h, F.lit(1.0)), F.lit(1.0))
    return one.withColumn("coverage", 0.45 * length + 0.35 * count + 0.20 * span)


def scores(candidates: DataFrame) -> DataFrame:
    """Adds language (unless there), score and expected_cer to rows of ``coverage`` with a ``model`` column."""
    c = candidates if "language" in candidates.columns else candidates.withColumn("language", text.language_quality(F.col("text")))
    score = 0.45 * F.col("confidence") + 0.15 * F.col("language") + 0.40 * F.col("coverage")
    cer = clamp(1 - (0.55 * F.col("confidence") + 0.15 * F.col("language") + 0.30 * F.col("coverage")), 0.01, 0.99)
    return c.withColumn("score", score).withColumn("expected_cer", F.when(F.col("model").startswith("trocr-"), F.greatest(cer, F.lit(0.12))).otherwise(cer))


def best(candidates: DataFrame, page: list[str]) -> DataFrame:
    """The candidate of largest score of each page, ties by ``position``."""
    rank = F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("score"), "position"))
    return candidates.withColumn("rank", rank).where("rank = 1").drop("rank")


#: A page's warnings.
RULES = "Gedruckte Standesamtsformulierungen wurden regelgestützt ergänzt; Original-Lesarten stehen in den Alternativen"
INCOMPLETE = "Ergebnis wahrscheinlich unvollständig – zu wenig Textfläche erkannt"
REVIEW = "Niedrige Erkennungssicherheit – manuelle Prüfung empfohlen"


def warnings(rule_applied: Column, covered: Column, cer: Column) -> Column:
    found = F.array(F.when(rule_applied, RULES), F.when(covered < 0.35, INCOMPLETE), F.when(cer > 0.10, REVIEW))
    return F.filter(found, lambda w: w.isNotNull())


def page_confidence(pages: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence of each page's lines, 0 without lines."""
    mean = lines.groupBy(*keys).agg(F.avg("confidence").alias("m"))
    return pages.join(mean, keys, "left").withColumn("mean_confidence", F.coalesce("m", F.lit(0.0))).drop("m")


def within_budget(calls: DataFrame, job: str, order: list[str], budget: float) -> DataFrame:
    """Which paid second readings happen: spending so far must leave some budget before a call, and a
    call that exceeds it is discarded without being counted. Needs ``cost``; adds ``accepted``, ``spent``.

    A running sum of the accepted costs depends on each decision, so each job's
    calls (one user's batch, in order) are folded by one aggregate expression.
    """
    rows = calls.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(*order, "cost"))).alias("calls"))
    start = F.struct(F.lit(0.0).alias("spent"), F.expr("cast(array() as array<struct<accepted:boolean,spent:double>>)").alias("out"))

    def step(s: Column, c: Column) -> Column:
        fine = (s["spent"] < budget) & (s["spent"] + c["cost"] <= budget)
        spent = F.when(fine, s["spent"] + c["cost"]).otherwise(s["spent"])
        return F.struct(spent.alias("spent"), F.concat(s["out"], F.array(F.struct(fine.alias("accepted"), spent.alias("spent")))).alias("out"))

    folded = rows.withColumn("out", F.aggregate("calls", start, step, lambda s: s["out"]))
    one = folded.select(job, F.explode(F.arrays_zip("calls", "out")).alias("x"))
    return one.select(job, *(F.col(f"x.calls.{c}").alias(c) for c in [*order, "cost"]), F.col("x.out.accepted").alias("accepted"), F.col("x.out.spent").alias("spent"))
