"""Rule-based corrections that keep what was read as an alternative.

Lines are rows with text, model, confidence and alternatives (array of structs
text, model, confidence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Month names that make a line a date line.
MONTHS = "januar februar märz maerz april mai juni juli august september oktober november dezember".split()
YEAR = r"(?<!\d)(1[5-9]\d{2}|20\d{2})(?!\d)"
#: Words of which three make a page a civil-register form.
MARKERS = ("standesbeamte", "verstorben", "hauptregi", "genehmigt")
#: The form's printed phrases, patterns and replacements in order.
NUMBER = (r"^[A-Za-z]{1,3}\s*\.\s*(\d{1,5})\s*\.$", "Nr. $1.")
FORM = (
    (r"^Wor dem(?![\p{L}\p{N}_])", "Vor dem"),
    (r"(?iu)^worden in(?![\p{L}\p{N}_])", "wohnhaft in"),
    (r"(?iu)^(?:sind|und) setzte aus\s*,\s*das(?![\p{L}\p{N}_])", "und zeigte an, daß"),
    (r"(?iu)^(\d+)\s+Jahre.*katholischer.*$", "$1 Jahre alt, katholischer Religion,"),
    (r"(?iu)^wäre in(?![\p{L}\p{N}_])", "wohnhaft in"),
    (r"(?iu)^geborenen?\s+", "geboren zu "),
    (r"(?iu)^Sohn aus Anzeigenden(?![\p{L}\p{N}_])", "Sohn des Anzeigenden"),
    (r"(?iu)^\S+\s*,\s*genehmigt und unterschrieben\s*\.?$", "Vorgelesen, genehmigt und unterschrieben."),
    (r"(?iu)(?<![\p{L}\p{N}_])zwanzig[\p{L}\p{N}_]*(?:\s+[\p{L}\p{N}_]{1,3}\s*\.)?\s+(April|Mai|Juni|Juli)(?![\p{L}\p{N}_])", "zwanzigsten $1"),
)
#: German number words; a unit before "und" loses its last s.
UNITS = " eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split(" ")
TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()


def year_words(year: Column) -> Column:
    """A year from 1800 to 1999 in words as the form writes it, else null."""
    rest, unit = year % 100, year % 10
    small = F.element_at(F.array(*map(F.lit, UNITS)), (F.least(rest, F.lit(19)) + 1).cast("int"))
    ten = F.element_at(F.array(*map(F.lit, TENS)), F.greatest(F.floor(rest / 10) - 1, F.lit(1)).cast("int"))
    before = F.regexp_replace(F.element_at(F.array(*map(F.lit, UNITS)), (unit + 1).cast("int")), "s$", "")
    ending = F.when(rest < 20, small).when(unit == 0, ten).otherwise(F.concat(before, F.lit("und"), ten))
    century = F.when(year < 1900, "tausend achthundert").otherwise("tausend neunhundert")
    return F.when(year.between(1800, 1999), F.concat(century, F.when(ending == "", "").otherwise(F.concat(F.lit(" und "), ending))))


def _reading() -> Column:
    """The line as it was read, as an alternative."""
    return F.array(F.struct(F.col("text").alias("text"), F.col("model").alias("model"), F.col("confidence").alias("confidence")))


def year_hint(lines: DataFrame, year: Column) -> DataFrame:
    """Sets every year of a date line to the known one, if any differs."""
    dated = reduce(lambda a, b: a | b, (F.contains(F.lower("text"), F.lit(m)) for m in MONTHS))
    known = F.regexp_extract_all("text", F.lit(YEAR), F.lit(0))
    applies = year.isNotNull() & dated & F.exists(known, lambda y: y != year.cast("string"))
    applies = F.coalesce(applies, F.lit(False))
    return lines.withColumns({
        "alternatives": F.when(applies, F.concat("alternatives", _reading())).otherwise(F.col("alternatives")),
        "text": F.when(applies, F.regexp_replace(F.col("text"), F.lit(YEAR), year.cast("string"))).otherwise(F.col("text")),
        "model": F.when(applies, F.concat("model", F.lit("+jahrangabe"))).otherwise(F.col("model")),
    })


def civil_register(lines: DataFrame, page: list[str], year: Column) -> DataFrame:
    """Corrects the printed phrases of civil-register forms; needs ``line_order`` from 0 in each page.

    Each marker is looked for line by line and combined per page, so a page's text is never gathered.
    """
    seen = Window.partitionBy(*page)
    marks = sum((F.max(F.contains(F.lower("text"), F.lit(m)).cast("int")).over(seen) for m in MARKERS), F.lit(0))
    fixed = F.when(F.col("line_order") < 4, F.regexp_replace("text", *NUMBER)).otherwise(F.col("text"))
    for pattern, replacement in FORM:
        fixed = F.regexp_replace(fixed, pattern, replacement)
    words = year_words(year)
    fixed = F.when(F.lower(fixed).startswith("des jahres") & words.isNotNull(), F.concat(F.lit("des Jahres "), words)).otherwise(fixed)
    staged = lines.withColumn("__fixed", F.when(marks >= 3, fixed).otherwise(F.col("text")))
    applies = F.col("__fixed") != F.col("text")
    last = F.try_element_at("alternatives", F.lit(-1))["text"]
    kept = F.coalesce(last == F.col("text"), F.lit(False))
    return staged.withColumns({
        "alternatives": F.when(applies & ~kept, F.concat("alternatives", _reading())).otherwise(F.col("alternatives")),
        "text": F.col("__fixed"),
        "model": F.when(applies, F.concat("model", F.lit("+standesformular"))).otherwise(F.col("model")),
    }).drop("__fixed")
