"""Text functions of the archive as Column expressions, all evaluated inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that normalisation writes otherwise, before and after case folding.
LIGATURES = (("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ꝛ", "r"))
FOLDED = (("µ", "μ"), ("ς", "σ"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
#: Signs that count as useful beside letters and digits.
USEFUL = "äöüÄÖÜß.,;:!?-–—()[]'\"/"
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def _replaced(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def compose(df: DataFrame, *columns: str) -> DataFrame:
    """NFC of string columns. Only rows with combining marks leave the JVM; the others pass as they are."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    marked = F.coalesce(F.concat_ws("", *columns).rlike(r"\p{M}"), F.lit(False))
    return df.where(~marked).unionByName(df.where(marked).withColumns({c: nfc(c) for c in columns}))


def compose_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """NFC of a field of the structs in an array column, likewise."""

    @F.pandas_udf("array<string>")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda found: None if found is None else [None if t is None else unicodedata.normalize("NFC", t) for t in found])

    said = F.transform(column, lambda x: x[field])
    marked = F.coalesce(F.exists(said, lambda t: F.coalesce(t.rlike(r"\p{M}"), F.lit(False))), F.lit(False))
    return df.where(~marked).unionByName(df.where(marked).withColumn(column, F.zip_with(column, nfc(said), lambda x, t: x.withField(field, t))))


def normalize(x: Column) -> Column:
    """Search form: ligatures and umlauts spelled out, case folded, punctuation to blanks.

    Expects composed text (see ``compose``); other accents, ``_`` and ``-`` stay.
    """
    spelt = F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(_replaced(F.lower(_replaced(x, LIGATURES)), FOLDED))  # ASCII has nothing to replace
    return F.trim(F.regexp_replace(spelt, r"[^\p{L}\p{N}_-]+", " "))


def words(x: Column) -> Column:
    """Runs of letters, digits, ``_`` and ``-``."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))


def folded(x: Column) -> Column:
    """Lower case, diacritics kept, long s as s."""
    return F.replace(F.lower(x), F.lit("ſ"), F.lit("s"))


def index_tokens(x: Column) -> Column:
    """Full-text tokens: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def language_quality(x: Column) -> Column:
    """Share of useful characters, less 0.03 for each run of four equal ones, within 0 and 1."""
    useful = F.length(F.regexp_replace(x, r"[^\p{L}\p{N}.,;:!?–—()\[\]'\"/-]", ""))
    repeated = F.size(F.regexp_extract_all(x, F.lit(r"(?s)(.)\1{3}"), F.lit(0)))
    score = useful / F.length(x) - F.lit(0.03) * repeated
    return F.when(F.trim(F.regexp_replace(x, BLANK, " ")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def quality_counts(x: Column) -> list[Column]:
    """Of one line: useful characters, runs of four equal ones other than line feeds, and whether it is blank."""
    useful = F.length(F.regexp_replace(x, r"[^\p{L}\p{N}.,;:!?–—()\[\]'\"/-]+", ""))
    repeated = F.size(F.regexp_extract_all(x, F.lit(r"([^\n])\1{3}"), F.lit(0)))
    blank = F.trim(F.regexp_replace(x, BLANK + "+", " ")) == ""
    return [useful.alias("useful"), repeated.alias("repeated"), blank.alias("blank")]


def quality_of_lines(joined: Column, useful: Column, repeated: Column, blank: Column) -> Column:
    """``language_quality`` of lines joined by line feeds, from the sums of their counts. Only runs of line feeds go over a line's end."""
    feeds = (F.length(joined) - F.length(F.replace(joined, F.lit("\n\n\n\n"), F.lit("")))) / 4
    score = useful / F.greatest(F.lit(1), F.length(joined)) - F.lit(0.03) * (repeated + feeds)
    return F.when(blank, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def slug(x: Column) -> Column:
    """File-name form: other signs than letters, digits, ``_``, ``.``, ``-`` become one ``-``."""
    found = F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_.-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(found == "", "dokument").otherwise(found)


def natural_key(x: Column) -> Column:
    """Sort key in which digit runs compare as numbers, as one string: a run's digits follow their count."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"\d+|[^\d]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), _counted(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "\u0001")


def _counted(digits: Column) -> Column:
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def percent(x: Column, digits: int = 0) -> Column:
    """Percentage text, halves rounded to even."""
    return F.concat(F.format_string(f"%.{digits}f", F.bround(x * 100, digits)), F.lit("%"))


def reading(x: Column) -> Column:
    """Reading version: hyphenated line ends joined, single line feeds to blanks, blanks collapsed."""
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N}_])-\n(?=[a-zäöüß])", "")
    x = F.regexp_replace(x, r"(?<!\n)(?<!--- Seite ---)\n(?!\n)(?!--- Seite ---)", " ")
    return F.concat(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", ""), F.lit("\n"))


# ------------------------------------------------------------ the same in DuckDB's SQL, for the oracles


def elapsed(seconds: Column) -> Column:
    """A duration in words: seconds, or minutes and seconds; below zero is zero."""
    whole = F.greatest(F.lit(0), F.bround(seconds, 0).cast("long"))
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit(" s"))).otherwise(F.format_string("%d:%02d min", F.floor(whole / 60), whole % 60))


def progress(value: Column) -> Column:
    """A share as whole percents from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(value * 100, 0).cast("int")))


def normalize_sql(x: str) -> str:
    x = f"nfc_normalize({x})"
    for a, b in LIGATURES:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"lower({x})"
    for a, b in FOLDED:
        x = f"replace({x}, '{a}', '{b}')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def natural_key_sql(x: str) -> str:
    digits = "coalesce(nullif(ltrim(p, '0'), ''), '0')"
    counted = f"lpad(length({digits})::VARCHAR, 10, '0') || {digits}"
    return rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '\d+|[^\d]+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN {counted} ELSE p END), chr(1))"


def index_tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(replace(lower({x}), 'ſ', 's'), '[\p{{L}}\p{{N}}]+')"


def language_quality_sql(x: str) -> str:
    useful = rf'''length(regexp_replace({x}, '[^\p{{L}}\p{{N}}.,;:!?–—()\[\]\'\'"/-]', '', 'g'))'''.replace("\\'", "'")
    repeated = f"coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), lambda ch: (length({x}) - length(replace({x}, repeat(ch, 4), ''))) / 4)), 0)"
    return f"CASE WHEN trim({x}) = '' THEN 0.0 ELSE greatest(0.0, least(1.0, {useful} / length({x})::DOUBLE - 0.03::DOUBLE * {repeated})) END"


def normalize_string(value: str) -> str:
    """``normalize`` of one query string, on the driver."""
    import re

    value = unicodedata.normalize("NFC", value)
    for a, b in LIGATURES:
        value = value.replace(a, b)
    value = value.casefold()
    for a, b in FOLDED:
        value = value.replace(a, b)
    return " ".join(re.sub(r"[^\w\s-]", " ", value).split())
