"""Cologne phonetic codes by replacements that look at the original neighbours of each letter.

Letters whose code depends on neighbours are rewritten first, to marks that
later rules can still tell apart; then all others are translated at once. An
absent neighbour counts as a member of every set that a rule asks about.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import text

#: Pattern and replacement in order; c and s mark a C that sounds 4 or 8.
CONTEXT = (
    (r"[0-9 ]", "#"),
    (r"[DT](?=[CSZ]|$)", "#"),
    (r"^C(?=[AHKLOQRUX]|$)", "c"),
    (r"^C|(?<=[SZ])C", "s"),
    (r"C(?=[AHKOQUX]|$)", "c"),
    (r"C", "s"),
    (r"(^|(?<=[csKQ]))X", "8"),
    (r"X", "48"),
    (r"P(?=H)", "3"),
)
#: Letters and their codes.
LETTERS, CODES = "AEIJOUYBPDTFVWGKQcLMNRSZs", "0000000112233344445667888"


def cologne(x: Column) -> Column:
    """Code of a word or phrase; blanks are ignored."""
    x = F.replace(F.upper(text.normalize(x)), F.lit(" "), F.lit(""))
    for pattern, with_ in CONTEXT:
        x = F.regexp_replace(x, pattern, with_)
    x = F.regexp_replace(F.translate(x, LETTERS, CODES), r"[^0-8]", "")
    return F.regexp_replace(F.regexp_replace(x, r"(\d)\1+", "$1"), r"(?<!^)0", "")


def codes(x: Column) -> Column:
    """Codes of the blank-separated words of a normalised text."""
    return F.transform(F.split(x, " "), cologne)


def cologne_sql(x: str) -> str:
    """The rule table, letter by letter, as a DuckDB expression."""
    u = f"replace(upper({text.normalize_sql(x)}), ' ', '')"
    c, p, n = "substr(u, i, 1)", "substr(u, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END)", "substr(u, i + 1, 1)"
    within = lambda y, letters: f"({y} = '' OR contains('{letters}', {y}))"
    case = f"""CASE WHEN contains('AEIJOUY', {c}) THEN '0' WHEN {c} = 'B' THEN '1'
      WHEN {c} = 'P' THEN CASE WHEN {n} = 'H' THEN '3' ELSE '1' END
      WHEN {c} IN ('D', 'T') THEN CASE WHEN {within(n, "CSZ")} THEN '' ELSE '2' END
      WHEN contains('FVW', {c}) THEN '3' WHEN contains('GKQ', {c}) THEN '4'
      WHEN {c} = 'C' THEN CASE WHEN i = 1 AND {within(n, "AHKLOQRUX")} THEN '4'
        WHEN {within(p, "SZ")} OR NOT {within(n, "AHKOQUX")} THEN '8' ELSE '4' END
      WHEN {c} = 'X' THEN CASE WHEN {within(p, "CKQ")} THEN '8' ELSE '48' END
      WHEN {c} = 'L' THEN '5' WHEN contains('MN', {c}) THEN '6' WHEN {c} = 'R' THEN '7'
      WHEN contains('SZ', {c}) THEN '8' ELSE '' END"""
    out = f"list_aggregate(list_transform([{u}], lambda u: array_to_string(list_transform(range(1, length(u) + 1), lambda i: {case}), '')), 'min')"
    for d in "012345678":
        out = f"regexp_replace({out}, '{d}+', '{d}', 'g')"
    return f"list_aggregate(list_transform([{out}], lambda o: left(o, 1) || replace(substr(o, 2), '0', '')), 'min')"
