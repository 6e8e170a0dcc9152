"""Secret scan through a trigram inverted index, in DataFrame operations only.

Every rule's regular expression yields a Boolean query over trigrams that any
match must contain. Postings of just those trigrams are intersected per query,
and the rule's expression runs on the candidates alone. Rules without mandatory
trigrams scan every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import _shared as S


@dataclass(frozen=True)
class Rule:
    """A span is a match whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Order of kinds among spans with one start. A hexadecimal run of 32 and an access key of 16
#: characters are maximal runs, so these patterns carry their least lengths themselves.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Rules that the index makes cheap to add.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
#: Alternatives that a run of literals may branch into before it is closed.
MOST_ALTERNATIVES = 8

#: A query: any of these sets of trigrams, each to be found whole. None: no condition.
Query = frozenset[frozenset[str]] | None


def _close(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(a for a in sets if not any(b < a for b in sets))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b)


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else a | b


def _analyse(items) -> tuple[set[str] | None, Query]:
    """All strings that the expression matches if they are few, else None; and its query."""
    run: set[str] = {""}
    query: Query = None
    exact = True

    def close() -> None:
        nonlocal run, query, exact
        query, run, exact = _both(query, _close(run)), {""}, False

    for op, arg in items:
        options: set[str] | None = None
        inner: Query = None
        if op is sre.LITERAL:
            options = {chr(arg).lower()}
        elif op is sre.IN:
            if all(o is sre.LITERAL for o, _ in arg):
                options = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            options, inner = _analyse(arg[3])
        elif op is sre.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            options = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
            inner = parts[0][1]
            for p in parts[1:]:
                inner = _either(inner, p[1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            strings, inner = _analyse(body)
            if strings is not None and (least, most) == (0, 1):
                options = {""} | strings
            elif strings is not None and least == most == 1:
                options = strings
            inner = inner if least else None
        if options is not None and len(options) * len(run) <= MOST_ALTERNATIVES:
            run = {a + b for a in run for b in options}
        else:
            close()
            if options is not None and len(options) <= MOST_ALTERNATIVES:
                run = set(options)
            else:
                query = _both(query, inner)
    whole = _both(query, _close(run))
    return (run if exact else None), whole


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams of which every match holds at least one set; None if there is none."""
    return _analyse(parser.parse(pattern))[1]


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, rules``: the kinds whose query the document's postings satisfy (those with a query)."""
    clauses = [(r.kind, k, sorted(c)) for r in rules if (q := trigram_query(r.pattern)) is not None for k, c in enumerate(sorted(q, key=sorted))]
    wanted = sorted({t for _, _, c in clauses for t in c})
    low = F.array(F.lower(F.coalesce("text", F.lit(""))))
    found = F.transform(low, lambda t: F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(t, g)))
    postings = docs.select("doc_id", F.explode(F.element_at(found, 1)).alias("trigram"))
    table = docs.sparkSession.createDataFrame(
        [(t, kind, k, 1 << c.index(t), (1 << len(c)) - 1) for kind, k, c in clauses for t in c],
        "trigram string, kind string, clause int, bit long, need long",
    )  # as many rows as the rules have trigrams
    held = postings.join(F.broadcast(table), "trigram").groupBy("doc_id", "kind", "clause", "need").agg(F.bit_or("bit").alias("have"))
    return held.where("have = need").groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as structs, from the pieces before them and their lengths."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    none = F.expr("cast(array() as array<struct<s:int,k:int,kind:string,e:int>>)")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.struct(start.alias("s"), F.lit(order).alias("k"), F.lit(rule.kind).alias("kind"), end.alias("e"))
        kept = F.when(F.length(x["2"]) >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]


def scan(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and an array column of spans (s, k, kind, e) for each rule's kind, one row per input row.

    Null text counts as empty. Positions are code points, the end exclusive.
    Rows that share a doc_id share their candidates, which verification settles;
    repeated rows and rows with a null doc_id have their own. Texts are read whole,
    however long; an empty table gives no rows. Other columns are left out.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), "text")
    found = S.materialize(candidates(rows, rules).withColumnRenamed("doc_id", "id"), "candidates")
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]), "left")
    text, out = F.coalesce(F.col("text"), F.lit("")), []
    for order, rule in enumerate(rules):
        spans = _spans(text, rule, order)
        if trigram_query(rule.pattern) is not None:
            spans = F.when(F.array_contains(F.col("rules"), rule.kind), spans)
        out.append(F.coalesce(spans, F.expr("cast(array() as array<struct<s:int,k:int,kind:string,e:int>>)")).alias(rule.kind))
    return joined.select("doc_id", *out)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(S.read(spark, sf_dir, "documents"), BASE + EXTRA)
    sizes = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.concat(*(F.col(r.kind) for r in BASE))
    every = F.concat(*(F.col(r.kind) for r in BASE + EXTRA))
    return found.select("doc_id", *sizes, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"))


def _oracle() -> str:
    parts = []
    for order, rule in enumerate(BASE + EXTRA):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
      SELECT id, {order} AS k, '{rule.kind}' AS kind, cast(stop - l AS BIGINT) AS s, cast(stop AS BIGINT) AS e, v FROM (
        SELECT id, l, v, sum(b + coalesce(l, 0)) OVER (PARTITION BY id ORDER BY i) AS stop FROM (
          SELECT id, unnest(range(1, len(string_split_regex(t, {p})) + 1)) AS i,
            unnest(list_transform(string_split_regex(t, {p}), lambda x: length(x))) AS b,
            unnest(list_transform(regexp_extract_all(t, {p}, 0), lambda x: length(x))) AS l,
            unnest(list_transform(regexp_extract_all(t, {p}, {rule.group}), lambda x: length(x))) AS v
          FROM d)) WHERE l IS NOT NULL AND v >= {rule.least}""")
    union = " UNION ALL ".join(parts)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({union})
    SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
      count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      sha256(coalesce({listed} FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256, coalesce({listed}, '') AS spans
    FROM d LEFT JOIN found USING (id) GROUP BY d.id, d.doc_id"""


ORACLE = _oracle()
