"""Full-text search: postings, phrase and prefix matching, BM25 with two weighted columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text

#: Column weights and BM25's k1 and b.
TEXT_WEIGHT, NORMALIZED_WEIGHT, K1, B = 1.0, 0.5, 1.2, 0.75


@dataclass(frozen=True)
class Phrase:
    """Tokens that must follow each other in one column; with ``prefix`` the last may go on."""

    tokens: tuple[str, ...]
    prefix: bool


def parse(query: str, exact: bool) -> list[Phrase]:
    """One phrase, or one prefix phrase for each blank-separated term, any of which may match."""
    tokens = lambda term: tuple(t for t in re.split(r"[\W_]+", term) if t)
    terms = text.normalize_string(query).split()
    found = [Phrase(tokens(" ".join(terms)), False)] if exact else [Phrase(tokens(t), True) for t in terms]
    return [p for p in dict.fromkeys(found) if p.tokens]


def postings(lines: DataFrame) -> DataFrame:
    """token, line_id, col (0 text, 1 normalized), pos of every token of ``line_id, text, normalized``."""
    columns = F.array(F.struct(F.lit(0).alias("col"), text.index_tokens(F.col("text")).alias("tokens")), F.struct(F.lit(1).alias("col"), text.index_tokens(F.col("normalized")).alias("tokens")))
    one = lines.select("line_id", F.explode(columns).alias("c"))
    return one.select("line_id", F.col("c.col").alias("col"), F.posexplode("c.tokens").alias("pos", "token")).select("token", "line_id", "col", "pos")


def marked_postings(lines: DataFrame) -> DataFrame:
    """The postings with first: whether it is the token's first one in its line, by col and pos.

    Marked within each line's arrays, so that lines can be counted by token without bringing each token's lines together.
    """
    tokens = lambda c: F.coalesce(text.index_tokens(F.col(c)), F.array().cast("array<string>"))
    cut = lines.select("line_id", tokens("text").alias("t0"), tokens("normalized").alias("t1"))

    def places(col: int) -> Column:
        n = F.size(f"t{col}")
        return F.arrays_zip(F.col(f"t{col}").alias("token"), F.array_repeat(F.lit(col), n).alias("col"), F.slice(F.sequence(F.lit(0), n), F.lit(1), n).alias("pos"))

    ordered = cut.select("line_id", F.sort_array(F.concat(places(0), places(1))).alias("p"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("p.token", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))))
    each = ordered.select("line_id", F.explode(F.slice(F.arrays_zip(F.col("p").alias("p"), before.alias("before")), F.lit(1), F.size("p"))).alias("x"))
    return each.select("x.p.token", "line_id", "x.p.col", "x.p.pos", (~F.equal_null("x.p.token", "x.before")).alias("first"))


def frequencies(marked: DataFrame, arrivals: DataFrame) -> DataFrame:
    """token, lines (line_ids that hold it) and n (postings) of marked postings.

    ``arrivals`` has a line_id for each time a line came. What first marks is summed; only for lines that came
    several times, which it marks each time, are the tokens' lines told apart. Looks for such lines at once.
    """
    held = F.coalesce("first", F.raise_error(F.lit("postings without marks: index the lines anew")))
    sums = marked.groupBy("token").agg(F.count_if(held & F.col("line_id").isNotNull()).alias("lines"), F.count("*").alias("n"))
    again = arrivals.groupBy("line_id").agg(F.count("*").alias("k")).where("k > 1 and line_id is not null").select("line_id")
    if again.isEmpty():
        return sums
    pairs = marked.where("first").join(again, "line_id", "left_semi").groupBy("token", "line_id").agg((F.count("*") - 1).alias("more"))
    more = pairs.where("more > 0").groupBy("token").agg(F.sum("more").alias("more"))
    return sums.join(more, "token", "left").select("token", (F.col("lines") - F.coalesce("more", F.lit(0))).alias("lines"), "n")


def lengths(lines: DataFrame) -> DataFrame:
    """line_id and d, its tokens in both columns."""
    return lines.select("line_id", (F.size(text.index_tokens(F.col("text"))) + F.size(text.index_tokens(F.col("normalized")))).alias("d"))


def _standing(index: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """line_id, col, phrase of every place where a phrase stands, from one pass over the postings."""
    single, several = [], []
    for k, phrase in enumerate(phrases):
        for at, token in enumerate(phrase.tokens):
            last = phrase.prefix and at == len(phrase.tokens) - 1
            held = F.col("token").startswith(token) if last else F.col("token") == token
            (single if len(phrase.tokens) == 1 else several).append(F.when(held, F.struct(F.lit(k).alias("phrase"), F.lit(at).alias("at"))))
    found = index.select("line_id", "col", "pos", F.explode(F.filter(F.array(*single, *several), lambda x: x.isNotNull())).alias("x")).select("line_id", "col", "pos", "x.*")
    if not several:
        return found
    size = F.element_at(F.array(*(F.lit(len(p.tokens)) for p in phrases)), F.col("phrase") + 1)
    return found.groupBy("line_id", "col", "phrase", (F.col("pos") - F.col("at")).alias("base")).agg(F.count_distinct("at").alias("held")).where(F.col("held") == size)


def bm25(index: DataFrame, sizes: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """line_id and bm25, the smaller the better, of every line that holds a phrase.

    ``index`` is a postings table; stored sorted by token, the filters on token
    reach its Parquet files. Both tables are read once. ``sizes`` has line_id and d of all lines; if only
    line_id, the same pass over all postings counts d, for postings that are not stored.
    """
    weight = F.when(F.col("col") == 0, TEXT_WEIGHT).otherwise(NORMALIZED_WEIGHT)
    none = F.lit(None).cast("int")
    tfs = lambda found: [F.when(f, weight).alias(f"tf{k}") for k, f in enumerate(found)]
    known = "d" in sizes.columns
    rows = sizes.select("line_id", F.col("d").cast("int").alias("d") if known else F.lit(0).alias("d"), *(F.lit(None).cast("double").alias(f"tf{k}") for k in range(len(phrases))))
    one = all(len(p.tokens) == 1 for p in phrases)
    if not known:
        here = [F.col("token").startswith(p.tokens[0]) if p.prefix else F.col("token") == p.tokens[0] for p in phrases] if one else [F.lit(False)] * len(phrases)
        rows = rows.unionByName(index.select("line_id", F.lit(1).alias("d"), *tfs(here)))
    if known or not one:
        rows = rows.unionByName(_standing(index, phrases).select("line_id", none.alias("d"), *tfs([F.col("phrase") == k for k in range(len(phrases))])))
    return _scored(rows, len(phrases))


def _scored(rows: DataFrame, phrases: int) -> DataFrame:
    """line_id and bm25 from rows of line_id, d and the weights tf0, tf1, … of the phrases, each maybe null.

    The sums of each line serve the collection's figures and the scores alike, so they are exchanged
    once and the exchange is used twice: all of their columns are asked for on both sides.
    """
    tfs = [f"tf{k}" for k in range(phrases)]
    lines = rows.groupBy("line_id").agg(F.sum("d").alias("d"), *(F.sum(c).alias(c) for c in tfs))
    whole = lines.agg(F.count("d").alias("lines"), F.avg("d").alias("mean"), *(F.count(c).alias(f"holders{k}") for k, c in enumerate(tfs)))  # one row
    held = lines.where(F.col("d").isNotNull() & F.coalesce(*tfs).isNotNull()).crossJoin(F.broadcast(whole))

    def part(k: int, c: str) -> Column:
        idf = F.log((F.col("lines") - F.col(f"holders{k}") + 0.5) / (F.col(f"holders{k}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        return F.coalesce(idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("d") / F.col("mean"))), F.lit(0.0))

    return held.select("line_id", (-reduce(lambda x, y: x + y, (part(k, c) for k, c in enumerate(tfs)))).alias("bm25"))


def _places(tokens: Column, phrase: Phrase) -> Column:
    """At how many places of a token array the phrase stands."""
    n = len(phrase.tokens)
    same = lambda t, w, last: F.startswith(t, F.lit(w)) if phrase.prefix and last else t == w
    if n == 1:
        return F.size(F.filter(tokens, lambda t: same(t, phrase.tokens[0], True)))
    ways = [F.slice(tokens, k + 1, F.greatest(F.lit(0), F.size(tokens) - n + 1)) for k in range(n)]
    stands = lambda x: reduce(lambda a, b: a & b, (same(x[str(k)], w, k == n - 1) for k, w in enumerate(phrase.tokens)))
    return F.size(F.filter(F.arrays_zip(*(w.alias(str(k)) for k, w in enumerate(ways))), stands))


def tokens_of(lines: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """line_id, d and the weights tf0, tf1, … of the phrases in each line, null where it has none.

    Places are counted only in columns that have a phrase's tokens somewhere in their characters.
    """
    cut = lines.select("line_id", *(f(F.col(c)).alias(f"{name}{c}") for c in ("text", "normalized") for name, f in (("t_", text.index_tokens), ("f_", text.folded))))

    def count(c: str, phrase: Phrase) -> Column:
        may = reduce(lambda x, y: x & y, (F.contains(F.col(f"f_{c}"), F.lit(w)) for w in phrase.tokens))
        return F.when(may, _places(F.col(f"t_{c}"), phrase)).otherwise(0)

    tf = lambda p: TEXT_WEIGHT * count("text", p) + NORMALIZED_WEIGHT * count("normalized", p)
    rows = cut.select("line_id", (F.size("t_text") + F.size("t_normalized")).alias("d"), *(tf(p).alias(f"tf{k}") for k, p in enumerate(phrases)))
    return rows.select("line_id", "d", *(F.when(F.col(f"tf{k}") > 0, F.col(f"tf{k}")).alias(f"tf{k}") for k in range(len(phrases))))


def search(index: DataFrame, sizes: DataFrame, query: str, exact: bool, cap: int) -> DataFrame | None:
    """line_id, bm25, raw, rank (from 0) of the ``cap`` best lines by a postings table; None for a query without tokens."""
    phrases = parse(query, exact)
    return _best(bm25(index, sizes, phrases), cap) if phrases else None


def search_lines(lines: DataFrame, query: str, exact: bool, cap: int) -> DataFrame | None:
    """The same without an index: each line is cut into tokens once, and no postings are made."""
    phrases = parse(query, exact)
    return _best(_scored(tokens_of(lines, phrases), len(phrases)), cap) if phrases else None


def _best(scored: DataFrame, cap: int) -> DataFrame:
    top = scored.orderBy("bm25", "line_id").limit(cap)
    rank = F.row_number().over(Window.orderBy("bm25", "line_id")) - 1  # over cap rows
    return top.select("line_id", "bm25", (1 / (1 + F.abs("bm25"))).alias("raw"), rank.alias("rank"))


def contains_phrase(tokens: Column, phrase: Phrase) -> Column:
    """Whether a token array holds the phrase: for filters without a postings table."""
    n = len(phrase.tokens)
    if phrase.prefix and n == 1:
        return F.exists(tokens, lambda t: t.startswith(phrase.tokens[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - n + 1))
    want = F.array(*map(F.lit, phrase.tokens))
    return F.exists(starts, lambda i: F.slice(tokens, i, n) == want)
