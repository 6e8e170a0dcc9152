"""Registered queries over text and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import phonetics, text
from quillmark.operators import fuzzy, lexical, search, semantic, store
from quillmark.sources import corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Texts that the registered searches ask for.
PREFIXES, PHRASE = "thon erly", "of the"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


LINES = corpus.LINES_SQL
NORMALIZED = f"SELECT *, {text.normalize_sql('text')} AS normalized FROM ({LINES})"


@query(f"SELECT line_id, document_id, page_index, line_order, confidence, x1, y1, x2, y2, text FROM ({LINES})")
def line_explode(spark, sf_dir) -> DataFrame:
    lines = corpus.archive_lines(spark, sf_dir)
    return lines.select("line_id", "document_id", "page_index", "line_order", "confidence", "bbox.*", "text")


@query(f"SELECT line_id, {text.normalize_sql('text')} AS normalized FROM ({LINES})")
def normalize_lines(spark, sf_dir) -> DataFrame:
    return corpus.indexed_lines(spark, sf_dir).select("line_id", "normalized")


@query(f"SELECT line_id, len({text.index_tokens_sql('text')})::INT + len({text.index_tokens_sql('normalized')})::INT AS d FROM ({NORMALIZED})")
def token_stats(spark, sf_dir) -> DataFrame:
    return lexical.lengths(corpus.indexed_lines(spark, sf_dir))


@query(f"""SELECT token, count(DISTINCT line_id) AS lines, count(*) AS n FROM (
    SELECT line_id, unnest({text.index_tokens_sql('text')} || {text.index_tokens_sql('normalized')}) AS token FROM ({NORMALIZED})) GROUP BY token""")
def token_doc_freq(spark, sf_dir) -> DataFrame:
    return lexical.frequencies(lexical.marked_postings(corpus.indexed_lines(spark, sf_dir)), corpus.archive_lines(spark, sf_dir).select("line_id"))


WORDS_SQL = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_-]+')) AS word FROM documents"


@query(f"SELECT word, {phonetics.cologne_sql('word')} AS code FROM ({WORDS_SQL})")
def phonetic_keys(spark, sf_dir) -> DataFrame:
    words = corpus.table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", phonetics.cologne(F.col("word")).alias("code"))


NAMES_SQL = f"SELECT p_name AS name, {phonetics.cologne_sql('p_name')} AS code FROM part"


@query(f"SELECT code, count(*) AS n, count(DISTINCT name) AS names, min(name) AS first_name FROM ({NAMES_SQL}) GROUP BY code")
def phonetic_groups(spark, sf_dir) -> DataFrame:
    names = corpus.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("k"))
    coded = names.select("name", "k", phonetics.cologne(F.col("name")).alias("code"))
    return coded.groupBy("code").agg(F.sum("k").alias("n"), F.count("*").alias("names"), F.min("name").alias("first_name"))


@query(f"SELECT line_id, round({text.language_quality_sql('text')}, 6) AS quality FROM ({LINES})")
def language_quality(spark, sf_dir) -> DataFrame:
    return corpus.archive_lines(spark, sf_dir).select("line_id", F.round(text.language_quality(F.col("text")), 6).alias("quality"))


@query(r"""SELECT doc_id, CASE WHEN s = '' THEN 'dokument' ELSE s END AS slug FROM (SELECT doc_id,
    regexp_replace(regexp_replace(source || ' / ' || coalesce(lang, '') || ' #' || doc_id, '[^\p{L}\p{N}_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS s FROM documents)""")
def slug_titles(spark, sf_dir) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    title = F.concat("source", F.lit(" / "), F.coalesce("lang", F.lit("")), F.lit(" #"), "doc_id")
    return docs.select("doc_id", text.slug(title).alias("slug"))


@query(f"SELECT page_id, {text.natural_key_sql('url')} AS key FROM pages")
def natural_order(spark, sf_dir) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.natural_key(F.col("url")).alias("key"))


def archive(spark, sf_dir, vectors: bool = False) -> search.Archive:
    """The derived archive; each document's first line stands for its embedding."""
    found = None
    if vectors:
        e = corpus.table(spark, sf_dir, "embeddings")
        found = e.select(F.format_string("%d-0000-0000", "vec_id").alias("line_id"), F.lit("r1").alias("revision"), "embedding")
    return search.Archive(corpus.indexed_lines(spark, sf_dir), corpus.archive_documents(spark, sf_dir), vectors=found)


def bm25_sql(phrases: list[lexical.Phrase], cap: int) -> str:
    """The scores of the phrases over the derived lines, the best ``cap``, with their rank."""
    parts = []
    for k, p in enumerate(phrases):
        n = len(p.tokens)
        tests = [f"starts_with(t[i + {j}], '{w}')" if p.prefix and j == n - 1 else f"t[i + {j}] = '{w}'" for j, w in enumerate(p.tokens)]
        hits = lambda t: f"len(list_filter(range(1, len({t}) - {n} + 2), lambda i: {' AND '.join(x.replace('t[', t + '[').replace('(t', '(' + t) if False else x.replace('t[i', t + '[i') for x in tests)}))"  # noqa: B023, E731
        parts.append(f"SELECT line_id, d, {k} AS phrase, 1.0::DOUBLE * {hits('a')} + 0.5::DOUBLE * {hits('b')} AS tf FROM toks")
    return f"""
    toks AS (SELECT line_id, {text.index_tokens_sql('text')} AS a, {text.index_tokens_sql('normalized')} AS b,
      len({text.index_tokens_sql('text')}) + len({text.index_tokens_sql('normalized')}) AS d FROM lines),
    whole AS (SELECT count(*)::DOUBLE AS lines, avg(d)::DOUBLE AS mean FROM toks),
    tf AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE tf > 0),
    np AS (SELECT phrase, count(*)::DOUBLE AS k FROM tf GROUP BY phrase),
    idf AS (SELECT phrase, CASE WHEN ln((lines - k + 0.5) / (k + 0.5)) > 0 THEN ln((lines - k + 0.5) / (k + 0.5)) ELSE 1e-6 END AS idf FROM np, whole),
    bm AS (SELECT line_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / mean))) AS bm25 FROM tf JOIN idf USING (phrase), whole GROUP BY line_id),
    lex AS (SELECT line_id, bm25, 1 / (1 + abs(bm25)) AS raw, (row_number() OVER (ORDER BY bm25, line_id) - 1)::INT AS rank FROM bm QUALIFY rank < {cap})"""


def lexical_sql(q: str, exact: bool, cap: int) -> str:
    return f"WITH lines AS ({NORMALIZED}), {bm25_sql(lexical.parse(q, exact), cap)} SELECT line_id, round(bm25, 6) AS bm25, round(raw, 6) AS raw, rank FROM lex"


def _lexical(spark, sf_dir, q: str, exact: bool, cap: int) -> DataFrame:
    found = lexical.search_lines(corpus.indexed_lines(spark, sf_dir), q, exact, cap)
    return found.select("line_id", F.round("bm25", 6).alias("bm25"), F.round("raw", 6).alias("raw"), "rank")


@query(lexical_sql("heed", False, 200))
def lexical_topk(spark, sf_dir) -> DataFrame:
    return _lexical(spark, sf_dir, "heed", False, 200)


@query(lexical_sql(PREFIXES, False, 200))
def lexical_by_postings(spark, sf_dir) -> DataFrame:
    """The same search by a postings table, which counts the lines' tokens too."""
    lines = corpus.indexed_lines(spark, sf_dir)
    found = lexical.search(lexical.postings(lines), lines.select("line_id"), PREFIXES, False, 200)
    return found.select("line_id", F.round("bm25", 6).alias("bm25"), F.round("raw", 6).alias("raw"), "rank")


@query(lexical_sql(PREFIXES, False, 200))
def lexical_prefix_or(spark, sf_dir) -> DataFrame:
    return _lexical(spark, sf_dir, PREFIXES, False, 200)


@query(lexical_sql(PHRASE, True, 200))
def exact_phrase(spark, sf_dir) -> DataFrame:
    return _lexical(spark, sf_dir, PHRASE, True, 200)


def _hits(found: DataFrame) -> DataFrame:
    return found.select("line_id", "document_id", "document_title", "page_index", "text", "matched_form", "reason", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "year")


def hits_sql(q: str, exact: bool, limit: int, where: str = "true", semantic_sql: str | None = None) -> str:
    """Lexical hits, with a vector channel if given, fused and assembled."""
    reason = "exakter Texttreffer" if exact else "Volltexttreffer"
    channels = [f"SELECT line_id, 1.0::DOUBLE / (60 + rank) + raw * 0.02::DOUBLE AS part, 0 AS channel, rank, 2 AS priority, '{reason}' AS reason FROM lex"]
    sem = ""
    if semantic_sql:
        sem = f", sem AS ({semantic_sql})"
        channels.append(f"SELECT line_id, 0.82::DOUBLE / (60 + rank) + greatest(0, raw) * 0.012::DOUBLE, 2, rank, 0, '{search.SIMILAR}' FROM sem")
    return f"""
    WITH lines AS ({NORMALIZED}), docs AS ({corpus.DOCUMENTS_SQL}), {bm25_sql(lexical.parse(q, exact), max(200, 4 * limit))}{sem},
    fused AS (SELECT line_id, sum(part) AS s, max_by(reason, priority) AS reason, min(channel * 100000 + rank) AS seq FROM ({' UNION ALL '.join(channels)}) GROUP BY line_id)
    SELECT line_id, document_id, title AS document_title, page_index, text, '{q}' AS matched_form, reason,
      round(least(1.0, 20 * s), 6) AS score, round(confidence, 6) AS confidence, year
    FROM fused JOIN lines USING (line_id) JOIN docs USING (document_id) WHERE {where}
    ORDER BY least(1.0, 20 * s) DESC, confidence DESC, seq, line_id LIMIT {limit}"""


@query(hits_sql(PHRASE, True, 50, "year >= 1820 AND year <= 1880"))
def year_filtered_hits(spark, sf_dir) -> DataFrame:
    return _hits(search.search(archive(spark, sf_dir), search.Query(PHRASE, search.Mode.EXACT, year_from=1820, year_to=1880)))


@query(hits_sql(PREFIXES, False, 50, "document_id = '647'"))
def document_filtered_hits(spark, sf_dir) -> DataFrame:
    return _hits(search.search(archive(spark, sf_dir), search.Query(PREFIXES, search.Mode.MEANING, document_id="647")))


#: The vector that the registered vector searches ask with: the row of this vec_id.
ASKED = 7


def asked(spark, sf_dir) -> list[float]:
    row = corpus.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == ASKED).select("embedding").collect()
    return [float(x) for x in row[0][0]]


def semantic_sql(cap: int) -> str:
    return f"""SELECT line_id, raw, (row_number() OVER (ORDER BY raw DESC, line_id) - 1)::INT AS rank FROM (
      SELECT e.vec_id || '-0000-0000' AS line_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS raw
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {ASKED}) q) QUALIFY rank < {cap}"""


@query(f"SELECT line_id, round(raw, 6) AS raw, rank FROM ({semantic_sql(100)})")
def semantic_topk(spark, sf_dir) -> DataFrame:
    found = semantic.search(archive(spark, sf_dir, True).vectors, asked(spark, sf_dir), 100)
    return found.select("line_id", F.round("raw", 6).alias("raw"), "rank")


@query(f"SELECT line_id, text FROM ({LINES}) WHERE length(text) > 2 AND line_id NOT IN (SELECT vec_id || '-0000-0000' FROM embeddings)")
def missing_embeddings(spark, sf_dir) -> DataFrame:
    a = archive(spark, sf_dir, True)
    return semantic.missing(a.lines, a.vectors, "r1").select("line_id", "text")


@query(hits_sql(PREFIXES, False, 50, semantic_sql=semantic_sql(100)))
def rrf_fusion_lex_sem(spark, sf_dir) -> DataFrame:
    return _hits(search.search(archive(spark, sf_dir, True), search.Query(PREFIXES, search.Mode.MEANING), asked(spark, sf_dir)))


@query(f"""SELECT line_id, title, year, l.page_index, text, width, height FROM ({LINES}) l JOIN ({corpus.DOCUMENTS_SQL}) d USING (document_id)
    JOIN (SELECT DISTINCT document_id, page_index, 1000 AS width, 2440 AS height FROM ({LINES})) p USING (document_id, page_index)""")
def line_context(spark, sf_dir) -> DataFrame:
    lines = corpus.archive_lines(spark, sf_dir)
    pages = lines.select("document_id", "page_index").distinct().select("*", F.lit(1000).alias("width"), F.lit(2440).alias("height"))
    found = store.line_context(lines, pages, corpus.archive_documents(spark, sf_dir))
    return found.select("line_id", "title", "year", "page_index", "text", "width", "height")


def name_lines(spark, sf_dir) -> search.Archive:
    """Part names as one-line documents."""
    parts = corpus.table(spark, sf_dir, "part")
    lines = parts.select(
        F.col("p_partkey").cast("string").alias("line_id"), F.col("p_size").cast("string").alias("document_id"), F.lit(0).alias("page_index"), F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>").alias("bbox"),
        F.col("p_name").alias("text"), text.normalize(F.col("p_name")).alias("normalized"), (F.col("p_partkey") % 70 / 100.0).alias("confidence"),
    )
    documents = parts.select(F.col("p_size").cast("string").alias("document_id")).distinct().select("*", F.concat(F.lit("size "), "document_id").alias("title"), F.lit(1900).alias("year"))
    nations = corpus.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("canonical"), F.replace(F.lower("n_name"), F.lit("nation"), F.lit("land")).alias("alias"))
    return search.Archive(lines, documents, aliases=nations)


def _ratio_sql(query: str) -> str:
    """SQL of s, ratio for each distinct text in t (s, n of its length): the partial ratio by bit-parallel LCS in list functions."""
    m, masks = len(query), {c: sum(1 << k for k, x in enumerate(query) if x == c) for c in sorted(set(query))}
    full = f"{(1 << m) - 1}::BIGINT"
    mask = "CASE c " + " ".join(f"WHEN '{c}' THEN {b}::BIGINT" for c, b in masks.items()) + " ELSE 0::BIGINT END"
    bits = f"((1::BIGINT << least(k + n, {m})::INT) - (1::BIGINT << greatest(k, 0)::INT))"
    step = f"lambda v, u: ((v + (v & u & {bits})) | (v - (v & u & {bits}))) & {bits}"
    part = f"200.0::DOUBLE * (least(k + n, {m}) - greatest(k, 0) - bit_count(list_reduce(places, {step}, {bits}))) / (n + least(k + n, {m}) - greatest(k, 0))"
    zeros = f"list_resize([]::BIGINT[], {m - 1}, 0)"
    state = f"SELECT s, n, k, padded, {full} AS v FROM (SELECT s, n, {zeros} || places || {zeros} AS padded, unnest(range(1 - {m}, n)) AS k FROM p WHERE n >= {m})"
    for j in range(m):  # one character of every window at a time
        state = f"SELECT s, n, k, padded, ((v + (v & u)) | (v - (v & u))) & {full} AS v FROM (SELECT *, padded[k + {m + j}] AS u FROM ({state}))"
    return f"""WITH p AS (SELECT s, n, list_transform(string_split(s, ''), lambda c: {mask}) AS places FROM t)
      SELECT s, max(ratio) AS ratio FROM (
        SELECT s, 200.0::DOUBLE * ({m} - bit_count(v)) / ({m} + least(k + {m}, n) - greatest(k, 0)) AS ratio FROM ({state})
        UNION ALL SELECT s, list_max(list_transform(range(1 - n, {m}), lambda k: {part})) FROM p WHERE n <= {m}) GROUP BY s"""


NEARLY = "thonerly heed"


@query(f"""WITH l AS MATERIALIZED ({NORMALIZED}), t AS (SELECT DISTINCT normalized AS s, length(normalized) AS n FROM l WHERE normalized <> ''),
    r AS (SELECT line_id, ratio / 100 AS raw, s FROM ({_ratio_sql(NEARLY)}) JOIN l ON l.normalized = s WHERE ratio >= 60)
    SELECT line_id, round(raw, 6) AS raw, (row_number() OVER (ORDER BY raw DESC, line_id) - 1)::INT AS rank, '{fuzzy.SPELT}' AS reason, s AS matched_form
    FROM r QUALIFY rank < 200""")
def fuzzy_topk(spark, sf_dir) -> DataFrame:
    found = fuzzy.search(corpus.indexed_lines(spark, sf_dir), NEARLY, 0.6, False, 200)
    return found.select("line_id", F.round("raw", 6).alias("raw"), "rank", "reason", "matched_form")


@query()
def name_search(spark, sf_dir) -> DataFrame:
    first = corpus.table(spark, sf_dir, "part").agg(F.min("p_name")).collect()[0][0]
    return _hits(search.search(name_lines(spark, sf_dir), search.Query(first, search.Mode.NAMES, 0.65)))


@query()
def smart_search(spark, sf_dir) -> DataFrame:
    return _hits(search.search(archive(spark, sf_dir, True), search.Query(PREFIXES), asked(spark, sf_dir)))


@query("""WITH a AS (SELECT lower(n_name) AS canonical, replace(lower(n_name), 'nation', 'land') AS alias FROM nation)
    SELECT n.n_nationkey, unnest(list_distinct(list_concat([lower(n.n_name)], [a.canonical, a.alias]))) AS variant
    FROM nation n JOIN a ON a.canonical = lower(n.n_name) OR a.alias = lower(n.n_name)""")
def alias_expansion(spark, sf_dir) -> DataFrame:
    pairs = name_lines(spark, sf_dir).aliases
    names = corpus.table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    return store.alias_variants(names, pairs).select("n_nationkey", "variant")
