"""Quotation linking: messages that quote earlier ones are put after what they answer, without the quotes.

DataFrame operations only. Quote levels are the leading ``>`` marks of a line;
normalised quoted lines and passages are hashed and joined to the first message
of the conversation that says them. Following those links gives each message
the message its thread began with, and the order of the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import _shared as S

#: A line that only introduces the quotation after it.
ATTRIBUTION = r"(?i)^.{0,300}\b(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$"
MARKS = r"^(?:[ \t]*>)+"
#: Consecutive turns, or threads, whose places are counted in one task.
SPAN = 256


def level(line: Column) -> Column:
    """Quote marks before a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (the text without quotations) and quotes (level, text of each quoted unit)."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)
    marked = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("body")))
    quoting = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    rows = messages.select("conv_id", "turn", "role", "text", F.when(quoting, marked).alias("lines"))

    def own_line(x: Column, i: Column) -> Column:
        after = F.get(F.col("lines"), i + 1)
        introduces = x["body"].rlike(ATTRIBUTION) & (F.coalesce(after["level"], F.lit(0)) > 0)
        return (x["level"] == 0) & ~introduces

    # a passage is a run of quoted lines of one level; its number counts the changes of level before it
    changes = F.transform("lines", lambda x, i: F.when((i > 0) & (F.get(F.col("lines"), i - 1)["level"] == x["level"]), 0).otherwise(1))
    own = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.filter("lines", own_line), lambda x: x["body"]), "\n"))
    return rows.select("conv_id", "turn", "role", F.trim(F.regexp_replace(F.coalesce(own, F.lit("")), r"^\s+|\s+$", "")).alias("own"), "lines", changes.alias("changes"))


def quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, key, size: every quoted line and every quoted passage of several lines."""
    lines = messages.where(F.col("lines").isNotNull()).select("conv_id", "turn", F.posexplode(F.arrays_zip("lines", "changes")).alias("at", "x"))
    lines = lines.select("conv_id", "turn", "at", F.col("x.lines.level").alias("level"), F.col("x.lines.body").alias("body"), F.col("x.changes").alias("new"))
    by_message = Window.partitionBy("conv_id", "turn").orderBy("at")
    quoted = lines.withColumn("passage", F.sum("new").over(by_message)).where("level > 0")
    whole = quoted.groupBy("conv_id", "turn", "level", "passage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), " ").alias("body"), F.count("*").alias("n"))
    units = quoted.select("conv_id", "turn", "level", "body").unionByName(whole.where("n > 1").select("conv_id", "turn", "level", "body"))
    units = units.withColumn("body", normalised(F.col("body"))).where("body <> ''")
    return units.select("conv_id", "turn", "level", F.md5("body").alias("key"), F.length("body").alias("size"))


def originals(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv_id, key, said: the first turn that says a line, a paragraph or the whole of a message, where anything is quoted."""
    some = messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    units = F.concat(F.split("own", "\n", -1), F.split("own", r"\n\s*\n", -1), F.array("own"))
    said = some.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, normalised))).alias("body")).where("body <> ''")
    return said.groupBy("conv_id", F.md5("body").alias("key")).agg(F.min("turn").alias("said"))


def links(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the message quoted at the outermost level, by most characters, the latest of equals."""
    found = quoted.join(said, ["conv_id", "key"]).where("said < turn")
    each = found.groupBy("conv_id", "turn", "said").agg(F.min("level").alias("level"), F.sum("size").alias("size"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "size", "said"))
    return each.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.said").alias("parent"))


def threads(linked: DataFrame) -> DataFrame:
    """Adds ``root`` and ``depth`` to conv_id, turn, parent by pointer doubling."""
    now = S.materialize(linked.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth"), F.lit(False).alias("done")), "threads")
    while now.where("not done").limit(1).count():
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"))
        joined = now.join(up, ["conv_id", "root"], "left")
        now = S.materialize(
            joined.select("conv_id", "turn", "parent", F.coalesce("up_root", "root").alias("root"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), F.col("up_root").isNull().alias("done")),
            "threads",
        )
    return now.drop("done")


def _before(size: str, by: list[str], order: list[str]) -> Column:
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(window), F.lit(0))


def places(turns: DataFrame) -> DataFrame:
    """Adds ``position``, the rows of the conversation before (root, turn), to conv_id, turn, root, n.

    Counted through spans of threads, threads in a span, spans of a thread and
    turns in a span, so that no conversation is ordered in one task.
    """
    turns = turns.withColumn("band", F.expr(f"floor(root / {SPAN})")).withColumn("span", F.expr(f"floor(turn / {SPAN})"))
    parts = turns.groupBy("conv_id", "band", "root", "span").agg(F.sum("n").alias("n"))
    roots = parts.groupBy("conv_id", "band", "root").agg(F.sum("n").alias("n"))
    bands = roots.groupBy("conv_id", "band").agg(F.sum("n").alias("n"))
    a = bands.select("conv_id", "band", _before("n", ["conv_id"], ["band"]).alias("a"))
    b = roots.select("conv_id", "band", "root", _before("n", ["conv_id", "band"], ["root"]).alias("b"))
    c = parts.select("conv_id", "band", "root", "span", _before("n", ["conv_id", "root"], ["span"]).alias("c"))
    own = turns.withColumn("d", _before("n", ["conv_id", "root", "span"], ["turn"]))
    joined = own.join(c, ["conv_id", "band", "root", "span"]).join(b, ["conv_id", "band", "root"]).join(a, ["conv_id", "band"])
    return joined.select("conv_id", "turn", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("position"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotations), parent_turn, root_turn, depth, position.

    ``position`` orders a conversation: threads by their first turn, messages
    of a thread by turn. A message without a link begins a thread of its own,
    so a conversation without quotations stays in turn order. Rows repeating
    (conv_id, turn) share one position. Null text counts as empty. Rows with a
    null conv_id or turn are in no conversation: depth 0, no position. Marks
    that quote nothing earlier are removed all the same.
    """
    rows = parsed(messages.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")))
    named = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = S.materialize(quotations(named), "quotations")
    linked = threads(links(quoted, originals(named, quoted)))
    turns = named.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    turns = S.materialize(turns.join(linked, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn")), "turns")
    known = turns.select("conv_id", "turn", "parent", "root", "depth").join(places(turns.select("conv_id", "turn", "root", "n")), ["conv_id", "turn"])
    return rows.join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce(F.col("depth"), F.lit(0)).cast("long").alias("depth"), F.col("position").cast("long").alias("position"),
    )


def op7_chat(spark, sf_dir: str) -> DataFrame:
    return conversations(S.read(spark, sf_dir, "conversations"))


def _oracle() -> str:
    said = lambda x: rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    marks = MARKS.replace("'", "''")
    return rf"""
    WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text, string_split_regex(coalesce(text, ''), '\r?\n') AS ls,
      coalesce(regexp_matches(text, '(?m)^[ \t]*>'), false) AS q FROM conversations),
    l AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '{marks}'), '[^>]', '', 'g')) AS level, regexp_replace(x, '{marks}[ \t]?', '') AS body
      FROM (SELECT id, conv_id, turn, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM m WHERE q)),
    n AS (SELECT *, coalesce(lead(level) OVER w, 0) AS following, CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY id ORDER BY i)),
    kept AS (SELECT id, string_agg(body, chr(10) ORDER BY i) AS t FROM n WHERE level = 0 AND NOT (regexp_matches(body, '{ATTRIBUTION}') AND following > 0) GROUP BY id),
    r AS (SELECT id, conv_id, turn, role, trim(regexp_replace(CASE WHEN q THEN coalesce(t, '') ELSE coalesce(text, '') END, '^\s+|\s+$', '', 'g')) AS own FROM m LEFT JOIN kept USING (id)),
    p AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS passage FROM n),
    units AS (SELECT conv_id, turn, level, {said('body')} AS b FROM p WHERE level > 0
      UNION ALL SELECT conv_id, turn, level, {said("string_agg(body, ' ' ORDER BY i)")} FROM p WHERE level > 0 GROUP BY conv_id, turn, level, passage HAVING count(*) > 1),
    origin AS (SELECT conv_id, b, min(turn) AS first FROM (SELECT conv_id, turn, {said('part')} AS b FROM (
      SELECT conv_id, turn, unnest(string_split(own, chr(10)) || string_split_regex(own, '\n\s*\n') || [own]) AS part FROM r)) WHERE b <> '' GROUP BY conv_id, b),
    f AS (SELECT u.conv_id, u.turn, o.first, min(level) AS level, sum(length(u.b)) AS size FROM units u JOIN origin o ON o.conv_id = u.conv_id AND o.b = u.b AND o.first < u.turn GROUP BY ALL),
    link AS (SELECT conv_id, turn, first AS parent FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, first DESC) = 1),
    th AS (SELECT DISTINCT conv_id, turn, turn AS root, 0 AS depth FROM r ANTI JOIN link USING (conv_id, turn)
      UNION ALL SELECT link.conv_id, link.turn, th.root, th.depth + 1 FROM th JOIN link ON link.conv_id = th.conv_id AND link.parent = th.turn)
    SELECT r.conv_id, r.turn, role, own AS text, parent AS parent_turn, root AS root_turn, depth::BIGINT AS depth,
      (rank() OVER (PARTITION BY r.conv_id ORDER BY root, r.turn) - 1)::BIGINT AS position
    FROM r JOIN th ON th.conv_id = r.conv_id AND th.turn = r.turn LEFT JOIN link ON link.conv_id = r.conv_id AND link.turn = r.turn"""


ORACLE = _oracle()
