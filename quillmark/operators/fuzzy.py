"""Fuzzy and phonetic line search: best partial ratio of normalised forms, names matched by sound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import phonetics, text

#: Least score, score of a full phonetic match, and of partial ones.
LEAST, PHONETIC, PARTIAL, PER_WORD = 45.0, 86.0, 68.0, 12.0
SOUNDS, SPELT = "phonetische Namensvariante", "ähnliche Schreibweise"


#: Bits of a machine word that hold pattern characters; the last one is for the carry.
BITS = 63


def _common(masks: list[np.ndarray], m: int, windows: int) -> np.ndarray:
    """LCS of a pattern of m characters with every window of m places along the last axis.

    ``masks`` has, for each word of the pattern, the bits of the pattern's characters that equal
    a place's character. The state of a window is as many words, advanced for all windows together.
    """
    full = [np.uint64((1 << min(BITS, m - BITS * w)) - 1) for w in range(len(masks))]
    state = [np.full((*masks[0].shape[:-1], windows), f, np.uint64) for f in full]
    for j in range(m):
        carry = np.uint64(0)
        for w, f in enumerate(full):
            u = state[w] & masks[w][..., j : j + windows]
            total = state[w] + u + carry
            carry = total >> np.uint64(BITS)
            state[w] = (total | (state[w] - u)) & f
    return m - sum(np.bitwise_count(s).astype(np.int64) for s in state)


def _within_texts(query: str, texts: list[str]) -> np.ndarray:
    """Best ratio of the query over windows of texts at least as long."""
    m, sizes = len(query), np.array([len(t) for t in texts])
    pad = "\0" * (m - 1)
    points = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), "<u4")
    masks = [np.zeros(len(points), np.uint64) for _ in range(0, m, BITS)]
    for c in set(query):
        at = points == ord(c)
        for w, mask in enumerate(masks):
            mask[at] = sum(1 << k for k, x in enumerate(query[BITS * w : BITS * (w + 1)]) if x == c)
    count = sizes + m - 1
    first = np.cumsum(count) - count  # the window one character into each text
    owner = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(count.sum()) - np.repeat(first, count)
    inside = np.minimum(offset + 1, np.minimum(m, sizes[owner] + m - 1 - offset))
    return np.maximum.reduceat(200.0 * _common(masks, m, len(points) - m + 1)[: count.sum()] / (m + inside), first)


def _within_query(query: str, texts: list[str]) -> np.ndarray:
    """Best ratio of texts of one length, at most the query's, over windows of the query."""
    k, pad = len(texts[0]), "\0" * (len(texts[0]) - 1)
    place = np.frombuffer((pad + query + pad).encode("utf-32-le", "surrogatepass"), "<u4")
    said = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, k)
    masks = [np.zeros((len(texts), len(place)), np.uint64) for _ in range(0, k, BITS)]
    for j in range(k):
        masks[j // BITS] |= (said[:, j : j + 1] == place).astype(np.uint64) << np.uint64(j % BITS)
    n = len(query) + k - 1
    inside = np.minimum(np.arange(n) + 1, np.minimum(k, n - np.arange(n)))
    return (200.0 * _common(masks, k, n) / (k + inside)).max(axis=1)


#: Places handled at once; bounds memory.
PLACES = 400_000


def partial_ratios(query: str, texts: list[str]) -> np.ndarray:
    """Partial ratio of the query with every text, 0 to 100: the shorter over windows of the longer, either way if equally long."""
    m, out = len(query), np.zeros(len(texts))
    if not m:
        return out
    longer = [k for k, t in enumerate(texts) if len(t) >= m]
    ends = np.cumsum([len(texts[k]) + m for k in longer], dtype=np.int64)
    for part in np.split(np.array(longer, np.int64), np.flatnonzero(np.diff(ends // PLACES)) + 1):
        if len(part):
            out[part] = _within_texts(query, [texts[k] for k in part])
    by_size: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        if 0 < len(t) <= m:
            by_size.setdefault(len(t), []).append(k)
    for size, some in by_size.items():
        step = max(1, PLACES // (m + 2 * size))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            out[part] = np.maximum(out[part], _within_query(query, [texts[k] for k in part]))
    return out


def aliases_of(aliases: DataFrame | None, name: str) -> list[str]:
    """The normalised name and both sides of every alias pair that it is part of."""
    if aliases is None:
        return [name]
    pairs = aliases.where(F.col("canonical") == name).unionByName(aliases.where(F.col("alias") == name))
    found = {x for r in pairs.select("canonical", "alias").distinct().collect() for x in r}
    return [name, *sorted(found - {name})]


def search(lines: DataFrame, query: str, fuzziness: float, names: bool, cap: int, aliases: DataFrame | None = None, candidate_cap: int | None = None) -> DataFrame | None:
    """line_id, raw, rank, reason, matched_form of the ``cap`` best lines; None for an empty query.

    ``lines`` has line_id, normalized, confidence and maybe alternatives (an
    array of structs with text). All lines are scored; ``candidate_cap``
    scores only so many, the most confident first, as the archive's users know it (20,000).
    """
    q = text.normalize_string(query)
    if not q:
        return None
    variants = aliases_of(aliases, q)
    if candidate_cap is not None:
        lines = lines.orderBy(F.desc("confidence"), "line_id").limit(candidate_cap)
    forms = F.array("normalized")
    if "alternatives" in lines.columns:
        forms = F.concat(forms, F.transform(F.coalesce("alternatives", F.array()), lambda a: text.normalize(a["text"])))
    rows = lines.select("line_id", F.posexplode(forms).alias("k", "form"))

    @F.pandas_udf("double")
    def ratio(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            where, distinct = pd.factorize(s.fillna("").to_numpy(object))
            yield pd.Series(np.max([partial_ratios(v, distinct.tolist()) for v in variants], axis=0)[where])

    scored = rows.withColumn("score", ratio("form")).withColumn("sounds", F.lit(False))
    if names:
        wanted = rows.sparkSession.createDataFrame([(w,) for w in q.split(" ")], "w string").select(phonetics.cologne(F.col("w")).alias("c"))
        wanted = [r["c"] for r in wanted.collect()]
        held = phonetics.codes(F.col("form"))
        have = sum((F.when(F.array_contains(held, c), 1).otherwise(0) for c in wanted if c), F.lit(0))
        scored = scored.withColumn("have", have)
        every = F.col("have") == len(wanted)
        some = (F.col("have") > 0) & F.lit(len(wanted) > 1)
        scored = scored.withColumn("sounds", every).withColumn(
            "score", F.when(every, F.greatest("score", F.lit(PHONETIC))).when(some, F.greatest("score", PARTIAL + PER_WORD * F.col("have") / len(wanted))).otherwise(F.col("score"))
        )
    least = max(LEAST, 100.0 * fuzziness)
    best = scored.where(F.col("score") >= least).groupBy("line_id").agg(F.max(F.struct("score", (-F.col("k")).alias("k"), "form", "sounds")).alias("b"))
    kept = best.select(
        "line_id", (F.col("b.score") / 100).alias("raw"), F.when(F.col("b.sounds"), SOUNDS).otherwise(SPELT).alias("reason"), F.col("b.form").alias("matched_form")
    )
    top = kept.orderBy(F.desc("raw"), "line_id").limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("raw"), "line_id")) - 1)  # over cap rows
