"""Fast exact token ids of a byte-level BPE vocabulary.

Texts are cut into pre-tokens with array operations, each distinct pre-token is
encoded once, and the ids are gathered back into text order. The vocabulary is
the ``tokenizers`` file; ``tiktoken`` merges its ranks several times as fast, and
the tests hold the ids equal to those of ``tokenizers`` on the whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from quillmark.llm import _shared as S

#: Distinct pre-tokens remembered in a worker; the memory is cleared beyond it.
CACHE = 250_000
#: The contractions that the pre-tokenizer's pattern splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of concatenated texts begin; no pre-token spans two texts.

    A run of letters, of numbers or of other signs takes one space before it;
    other white space stays apart, its last character on its own before a run.
    """
    n = len(points)
    kind = S.classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == S.SPACE
    # the last white space of a run that is followed by another run of the same text
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start[:n])
    if len(quote):
        padded = np.concatenate((points, np.zeros(3, points.dtype)))
        stop = offsets[np.searchsorted(offsets, quote, side="right")]
        for suffix in CONTRACTIONS:
            hit = quote + len(suffix) < stop
            for k, c in enumerate(suffix):
                hit &= padded[quote + 1 + k] == ord(c)
            start[quote[hit] + 1] = False
            start[quote[hit] + 1 + len(suffix)] = True
    return np.flatnonzero(start[:n])


def ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level vocabulary file of ``tokenizers``, special tokens left out.

    Its strings write each byte as a printable character: bytes that print in
    Latin-1 as themselves, the others, in order, from code point 256 on.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"] for t in content["added_tokens"]}
    return {bytes(byte[c] for c in word): n for word, n in content["model"]["vocab"].items() if word not in special}


class Encoder:
    """Ids of whole texts; one instance in each worker process."""

    _instances: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        #: Added tokens stand for themselves wherever their text occurs; the longest wins.
        self.added = {k: np.array([n], np.uint32) for k, n in added.items()}
        self.splits = re.compile("|".join(re.escape(k) for k in sorted(added, key=lambda k: (-len(k), k)))) if added else None
        # every text given is one pre-token already
        self.bpe = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})
        self.known: dict[int, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._instances:
            cls._instances[path] = cls(path)
        return cls._instances[path]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's offset in it."""
        if self.splits is None or not any(self.splits.search(t) for t in texts):
            return self._plain(texts)
        pieces, after, owner = [], [], []  # what stands between added tokens, and the one that ends it
        for n, text in enumerate(texts):
            at = 0
            for found in self.splits.finditer(text):
                pieces.append(text[at : found.start()])
                after.append(self.added[found[0]])
                owner.append(n)
                at = found.end()
            pieces.append(text[at:])
            after.append(np.zeros(0, np.uint32))
            owner.append(n)
        ids, offsets = self._plain(pieces)
        parts = [x for k, end in enumerate(after) for x in (ids[offsets[k] : offsets[k + 1]], end)]
        sizes = np.bincount(owner, [len(parts[2 * k]) + len(parts[2 * k + 1]) for k in range(len(after))], len(texts))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes).astype(np.int64)))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, offsets = S.code_points(texts)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        start = pretoken_starts(points, offsets)
        end = np.append(start[1:], len(points))
        distinct, at, where = np.unique(S.Rolling(points)(start, end), return_index=True, return_inverse=True)
        keys, known = distinct.tolist(), self.known
        missing = [k for k, h in enumerate(keys) if h not in known]
        if missing:
            if len(known) + len(missing) > CACHE:
                known.clear()
                missing = range(len(keys))
            whole, first, stop, encode = "".join(texts), start[at].tolist(), end[at].tolist(), self.bpe.encode_ordinary
            for k in missing:
                known[keys[k]] = array("I", encode(whole[first[k] : stop[k]])).tobytes()
        parts = [known[h] for h in keys]
        sizes = np.array([len(p) for p in parts], np.int64) // 4
        flat, begin = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(sizes) - sizes
        each = sizes[where]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begin[where] - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
