import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmark.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "S", "s", "t", "r", "e", "v", "l", "d", "m", "'", " ", " ", "\n", "\t", "\r", " ", "　", "1", "²", "é", "ß", "中", ",", ".", "!", "\U0001f600", "́", "_", "\x1c", "\x85", "<|endoftext|>", "'s", "'ll", "  ", "The", " of"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_ids_equal_those_of_the_library(reference):
    rng = random.Random(3)
    texts = ["", *("".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(5000)), "x" * 5000, " " * 3000]
    ids, offsets = Encoder.at(PATH)(texts)
    want = reference.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [e.ids for e in want]
