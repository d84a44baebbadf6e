import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from draftmill.llm.token_counts import BytePairs, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(docs, records, rows, library):
    expected = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in records), key=repr)
    assert rows(token_counts(docs, PATH, limit=50)) == expected


def test_odd_texts_equal_the_library(library):
    rng = random.Random(1)
    parts = ["a", "Z", " ", "  ", "\n", "\t", "\u0085", "\x1c", "'s", "'ll", "<|endoftext|>", "<|endof", "é", "中", "٣", "½", "🙂", "\u200b", "\u3000", "!", "...", "\x00", "ab" * 40]
    pairs = BytePairs(open(PATH, "rb").read())
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pairs.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_no_rows(empty):
    assert token_counts(empty, PATH).count() == 0
