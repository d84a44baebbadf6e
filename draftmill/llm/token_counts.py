"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The lowest-rank adjacent pair is popped again and again and merged; a word's count is its initial symbols
minus its merges. No identifiers are emitted. Words repeat, so each worker keeps a bounded table of counts.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, lean, text_or_empty

# Fixed value: how byte-level vocabularies of this kind split a text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a worker remembers, and the longest such word.
REMEMBERED, LONGEST = 400_000, 40


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BytePairs:
    """Counts tokens as the vocabulary file's library does, without special tokens at the ends."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level byte-pair vocabularies without a normaliser can be counted")
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        self.symbol = [vocab[alphabet[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left], vocab[right]] = k
            self.result.append(vocab[left + right])
        self.words = regex.compile(SPLIT)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.counts = _Counts(self)

    def merged(self, word: bytes) -> int:
        """Tokens of one word: symbols minus merges."""
        n = len(word)
        if n < 2:
            return n
        ranks, result = self.ranks.get, self.result
        sym = [self.symbol[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is rank * n + place: the lowest rank first, then the leftmost. The rank tells the pair, so an entry is stale if the pair there has changed.
        heap = [r * n + i for i in range(n - 1) if (r := ranks((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or sym[i] < 0 or ranks((sym[i], sym[j])) != rank:
                continue
            sym[i], sym[j] = result[rank], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, r * n + i)
            if (p := before[i]) >= 0 and (r := ranks((sym[p], sym[i]))) is not None:
                heapq.heappush(heap, r * n + p)
        return left

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if len(text) < 1 << 20:
            return sum(map(self.counts.__getitem__, self.words.findall(text)))
        return sum(self.counts[m[0]] for m in self.words.finditer(text))


class _Counts(dict):
    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, word: str) -> int:
        n = self.pairs.merged(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


_loaded: dict[int, BytePairs] = {}


def _counter(vocabulary) -> BytePairs:
    if vocabulary.id not in _loaded:
        _loaded.clear()
        _loaded[vocabulary.id] = BytePairs(vocabulary.value)
    return _loaded[vocabulary.id]


class _Shared:
    """A broadcast with a stable key, so that a worker parses the vocabulary once."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Whole texts, without truncation. A null text counts as empty: 0 bytes, 0 tokens. Special strings of the
    vocabulary inside a text are one token each. Null ids and repeated rows pass through. Other columns are
    ignored. The vocabulary file is read on the driver and its bytes are broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        raw = f.read(BROADCAST_BYTES + 1)
    if len(raw) > BROADCAST_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    BytePairs(raw)  # fails here, not on an executor
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(raw), hash(raw))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _counter(shared)
        for b in batches:
            text = b.column(1)
            n = [pairs.count(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(lean(count), "id long, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
