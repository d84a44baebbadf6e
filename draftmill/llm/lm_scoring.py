"""Language-model scores from a log-frequency Bloom filter.

Tokens and adjacent token pairs of the training texts are counted by 64-bit hashes: each task sorts and counts
what it has read and sends one packed run per shard; one task per shard merges its runs. Exact token counts
stay sorted arrays. A pair's count c is quantised to q = 1 + floor(log2 c), and (pair, 1) ... (pair, q) go
into the shard's part of one Bloom filter. Arrays and filter are broadcast to the workers. A pair's count is
found by probing (pair, 1), (pair, 2), ... until one is missing; it interpolates with the token's own share:

    p(w | v) = (1 - MIX) * p(w) + MIX * c(v, w) / c(v),    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

and p(w | v) = p(w) where v is unknown. A level stands for the least count that it holds, so the shares of all
followers of a word sum to at most 1, but for pairs that the filter wrongly holds. A text's first token follows an
end token. A model beyond the broadcast bound stays where its shards are: chunks of texts send each shard the distinct
tokens and pairs that it would know, and are scored from the answers.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_first, dealt_out, id_remainder, lean, materialise, packed, text_or_empty, unpacked

#: Filter bits of an entry, and probes.
ENTRY_BITS, PROBES = 10, 6
MIX = 0.5
#: Hashes that a task counts at a time, characters of text that are turned to words at a time, and of a chunk that asks shards.
COUNTED, CHUNK, ASKED = 2_000_000, 400_000, 4_000_000
END = np.uint64(xxhash.xxh64_intdigest(b"\n", 42))  # no word holds a line feed
#: The count that stands for a level q: the least of [2^(q-1), 2^q).
_LEVEL = np.r_[0.0, 2.0 ** np.arange(63)]
#: Counts from here on are kept beside those of one byte.
LARGE = 255


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; the first follows an end."""
    return _mix(np.r_[END, tokens[:-1]] * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts, each text with its end, and tokens per text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    flat: list[bytes] = []
    for w in words:
        flat += w
        flat.append(b"\n")
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 42) for w in flat), np.uint64, len(flat)), lengths


def _chunks(texts: pa.Array, most: int) -> Iterator[list[str]]:
    chunk, n = [], 0
    for t in texts:
        t = t.as_py()
        chunk.append(t)
        n += len(t)
        if n >= most:
            yield chunk
            chunk, n = [], 0
    if chunk:
        yield chunk


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes by byte planes, whose high ones compress well, then the counts."""
    return hashes.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if len(hashes) else b""


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    planes = np.frombuffer(raw, np.uint8)
    return np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _gather(shard_bits: int):
    """Task side: packed runs (shard, kind 1 for tokens or 2 for pairs, run)."""

    def runs(kind: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(hashes, (np.arange(1, 1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits))) if shard_bits else np.array([], np.int64)
        edges = np.r_[0, cut, len(hashes)]
        for s in range(1 << shard_bits):
            if edges[s] < edges[s + 1]:
                at = slice(edges[s], edges[s + 1])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind], pa.int32()), pa.array([_pack(hashes[at], counts[at])], pa.binary())], ["shard", "kind", "run"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        n = 0
        for b in batches:
            for chunk in _chunks(b.column(0), CHUNK):
                tokens, _ = _tokens(chunk)
                held[1].append(tokens)
                held[2].append(_pairs(tokens))
                n += len(tokens)
                if n >= COUNTED:
                    for kind, parts in held.items():
                        yield from runs(kind, parts)
                        parts.clear()
                    n = 0
        if n:
            for kind, parts in held.items():
                yield from runs(kind, parts)

    return scan


def _positions(hashes: np.ndarray, level: int, probe: int, sizes: np.ndarray) -> np.ndarray:
    x = _mix(hashes + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    y = _mix(x + np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return (x + np.uint64(probe) * y) % sizes


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard side: one row per shard with its token arrays and its part of the filter."""

    def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.array([], np.uint64), np.array([], np.int64)
        return _summed(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]))

    def done(shard: int, held: dict[int, list], n: int) -> pa.RecordBatch:
        tokens, counts = folded(held[1])
        pairs, times = folded(held[2])
        level = np.floor(np.log2(np.maximum(times, 1))).astype(np.int64) + 1
        size = max(64, int(level.sum()) * ENTRY_BITS + 7 & ~7)
        bits = np.zeros(size, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            some = pairs[level >= q]
            for k in range(PROBES):
                bits[_positions(some, q, k, np.uint64(size)).astype(np.int64)] = True
        large = np.flatnonzero(counts >= LARGE)
        row = [shard, len(tokens), int(counts.sum()), len(pairs), tokens.tobytes(), np.minimum(counts, LARGE).astype(np.uint8).tobytes(), np.r_[tokens[large].view(np.int64), counts[large]].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], MODEL_NAMES)

    shard, held, n = None, {1: [], 2: []}, 0
    for b in batches:
        for s, kind, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if s != shard:
                if shard is not None:
                    yield done(shard, held, n)
                shard, held, n = s, {1: [], 2: []}, 0
            held[kind].append(_unpack(run.as_buffer().to_pybytes()))
            n += len(held[kind][-1][0])
            if n > 4 * COUNTED:  # fold, so that a shard's memory follows its distinct hashes
                held = {k: [folded(v)] if v else [] for k, v in held.items()}
                n = 0
    if shard is not None:
        yield done(shard, held, n)


MODEL = "shard int, v long, n long, pairs long, tokens binary, counts binary, large binary, filter binary"
MODEL_NAMES = [c.split()[0] for c in MODEL.split(", ")]


class Part:
    """What some shards know: exact counts of their tokens, quantised counts of their pairs."""

    def __init__(self, shard_bits: int, sizes: dict[int, tuple[int, int]], rows: Iterable):
        """``sizes``: tokens and filter bytes of each shard. ``rows`` of shards go one by one to their places in arrays, so that none is held twice."""
        self.bits = shard_bits
        self.size, self.start = np.zeros(1 << shard_bits, np.uint64), np.zeros(1 << shard_bits, np.int64)
        place, v, at = {}, 0, 0
        for shard in sorted(sizes):
            place[shard], (n, held) = v, sizes[shard]
            self.size[shard], self.start[shard] = 8 * held, at
            v, at = v + n, at + held
        self.tokens, self.counts, self.filter = np.empty(v, np.uint64), np.empty(v, np.uint8), np.empty(at, np.uint8)
        large = [np.empty((2, 0), np.int64)]
        for r in rows:
            tokens, bits = np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["filter"], np.uint8)
            own, start = slice(place[r["shard"]], place[r["shard"]] + len(tokens)), self.start[r["shard"]]
            self.tokens[own], self.counts[own] = tokens, np.frombuffer(r["counts"], np.uint8)
            self.filter[start : start + len(bits)] = bits
            large.append(np.frombuffer(r["large"], np.int64).reshape(2, -1))
        large_tokens, large_counts = np.concatenate(large, 1)
        order = np.argsort(large_tokens.view(np.uint64))
        self.large_tokens, self.large_counts = large_tokens.view(np.uint64)[order], large_counts[order]

    def token_counts(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.searchsorted(self.tokens, tokens).clip(0, len(self.tokens) - 1)
        found = np.where(self.tokens[at] == tokens, self.counts[at], 0).astype(np.int64)
        large = np.flatnonzero(found == LARGE)
        found[large] = self.large_counts[np.searchsorted(self.large_tokens, tokens[large])]
        return found

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """q of each pair, 0 where the filter doesn't hold (pair, 1)."""
        out = np.zeros(len(pairs), np.int8)
        shard = (pairs >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(pairs), np.int64)
        left = np.flatnonzero(self.size[shard] > 0)
        q = 1
        while len(left):
            for k in range(PROBES):
                s = shard[left]
                bit = _positions(pairs[left], q, k, self.size[s]).astype(np.int64)
                left = left[(self.filter[self.start[s] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0]
            out[left] = q
            q += 1
        return out


def train(texts: DataFrame, shard_bits: int | None = None) -> tuple[DataFrame, int]:
    """The model's shards (MODEL) from a table with one column of non-null texts, and the bits of a shard number.

    An empty text is its end alone; repeated texts count as often as they come.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (n - 1).bit_length()) if shard_bits is None else shard_bits
    runs = texts.mapInArrow(lean(_gather(bits)), "shard int, kind int, run binary")
    merged = runs.repartition(max(1, n), "shard").sortWithinPartitions("shard").mapInArrow(lean(_merge), MODEL)
    return materialise(merged, "model"), bits


def _scores(known: np.ndarray, levels: np.ndarray, lengths: np.ndarray, end_count: int, n: int, v: int) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of texts of ``lengths`` tokens, from the count of each token and the level of each pair."""
    starts = np.cumsum(lengths) - lengths
    share = (known + 0.5) / (n + 0.5 * (v + 1))
    before = np.r_[0, known[:-1]]
    before[starts] = end_count
    pair = np.divide(_LEVEL[levels], before, out=np.zeros(len(known)), where=before > 0)
    joint = np.where(before > 0, (1 - MIX) * share + MIX * np.minimum(pair, 1.0), share)
    add = lambda x: np.add.reduceat(x, starts)
    return [lengths, add((known > 0).astype(np.int64)), add(np.log10(share)), add(np.log10(joint))]


SCORED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def _scorer(shared, n: int, v: int):
    """Scores by a model that each worker holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        end_count = int(part.token_counts(np.array([END]))[0])
        for b in batches:
            at = 0
            for chunk in _chunks(b.column(2), CHUNK):
                tokens, lengths = _tokens(chunk)
                found = _scores(part.token_counts(tokens), part.levels(_pairs(tokens)), lengths, end_count, n, v)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(chunk)), b.column(1).slice(at, len(chunk)), *map(pa.array, found)], _SCORED_NAMES)
                at += len(chunk)

    return scan


def _asks(bits: int):
    """(shard, chunk, run): the distinct tokens and pairs of a chunk of texts by shard, and under shard -1 its rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for chunk in _chunks(b.column(2), ASKED):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(b.slice(at, len(chunk)))
                at += len(chunk)
                tokens, _ = _tokens(chunk)
                words, pairs = np.unique(tokens), np.unique(_pairs(tokens))
                own, other = dict(dealt_out(words, bits)), dict(dealt_out(pairs, bits))
                none = slice(0, 0)
                rows = [(-1, sink.getvalue().to_pybytes())]
                rows += [(s, packed(words[own.get(s, none)], pairs[other.get(s, none)])) for s in sorted({*own, *other})]
                name = int.from_bytes(os.urandom(8)) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows)), pa.array([r[1] for r in rows], pa.binary())], ["shard", "chunk", "run"])

    return scan


def _answers(bits: int):
    """Rows (shard, kind, chunk, run, tokens, counts, large, filter), a shard's model (kind 0) before what it is asked, to (chunk, shard, run)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = None, None
        for b in batches:
            out = []
            for s, kind, chunk, run, *model in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if s != shard:
                    shard, part = s, Part(bits, {}, [])
                if kind == 0:
                    row = dict(zip(("tokens", "counts", "large", "filter"), model, strict=True))
                    part = Part(bits, {s: (len(row["counts"]), len(row["filter"]))}, [row | {"shard": s}])
                else:
                    words, pairs = unpacked(run, "<u8", "<u8")
                    out.append((chunk, s, packed(part.token_counts(words), part.levels(pairs))))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "shard", "run"])

    return scan


def _from_answers(n: int, v: int):
    """Rows (chunk, shard, run) of a chunk, its texts first and then the answers by shard, to scores."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_first(batches):
            texts = pa.ipc.open_stream(rows[0][2]).read_all().to_batches()[0]
            counts, levels = map(np.concatenate, zip(*[unpacked(r[2], "<i8", "i1") for r in rows[1:]], strict=True))
            tokens, lengths = _tokens(texts.column(2).to_pylist())
            words, own = np.unique(tokens, return_inverse=True)
            pair = np.unique(_pairs(tokens), return_inverse=True)[1]
            end_count = int(counts[np.searchsorted(words, END)])
            found = _scores(counts[own], levels[pair], lengths, end_count, n, v)
            yield pa.RecordBatch.from_arrays([texts.column(0), texts.column(1), *map(pa.array, found)], _SCORED_NAMES)

    return scan


def score_texts(docs: DataFrame, training: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Scores ``docs`` (id long, held_out boolean, text, not null) by a model of ``training`` (text, not null).

    One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Words lie between
    space and \\x09-\\x0D, A-Z lowered, and each text has one end token more, so an empty text has one token.
    With no training text every share is 0.5 / (0.5 * 1) = 1. Counts are over all training texts; token counts
    are exact up to 64-bit hash collisions, pair counts are the filter's. A model of up to ``most`` bytes is
    broadcast; a larger one answers where its shards are, which takes two shuffles more and gives the same scores.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model, bits = train(training)
    total = F.expr("octet_length(tokens) + octet_length(counts) + octet_length(large) + octet_length(filter)")
    n, v, size = model.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", total)]).first()
    if size <= most:
        sizes = {r[0]: (r[1], r[2]) for r in model.select("shard", F.octet_length("counts"), F.octet_length("filter")).collect()}
        shared = spark.sparkContext.broadcast(Part(bits, sizes, model.toLocalIterator()))
        out = docs.mapInArrow(lean(_scorer(shared, n, v)), SCORED)
    else:
        dealt = lambda rows, *keys: rows.repartition(parts, keys[0]).sortWithinPartitions(*keys)
        asks = materialise(docs.mapInArrow(lean(_asks(bits)), "shard int, chunk long, run binary"), "asks")
        known = model.select("shard", F.lit(0).alias("kind"), "tokens", "counts", "large", "filter")
        both = known.unionByName(asks.filter("shard >= 0").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        answers = dealt(both.select("shard", "kind", "chunk", "run", "tokens", "counts", "large", "filter"), "shard", "kind").mapInArrow(lean(_answers(bits)), "chunk long, shard int, run binary")
        texts = asks.filter("shard < 0").select("chunk", "shard", "run")
        out = dealt(texts.unionByName(answers), "chunk", "shard").mapInArrow(lean(_from_answers(n, v)), SCORED)
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def lm_scores(docs: DataFrame, modulus: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """Scores all rows of ``docs`` by a model of those whose crc32(id as text) mod ``modulus`` isn't ``held_out``.

    Null texts count as empty, null ids as the empty text; other columns are ignored; repeated rows count
    and are scored each. See ``score_texts`` for the columns.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (id_remainder(id_col, modulus) == held_out).alias("held_out"), text_or_empty(text_col).alias("text"))
    scored = score_texts(rows, rows.filter(~F.col("held_out")).select("text"), most)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
