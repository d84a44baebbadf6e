"""Repeated passages, found as near-duplicate paragraphs by MinHash banding.

There are two kinds of paragraphs. Lines get a MinHash signature of their five-word shingles, cut into bands that
are tuned so that lines at the wanted similarity collide with high probability. Colliding lines form candidate
groups; inside a group exact Jaccard similarities decide the links, and components of links are the classes of
repeats. Equal lines are one node throughout, however often they occur. A passage is a run of repeated lines in a
text; runs of too few words are let be.

A passage may also stand anywhere else, inside longer lines, over line ends or in lines of few words. So each run of
51 words, wherever it starts, is a paragraph too. Neighbours overlap, hence their MinHash values are sliding minima,
which stay the same for many words on. One band of these is a key; paragraphs whose key several places have are
candidates, verified word for word (by a hash of all 51 words). Repeated ones that follow each other are a passage, so
its ends are exact and no window of 51 words is missed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import by_first, dealt_out, lean, materialise, packed, text_or_empty, unpacked, words_of

SHINGLE = 5
#: Words of a run of repeated lines that is reported, and of a window of the word stream that is a paragraph of its own.
PASSAGE_WORDS, WINDOW_WORDS = 50, 51
#: MinHash values in the one band of windows. Equal windows agree in all, so one band finds them all; two values keep most windows out that share only a phrase.
WINDOW_ROWS = 2
#: Most binary logarithm of the bits that keys set in a table sent to all tasks (32 MB); a fuller one only lets more windows or lines be verified.
TABLE_LOG = 28
#: Signature values at most (of whole texts, of lines), and the share of pairs at the wanted similarity that must collide.
VALUES, LINE_VALUES, RECALL = 64, 32, 0.999
#: Lines of a candidate group that one task compares with as many others.
PART = 500
#: Groups of over PART lines up to which their sizes are broadcast (16 bytes each); beyond, a shuffle does it.
BROADCAST_GROUPS = 1_000_000
#: Words of lines, and of windows, that are hashed at a time.
CHUNK, WINDOW_CHUNK = 100_000, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(7).integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def tune_bands(similarity: float, recall: float = RECALL, values: int = VALUES) -> tuple[int, int]:
    """(bands, rows): most rows a band, hence fewest false candidates, that reach ``recall`` within ``values``."""
    best = None
    for rows in range(1, values + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows <= values:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach that recall; allow more values")
    return best


def paragraphs(text: str | None) -> list[list[bytes]]:
    """Words (A-Z lowered) of each line that has any, in order."""
    lines = (line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")) if text else ()
    return [w for w in lines if w]


def paragraph_id(words: list[bytes]) -> int:
    """Signed 64-bit hash of the words joined by blanks."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def _shingles(many: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of paragraphs, and where each starts; those of fewer than SHINGLE words are one shingle."""
    digest = xxhash.xxh64_intdigest
    many = [p if len(p) >= SHINGLE else [*p, *[b""] * (SHINGLE - len(p))] for p in many]
    lengths = np.array([len(p) for p in many])
    words = np.fromiter((digest(w) for p in many for w in p), np.uint64, int(lengths.sum()))
    rolled = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * _BASE + words[k : len(words) - SHINGLE + 1 + k]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(29)
    ends = np.cumsum(lengths)
    inside = np.ones(len(words), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    counts = lengths - SHINGLE + 1
    return rolled[inside[: len(rolled)]], np.r_[0, np.cumsum(counts)[:-1]]


def band_keys(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(bands, n) keys of n sets of shingle hashes, none empty: the MinHash values of each band, mixed."""
    keys = np.empty((bands, len(starts)), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for a in _ODD[band * rows : (band + 1) * rows]:
            key = (key ^ np.minimum.reduceat(shingles * a, starts)) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
        keys[band] = key
    return keys


def packed_keys(keys: np.ndarray, names: np.ndarray, log: int) -> pa.RecordBatch:
    """(bucket, run): the (bands, n) keys and their names, by the first ``log`` bits of the keys."""
    names = np.tile(names, len(keys))
    keys = keys.ravel()
    order = np.argsort(keys)
    keys, names = keys[order], names[order]
    place = (keys >> np.uint64(64 - log)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    ends = np.r_[edges[1:], len(place)]
    blobs = [keys[s:e].tobytes() + names[s:e].tobytes() for s, e in zip(edges, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(place[edges], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "run"])


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring words, the same wherever they stand."""
    one = np.ones(1, np.uint64)
    powers = np.multiply.accumulate(np.r_[one, np.full(len(words), _BASE)])
    inverse = np.multiply.accumulate(np.r_[one, np.full(len(words), pow(int(_BASE), -1, 1 << 64), np.uint64)])
    sums = np.r_[np.zeros(1, np.uint64), np.add.accumulate(words * inverse[:-1])]
    h = (sums[n:] - sums[: len(sums) - n]) * powers[: len(sums) - n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """``f`` (least or greatest) over each n neighbours."""
    width = 1
    while 2 * width <= n:
        x, width = f(x[:-width], x[width:]), 2 * width
    return f(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def window_keys(words: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window's start its key, one band of MinHash values of its shingles, and whether it lies in one text.

    ``words`` holds hashes of the words of texts in a row, ``ends`` for each the end of its text.
    """
    n = min(SHINGLE, window)
    shingles = _rolled(words, n)
    keys = np.zeros(len(words) - window + 1, np.uint64)
    for a in _ODD[:WINDOW_ROWS]:
        keys = (keys ^ _sliding(np.minimum, shingles * a, window - n + 1)) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(31)
    return keys, np.arange(window, len(words) + 1) <= ends[: len(keys)]


def _streams(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the words of texts of at least ``window`` words, texts by id: ids, starts and ends of their texts, hashes."""

    def joined(held: list[tuple[int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        held.sort(key=lambda x: x[0])
        sizes = np.array([len(w) for _, w in held])
        ends = np.cumsum(sizes)
        words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(w for _, w in held)), np.uint64, int(ends[-1]))
        return np.repeat(np.array([i for i, _ in held], np.int64), sizes), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), words

    held, n = [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = words_of(text.as_py())
            if len(words) >= window:
                held.append((i, words))
                n += len(words)
                if n > WINDOW_CHUNK:
                    yield joined(held)
                    held, n = [], 0
    if held:
        yield joined(held)


def _key_runs(window: int, log: int):
    """Task side: (bucket, run) of the sorted keys of windows and whether several places of the chunk have them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, starts, ends, words in _streams(batches, window):
            keys, inside = window_keys(words, ends, window)
            at = np.flatnonzero(inside)
            keys, text = keys[at], starts[at]
            keys = keys[np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]]
            keys, times = np.unique(keys, return_counts=True)
            buckets, runs = zip(*[(k, packed(keys[s], times[s] > 1)) for k, s in dealt_out(keys, log)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(runs, pa.binary())], ["bucket", "run"])

    return scan


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket side: the keys that several places have."""
    for rows in by_first(batches):
        keys, several = map(np.concatenate, zip(*[unpacked(r[1], "<u8", "?") for r in rows], strict=True))
        order = np.argsort(keys)
        keys, several = keys[order], several[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        shared = np.logical_or.reduceat(several, start) | (np.diff(np.r_[start, len(keys)]) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[start][shared].view(np.int64))], ["key"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bit) in order of blocks to (block, bits packed)."""
    block, held = None, np.zeros(1 << 16, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    for b in batches:
        blocks, bits = b.column(0).to_numpy(), b.column(1).to_numpy()
        for k in np.unique(blocks).tolist():
            if k != block:
                if block is not None:
                    yield done()
                block, held = k, np.zeros(1 << 16, bool)
            held[bits[blocks == k]] = True
    if block is not None:
        yield done()


def bit_table(keys: DataFrame):
    """A broadcast table of bits set by the first bits of ``keys`` (key long), and the logarithm of its size: at most TABLE_LOG."""
    log = min(TABLE_LOG, max(16, (16 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - log)
    rows = keys.select(F.shiftright(slot, 16).alias("block"), slot.bitwiseAND(F.lit(65535)).alias("bit"))
    bits = np.zeros(1 << (log - 3), np.uint8)
    for k, own in rows.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_bits), "block long, bits binary").toLocalIterator():
        bits[k << 13 : (k + 1) << 13] = np.frombuffer(own, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits), log


def _in_table(bits: np.ndarray, log: int, keys: np.ndarray) -> np.ndarray:
    slot = (keys >> np.uint64(64 - log)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


WINDOW_RUN = ("<u8", "<i8", "<i4", "<i4", "?")  # of windows with one hash in a chunk: hash, first id and place, occurrences, whether several ids have it
CHUNK_PLACES = ("<i8", "<i4", "<i4", "<u4")  # of runs of windows in a chunk: id, first place, length; of each window the number of its hash
REPLY = ("?", "<i4", "<i8", "<i4")  # of each hash whether it is repeated; of those: occurrences, first id and place


def _window_runs(window: int, table, table_log: int, log: int):
    """Task side: (bucket, chunk, run) of the candidate windows of each chunk, and in bucket -1 their places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for ids, starts, ends, words in _streams(batches, window):
            keys, inside = window_keys(words, ends, window)
            at = np.flatnonzero(inside & _in_table(bits, table_log, keys))
            if not len(at):
                continue
            own, ids, place = _rolled(words, window)[at], ids[at], (at - starts[at]).astype(np.int32)
            order = np.argsort(own, kind="stable")  # equal ones stay in order of id and place
            new = np.r_[True, own[order][1:] != own[order][:-1]]
            number = np.empty(len(at), np.uint32)
            number[order] = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            size = np.diff(np.r_[head, len(at)])
            first, last = order[head], order[head + size - 1]
            columns = (own[first], ids[first], place[first], size.astype(np.int32), ids[first] != ids[last])
            broken = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (starts[at][1:] != starts[at][:-1])])
            rows = [(-1, packed(ids[broken], place[broken], np.diff(np.r_[broken, len(at)]).astype(np.int32), number))]
            rows += [(k, packed(*[c[s] for c in columns])) for k, s in dealt_out(own[first], log)]
            chunk = int.from_bytes(os.urandom(8)) >> 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows)), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "chunk", "run"])

    return scan


def _window_replies(inside: bool):
    """Bucket side: (chunk, bucket, run): a REPLY for each run. A window that very many texts have comes once a chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_first(batches):
            parts = [unpacked(r[2], *WINDOW_RUN) for r in rows]
            lengths = [len(p[0]) for p in parts]
            hashes, ids, places, sizes, several = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((places, ids, hashes))
            new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
            start, group = np.flatnonzero(new), np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            size = np.add.reduceat(sizes[order].astype(np.int64), start)
            apart = np.logical_or.reduceat(several[order], start) | (np.maximum.reduceat(ids[order], start) != ids[order[start]])
            repeated = (size > 1 if inside else apart)[group]
            size = np.minimum(size, np.iinfo(np.int32).max).astype(np.int32)
            first = order[start][group]
            runs, at = [], 0
            for n in lengths:
                some = at + np.flatnonzero(repeated[at : at + n])
                runs.append(packed(repeated[at : at + n], size[group[some]], ids[first[some]], places[first[some]]))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows], pa.int32()), pa.array(runs, pa.binary())], ["chunk", "bucket", "run"])

    return scan


def _window_spans(window: int):
    """Chunk side: rows (chunk, bucket, run) of a chunk, its places first, to its spans of repeated windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_first(batches):
            ids, places, lengths, number = unpacked(rows[0][2], *CHUNK_PLACES)
            repeated, size, first_id, first_place = map(np.concatenate, zip(*[unpacked(r[2], *REPLY) for r in rows[1:]], strict=True))
            of = np.cumsum(repeated) - 1  # hashes to repeated ones
            run = np.repeat(np.arange(len(ids)), lengths)
            at = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + places[run]
            some = np.flatnonzero(repeated[number])
            if not len(some):
                continue
            own = of[number[some]]
            run, at, size, first_id, first_place = run[some], at[some], size[own], first_id[own], first_place[own]
            gone = (ids[run] != first_id) | (at != first_place)  # rows repeated with one id stay or go alike
            change = lambda x: x[1:] != x[:-1]
            start = np.flatnonzero(np.r_[True, change(run) | (np.diff(at) != 1) | change(size) | change(first_id) | change(gone)])
            n = np.diff(np.r_[start, len(some)]) + window - 1
            columns = [ids[run[start]], at[start].astype(np.int32), n.astype(np.int32), size[start].astype(np.int64), first_id[start], first_place[start], gone[start]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["id", "first_word", "n_words", "class_size", "first_id", "first_id_word", "removed"])

    return scan


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, places, names, sizes = [], [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for k, words in enumerate(paragraphs(text.as_py())):
                ids.append(i)
                places.append(k)
                names.append(paragraph_id(words))
                sizes.append(len(words))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(names, pa.int64()), pa.array(sizes, pa.int32())], ["id", "place", "paragraph", "n_words"])


def _bands(bands: int, rows: int, log: int):
    """Task side: (bucket, run) with packed (key, paragraph) pairs; each paragraph once in a chunk."""

    def packed(held: dict[int, list[bytes]]) -> pa.RecordBatch:
        return packed_keys(band_keys(*_shingles(list(held.values())), bands, rows), np.array(list(held), np.int64), log)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        n = 0
        for b in batches:
            for text in b.column(0):
                for words in paragraphs(text.as_py()):
                    name = paragraph_id(words)
                    if name not in held:
                        held[name] = words
                        n += len(words)
                if n > CHUNK:
                    yield packed(held)
                    held, n = {}, 0
        if held:
            yield packed(held)

    return scan


def collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket side: names of one band key, each linked with the first."""

    def links(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not runs:
            return
        keys = np.concatenate([np.frombuffer(r, np.uint64, len(r) // 16) for r in runs])
        names = np.concatenate([np.frombuffer(r, np.int64, len(r) // 16, len(r) // 2) for r in runs])
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        first = names[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        far = (first != names) & np.r_[True, names[1:] != names[:-1]]
        if far.any():
            yield pa.RecordBatch.from_arrays([pa.array(first[far]), pa.array(names[far])], ["a", "b"])

    bucket, runs = None, []
    for b in batches:
        for k, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if k != bucket:
                yield from links(runs)
                bucket, runs = k, []
            runs.append(run.as_py())
    yield from links(runs)


def _texts(table, log: int):
    """(paragraph, words) of the lines whose bits are in the table, each once a batch; a few others come along."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for b in batches:
            found: dict[int, bytes] = {}
            for text in b.column(0):
                own = {n: w for w in paragraphs(text.as_py()) if (n := paragraph_id(w)) not in found}
                names = np.fromiter(own, np.int64, len(own))
                found |= {n: b" ".join(own[n]) for n in names[_in_table(bits, log, names.view(np.uint64))].tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["paragraph", "words"])

    return scan


def similar_pairs(names: np.ndarray, sets: list[np.ndarray], own: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs that connect what exact Jaccard similarities connect. ``own``: the part of each, one of which pairs need differ from the other unless all are the same."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    posting = np.empty(len(order), np.int64)
    posting[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(values)]))
    ends = np.r_[start[1:], len(values)]
    sizes = np.array([len(s) for s in sets])
    offsets = np.r_[0, np.cumsum(sizes)]
    root = np.arange(len(sets))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    mixed = bool((own != own[0]).any())
    for k in range(len(sets)):
        mine = posting[offsets[k] : offsets[k + 1]]
        shared = np.bincount(np.concatenate([owners[start[p] : ends[p]] for p in mine]), minlength=k)[:k]
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (sizes[:k] + sizes[k] - shared) - 1e-9))
        for j in near if not mixed else near[own[near] != own[k]]:
            a, b = find(int(j)), find(k)
            if a != b:
                root[a] = b
                yield int(names[j]), int(names[k])


def _verified(similarity: float):
    """Streams (group, left, right, part, paragraph, words) blocks; links of exact similarity."""

    def links(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = list({r[1]: r for r in rows}.values())
        if len(rows) < 2:
            return
        shingles, starts = _shingles([r[2].split(b" ") for r in rows])
        sets = [np.unique(s) for s in np.split(shingles, starts[1:])]
        found = list(similar_pairs(np.array([r[1] for r in rows], np.int64), sets, np.array([r[0] for r in rows]), similarity))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(6)]
            for group, left, right, part, name, words in zip(*columns, strict=True):
                if (group, left, right) != block:
                    yield from links(rows)
                    block, rows = (group, left, right), []
                rows.append((part, name, words))
        yield from links(rows)

    return scan


def in_parts(groups: DataFrame, part: int) -> DataFrame:
    """``groups`` (node, component) with cuts and part: components of over ``part`` nodes in cuts parts, by hash of the node."""
    large = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("cuts")).filter("cuts > 1")
    large = materialise(large, "large")  # at most one row in ``part`` nodes
    large = F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large
    placed = groups.join(large, "component", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    return placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))


def paragraph_classes(source: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(paragraph, class_id) of paragraphs of ``source`` (text, not null) with similar, different ones."""
    spark = source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, rows = tune_bands(similarity, values=LINE_VALUES)
    log = max(1, (2 * parts - 1).bit_length())
    runs = source.select("text").mapInArrow(lean(_bands(bands, rows, log)), "bucket int, run binary")
    links = runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(collisions), "a long, b long")
    groups = materialise(connected_components(links), "collisions")
    wanted = bit_table(groups.select(F.col("node").alias("key")))
    texts = source.select("text").mapInArrow(lean(_texts(*wanted)), "paragraph long, words binary")
    texts = texts.groupBy("paragraph").agg(F.min("words").alias("words"))
    placed = in_parts(groups, PART)
    # Blocks (left, right) of parts, left <= right: each pair of paragraphs meets in one.
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    blocks = placed.join(texts, placed["node"] == texts["paragraph"]).select("component", "part", other.alias("o"), "paragraph", "words")
    blocks = blocks.select("component", F.least("part", "o").alias("left"), F.greatest("part", "o").alias("right"), "part", "paragraph", "words")
    blocks = blocks.repartition(parts, "component", "left", "right").sortWithinPartitions("component", "left", "right", "paragraph")
    found = connected_components(blocks.mapInArrow(lean(_verified(similarity)), "a long, b long"))
    return found.select(F.col("node").alias("paragraph"), F.col("component").alias("class_id"))


def _repeated_windows(source: DataFrame, window: int, inside: bool) -> DataFrame:
    """(id, first_word, n_words, class_id, class_size, first_id, removed): runs of windows that several ids hold."""
    spark = source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = max(1, (2 * parts - 1).bit_length())
    dealt = lambda rows, *keys: rows.repartition(parts, keys[0]).sortWithinPartitions(*keys)
    keys = dealt(source.mapInArrow(lean(_key_runs(window, log)), "bucket int, run binary"), "bucket").mapInArrow(lean(_shared_keys), "key long")
    table, table_log = bit_table(materialise(keys, "windowkeys"))
    found = materialise(source.mapInArrow(lean(_window_runs(window, table, table_log, log)), "bucket int, chunk long, run binary"), "windows")
    replies = dealt(found.filter("bucket >= 0"), "bucket", "chunk").mapInArrow(lean(_window_replies(inside)), "chunk long, bucket int, run binary")
    places = found.filter("bucket < 0").select("chunk", "bucket", "run")
    spans = dealt(places.unionByName(replies), "chunk", "bucket").mapInArrow(lean(_window_spans(window)), "id long, first_word int, n_words int, class_size long, first_id long, first_id_word int, removed boolean")
    return spans.withColumn("class_id", F.xxhash64("first_id", "first_id_word")).drop("first_id_word")


def repeated_passages(docs: DataFrame, similarity: float = 0.8, least_words: int = PASSAGE_WORDS, window_words: int = WINDOW_WORDS, inside: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of a repeated passage, and per span of words that several ids hold: id, place,
    first_word, n_words, class_id, class_size, first_id, removed.

    place counts the id's lines that have words from 0. A class holds lines of Jaccard similarity of at least
    ``similarity``, directly or over others; class_size is its occurrences. A passage is a run of lines whose
    classes several ids have, ``least_words`` words long or more. Of a class the occurrence of smallest (id,
    place) stays; removed is true for the others. first_word is 0 for lines.

    Regardless of lines, all windows of ``window_words`` words that several ids hold are reported as well, with
    place null and first_word counted in the text's words. Windows that follow each other are one span if
    they occur as often, are first in the same id and stay or go alike; spans may overlap each other and
    lines. Of a window the occurrence of smallest (id, first_word) stays. class_id is a hash of the place of
    the first occurrence of a span's first window.

    What one id alone says several times is reported only if ``inside`` is true. Null and empty texts have no
    lines. Rows with a null id are not looked at. Rows repeated with one id are that id's repeats of itself.
    Other columns are ignored; an empty table gives no rows.
    """
    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = materialise(source.mapInArrow(lean(_occurrences), "id long, place int, paragraph long, n_words int"), "lines")
    classes = materialise(paragraph_classes(source, similarity), "classes")
    # Counts fold by line first, then by class.
    counts = rows.groupBy("paragraph").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("first"), F.max("id").alias("last_id"))
    counts = counts.join(classes, "paragraph", "left").withColumn("class_id", F.coalesce("class_id", "paragraph"))
    totals = counts.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"), F.max("last_id").alias("last_id"))
    totals = totals.filter("class_size > 1" if inside else "first.id <> last_id").drop("last_id")
    named = materialise(counts.select("paragraph", "class_id").join(totals, "class_id"), "repeats")
    hits = rows.join(named, "paragraph")
    # Runs of neighbouring places: place less its rank is constant in a run; repeated rows share a rank.
    run = hits.withColumn("run", F.col("place") - F.expr("dense_rank() over (partition by id order by place)"))
    words = run.withColumn("run_words", F.expr("sum(n_words) over (partition by id, run)"))
    lines = words.filter(F.col("run_words") >= least_words).withColumn("first_word", F.lit(0))
    lines = lines.withColumn("removed", ~((F.col("id") == F.col("first.id")) & (F.col("place") == F.col("first.place"))))
    spans = _repeated_windows(source, window_words, inside).withColumn("place", F.lit(None).cast("int"))
    shown = [F.col("id").alias(id_col), "place", "first_word", "n_words", "class_id", "class_size"]
    return lines.select(*shown, F.col("first.id").alias("first_id"), "removed").unionByName(spans.select(*shown, "first_id", "removed"))


def remove_passages(docs: DataFrame, similarity: float = 0.8, least_words: int = PASSAGE_WORDS, window_words: int = WINDOW_WORDS, inside: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what ``repeated_passages`` removes cut from their texts, in the same columns.

    Lines that lose some words have the others joined by blanks. Columns may have any names. Null and empty texts stay
    as they are, as do rows with a null id. Rows that share an id lose the same places; of repeated passages the one of
    smallest id stays, as ``repeated_passages`` decides. No rows give no rows.
    """
    place, names = docs.columns.index(text_col), [f"c{k}" for k in range(len(docs.columns))]
    found = repeated_passages(docs, similarity, least_words, window_words, inside, id_col, text_col).filter("removed")
    cuts = found.groupBy(F.col(id_col).alias("_id")).agg(F.collect_set(F.struct("place", "first_word", "n_words")).alias("_cuts"))
    joined = docs.toDF(*names).join(cuts, F.col(names[docs.columns.index(id_col)]).cast("long") == F.col("_id"), "left").drop("_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b.column(k) for k in range(b.num_columns - 1)]
            given = b.column(b.num_columns - 1).to_pylist()
            texts = [without(t, [tuple(x.values()) for x in c]) if c and t else t for t, c in zip(kept[place].to_pylist(), given, strict=True)]
            kept[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, names)

    return joined.mapInArrow(lean(cut), docs.toDF(*names).schema).toDF(*docs.columns)


def without(text: str, cuts: list[tuple[int | None, int, int]]) -> str:
    """The text less (place, first word, words) cuts, those of place null by words of the text; a line without words left goes as a whole."""
    gone: dict[int | None, set[int]] = {}
    for place, first, n in cuts:
        gone.setdefault(place, set()).update(range(first, first + n))
    spans = gone.pop(None, set())
    kept, k, at = [], 0, 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        own = {j for j in range(len(words)) if at + j in spans}
        at += len(words)
        if words:
            own |= gone.get(k, set())
            k += 1
        if not own:
            kept.append(line)
        elif left := [w for j, w in enumerate(words) if j not in own]:
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return "\n".join(kept)
