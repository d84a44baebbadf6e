"""Near-duplicates by SimHash fingerprints, found with the generalised pigeonhole principle.

Fingerprints that differ in at most R bits must differ in at most T of the bits of some partition when the sum
of (T + 1) over partitions is R + 1. Bits are put in an order in which neighbours correlate; dynamic programming
cuts that order into partitions and gives each its own threshold (-1: unused), so that the estimated signatures
and candidates cost least. The estimate comes from counts of bit pairs over all fingerprints. A partition of
threshold T gives one signature for each choice of T bits to leave out; fingerprints that share a signature
are candidates and are verified. Each bucket of a signature gives a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import lean, materialise, text_or_empty, words_of
from .substring_dedup import _ODD, band_keys, in_parts, similar_pairs, tune_bands

#: Seconds for each 64-bit word of a signature's record (made, shuffled, sorted) and for a candidate (compared), for the plan's costs.
SIGNATURE_COST, CANDIDATE_COST = 2e-7, 4e-9
#: Fingerprints whose signatures a task makes at a time.
BLOCK = 20_000
#: Texts of a component that one task compares with as many others.
PART = 1000
#: Ids of dropped documents up to which they are broadcast (8 bytes each); beyond, documents are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Shingles, and eighths of characters, whose MinHash values a task makes at a time.
CHUNK = 400_000
#: MinHash values in a sketch, four bits of each in 64-bit words, and the chance that a pair at the wanted similarity is taken for unlike.
SKETCH, SKETCH_WORDS, SKETCH_MISS = 64, 4, 5e-5
#: Up to this size a bucket's pairs are compared by offset, all buckets at once.
SMALL = 48


# ---- fingerprints


def _majority(hashes: np.ndarray) -> np.ndarray:
    """(n, bytes) hashes to the bytes whose bits are set in over half of them."""
    n, width = hashes.shape
    totals = np.zeros(8 * width, np.int64)
    for at in range(0, n, 65025):
        bits = np.unpackbits(hashes[at : at + 65025], axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            totals += np.add.reduce(bits[:whole].reshape(-1, 255, 8 * width), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        totals += bits[whole:].sum(0, dtype=np.int64)
    return np.packbits(2 * totals > n, bitorder="little")


def shingle_fingerprint(text: str | None, n: int) -> bytes:
    """8 bytes, little-endian: each bit set in over half of the XXH64 hashes (seed 42) of the n-word shingles.

    Repeats count; fewer words are one shingle; no words give zero.
    """
    words = words_of(text)
    if not words:
        return bytes(8)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False)) if len(words) >= n else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, max(1, len(words) - n + 1))
    return _majority(hashes.view(np.uint8).reshape(-1, 8)).tobytes()


def word_set_fingerprint(text: str | None) -> bytes:
    """16 bytes over the set of words: an edited word changes one feature, not n shingles."""
    words = set(words_of(text))
    if not words:
        return bytes(16)
    return _majority(np.frombuffer(b"".join(map(xxhash.xxh128_digest, words)), np.uint8).reshape(-1, 16)).tobytes()


def fingerprints(docs: DataFrame, make, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, fp binary) for each row; ``make`` turns a text (never null) into bytes of one length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(t.as_py()) for t in b.column(1)], pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(lean(scan), "id long, fp binary")


# ---- the plan


def bit_counts(fps: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, in how many both are set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((bits, bits)), 0
        for b in batches:
            for at in range(0, len(b), 1 << 16):
                some = b.column(0).slice(at, 1 << 16)
                x = np.unpackbits(_raw(some, bits), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                n += len(some)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits * bits + 1), pa.int64()), pa.array(np.r_[total.ravel(), n].astype(np.int64))], ["k", "n"])

    rows = fps.select("fp").mapInArrow(lean(scan), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # bits * bits + 1 rows
    counts = np.zeros(bits * bits + 1)
    for k, n in rows:
        counts[k] = n
    return int(counts[-1]), counts[:-1].reshape(bits, bits)


def _raw(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, bits // 8)


def correlated_order(n: int, both: np.ndarray) -> list[int]:
    """The bits along a greedy path to the most correlated bit not yet on it."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, -1)
    order = [int(np.unravel_index(corr.argmax(), corr.shape)[0])]
    left = set(range(len(p))) - set(order)
    while left:
        nearest = max(left, key=lambda k: (corr[order[-1], k], -k))
        order.append(nearest)
        left.remove(nearest)
    return order


def plan_partitions(n: int, both: np.ndarray, radius: int, most: int = 3, words: int = 1) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold) of least estimated cost; thresholds up to ``most``. A signature's record is of ``words`` words.

    The distance of two fingerprints inside a partition is taken from a chain over its bits in order, with the
    counted pair probabilities of neighbours.
    """
    order = correlated_order(n, both)
    bits = len(order)
    p = np.clip(np.diag(both) / max(1, n), 1e-6, 1 - 1e-6)
    # joint[k]: the four probabilities of bits order[k], order[k + 1]; from it the transitions of a pair of fingerprints.
    steps = []
    for a, b in zip(order, order[1:], strict=False):
        one = np.clip(both[a, b] / max(1, n), 1e-9, 1)
        joint = np.clip(np.array([[1 - p[a] - p[b] + one, p[b] - one], [p[a] - one, one]]), 1e-9, 1)
        steps.append(np.kron(*[joint / joint.sum(1, keepdims=True)] * 2))
    differs = np.array([False, True, True, False])
    pairs = n * (n - 1) / 2

    def costs(start: int) -> Iterator[tuple[int, list[float]]]:
        one = np.array([1 - p[order[start]], p[order[start]]])
        first = np.kron(one, one)
        state = np.zeros((most + 1, 4))
        state[0, ~differs] = first[~differs]
        state[1, differs] = first[differs]
        for end in range(start + 1, bits + 1):
            width, at = end - start, state.sum(1)
            yield end, [math.comb(width, t) * n * words * SIGNATURE_COST + pairs * CANDIDATE_COST * sum(at[h] * math.comb(width - h, t - h) for h in range(t + 1)) if t <= width else math.inf for t in range(most + 1)]
            if end < bits:
                moved = state @ steps[end - 1]
                state = np.where(differs, np.r_[np.zeros((1, 4)), moved[:-1]], moved)

    need = radius + 1
    best = [[math.inf] * (need + 1) for _ in range(bits + 1)]
    back: list[list] = [[None] * (need + 1) for _ in range(bits + 1)]
    best[0][0] = 0.0
    for start in range(bits):
        reach = [u for u in range(need + 1) if best[start][u] < math.inf]
        for end, cost in costs(start):
            for u in reach:
                for t in range(-1, most + 1):
                    v, c = min(need, u + t + 1), best[start][u] + (cost[t] if t >= 0 else 0.0)
                    if c < best[end][v]:
                        best[end][v], back[end][v] = c, (start, u, t)
    plan, end, u = [], bits, need
    while end:
        start, u, t = back[end][u]
        if t >= 0:
            plan.append((order[start:end], t))
        end = start
    return plan[::-1]


def masks_of(plan: list[tuple[list[int], int]], words: int) -> np.ndarray:
    """One row of 64-bit words for each signature: the bits that it keeps."""
    rows = []
    for part, t in plan:
        for out in combinations(part, t):
            row = [0] * words
            for k in set(part) - set(out):
                row[k // 64] |= 1 << (k % 64)
            rows.append(row)
    return np.array(rows, np.uint64).reshape(-1, words)


# ---- probing


def _keys(fps: np.ndarray, mask: np.ndarray, number: int) -> np.ndarray:
    """A 64-bit key of the kept bits; unequal bits may share one, which verification sorts out."""
    x = np.full(len(fps), (number * 0x9E3779B97F4A7C15 + 1) % (1 << 64), np.uint64)
    for w in range(fps.shape[1]):
        x = (x ^ (fps[:, w] & mask[w])) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _signatures(masks: np.ndarray, buckets_log: int):
    """Task side: for each bucket and mask, the fingerprints whose key falls there, packed."""
    words = masks.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                fps = np.ascontiguousarray(_raw(b.column(0).slice(at, BLOCK), 64 * words)).view(np.uint64)
                parts: dict[int, list[bytes]] = {}
                for number, mask in enumerate(masks):
                    place = (_keys(fps, mask, number) >> np.uint64(64 - buckets_log)).astype(np.int64)
                    order = np.argsort(place, kind="stable")
                    ends = np.cumsum(np.bincount(place, minlength=1 << buckets_log))
                    sorted_fps = fps[order]
                    start = 0
                    for bucket in np.flatnonzero(np.diff(ends, prepend=0)):
                        end = ends[bucket]
                        parts.setdefault(int(bucket), []).append(np.array([number, end - start], "<u4").tobytes() + sorted_fps[start:end].tobytes())
                        start = end
                blobs = [b"".join(x) for x in parts.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "run"])

    return scan


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def within(radius: int) -> Near:
    return lambda a, b: _distance(a, b) <= radius


def sketches(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(n, SKETCH_WORDS): four bits of each of SKETCH MinHash values of n sets of shingle hashes, none empty."""
    out = np.zeros((len(starts), SKETCH_WORDS), np.uint64)
    for k, a in enumerate(_ODD[:SKETCH]):
        out[:, k // 16] |= (np.minimum.reduceat(shingles * a, starts) & np.uint64(15)) << np.uint64(4 * (k % 16))
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values of two sketches agree."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return SKETCH - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def least_agreement(similarity: float) -> int:
    """The most values of which pairs at ``similarity`` have fewer in common by a chance of at most SKETCH_MISS."""
    p = similarity + (1 - similarity) / 16
    missed, k = 0.0, 0
    while k < SKETCH and missed + (now := math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)) <= SKETCH_MISS:
        missed, k = missed + now, k + 1
    return k


def within_and_alike(radius: int, words: int, least: int) -> Near:
    """Whether fingerprints of ``words`` words are within ``radius`` and the sketches behind them agree in ``least`` values, which is asked of the few that are."""

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = _distance(a[:, :words], b[..., :words]) <= radius
        some = np.flatnonzero(near)
        near[some] = agreement(a[some, words:], (b[some] if b.ndim > 1 else b)[..., words:]) >= least
        return near

    return close


def _forest(fps: np.ndarray, close: Near) -> list[tuple[int, int]]:
    """Links (row numbers) that connect what rows that are ``close`` connect, at most one fewer than rows."""
    left = np.arange(len(fps))
    links = []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            k = frontier.pop()
            near = close(fps[left], fps[k])
            if near.any():
                found = left[near]
                links += zip(repeat(int(k)), found.tolist())
                frontier += found.tolist()
                left = left[~near]
    return links


def bucket_links(fps: np.ndarray, keys: np.ndarray, close: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (two arrays of fingerprints) among rows of equal key that are ``close``, enough to connect them all."""
    order = np.argsort(keys, kind="stable")
    fps, keys = fps[order], keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    size = np.diff(np.r_[start, len(keys)])
    small = (size > 1) & (size <= SMALL)
    # Rows with a partner `offset` places on in the same bucket.
    rest = np.repeat(np.where(small, size, 0), size) - (np.arange(len(keys)) - np.repeat(start, size)) - 1
    rows = np.flatnonzero(rest > 0)
    offset = 1
    while len(rows):
        near = rows[close(fps[rows], fps[rows + offset])]
        if len(near):
            yield fps[near], fps[near + offset]
        offset += 1
        rows = rows[rest[rows] >= offset]
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        links = _forest(fps[s : s + n], close)
        if links:
            at = np.array(links)
            yield fps[s + at[:, 0]], fps[s + at[:, 1]]


def _probe(masks: np.ndarray, close: Near):
    """Bucket side: links between fingerprints."""
    words = masks.shape[1]

    def links(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        by_mask: dict[int, list[np.ndarray]] = {}
        for run in runs:
            at = 0
            while at < len(run):
                number, n = np.frombuffer(run, "<u4", 2, at).tolist()
                by_mask.setdefault(number, []).append(np.frombuffer(run, np.uint64, n * words, at + 8).reshape(-1, words))
                at += 8 + 8 * n * words
        del runs
        for number in sorted(by_mask):
            fps = np.concatenate(by_mask.pop(number))
            for a, b in bucket_links(fps, _keys(fps, masks[number], number), close):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, runs = None, []
        for b in batches:
            for k, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != bucket:
                    yield from links(runs)
                    bucket, runs = k, []
                runs.append(run.as_py())
        yield from links(runs)

    return scan


def fingerprint_links(fps: DataFrame, bits: int, radius: int, similarity: float | None = None) -> DataFrame:
    """Links (a, b binary) between rows of ``fps`` (fp binary, distinct): enough to connect all within ``radius``.

    With ``similarity`` a sketch follows each fingerprint in fp, and rows are linked only if their sketches, too,
    are those of texts of that similarity.
    """
    n, both = bit_counts(fps.select(F.substring("fp", 1, bits // 8).alias("fp")), bits)
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a binary, b binary")
    words, close = bits // 64, within(radius)
    if similarity is not None:
        close = within_and_alike(radius, words, least_agreement(similarity))
        words += SKETCH_WORDS
    masks = masks_of(plan_partitions(n, both, radius, words=words), words)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log = max(1, (2 * parts - 1).bit_length())
    runs = fps.select("fp").mapInArrow(lean(_signatures(masks, log)), "bucket int, run binary")
    return runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_probe(masks, close)), "a binary, b binary").distinct()


def fingerprint_components(rows: DataFrame, bits: int, radius: int, similarity: float | None = None) -> DataFrame:
    """(fp, first_id, component_id) for each distinct fp of ``rows`` (id, fp), ids not null.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits; ``similarity`` as in
    ``fingerprint_links``.
    """
    groups = materialise(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "fingerprints")
    links = materialise(fingerprint_links(groups, bits, radius, similarity), "fplinks")
    named = links.join(groups.select(F.col("fp").alias("a"), F.col("first_id").alias("x")), "a").join(groups.select(F.col("fp").alias("b"), F.col("first_id").alias("y")), "b")
    found = connected_components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return groups.join(found.withColumnRenamed("node", "first_id"), "first_id", "left").select("fp", "first_id", F.coalesce("component", "first_id").alias("component_id"))


def simhash_components(docs: DataFrame, n: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Fingerprints are over n-word shingles; those that differ in at most ``radius`` bits are linked, and a
    component is named by its smallest id. Null and empty texts have fingerprint zero and are linked like any
    other. A row with a null id gets its fingerprint, is not linked and has component_id null. Rows repeated
    with one id are one document if their texts are the same, else each has its own fingerprint and component.
    Other columns are ignored; no rows give no rows.
    """
    rows = materialise(fingerprints(docs, lambda t: shingle_fingerprint(t, n), id_col, text_col), "simhash")
    found = fingerprint_components(rows.filter("id is not null"), 64, radius)
    joined = rows.join(found.select("fp", "component_id"), "fp", "left")
    digits = F.lower(F.concat(*[F.substring(F.hex("fp"), k, 2) for k in range(15, 0, -2)]))  # bytes are little-endian
    return joined.select(F.col("id").alias(id_col), digits.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


# ---- documents to keep


def _similar(shingle: int, similarity: float):
    """Streams rows (component, left, right, part, id, text) in order; links of ids that connect what is similar in a block."""

    def links(rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        ids = np.array([r[1] for r in rows], np.int64)
        found = list(similar_pairs(ids, [r[2] for r in rows], np.array([r[0] for r in rows]), similarity))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for b in batches:
            for c, left, right, part, i, text in zip(*[b.column(k).to_pylist() for k in range(5)], b.column(5), strict=True):
                if (c, left, right) != block:
                    yield from links(rows)
                    block, rows = (c, left, right), []
                own = shingle_hashes(text.as_py(), shingle)
                rows.append((part, i, np.fromiter(own, np.uint64, len(own))))
        yield from links(rows)

    return scan


def shingle_hashes(text: str | None, n: int) -> set[int]:
    """Hashes of the set of n-word shingles; fewer words are one, no words the empty shingle."""
    words = words_of(text)
    if len(words) < n:
        return {xxhash.xxh64_intdigest(b" ".join(words))}
    return set(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False))))


def _chunks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[dict[str, list[int]], np.ndarray, np.ndarray]]:
    """Some texts at a time, each once with its ids, their sets of shingle hashes in a row, and where each starts."""
    held: dict[str, list[int]] = {}
    sets: list[np.ndarray] = []
    n = 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            n += 1
            if text in held:
                held[text].append(i)
            else:
                own = shingle_hashes(text, shingle)
                held[text] = [i]
                sets.append(np.fromiter(own, np.uint64, len(own)))
                n += len(own) + len(text) // 8
            if n > CHUNK:
                yield held, np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
                held, sets, n = {}, [], 0
    if held:
        yield held, np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]


def _sketched(shingle: int):
    """Task side: (id, fp) with the fingerprint of each text's set of words and the sketch of its shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shingles, starts in _chunks(batches, shingle):
            prints = [word_set_fingerprint(t) + x.tobytes() for t, x in zip(held, sketches(shingles, starts), strict=True)]
            ids = [i for own in held.values() for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([p for p, own in zip(prints, held.values(), strict=True) for _ in own], pa.binary())], ["id", "fp"])

    return scan


def _banded(shingle: int, bands: int, rows: int, log: int):
    """Task side: (bucket, run) with records of MinHash band key, smallest id and sketch of each text of a chunk, packed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shingles, starts in _chunks(batches, shingle):
            keys = band_keys(shingles, starts, bands, rows)
            ids = np.array([min(own) for own in held.values()], np.int64).view(np.uint64)
            records = np.c_[keys.ravel(), np.tile(np.c_[ids, sketches(shingles, starts)], (bands, 1))]
            records = records[np.argsort(records[:, 0], kind="stable")]
            place = (records[:, 0] >> np.uint64(64 - log)).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            blobs = [records[s:e].tobytes() for s, e in zip(edges, np.r_[edges[1:], len(place)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(place[edges], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "run"])

    return scan


def _band_links(least: int):
    """Bucket side: links of ids of one band key whose sketches agree in ``least`` values."""

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return agreement(a[..., 1:], b[..., 1:]) >= least

    def links(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not runs:
            return
        records = np.concatenate([np.frombuffer(r, np.uint64).reshape(-1, 2 + SKETCH_WORDS) for r in runs])
        # Copies of one text come once a chunk: their records are alike but for the id, the smallest of which stands for the rest.
        records = records[np.lexsort(records.T[[1, *range(2, 2 + SKETCH_WORDS), 0]])]
        same = np.r_[False, (records[1:, [0, *range(2, 2 + SKETCH_WORDS)]] == records[:-1, [0, *range(2, 2 + SKETCH_WORDS)]]).all(1)]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(records))))
        found = [(records[first[same], 1], records[same, 1])]
        records = records[~same]
        found += [(a[:, 0], b[:, 0]) for a, b in bucket_links(records[:, 1:], records[:, 0], close)]
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in range(2))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, runs = None, []
        for b in batches:
            for k, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != bucket:
                    yield from links(runs)
                    bucket, runs = k, []
                runs.append(run.as_py())
        yield from links(runs)

    return scan


def shingle_links(source: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b long) of ids of ``source`` (id, text): enough to connect those whose texts share a MinHash band and whose sketches agree.

    The share of pairs found depends on the Jaccard similarity of their shingles alone, whatever the edit: 0.999
    at ``similarity``, more above. Texts that merely share a band aren't linked, so unlike texts form no chains. Of
    texts that are equal the smallest id has links.
    """
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log = max(1, (2 * parts - 1).bit_length())
    runs = source.select("id", "text").mapInArrow(lean(_banded(shingle, *tune_bands(similarity), log)), "bucket int, run binary")
    return runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_band_links(least_agreement(similarity))), "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less near copies: one document of each group stays, with all its columns.

    Fingerprints are 128-bit SimHashes of the sets of words; those within ``radius`` bits are candidates. They find
    scattered edits, but few texts cut short or added to, so texts that share a MinHash band of their shingles
    are candidates as well. Each candidate pair is judged by sketches of both texts (four bits of 64 MinHash
    values), which tell unlike texts apart, and only pairs that pass are linked. Components of these links are
    compared exactly. Texts of a component whose sets of
    ``shingle``-word shingles have a Jaccard similarity of at least ``similarity`` are similar, and so are texts
    that others link by such pairs; of each such group the smallest id stays. A component of over PART texts is
    split by hash of the id, and each two of its parts are compared.

    Of equal texts the smallest id stays. Null texts count as empty, and empty texts are copies of each other.
    Rows with a null id stay. Rows that share an id are one document and stay or go together. A task holds
    the shingles of two parts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty(text_col)
    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = materialise(source.mapInArrow(lean(_sketched(shingle)), "id long, fp binary"), "simhash128")
    # Equal texts fold by digest, so that no copy's text travels.
    firsts = materialise(source.select(F.sha2("text", 256).alias("sha"), "id").groupBy("sha").agg(F.min("id").alias("id")).select("id").distinct(), "firsts")
    near = materialise(fingerprint_components(rows, 128, radius, similarity), "fpgroups")
    near = rows.join(near.select("fp", "component_id"), "fp").filter("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b"))
    found = connected_components(near.unionByName(shingle_links(source, shingle, similarity)))
    groups = materialise(firsts.withColumnRenamed("id", "node").join(found, "node"), "candidates")
    group = in_parts(groups, PART).select(F.col("component").alias("component_id"), "cuts", "part", F.col("node").alias("id")).join(source, "id")
    # Blocks (left, right) of parts, left <= right: each pair of texts meets in one.
    group = group.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    blocks = group.select("component_id", F.least("part", "o").alias("left"), F.greatest("part", "o").alias("right"), "part", "id", "text")
    blocks = blocks.repartition(parts, "component_id", "left", "right").sortWithinPartitions("component_id", "left", "right", "id")
    similar = connected_components(blocks.mapInArrow(lean(_similar(shingle, similarity)), "a long, b long"))
    copies = similar.filter("node <> component").select(F.col("node").alias("id"))
    kept = firsts.join(copies, "id", "left_anti")
    gone = materialise(rows.select(F.col("id").alias("_gone_id")).distinct().join(kept, F.col("_gone_id") == F.col("id"), "left_anti"), "dropped")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_gone_id"), "left_anti")
