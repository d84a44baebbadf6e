"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel of two words is that of Lodhi et al. (2002) with subsequences of three characters: each weighs DECAY
to the power of the characters it spans, up to SPAN, so that gaps and inserted characters cost similarity but
don't break it. It is normalised and squared. A word is mapped to its kernels with landmark words, whitened by
the landmarks' own kernel matrix (Nystrom), and a linear machine with squared hinge loss judges it. A text is a
bag of words: a toxic one is known to hold some toxic word, which training finds in rounds (the words that the
last round judges worst); words of clean texts are all clean and all fitted. A text's score is a logistic function of its two
worst words, fitted on the same texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, lean, text_or_empty

DECAY, SPAN = 0.8, 5
#: Characters of a piece; longer words are cut into pieces that overlap.
PIECE, OVERLAP = 24, 8
LANDMARKS = 96
#: Words that mark toxic texts and are compared at a time when landmarks are chosen.
MARKS = 500
#: Labelled texts of each class that are fitted, chosen by hash of the id.
TOXIC_ROWS, CLEAN_ROWS = 1500, 2000
#: Bytes of all these texts together, and of the longest of them: longer ones are scored but not fitted.
SAMPLE_BYTES, ROW_BYTES = 48 << 20, 1 << 20
#: Words whose judgement a task remembers in each of two generations, and characters of text judged at a time.
REMEMBERED, CHUNK = 120_000, 400_000
# Fixed value: ASCII signs, taken off both ends of words.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CODES = 48
#: What a word on the wrong side costs: a witness, one of its disguised forms, a word of clean texts; and what the squares of the weights cost.
WITNESS_COST, FORM_COST, CLEAN_COST, RIDGE = 2.0, 0.5, 0.1, 1.0
#: Log of how much more frequent in toxic texts a word must be to be a witness.
LEAST_ODDS = 1.5


def _code(c: str) -> int:
    """1 to 47: letters a-z, then others, digits and signs in few classes; 0 pads."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if c.isalpha():
        return 27 + ord(c) % 16
    if c.isdigit():
        return 43
    return 44 + ord(c) % 3


_TABLE = {k: _code(chr(k)) for k in range(0x250)}
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]  # offsets of a subsequence's second and third character


def pieces(word: str) -> list[str]:
    """A word without signs around it, between ^ and $, in pieces; with signs inside, also without those."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    if start == end:
        return []
    word = word[start:end].lower()
    found = []
    for form in [word] if word.isalnum() else [word, "".join(filter(str.isalnum, word))]:
        marked = f"^{form}$"
        found += [marked] if len(marked) <= PIECE else [marked[k : k + PIECE] for k in range(0, len(marked) - OVERLAP, PIECE - OVERLAP)]
    return found


def disguised(piece: str) -> list[str]:
    """A piece with one character put in, and with one doubled, at places that depend on it alone."""
    k = 2 + hash_order(piece) % max(1, len(piece) - 3)
    return [(piece[:k] + "xqwz"[hash_order(piece) % 4] + piece[k:])[:PIECE], (piece[:k] + piece[k - 1 :])[:PIECE]]


def units(text: str) -> list[str]:
    """Lower-case words without ASCII signs around them, and runs of three or more one-character words as one word more."""
    words = [w.strip(SIGNS) for w in text.lower().split()]
    found, run = words, []
    for w in words if 1 in map(len, words) else ():
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                found = [*found, "".join(run)]
            run = []
    return [*found, "".join(run)] if len(run) > 2 else found


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) codes of three-character subsequences, 0 where there is none, and their weights."""
    codes = np.zeros((len(words), PIECE + SPAN), np.int32)
    for row, w in enumerate(words):
        codes[row, : len(w)] = [47 if c in "^$" else _TABLE.get(ord(c)) or _code(c) for c in w]
    keys, weights = [], []
    for a, b in _STEPS:
        x, y, z = codes[:, :PIECE], codes[:, a : a + PIECE], codes[:, b : b + PIECE]
        keys.append(np.where(z > 0, (x * CODES + y) * CODES + z, 0))
        weights.append(DECAY ** (b + 1))
    return np.concatenate(keys, 1), np.repeat(np.array(weights, np.float32), PIECE)


def self_kernel(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each word's kernel with itself: equal subsequences at several places add up first."""
    order = np.argsort(keys, axis=1)
    sorted_keys = np.take_along_axis(keys, order, 1)
    w = np.where(sorted_keys > 0, weights[order], 0)
    first = np.c_[np.ones(len(keys), bool), sorted_keys[:, 1:] != sorted_keys[:, :-1]]
    starts = np.flatnonzero(first.ravel())
    sums = np.add.reduceat(w.ravel(), starts) if len(starts) else np.zeros(0)
    return np.add.reduceat(sums**2, np.searchsorted(starts, np.arange(len(keys)) * keys.shape[1])) if len(keys) else np.zeros(0)


@dataclass
class Machine:
    """Landmark columns by subsequence, and a linear judgement of the squared kernels."""

    row_of: np.ndarray  # subsequence -> row of columns, 0 for none
    columns: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    bias: float
    link: np.ndarray  # of the worst word, the second worst, and 1

    def kernels(self, words: list[str]) -> np.ndarray:
        """Squared normalised kernels of pieces with the landmarks."""
        out = np.zeros((len(words), len(self.norms)), np.float32)
        block = max(32, 512 * LANDMARKS // max(1, len(self.norms)))
        for at in range(0, len(words), block):
            keys, weights = subsequences(words[at : at + block])
            rows = self.row_of[keys]
            i, j = np.nonzero(rows)
            if len(i):
                values = self.columns[rows[i, j]] * weights[j, None]
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                raw = np.add.reduceat(values, starts, axis=0)
                own = np.sqrt(np.maximum(self_kernel(keys[i[starts]], weights), 1e-12))
                out[at + i[starts]] = (raw / (own[:, None] * self.norms)) ** 2
        return out

    def judge(self, words: list[str]) -> list[float]:
        """Each word's judgement: that of its worst piece."""
        cut = [pieces(w) for w in words]
        flat = [p for c in cut for p in c]
        values = (self.kernels(flat) @ self.weights + self.bias).tolist() if flat else []
        out, at = [], 0
        for c in cut:
            out.append(max(values[at : at + len(c)], default=self.bias))
            at += len(c)
        return out

    def scores(self, worst: np.ndarray) -> np.ndarray:
        z = worst @ self.link[:2] + self.link[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _landmarks(words: list[str]) -> Machine:
    keys, weights = subsequences(words)
    norms = np.sqrt(np.maximum(self_kernel(keys, weights), 1e-12))
    row_of = np.zeros(CODES**3, np.int32)
    used = np.unique(keys[keys > 0])
    row_of[used] = np.arange(1, len(used) + 1)
    columns = np.zeros((len(used) + 1, len(words)), np.float32)
    for k, own in enumerate(keys):
        np.add.at(columns[:, k], row_of[own], np.where(own > 0, weights, 0))
    columns[0] = 0
    return Machine(row_of, columns, norms.astype(np.float32), np.zeros(len(words)), 0.0, np.array([0.0, 0.0, -9.0]))


def _squared_hinge(groups: list[tuple[np.ndarray, float, float]], ridge: float = 1.0, block: int = 20_000) -> np.ndarray:
    """Weights (the last is the bias) of the primal support vector machine, by Newton steps over blocks of rows.

    ``groups`` are (rows, their class: 1 or -1, the cost of each).
    """
    size = groups[0][0].shape[1] + 1
    w = np.zeros(size)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        gradient, bend = penalty * w, np.diag(penalty)
        for rows, y, cost in groups:
            for at in range(0, len(rows), block):
                x = rows[at : at + block]
                gap = 1 - y * (x @ w[:-1].astype(np.float32) + w[-1])
                on = gap > 0
                x = np.c_[x[on].astype(np.float64), np.ones(int(on.sum()))]
                gradient -= 2 * cost * y * (gap[on] @ x)
                bend += 2 * cost * x.T @ x
        step = np.linalg.solve(bend, gradient)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Logistic regression on the two worst words; both weights at least 0."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (cost * p * (1 - p))[:, None]) + np.diag([0.02, 0.02, 1e-4])
        step = np.linalg.solve(h, x.T @ (cost * (p - y)) + np.array([0.02, 0.02, 1e-4]) * w)
        w -= np.clip(step, -3, 3)
    return np.r_[np.maximum(w[:2], 0), w[2]]


class _Numbers(dict):
    """Numbers things in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def fit(texts: list[str], toxic: list[bool], share: float | None = None) -> Machine | None:
    """A machine from labelled texts; None if either class is missing. Texts are kept as numbers of words.

    ``share`` is the part of texts that is toxic in general, for the scores; by default that among these.
    """
    if not any(toxic) or all(toxic):
        return None
    words, forms = _Numbers(), _Numbers()
    bags = [np.fromiter(map(words.__getitem__, units(t)), np.int32) for t in texts]
    cut = [[forms[p] for p in pieces(w)] for w in words]
    length = np.array([len(c) for c in cut], np.int64)
    start = np.cumsum(length) - length
    of_words = np.fromiter((p for c in cut for p in c), np.int32, int(length.sum()))
    del cut
    names = list(forms)
    counts = np.zeros((2, len(names)), np.int32)
    members: list[np.ndarray] = []
    for bag, t in zip(bags, toxic, strict=True):
        k = np.unique(bag)
        n = length[k]
        own = np.unique(of_words[np.repeat(start[k] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        counts[int(t), own] += 1
        if t:
            members.append(own)
    good, bad = counts
    n_bad, n_good = sum(toxic), len(toxic) - sum(toxic)
    odds = np.log((bad + 0.2) / (n_bad + 1)) - np.log((good + 0.2) / (n_good + 1))
    # Landmarks: two thirds words that mark toxic texts, the more texts the better, no two alike; the rest frequent words of clean ones.
    able = np.array([len(w) > 4 for w in names])
    marks = np.flatnonzero(able & (bad > 0))
    marks = marks[np.lexsort((marks, -odds[marks] * np.minimum(bad[marks], 20) ** 0.5))].tolist()
    chosen: list[int] = []
    for at in range(0, len(marks), MARKS):
        block = [*chosen, *marks[at : at + MARKS]]
        near = _landmarks([names[k] for k in block]).kernels([names[k] for k in block])
        picked = list(range(len(chosen)))
        for k in range(len(picked), len(block)):
            if len(picked) < LANDMARKS * 2 // 3 and (not picked or near[k, picked].max() < 0.7):
                picked.append(k)
        chosen = [block[k] for k in picked]
        if len(chosen) >= LANDMARKS * 2 // 3:
            break
    common = np.flatnonzero(able & (good > 0))
    common = common[np.lexsort((common, -good[common]))][: LANDMARKS - len(chosen)].tolist()
    machine = _landmarks([names[k] for k in dict.fromkeys(chosen + common)])
    own = machine.kernels([names[k] for k in dict.fromkeys(chosen + common)]).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-4 * np.eye(len(own)))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-4))).astype(np.float32)

    clean = np.flatnonzero(good > 0)
    clean_x = np.empty((len(clean), whiten.shape[1]), np.float32)
    for at in range(0, len(clean), 10_000):
        clean_x[at : at + 10_000] = machine.kernels([names[k] for k in clean[at : at + 10_000]]) @ whiten
    # Only words that are far more frequent in toxic texts can be what makes a text toxic.
    able = np.flatnonzero((bad > 0) & (odds > LEAST_ODDS))
    place = np.full(len(names), -1, np.int32)
    place[able] = np.arange(len(able))
    able_x = machine.kernels([names[k] for k in able]) @ whiten
    judged = odds[able]
    for _ in range(5):
        witness = []
        for m in members:
            m = place[m]
            m = m[m >= 0]
            witness.append(m[np.argsort(-judged[m], kind="stable")[:2]])
        witness = np.unique(np.concatenate(witness))
        forms_x = machine.kernels([f for k in witness for f in disguised(names[able[k]])]) @ whiten
        w = _squared_hinge([(able_x[witness], 1.0, WITNESS_COST), (forms_x, 1.0, FORM_COST), (clean_x, -1.0, CLEAN_COST)], RIDGE)
        judged = able_x @ w[:-1] + w[-1]
    machine.weights, machine.bias = whiten @ w[:-1], float(w[-1])
    del able_x, clean_x
    listed = list(words)
    judgement = np.concatenate([np.array(machine.judge(listed[at : at + 5000])) for at in range(0, len(listed), 5000)] or [np.zeros(0)])
    worst = np.array([two_worst(judgement[b], machine.bias) for b in bags])
    given = n_bad / len(toxic)
    share = given if share is None else min(max(share, 1e-3), 1 - 1e-3)
    machine.link = _logistic(worst, np.array(toxic, float), np.where(toxic, share / given, (1 - share) / (1 - given)))
    return machine


def hash_order(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def two_worst(values: list[float] | np.ndarray, floor: float) -> tuple[float, float]:
    if len(values) < 2:
        return (values[0] if values else floor), floor
    at = np.partition(np.asarray(values), len(values) - 2)[-2:]
    return float(at[1]), float(at[0])


class _Memory:
    """Judgements of words in two generations: when the young one is full it becomes the old one, which is forgotten."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def worst(self, bags: list[list[str]]) -> list[tuple[float, float]]:
        seen = {w for bag in bags for w in bag}
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        missing = seen - self.young.keys()
        again = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        fresh = list(missing - again)
        self.young.update(zip(fresh, self.machine.judge(fresh), strict=True))
        return [two_worst(list(map(self.young.__getitem__, bag)), self.machine.bias) for bag in bags]


def _scored(shared):
    """Scores of columns of texts, by a memory that lasts as long as the task."""
    machine = shared.value
    memory = _Memory(machine)

    def scores(texts: pa.Array) -> np.ndarray:
        bags: list[list[str]] = []
        worst: list[tuple[float, float]] = []
        n = 0
        for t in texts:
            t = t.as_py() or ""
            bags.append(units(t))
            n += len(t)
            if n > CHUNK:
                worst += memory.worst(bags)
                bags, n = [], 0
        worst += memory.worst(bags)
        return machine.scores(np.array(worst).reshape(-1, 2))

    return scores


def training_sample(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[bool], float]:
    """At most about TOXIC_ROWS and CLEAN_ROWS labelled texts, chosen by hash of the id among those not held out, and the share of toxic ones.

    Texts of over ROW_BYTES take no part, and both classes are thinned alike where the rest weigh over SAMPLE_BYTES.
    A document with several labels counts as toxic if any says so; null labels are ignored.
    """
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(id_remainder(id_col, modulus) != held_out)
    one = one.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_toxic"))
    counts = {r[0]: r[1] for r in one.groupBy("_toxic").count().collect()}
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / float(1 << 20)
    quota = F.when(F.col("_toxic") == 1, F.lit(TOXIC_ROWS / max(1, counts.get(1, 0)))).otherwise(F.lit(CLEAN_ROWS / max(1, counts.get(0, 0))))
    chosen = one.filter(share < quota).withColumn("_share", share / F.least(quota, F.lit(1.0)))  # about TOXIC_ROWS + CLEAN_ROWS ids, whatever the tables' sizes
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).filter(F.octet_length("_text") <= ROW_BYTES).join(F.broadcast(chosen), "_id")
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if total > SAMPLE_BYTES:
        texts = texts.filter(F.col("_share") < SAMPLE_BYTES / total)
    texts = texts.orderBy("_id", "_text")
    texts_, toxic = [], []
    for row in texts.select("_text", "_toxic").toLocalIterator():
        texts_.append(row[0])
        toxic.append(bool(row[1]))
    return texts_, toxic, counts.get(1, 0) / max(1, sum(counts.values()))


def _fitted(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, id_col: str, text_col: str, label_col: str) -> Machine | None:
    texts, toxic, share = training_sample(docs, labels, modulus, held_out, id_col, text_col, label_col)
    return fit(texts, toxic, share)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    The machine is fitted on the driver on a bounded sample of labelled texts whose crc32(id as text) mod
    ``modulus`` isn't ``held_out``; only texts are inputs of a score. Null and empty texts score like a text
    without words. Without labels of both classes all scores are 0. Null ids and repeated rows are scored like
    any other. Other columns are ignored; an empty table gives no rows.
    """
    machine = _fitted(docs, labels, modulus, held_out, id_col, text_col, label_col)
    held = (id_remainder(id_col, modulus) == held_out).alias("held_out")
    source = docs.select(F.col(id_col).alias("id"), held, F.col(text_col).alias("text"))
    if machine is None:
        scored = source.select("id", "held_out", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = _scored(shared)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores(b.column(2)), pa.float64())], ["id", "held_out", "score"])

        scored = source.mapInArrow(lean(scan), source.select("id", "held_out").schema.add("score", "double"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` less the rows that ``score_toxicity`` predicts to be toxic, with all their columns, whatever their names.

    Rows go through Python once and come back or don't. A null text counts as empty; null ids and repeated rows are
    judged like any other. Without labels of both classes, or of an empty table, all rows stay.
    """
    machine = _fitted(docs, labels, modulus, held_out, id_col, text_col, label_col)
    if machine is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place, rows = docs.columns.index(text_col), docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scored(shared)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(place)) < threshold))

    return rows.mapInArrow(lean(scan), rows.schema).toDF(*docs.columns)
