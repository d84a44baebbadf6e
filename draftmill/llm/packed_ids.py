"""Token ids as binary files of fixed-width bit packing.

Each id takes the least bits that hold the vocabulary. Ids are packed in blocks of BLOCK_IDS, whose offsets stand
behind them, so that any range of ids or any document is read without the rest and unpacked by numpy at once.

A file is: MAGIC; the blocks; the index (block offsets, a checksum of each block, ids of documents, flags of null
ids, where each document starts); the tail (bits, ids a block, counts of ids, documents and blocks, place of the
index, MAGIC). All numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, lean, text_or_empty

MAGIC = b"PACKIDS1"
TAIL = struct.Struct("<IIQQQQ8s")
#: Ids of a block, a multiple of 8, so that blocks end at whole bytes; ids after which a new file begins.
BLOCK_IDS, FILE_IDS = 4096, 1 << 24
#: Bytes of pieces of words that a worker remembers, at WORD_BYTES a piece and its length; words taken at once; bytes of texts (one at least) that are split at once.
REMEMBERED_BYTES, WORD_BYTES, WORDS, SPLIT_BYTES = 128 << 20, 120, 1 << 19, 4 << 20
#: New words that the library gets at once, and the word between them.
TOGETHER, MARK = 512, "!"
#: Ids that a reading task hands on at once.
CHUNK = 1 << 20
MANIFEST = "part int, number int, file string, bits int, n_docs long, n_ids long"

# Fixed value: how vocabularies with word ends split a text; no match has white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Plain words hold visible ASCII and the letters from U+00C0 to U+00FF alone: NFC leaves these as they are, each has one
# lower-case form, and WORD_PATTERN is _PIECE on them. Words are joined by END; other words have ODD in their place.
END, ODD = "\n", "\0"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ\n]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|\0|[^a-z0-9ß-öø-ÿ\n\0]+")


# ---- bits


def bits_for(vocabulary: int) -> int:
    """The least bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, each in ``bits`` (32 at most), lowest bits first; the last byte is filled up with zeros."""
    n = len(ids)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.zeros((-(-n // 8), 8), np.uint64)
    rows.ravel()[:n] = ids
    out = np.zeros((len(rows), bits), np.uint8)  # eight ids take ``bits`` bytes
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        value = rows[:, k] << np.uint64(shift)
        for j in range(-(-(bits + shift) // 8)):
            out[:, first + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes, as unsigned 32-bit numbers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    padded = np.zeros(-(-n * bits // 8) + 8, np.uint8)
    padded[:-8] = np.frombuffer(raw, np.uint8, len(padded) - 8)
    windows = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    place = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    return ((windows[place >> np.uint64(3)] >> (place & np.uint64(7))) & np.uint64((1 << bits) - 1)).astype(np.uint32)


# ---- files


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that pyarrow opens (shared disk, hdfs, s3, gs), and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class PackedWriter:
    """Writes one file; documents come in order."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.at, self.n_ids, self.n_docs = len(MAGIC), 0, 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.offsets, self.sums = [], []
        self.docs, self.lengths = [], []
        stream.write(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents with their ids one after another; an id of a document may be null."""
        self.docs.append(doc_ids)
        self.lengths.append(np.asarray(lengths, np.int64))
        self.n_docs += len(lengths)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self._flush(self.waiting - self.waiting % BLOCK_IDS)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for s in range(0, n, BLOCK_IDS):
            raw = pack(ids[s : min(s + BLOCK_IDS, n)], self.bits)
            self.offsets.append(self.at)
            self.sums.append(zlib.crc32(raw))
            self.stream.write(raw)
            self.at += len(raw)
        self.pending, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.waiting)
        docs = pa.concat_arrays(self.docs) if self.docs else pa.array([], pa.int64())
        starts = np.r_[0, np.cumsum(np.concatenate(self.lengths))] if self.lengths else np.zeros(1)
        index = [np.array(self.offsets, "<u8"), np.array(self.sums, "<u4"), docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), starts.astype("<u8")]
        for a in index:
            self.stream.write(a.tobytes())
        self.stream.write(TAIL.pack(self.bits, BLOCK_IDS, self.n_ids, self.n_docs, len(self.offsets), self.at, MAGIC))
        self.stream.close()


class PackedFile:
    """Random access to one file: only the index and the blocks asked for are read."""

    def __init__(self, path: str):
        system, inner = _located(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(TAIL.size, max(0, size - TAIL.size))
        if size < TAIL.size + len(MAGIC) or tail[-8:] != MAGIC:
            raise ValueError(f"not a file of packed ids, or cut short: {path}")
        self.bits, self.block, self.n_ids, self.n_docs, blocks, at, _ = TAIL.unpack(tail)
        raw, self._at = self.file.read_at(size - TAIL.size - at, at), 0
        self._raw = raw
        self.offsets = np.r_[self._numbers("<u8", blocks), np.uint64(at)].astype(np.int64)
        self.sums = self._numbers("<u4", blocks)
        self.doc_ids = self._numbers("<i8", self.n_docs)
        self.doc_nulls = self._numbers(np.uint8, self.n_docs).astype(bool)
        self.starts = self._numbers("<u8", self.n_docs + 1).astype(np.int64)

    def _numbers(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._raw, kind, n, self._at)
        self._at += out.nbytes
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of places ``start`` to ``stop`` - 1 of the file."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = memoryview(self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first])))
        base, out = int(self.offsets[first]), []
        for k in range(first, last + 1):
            block = raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]
            if zlib.crc32(block) != self.sums[k]:
                raise ValueError(f"block {k} is damaged")
            out.append(unpack(block, min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


# ---- ids of texts


class _Places(dict):
    """The place of each piece that has been met; new pieces are listed."""

    def __init__(self, known: Iterable[str]):
        super().__init__((piece, place) for place, piece in enumerate(known))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


def _runs(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, ``count`` from ``first`` on, one after another, and how many numbers stand before each run and behind the last."""
    before = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=before[1:])
    return flat[np.repeat(first - before[:-1], count) + np.arange(before[-1])], before


class TextIds:
    """Ids of whole texts as the tokenizers library gives them, without special tokens at the ends.

    Where the vocabulary's rules never look past ASCII white space, a text's ids are those of its words one after
    another, and a plain word's are those of its pieces in lower case: the library encodes each distinct piece, and
    each distinct word that isn't plain, once, and the ids are remembered (up to REMEMBERED_BYTES). Other
    vocabularies encode whole texts.
    """

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(vocabulary)
        self.size = max(self.library.get_vocab(with_added_tokens=True).values(), default=0) + 1
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1
        spec = json.loads(vocabulary)
        self.by_word = self.mark >= 0 and self._independent_words(spec)
        if self.by_word:
            # Pieces are in normal form and cut already, so that white space alone parts them.
            rules = [{"type": "WhitespaceSplit"}, *_listed(spec["pre_tokenizer"], "pretokenizers")[1:]]
            self.of_pieces = Tokenizer.from_buffer(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": rules}}).encode())
            self.is_end = np.zeros(self.size, bool)
            self.is_end[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith(WORD_END)]] = True
            added = {t["content"] for t in spec.get("added_tokens", [])}
            if self.library.normalizer is not None:
                added |= {self.library.normalizer.normalize_str(t) for t in added}
            self.added = re.compile("|".join(map(re.escape, sorted(added - {""}))) or r"(?!)", re.IGNORECASE)
        self._forget()

    @staticmethod
    def _independent_words(spec: dict) -> bool:
        own = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in _listed(spec.get("normalizer"), "normalizers"))
        lowered = any(n["type"] == "Lowercase" for n in _listed(spec.get("normalizer"), "normalizers"))
        rules = _listed(spec.get("pre_tokenizer"), "pretokenizers")
        split = (rules or [{}])[0]
        words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern") == {"Regex": WORD_PATTERN}
        rest = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex", True) for p in rules[1:])
        ends = spec["model"].get("end_of_word_suffix") == WORD_END
        added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        return bool(own and lowered and words and rest and ends and added and not spec.get("truncation") and not spec.get("padding"))

    def _forget(self) -> None:
        self.places, self.held, self.used = _Places([END, ODD]), 0, 0
        self.flat, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(2, np.int64), np.zeros(2, np.int64)

    def _one_by_one(self, library, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for word in found for i in word], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has. No id but a piece's last is one of a word's end."""
        ids = np.array(self.of_pieces.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) == len(pieces) and ends[-1] == len(ids) - 1:
            return ids, np.diff(ends, prepend=-1)
        return self._one_by_one(self.of_pieces, pieces)

    def _odd_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that aren't plain. Those without the mark are encoded as one text with marks between them."""
        ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) == len(words) - 1 and not any(MARK in w for w in words):
            return np.delete(ids, marks), np.diff(np.r_[-1, marks, len(ids)]) - 1
        return self._one_by_one(self.library, words)

    def _learn(self) -> None:
        new, self.places.new = self.places.new, []
        if not new:
            return
        # Plain pieces, then odd words, those with the mark last, whatever place they have.
        kinds = [0 if w[0] != ODD else 1 + (MARK in w) for w in new]
        order = np.argsort(np.array(kinds, np.int8), kind="stable")
        sorted_, parts = [new[k] for k in order.tolist()], []
        plain = kinds.count(0)
        unmarked = plain + kinds.count(1)
        for s, e, ids_of in ((0, plain, self._piece_ids), (plain, unmarked, self._odd_ids), (unmarked, len(new), self._odd_ids)):
            words = [w.removeprefix(ODD) for w in sorted_[s:e]]
            parts += [ids_of(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        ids, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        back = np.empty(len(new), np.int64)
        back[order] = np.arange(len(new))
        self.first = np.concatenate([self.first, (self.used + np.cumsum(count) - count)[back]])
        self.count = np.concatenate([self.count, count[back]])
        self.used += len(ids)
        self.held += sum(map(len, new)) + WORD_BYTES * len(new)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many ids stand before each word and behind the last."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        odd, text = [], END.join(words)
        if not _PLAIN.fullmatch(text) or self.added.search(text):
            is_odd = [not _PLAIN.fullmatch(w) or self.added.search(w) is not None for w in words]
            odd = [ODD + w for w, o in zip(words, is_odd, strict=True) if o]
            text = END.join([ODD if o else w for w, o in zip(words, is_odd, strict=True)])
        pieces = _PIECE.findall(text.lower())
        place = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        ends = np.flatnonzero(place == self.places[END])
        if odd:
            place[place == self.places[ODD]] = [self.places[w] for w in odd]
        self._learn()
        ids, before = _runs(self.flat, self.first[place], self.count[place])
        return ids, np.r_[0, before[ends], before[-1]]

    def encoded(self, texts: pa.Array | Iterable[str]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Ids of some pieces of texts, one after another, and the length of each; a negative length, -1 - n, means that the text goes on."""
        if not self.by_word:
            for t in texts:
                ids = self.library.encode(t.as_py() if isinstance(t, pa.Scalar) else t, add_special_tokens=False).ids
                yield np.array(ids, np.uint32), [len(ids)]
            return
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):  # as many texts as have SPLIT_BYTES, one at least
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SPLIT_BYTES, "right")))
            yield from self._split(texts.slice(at, stop - at))
            at = stop

    def _split(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[int]]]:
        split = pc.ascii_split_whitespace(texts)
        words, ends = split.flatten(), np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        done = 0  # texts that have ended
        for s in range(0, max(1, len(words)), WORDS):
            some = words.slice(s, WORDS).dictionary_encode()
            own, before = self._of_words(some.dictionary.to_numpy(zero_copy_only=False).tolist() or [""])
            place = some.indices.to_numpy()
            ids, at = _runs(own, before[place], np.diff(before)[place])
            stop = int(np.searchsorted(ends, s + len(place), "right"))
            lengths = np.diff(at[np.r_[s, ends[done:stop], s + len(place)] - s]).tolist()
            rest = lengths.pop()
            if stop < len(ends):
                lengths.append(-1 - rest)
            yield ids, lengths
            done = stop


def _listed(rules: dict | None, key: str) -> list[dict]:
    return [] if not rules else rules[key] if rules.get("type") == "Sequence" else [rules]


_loaded: dict[int, TextIds] = {}


def _tokens(key: int, vocabulary: Callable[[], bytes]) -> TextIds:
    """The worker's own, so that words are remembered from task to task."""
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _loaded.clear()
        _loaded[key] = TextIds(vocabulary())
    return _loaded[key]


def _with_ends(pieces: Iterator[tuple[np.ndarray, list[int]]], end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole documents of ``pieces``, each with the end id behind it: ids and lengths."""
    held: list[np.ndarray] = []  # the pieces of a text that goes on
    end = np.array([end_id], np.uint32)
    for ids, lengths in pieces:
        parts, done, at = held, [], 0
        size = sum(map(len, held))
        for n in lengths:
            own = -1 - n if n < 0 else n
            parts.append(ids[at : at + own])
            at, size = at + own, size + own
            if n >= 0:
                parts.append(end)
                done.append(size + 1)
                size = 0
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        total = sum(done)
        held = [whole[total:]] if size else []
        if done:
            yield whole[:total], np.array(done, np.int64)


# ---- tables


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all texts into files under ``path``, in ascending order of the documents' ids, and returns the manifest.

    The manifest (part, number, file, bits, n_docs, n_ids) is itself the table ``path``/manifest; files come in
    the order of part and number. Only files that it names count: a task that was lost leaves files that nothing
    refers to. Each document ends with ``end_id``; a null text counts as empty and is the end id alone. Rows with a
    null id come last; rows that share an id come by the hash of their text, repeated rows one after another. Texts
    of any length are taken whole. No rows give a manifest without rows. Other columns are ignored.

    ``path`` must be a place that Spark and pyarrow open on all executors. Tasks hold one range of ids, sorted by
    Spark, and stream it; no task holds more than one batch and the index of one file.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        raw = f.read(BROADCAST_BYTES + 1)
    if len(raw) > BROADCAST_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    bits = bits_for(max(TextIds(raw).size, end_id + 1))
    shared, key = spark.sparkContext.broadcast(raw), hash(raw)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = _tokens(key, lambda: shared.value), TaskContext.get().partitionId()
        number, writer, name = 0, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "file": name, "bits": bits, "n_docs": writer.n_docs, "n_ids": writer.n_ids}], schema)

        for b in batches:
            at = 0
            for ids, lengths in _with_ends(tokens.encoded(b.column(1)), end_id):
                ends, k = np.cumsum(lengths), 0
                while k < len(lengths):
                    if writer is None:
                        name = f"{path.rstrip('/')}/ids/{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
                        system, inner = _located(name)
                        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        writer = PackedWriter(system.open_output_stream(inner), bits)
                    done = int(ends[k - 1]) if k else 0
                    stop = min(len(lengths), int(np.searchsorted(ends, done + file_ids - writer.n_ids)) + 1)  # the document that fills the file is its last
                    writer.add(b.column(0).slice(at + k, stop - k), ids[done : ends[stop - 1]], lengths[k:stop])
                    k = stop
                    if writer.n_ids >= file_ids:
                        yield closed()
                        writer, number = None, number + 1
                at += len(lengths)
        if writer is not None:
            yield closed()

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("bits", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(lean(write), MANIFEST).write.parquet(f"{path.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")


def read_token_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files under ``path``: id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit numbers).

    Each file is read by one task, block after block, and each block is held against its checksum.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a task that wrote
    parts = parts.select("part", F.expr("sum(n) over (order by part)") - F.col("n"))
    within = F.expr("sum(n_ids) over (partition by part order by number)") - F.col("n_ids")
    placed = files.withColumn("within", within).join(F.broadcast(parts.toDF("part", "before")), "part")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(*[c.to_pylist() for c in b.columns], strict=True):
                file = PackedFile(name)
                at = 0
                while at < file.n_docs:  # as many documents as have CHUNK ids, one at least
                    stop = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + CHUNK, "right")) - 1)
                    ids = np.ascontiguousarray(file.ids(int(file.starts[at]), int(file.starts[stop])), "<u4")
                    own = file.starts[at : stop + 1]
                    places = pa.py_buffer(((own - own[0]) * 4).astype(np.int32).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[at:stop], pa.int64(), mask=file.doc_nulls[at:stop]), pa.array(start + own[:-1], pa.int64()), pa.array(np.diff(own), pa.int64()), pa.Array.from_buffers(pa.binary(), stop - at, [None, places, pa.py_buffer(ids)])], ["id", "start", "n_tokens", "ids"])
                    at = stop
                file.close()

    rows = placed.select("file", (F.col("before") + F.col("within")).alias("start")).repartition(tasks)
    return rows.mapInArrow(lean(read), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
