"""Benchmark decontamination with a generalised suffix automaton over item words.

All item texts, as sequences of word numbers, go into one automaton. A training text is streamed through it
word by word; the state and the longest matching length after each word tell which item windows end there.
Texts are first scanned for runs of words that items have at all, as only those can match.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, text_or_empty

#: Words of one automaton (about 600 bytes each in a worker); more items are taken in several passes.
AUTOMATON_WORDS = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}
# Fixed value: a word is a run of these, once A-Z are lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PLAIN = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters in UTF-8, A-Z lowered; null has none."""
    return text.encode().translate(_PLAIN).split() if text else []


class SuffixAutomaton:
    """Of several sequences of words; each state knows which items its substrings occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owners = [-1], [0], [set()]
        self.whole: dict[int, list[tuple[int, int]]] = {}  # state -> short items that end there: (length, item)
        ends = []
        for item, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.words[w])
                ends.append((last, item))
            if words and len(words) < window:
                self.whole.setdefault(last, []).append((len(words), item))
        for state, item in ends:  # a substring occurs in an item if it is a suffix of one of its prefixes
            while state > 0 and item not in self.owners[state]:
                self.owners[state].add(item)
                state = self.link[state]
        self.shortest = min([min(len(ws), window) for _, ws in items if ws], default=0)
        # Short items whose whole text is a suffix of what a state stands for.
        self.suffixes: dict[int, list[tuple[int, int]]] = {}
        if self.whole:
            for state in sorted(range(len(self.length)), key=self.length.__getitem__):
                found = [*self.suffixes.get(self.link[state], []), *self.whole.get(state, [])] if state else []
                if found:
                    self.suffixes[state] = found

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        self.owners.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state after c from p, cut so that its longest substring is that of p and c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans [start, end) that item windows cover, and the items with such windows."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        known = bytes(map(self.words.__contains__, words))
        need = b"\x01" * self.shortest
        at = known.find(need)
        while at >= 0:
            end = known.find(b"\x00", at)
            end = len(words) if end < 0 else end
            self._stream(words, at, end, spans, found)
            at = known.find(need, end)
        return spans, found

    def _stream(self, words: list[bytes], start: int, end: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        state = length = 0
        for k in range(start, end):
            c = self.words[words[k]]
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            first = k + 1
            if length >= self.window:
                first = k + 1 - length
                s = state  # the state that holds the last window words: those longer occur in fewer items
                while self.length[self.link[s]] >= self.window:
                    s = self.link[s]
                found |= self.owners[s]
            if self.whole:
                # A match that ends inside a state covers its shorter suffixes; those of full length only if matched so far.
                for n, item in self.suffixes.get(state, ()):
                    if n <= length:
                        first = min(first, k + 1 - n)
                        found.add(item)
            if first <= k:
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, k + 1))


def _joined(a: list, b: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([*map(tuple, a), *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _blocks(items: list[tuple[str, list[bytes]]], most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, n = [], 0
    for item in items:
        if block and n + len(item[1]) > most:
            yield block
            block, n = [], 0
        block.append(item)
        n += len(item[1])
    yield block


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", automaton_words: int = AUTOMATON_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with _n_words long, _spans (word spans [s, e) under item windows, merged) and _items (their ids).

    A window is ``window`` consecutive words of an item; an item of fewer, but some, words is one window.
    Null or empty texts have no words; items without words never match; equal items are all reported, a null
    item id as "". All columns of ``docs`` stay; its own columns of those three names are replaced. The items
    are read to the driver in blocks of ``automaton_words`` words; each block is one pass over ``docs``.
    Without ``keep_text`` the text column is left out of the result.
    """
    given = docs.drop("_n_words", "_spans", "_items")
    place, names = given.columns.index(text_col), given.columns
    kept = [k for k in range(len(names)) if keep_text or k != place]
    schema = T.StructType([*[given.schema.fields[k] for k in kept], *T.StructType.fromDDL(_ADDED).fields])
    last = lambda columns, counts, spans, found: _added([columns[k] for k in kept], counts, spans, found, schema.names)
    return _scanned(given, place, benchmark, window, item_id, item_text, automaton_words, last, schema)


_ADDED = "_n_words long, _spans array<struct<s:int,e:int>>, _items array<string>"
_Spans = list[list[tuple[int, int]]]


def _added(columns: list[pa.Array], counts: list[int], spans: _Spans, found: list[list[str]], names: list[str]) -> pa.RecordBatch:
    spans = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], _SPANS)
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), spans, pa.array(found, pa.list_(pa.string()))], names)


def _scanned(docs: DataFrame, place: int, benchmark: DataFrame, window: int, item_id: str, item_text: str, automaton_words: int, last: Callable, schema: T.StructType) -> DataFrame:
    """What ``last(columns, word counts, spans, items)`` makes of each batch of ``docs`` when all blocks of items have been looked for.

    Rows go through Python once for each block.
    """
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), text_or_empty(item_text).alias("t")).toLocalIterator()
    blocks = _blocks(((i, normal_words(t)) for i, t in rows), automaton_words)
    names = docs.columns
    between = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_ADDED).fields])
    out, number, block = docs, 0, next(blocks)
    while block is not None:
        following = next(blocks, None)
        out = materialise(out, "spans") if number else out
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))
        more = lambda columns, counts, spans, found: _added(columns, counts, spans, found, between.names)
        scan = _scanner(shared, place, len(names), last if following is None else more, number > 0)
        out = out.mapInArrow(lean(scan), schema if following is None else between)
        number, block = number + 1, following
    return out


def _scanner(shared, place: int, n: int, make: Callable, again: bool):
    """Finds spans and items of one automaton in each row, beside those of former passes if ``again``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            counts, spans, found = [], [], []
            for text in b.column(place):
                words = normal_words(text.as_py())
                s, f = automaton.match(words)
                counts.append(len(words))
                spans.append(s)
                found.append([automaton.names[k] for k in sorted(f)])
            if again:
                old_spans, old_found = b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()
                spans = [_joined([(x["s"], x["e"]) for x in old], new) for old, new in zip(old_spans, spans, strict=True)]
                found = [old + new for old, new in zip(old_found, found, strict=True)]
            yield make([b.column(k) for k in range(n)], counts, spans, found)

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0).

    items_sha256 is the digest of the ids of items with occurring windows, sorted as strings and joined by
    commas (of the empty text where there are none). Items that share an id count as one there. See
    ``contaminated_spans`` for nulls and empty texts.
    """
    found = contaminated_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), benchmark, window, "_text", keep_text=False, **kw)
    found = found.withColumn("_items", F.array_distinct("_items"))
    n_hit = F.expr("aggregate(_spans, 0L, (n, x) -> n + x.e - x.s)")
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int = 9, max_coverage: float = 0.5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` without benchmark passages, in the same columns.

    Spans of over ``max_span`` words are cut from the text, with what stands between their words. A text with
    over ``max_coverage`` of its words under item windows is dropped as a whole.
    Shorter spans (of short items) and all other texts stay as they are, null and empty ones too.
    """
    place = docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever names docs has
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(names, docs.schema, strict=True)])

    def cut(columns: list[pa.Array], counts: list[int], spans: _Spans, found: list[list[str]]) -> pa.RecordBatch:
        stays = [sum(e - s for s, e in x) <= max_coverage * max(n, 1) for n, x in zip(counts, spans, strict=True)]
        long = [[(s, e) for s, e in x if e - s > max_span] for x in spans]
        columns = list(columns)
        if any(long):
            texts = columns[place].to_pylist()
            columns[place] = pa.array([without(t, x) if x and stay else t for t, x, stay in zip(texts, long, stays, strict=True)], columns[place].type)
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    return _scanned(docs.toDF(*names), place, benchmark, window, item_id, item_text, automaton_words, cut, schema).toDF(*docs.columns)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less those word spans; what stands left and right of a span is joined by one blank."""
    ends = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at : ends[s][0]].rstrip())
        at = ends[e - 1][1]
    parts.append(text[at:].lstrip())
    return " ".join(p for p in parts if p)
