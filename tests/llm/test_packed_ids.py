import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from draftmill.llm import packed_ids
from draftmill.llm.packed_ids import PackedFile, PackedWriter, TextIds, bits_for, pack, read_token_ids, unpack, write_token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
OTHER = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Z", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u0085", " ", " ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>x", "<|endof", "é", "é", "́", "İ", "Σ", "ς", "中", "가", "가", "٣", "½", "🙂", "​", "　", "!", "...", "\x00", "ab" * 40, "12345"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, records, end_id=2):
    """Rows by the library on whole texts: documents by id, null ids last."""
    at, out = 0, []
    for i, t in sorted(records, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def digests(df):
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in df.collect()]


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_packing_is_exact(bits, values):
    ids = np.array(values, np.uint64) & np.uint64((1 << bits) - 1)
    raw = pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    assert unpack(raw, len(ids), bits).tolist() == ids.tolist()


def test_least_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    import pyarrow as pa

    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (1, 5000, 0, 9000, 3, 4096, 8192)]
    path = str(tmp_path / "x.ids")
    writer = PackedWriter(open(path, "wb"), bits)
    for k in range(0, len(docs), 2):
        some = docs[k : k + 2]
        writer.add(pa.array([None if k == 2 else k + j for j in range(len(some))], pa.int64()), np.concatenate(some), np.array([len(d) for d in some]))
    writer.close()
    file, whole = PackedFile(path), np.concatenate(docs)
    assert (file.n_ids, file.n_docs, file.doc_nulls.tolist()) == (len(whole), 7, [False, False, True, True, False, False, False])
    for s, e in [(0, len(whole)), (4095, 4097), (8192, 8193), (17, 17), (26000, 10**9)]:
        assert np.array_equal(file.ids(s, e), whole[s:e])
    assert all(np.array_equal(file.document(k), d) for k, d in enumerate(docs))


def test_damage_is_seen(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "x.ids")
    writer = PackedWriter(open(path, "wb"), 16)
    writer.add(pa.array([1]), np.arange(100, dtype=np.uint32), np.array([100]))
    writer.close()
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged"):
        PackedFile(path).ids(0, 10)
    open(path, "wb").write(raw[:-5])
    with pytest.raises(ValueError, match="cut short"):
        PackedFile(path)


@pytest.mark.parametrize("path", [PATH, OTHER])
def test_ids_of_odd_texts_equal_the_library(path, monkeypatch):
    monkeypatch.setattr(packed_ids, "WORDS", 40)
    monkeypatch.setattr(packed_ids, "SPLIT_BYTES", 25)
    monkeypatch.setattr(packed_ids, "REMEMBERED_BYTES", 20_000)
    library, tokens, rng = Tokenizer.from_file(path), TextIds(open(path, "rb").read()), random.Random(3)
    assert tokens.by_word == (path == PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = [ids[s:e].tolist() for ids, n in packed_ids._with_ends(tokens.encoded(texts), 2) for s, e in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True)]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def ids_of(tokens, texts):
    return [ids[s:e].tolist() for ids, n in packed_ids._with_ends(tokens.encoded(texts), 2) for s, e in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True)]


def test_the_library_encodes_pieces_once(library):
    tokens, rng = TextIds(open(PATH, "rb").read()), random.Random(5)
    stems = ["a" + "".join(rng.choice("bcdeéßü") for _ in range(9)) for _ in range(200)]
    words = [form + end for w in stems for form in (w, w.capitalize(), w.upper().replace("SS", "ß")) for end in ("", ",", ".", "...", "'s", "'LL", "7")]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    assert ids_of(tokens, texts) == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(tokens.places) < 220  # not one for each of 4200 words


@pytest.mark.parametrize("at_once", [2, 1000])
def test_words_that_are_not_plain_equal_the_library(library, monkeypatch, at_once):
    monkeypatch.setattr(packed_ids, "WORDS", at_once)
    monkeypatch.setattr(packed_ids, "SPLIT_BYTES", 100 * at_once)
    tokens, rng = TextIds(open(PATH, "rb").read()), random.Random(6)
    parts = [*"aZJhs'SmM!.,<|>09 \n\t\x0c\x00\x1cÀÉßÿ×÷ªº²İΣ", "\u0331", "\u030c", "\u0341", "\u00a0", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext", "'LL", "'re"]
    texts = ["", " ", "\x00", "\n", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    texts += [f"A{chr(c)}b {chr(c)}'S x{chr(c)}" for c in range(1, 0x590)]
    assert ids_of(tokens, texts) == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_files_give_the_library_s_ids(spark, docs, records, library, tmp_path):
    path = f"file://{tmp_path}/out"
    manifest = write_token_ids(docs, PATH, path, file_ids=700)
    assert manifest.count() > 4 and manifest.agg({"n_docs": "sum"}).first()[0] == len(records)
    assert {r.bits for r in manifest.collect()} == {16}
    got = digests(read_token_ids(spark, path))
    place = lambda rows: sorted((r[1], r[2]) for r in rows)
    assert [r[1] for r in sorted(got, key=lambda r: r[1])][0] == 0
    ends = sorted((r[1], r[1] + r[2]) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False)) and place(got)
    key = lambda r: repr((r[0], r[2], r[3]))
    assert sorted(map(key, got)) == sorted(map(key, expected(library, records)))  # rows of one id come in any order
    one = lambda rows: sorted(r for r in rows if r[0] is not None and r[0] != 5)
    assert one(got) == one(expected(library, records))
    by_place = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert by_place == sorted(by_place, key=lambda i: (i is None, i or 0))


def test_no_rows(spark, empty, tmp_path):
    assert write_token_ids(empty, PATH, str(tmp_path / "none")).count() == 0
    assert read_token_ids(spark, str(tmp_path / "none")).count() == 0
