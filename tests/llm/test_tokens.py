import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, empty, noisy
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, id_files, library_ids, packing, queries

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd():
    return [t or "" for t in AWKWARD] + noisy(300) + ["z" * 1500 + "qu" * 400, "ab" * 700]


def test_byte_bpe_equals_the_library(odd):
    library = Tokenizer.from_file(BYTES)
    got = bpe.loaded(BYTES).encode_batch([t.encode() for t in odd])
    want = [library.encode(t, add_special_tokens=False).ids for t in odd]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert bpe.loaded(BYTES).decode_batch(got) == [library.decode(x, skip_special_tokens=False) for x in want]


def test_words_forgotten_are_encoded_alike(odd):
    fresh = bpe.BytePairs(BYTES)
    fresh.words.entries = 5
    texts = [t.encode() for t in odd]
    assert fresh.encode_batch(texts) == bpe.loaded(BYTES).encode_batch(texts) == fresh.encode_batch(texts)


def test_library_ids_equal_the_library(odd):
    library = Tokenizer.from_file(WORDS)
    got = library_ids.loaded(WORDS).encode_slice(pa.array([t.encode() for t in odd]), None, "<u2").to_pylist()
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_op2_digests(spark, sf_dir, texts):
    library = Tokenizer.from_file(BYTES)
    got = queries.op2_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for doc, text in zip(texts.doc_id, texts.text, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got.loc[doc]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_awkward_rows_and_empty_table(spark):
    rows = documents(spark)
    arrays = bpe.encode(rows, BYTES).collect()
    assert len(arrays) == rows.count() and all(r.ids is not None for r in arrays)
    packed = bpe.encode(rows, BYTES, packed=True)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in bpe.decode(packed, BYTES).collect())
    assert back == sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows.collect())
    assert bpe.encode(empty(spark), BYTES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_packed_values_come_back(values):
    control, data = id_files.pack(np.array(values, dtype=np.uint32))
    assert id_files.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_op8_files(spark, sf_dir, texts):
    library = Tokenizer.from_file(WORDS)
    got = queries.op8_id_files(spark, sf_dir).toPandas().sort_values("doc_id", ignore_index=True)
    start = 0
    for row, text in zip(got.itertuples(), texts.text, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_awkward_rows(spark):
    rows = documents(spark)
    files = id_files.write_ids(id_files.store(library_ids.encode(rows, WORDS, end_id=2)), 3)
    got = id_files.read_ids(spark, files).toPandas().sort_values("start")
    assert len(got) == rows.count() and (got.start.diff().dropna().to_numpy() == got.n_tokens.to_numpy()[:-1]).all()
    ranks = files.table(spark, "ranks").toPandas()
    assert ranks["id"].is_unique
    none = id_files.write_ids(id_files.store(library_ids.encode(empty(spark), WORDS, end_id=2)), 3)
    assert id_files.read_ids(spark, none).count() == 0


def test_plain_characters_are_as_in_the_library():
    """Every character that takes the short way, alone and between others."""
    library = library_ids.LibraryIds(WORDS)
    plain = [chr(c) for c in range(0x21, 0x9FA6) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    texts = [f"a{c}B {c}{c}1 '{c}s 'S{c}" for c in plain] + noisy(200)
    got = library.encode_slice(pa.array([t.encode() for t in texts]), None, "<u2").to_pylist()
    want = library.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if np.frombuffer(g, "<u2").tolist() != w.ids] == []


def brute_fullest(counts, room):
    best = 0
    items = [x for x, n in counts.items() for _ in range(n)]
    reach = {0}
    for x in items:
        reach |= {r + x for r in reach if r + x <= room}
    best = max(reach)
    return best


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(0, 60))
def test_fullest_combination(counts, room):
    uses = packing.fullest(counts, room)
    total = sum(x * n for x, n in uses.items())
    assert total == brute_fullest(counts, room) and all(n <= counts[x] for x, n in uses.items())


def assert_packed(got, capacity):
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        ends = (bin_.offset + bin_.length).to_numpy()
        assert bin_.offset.iloc[0] == 0 and (bin_.offset.to_numpy()[1:] == ends[:-1]).all() and ends[-1] <= capacity


def test_op9_pieces(spark, sf_dir, texts):
    library = Tokenizer.from_file(WORDS)
    got = queries.op9_packing(spark, sf_dir).toPandas()
    assert_packed(got, 2048)
    want = {}
    for doc, text in zip(texts.doc_id, texts.text, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_packing_ties_repeats_and_refusals(spark):
    pieces = spark.createDataFrame([(1, 0, 5, 9)] * 7 + [(2, 0, 3, 9), (3, 0, 8, 9)], "doc_id long, piece int, length long, offset long")
    got = packing.pack(pieces, 8).toPandas()
    assert len(got) == 9
    assert_packed(got, 8)
    assert packing.pack(pieces.limit(0), 8).count() == 0
    with pytest.raises(ValueError, match="no length"):
        packing.pack(pieces, 7)


def test_sequences_hold_their_pieces(spark):
    encoded = library_ids.encode(documents(spark), WORDS, end_id=0, bits=32)
    packed = packing.pack(packing.table(packing.cut(encoded, 64)), 64)
    total = sum(len(r.ids) // 4 for r in packing.sequences(packed).collect())
    assert total == sum(r.length for r in packed.collect())
