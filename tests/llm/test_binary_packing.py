"""Power-of-two pieces: every token once, in order, and nothing padded."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import binary_packing, tokens

PATH = tokens.default_vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, _key string, _id string, _t string, ids string, sequence_id string"
TEXTS = [(1, "one two three"), (1, "one two three"), (None, "a"), (None, None), (2, ""), (3, "word " * 9000), (4, "x"), (5, "\n\n é 中文")]


@given(st.lists(st.integers(1, 5000), max_size=30), st.sampled_from([1, 2, 64, 2048]))
@settings(max_examples=100, deadline=None)
def test_cuts_against_binary_digits(lengths, size):
    doc, start, length = binary_packing.cuts(np.array(lengths, np.int64), size)
    want = []
    for d, n in enumerate(lengths):
        at = 0
        for piece in [size] * (n // size) + [1 << k for k in range(40, -1, -1) if n % size >> k & 1]:
            want.append((d, at, piece))
            at += piece
    assert list(zip(doc.tolist(), start.tolist(), length.tolist())) == want


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["c"] * 6) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [2048, 16])
def test_all_tokens(spark, size):
    rows = binary_packing.pack_powers(frame(spark, TEXTS), PATH, end_id=1, size=size, with_ids=True).collect()
    assert [r for r in rows if r.length & (r.length - 1) or r.length > size or r.offset] == []
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted(r.length for r in rows)  # buckets one after another
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in rows)
    library = tokens.encoder(PATH).tokenizer
    want = {}
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at, left = 0, len(ids)
        while left:
            n = min(size, 1 << left.bit_length() - 1)
            key = (i, at, n, tuple(ids[at : at + n]), len(ids))
            want[key] = want.get(key, 0) + 1
            at, left = at + n, left - n
    found = {}
    for r in rows:
        key = (r.doc_id, r.start, r.length, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens)
        found[key] = found.get(key, 0) + 1
    assert found == want


def test_buckets_are_files_of_their_own(spark, tmp_path):
    packed = binary_packing.pack_powers(frame(spark, TEXTS), PATH, end_id=1, with_ids=True)
    listed = {r.length: r for r in binary_packing.write_buckets(packed, str(tmp_path / "b")).collect()}
    rows = packed.collect()
    assert {k: r.sequences for k, r in listed.items()} == {n: sum(r.length == n for r in rows) for n in {r.length for r in rows}}
    assert sum(r.tokens for r in listed.values()) == sum(r.length for r in rows)
    for n in listed:
        back = {r.sequence_id: r.ids for r in binary_packing.read_bucket(spark, str(tmp_path / "b"), n).collect()}
        assert back == {r.sequence_id: np.frombuffer(r.ids, "<i4").tolist() for r in rows if r.length == n}


def test_no_rows_and_odd_sizes(spark):
    assert binary_packing.pack_powers(frame(spark, []), PATH, end_id=1).count() == 0
    with pytest.raises(ValueError):
        binary_packing.pack_powers(frame(spark, TEXTS), PATH, end_id=1, size=1000)
