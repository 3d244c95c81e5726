"""Token ids from cut pieces against the library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lorewell.llm import packing, tokens

# letters of several scripts, marks that compose, white space of every kind, endings after an apostrophe, special tokens
ALPHABET = list("abAB é中ñÑ \n\t.,'!|-&12  HKst’—\r😀İßΣς") + ["̱", "́", "\x1c", "\x85", "\xa0", " ", " ", " ", "​", "　", "'s", "\n\n", "<|endoftext|>"]
FIXED = ["", " ", "\n", "x" * 300, "a " * 50, "don't can't I'm. 's it's.'s ,'s", "one\n\ntwo  three \n four\t\tfive ", "H̱ ẖ Ķ", None]


def ids_of(texts, path, cache=tokens.CACHE):
    out = []
    for a, b, ids, at in tokens.encoded(pa.array(texts, pa.string()), path, 2, cache):
        out += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    rng = random.Random(3)
    path = tokens.default_vocabulary(name)
    texts = FIXED + ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(4000)]
    want = [e.ids + [2] for e in tokens.encoder(path).tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert ids_of(texts, path) == want
    monkeypatch.setattr(tokens, "PASS_BYTES", 2000)
    monkeypatch.setattr(tokens, "CALL_BYTES", 100)
    assert ids_of(texts, path, cache=500) == want  # forgets again and again
    assert ids_of(texts[:40][::-1], path) == want[:40][::-1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts_are_parted_at_boundaries(name, monkeypatch):
    rng = random.Random(9)
    path = tokens.default_vocabulary(name)
    texts = ["".join(rng.choices(ALPHABET, k=9000)), "x" * 9000, "ab " * 4000, "  \n" * 3000, "short"]
    want = [e.ids + [2] for e in tokens.encoder(path).tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "PASS_BYTES", 700)
    assert ids_of(texts, path) == want
    parts = list(tokens.encoder(path).parts(np.frombuffer(texts[2].encode(), np.uint8)))
    assert len(parts) > 9 and parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] == 12_000


def test_other_vocabularies_get_whole_texts(monkeypatch):
    path = tokens.default_vocabulary("byte_bpe_50k.json")
    want = ids_of(FIXED, path)
    e = tokens.Encoder(path)
    e.kind = "other"
    monkeypatch.setitem(tokens._loaded, path, e)
    assert ids_of(FIXED, path) == want


def test_long_pieces_are_not_remembered():
    e = tokens.Encoder(tokens.default_vocabulary("byte_bpe_50k.json"))
    data = np.frombuffer(b"word " + b"y" * 500, np.uint8)
    e.encode(data, np.array([0, len(data)]))
    assert max(map(len, e.known)) <= tokens.LONGEST_KEPT


def test_cuts_cover_documents_without_gaps():
    sizes = np.array([1, 63, 64, 65, 128, 129, 1000])
    doc, piece, start, length = packing.cuts(sizes, 64)
    for i, n in enumerate(sizes):
        mine = doc == i
        assert piece[mine].tolist() == list(range(mine.sum()))
        assert start[mine].tolist() == [0, *np.cumsum(length[mine])[:-1].tolist()] and length[mine].sum() == n
        assert (length[mine][1:] == 64).all() and 0 < length[mine][0] <= 64
