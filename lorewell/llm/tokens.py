"""Token ids of whole texts, by the tokenizers library, with a cache of pieces.

Most time of a byte-pair tokenizer goes into words that it has met before.  For
two kinds of vocabulary some places are always token boundaries: white space
next to visible characters, and an ASCII letter followed by a punctuation mark.
A pass over many texts is cut there as one byte buffer, Arrow finds the
different pieces, the library encodes those that are new, many in one call, and
numpy puts the ids together.  Where nothing is known to be a boundary, a piece
is as long as it has to be; other kinds of vocabulary get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from lorewell.llm import kernel

#: Different pieces that one worker remembers; beyond that it starts anew.
CACHE = 1_000_000
#: Longer pieces (in bytes) are encoded each time, so that the cache is bounded in bytes too.
LONGEST_KEPT = 64
#: Bytes of text that are cut and put together at a time; a longer text is parted at token boundaries.
PASS_BYTES = 1 << 21
#: Bytes of new pieces that go to the library in one call.
CALL_BYTES = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
_CUT_AT = np.zeros(256, bool)
_CUT_AT[[10, 0x20]] = True
_FOLDED = np.where(kernel.NON_SPACE, kernel.LOWER, 0x20).astype(np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation but the apostrophe, with which endings of words begin
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
# white space beyond ASCII, by its bytes
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Letters up to here compose with nothing before them and fold one by one; but for the dotted capital I.
_PLAIN = re.compile(" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")
_loaded: dict[str, "Encoder"] = {}


def _byte_names() -> dict[int, int]:
    """How byte-level vocabularies write each byte: visible Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + k for k, b in enumerate(others)}


_NAMES = _byte_names()


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any kind."""
    out = _SPACE[data]
    lead = np.flatnonzero(_WIDE_LEAD[data])
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        three = padded[lead[:, None] + np.arange(3)]
        for wide in _WIDE:
            k = len(wide)
            at = lead[(three[:, :k] == np.frombuffer(wide, np.uint8)).all(1)]
            for i in range(k):
                out[at + i] = True
    return out


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        folds = {"type": "Lowercase"} in ((said.get("normalizer") or {}).get("normalizers") or [])
        self.kind = "other"
        if (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and not said.get("normalizer")
        ):
            self.kind, self.between = "leading", "\n"  # a blank belongs to the word after it
        elif pre.get("type") == "Sequence" and first.get("behavior") == "Removed" and first.get("invert") and folds:
            self.kind, self.between = "dropped", " | "  # white space only parts words, and case is folded
        if self.kind != "other":
            one = self.tokenizer.encode(self.between, add_special_tokens=False).ids
            if len(one) != 1:
                self.kind = "other"
            else:
                self.between_id, self.model = one[0], self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)  # of all pieces, one after another
        self.ends = np.zeros(1 << 14, np.int64)
        self.n_pieces = self.n_ids = 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joins(self, piece: str) -> bool:
        """Whether the piece has the same ids when it stands in a row with others."""
        if self.kind == "dropped":
            return "|" not in piece
        visible = piece[1:] if piece.startswith(" ") else piece
        return bool(visible) and "\n" not in visible and visible.strip() == visible

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Append pieces with these ids to the pool."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while self.n_pieces + len(counts) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.ends[self.n_pieces + 1 : self.n_pieces + 1 + len(counts)] = self.n_ids + np.cumsum(counts)
        self.n_ids += len(ids)
        self.n_pieces += len(counts)

    def _add_row(self, row: list[str]) -> None:
        """Append pieces that one call encodes together."""
        got = self._library([self.between.join(row)])[0]
        at = np.flatnonzero(got == self.between_id)
        if len(at) == len(row) - 1:
            self._add(np.delete(got, at), np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
        else:
            self._add_each(row)

    def _add_each(self, texts: list[str]) -> None:
        each = self._library(texts)
        self._add(np.concatenate(each), np.array([len(e) for e in each]))

    def _add_words(self, pieces: list[bytes]) -> list[int]:
        """Append those of the pieces that are one word of plain letters, straight from the vocabulary's model; their places."""
        short = [k for k, p in enumerate(pieces) if len(p) <= LONGEST_KEPT and b"\n" not in p]
        lines = b"\n".join([pieces[k] for k in short])
        if self.kind == "dropped":
            lines = lines.replace(b" ", b"").decode().lower().encode()
        plain = map(_PLAIN.fullmatch, lines.decode().split("\n"))
        named = zip(short, plain, lines.decode("latin-1").translate(_NAMES).split(chr(_NAMES[10])))
        words = [(k, name) for k, match, name in named if match]
        each = [self.model.tokenize(name) for _, name in words]
        self._add(np.array([t.id for e in each for t in e], np.uint32), np.array([len(e) for e in each], np.int64))
        return [k for k, _ in words]

    def _learned(self, pieces: list[bytes]) -> np.ndarray:
        """Places in the pool of different pieces that are not in it yet."""
        first = self.n_pieces
        order = self._add_words(pieces)
        rows, single, size = [[]], [], 0
        for k in np.setdiff1d(np.arange(len(pieces)), order).tolist():
            text = pieces[k].decode()
            if len(text) <= LONGEST_KEPT and self._joins(text):
                rows[-1].append((k, text))
                size += len(text)
                if size >= CALL_BYTES:
                    rows.append([])
                    size = 0
            else:
                single.append((k, text))
        for row in rows:
            if row:
                self._add_row([t for _, t in row])
                order += [k for k, _ in row]
        for k in range(0, len(single), 1024):
            self._add_each([t for _, t in single[k : k + 1024]])
        order += [k for k, _ in single]
        out = np.empty(len(pieces), np.int64)
        out[order] = first + np.arange(len(pieces))
        self.known.update((p, n) for p, n in zip(pieces, out.tolist()) if len(p) <= LONGEST_KEPT)
        return out

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Places in the pool of these different pieces; new ones are encoded."""
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self._learned([pieces[k] for k in new.tolist()])
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes to encode, places where pieces begin) of a pass that has bytes."""
        cut = np.zeros(len(data), bool)
        if self.kind == "leading":
            seen = ~_white(data)
            cut[1:-1] = _CUT_AT[data[1:-1]] & seen[:-2] & seen[2:]
            filled = offsets[1:] > offsets[:-1]
            cut[offsets[1:][filled] - 1] = False  # the character after it is another text's
            cut[np.flatnonzero(cut & (data == 10)) + 1] = True
        else:
            cut = ~kernel.NON_SPACE[data]
            low = _FOLDED[data]
            # marks that compose with the letter before them, which the library does before it folds case
            marked = np.flatnonzero((data == 0xCC) | (data == 0xCD))
            for t in np.unique(np.searchsorted(offsets, marked, "right") - 1).tolist():
                low[offsets[t] : offsets[t + 1]] = data[offsets[t] : offsets[t + 1]]  # as it is given
            data = low
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        return data, np.flatnonzero(cut)

    def parts(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges of a text, of about ``PASS_BYTES``, that end where a piece does."""
        begin, n, margin = 0, len(text), 8
        while n - begin > 2 * PASS_BYTES and self.kind != "other":
            low, width, places = begin + PASS_BYTES, 1 << 12, []
            while not len(places) and low < n:
                window = text[low : low + width]
                places = self._cut(window, np.array([0, len(window)]))[1]
                # what stands near the ends of the window is not all in it
                places = places[(places > margin) & (places < len(window) - margin)]
                width *= 4
                if low + len(window) == n:
                    break
            if not len(places):
                break
            yield begin, low + int(places[0])
            begin = low + int(places[0])
        yield begin, n

    def encode(self, data: np.ndarray, offsets: np.ndarray, cache: int = CACHE) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n+1 offsets into them) of the texts of a pass; ``cache`` bounds the pieces remembered."""
        n = len(offsets) - 1
        if self.kind == "other":
            each = self._library([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(n)])
            return np.concatenate(each or [np.zeros(0, np.uint32)]), np.cumsum([0, *(len(e) for e in each)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if len(self.known) > cache or self.n_ids > 8 * cache:
            self._forget()
        data, begin = self._cut(data, offsets)
        places = np.append(begin, len(data))
        wide = len(data) > 0x7FFFFFFF
        cut = pa.Array.from_buffers(
            pa.large_binary() if wide else pa.binary(),
            len(begin),
            [None, pa.py_buffer(places.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
        ).dictionary_encode()
        number = self._numbers(cut.dictionary.to_numpy(zero_copy_only=False).tolist())
        first, count = self.ends[number], self.ends[number + 1] - self.ends[number]
        piece = cut.indices.to_numpy()
        times = count[piece]
        end = np.cumsum(times)
        at = np.repeat(first[piece] - (end - times), times)
        at += np.arange(len(at))
        before = np.concatenate([[0], end])  # ids before each piece
        return self.ids[at], before[np.searchsorted(begin, offsets)]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(column, path: str, end_id: int, cache: int = CACHE):
    """(first row, last row, ids, n+1 offsets) for passes over a column of texts; each text ends in the end id, null is empty."""
    e = encoder(path)
    data, offsets = kernel.utf8(column)
    for a, b in kernel.passes(offsets, PASS_BYTES):
        part = data[offsets[a] : offsets[b]]
        if b - a == 1 and len(part) > 2 * PASS_BYTES:
            each = [e.encode(part[x:y], np.array([0, y - x]), cache)[0] for x, y in e.parts(part)]
            ids = np.concatenate(each)
            at = np.array([0, len(ids)])
        else:
            ids, at = e.encode(part, offsets[a : b + 1] - offsets[a], cache)
        n = b - a
        out = np.full(len(ids) + n, end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[at[1:] + np.arange(n)] = False
        out[inside] = ids
        yield a, b, out, at + np.arange(n + 1)
    pa.default_memory_pool().release_unused()  # a worker lives on, and Arrow would keep what its batches took
