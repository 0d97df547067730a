"""Encode whole texts with a public tokenizer, each distinct piece of text once.

A text may be cut before a space or line feed that follows a printable ASCII or a Latin-1 letter, and before
an ASCII punctuation mark or sign (but ' < | >) that follows such a letter: the tokenizers used here never let
a token, a pre-token, a special token or a normalization step reach over such a place, so the ids of a text are
those of its pieces in order.
Pieces are found in the flat byte buffer and counted as an Arrow dictionary. A Python worker keeps the ids
of pieces that it has met in flat arrays, looked up by a 64-bit hash and then compared byte by byte; only
new pieces are encoded.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from sievelake.llm.common import BYTE_CODES, drop_kept, flat, prefix_hash, single_threaded, span_hash, worker_keeps

CACHE_PIECES = 400_000  # at most in a Python worker, some 50 bytes each; later ones are encoded anew in each batch
TOGETHER = 500  # words in one string for the library

#: A list of pieces -> ids end to end, and of each piece where its ids start and how many they are.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]

CLASS = np.zeros(256, np.uint8)  # bit 1: printable ASCII; bit 2: ASCII letter
CLASS[33:127] = 1
CLASS[[*range(65, 91), *range(97, 123)]] = 3
CUT_BEFORE = np.zeros(256, np.uint8)
CUT_BEFORE[[32, 10]] = 1
CUT_BEFORE[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = 2

PLAIN = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")


def library_encoder(path: str) -> Encode:
    """Encodes by the tokenizers library. Plain words (a space and Latin letters) go to it many in one string:
    each is one pre-token of its own there, and the library tells which pre-token an id belongs to."""
    single_threaded()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = np.fromiter((PLAIN.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        words, others = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        sizes = np.zeros(len(pieces), np.int64)
        ids: list[np.ndarray] = []
        runs = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for run in runs:
            x = tokenizer.encode("".join([pieces[i] for i in run]), add_special_tokens=False)
            counts = np.bincount(np.array(x.word_ids, np.int64), minlength=len(run))
            if len(counts) != len(run) or not counts.all():
                raise RuntimeError("this tokenizer doesn't keep plain words apart")
            sizes[run] = counts
            ids.append(np.array(x.ids, np.uint32))
        for k in range(0, len(others), TOGETHER):  # few at a time: what the library gives beside the ids takes much memory
            run = others[k : k + TOGETHER]
            found = [x.ids for x in tokenizer.encode_batch_fast([pieces[i] for i in run], add_special_tokens=False)]
            sizes[run] = [len(x) for x in found]
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32))
        order = np.array([*words, *others], np.int64)
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), starts, sizes

    return encode


def gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs source[start : start + size], end to end."""
    ends = np.cumsum(sizes)
    return source[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.all = np.zeros(1 << 16, kind)
        self.n = 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(max(len(more), self.n // 2), self.all.dtype)])
        self.all[self.n : self.n + len(more)] = more
        self.n += len(more)


class PieceEncoder:
    """Ids of the rows of string columns."""

    def __init__(self, encode: Encode) -> None:
        self.encode = encode
        self.starts, self.sizes, self.ids = Grown(np.int64), Grown(np.uint16), Grown(np.uint32)
        self.text_at, self.text = Grown(np.int64), Grown(np.uint8)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes and their pieces; few levels, each much smaller than the one before

    def _find(self, hashes: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The kept piece equal to each of those in data, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        for keys, pieces in self.levels:
            where = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[where] == hashes
            found[hit] = pieces[where[hit]]
        hits = np.flatnonzero(found >= 0)
        kept = found[hits]
        begin, size = self.text_at.all[kept], self.text_at.all[kept + 1] - self.text_at.all[kept]
        own = at[hits + 1] - at[hits]
        same = size == own
        long = np.repeat(np.arange(len(hits)), np.where(same, own, 0))
        odd = gathered(data, at[hits], np.where(same, own, 0)) != gathered(self.text.all, begin, np.where(same, own, 0))
        same[long[odd]] = False
        found[hits[~same]] = -2  # another piece has this hash: never kept
        return found

    def _keep(self, hashes: np.ndarray, first: int) -> None:
        order = np.argsort(hashes)
        level = (hashes[order], first + order)
        while self.levels and len(self.levels[-1][0]) < 4 * len(level[0]):
            last = self.levels.pop()
            keys, pieces = np.concatenate([last[0], level[0]]), np.concatenate([last[1], level[1]])
            order = np.argsort(keys, kind="stable")
            level = (keys[order], pieces[order])
        self.levels.append(level)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end (uint32), and the offset of each row in them."""
        data, offsets = flat(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        after = CLASS[data]
        after[1:][data[:-1] == 0xC3] = 3  # the second byte of a Latin-1 letter
        after[1:][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = 1  # of a sign among them
        cut[1:-1] = (CUT_BEFORE[data[1:]] & after[:-1]) != 0
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        words, at = flat(coded.dictionary)
        hashes = span_hash(prefix_hash(BYTE_CODES[words]), at[:-1], at[1:])
        slots = self._find(hashes, words, at)
        new = np.flatnonzero(slots < 0)
        ids, starts, sizes = self.encode(coded.dictionary.take(pa.array(new)).to_pylist()) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        begin, length = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        known = slots >= 0
        begin[known], length[known] = self.starts.all[slots[known]], self.sizes.all[slots[known]]
        begin[new], length[new] = self.ids.n + starts, sizes
        source = np.concatenate([self.ids.all[: self.ids.n], ids])
        stay = new[(slots[new] == -1) & (sizes < 1 << 16)][: max(0, CACHE_PIECES - self.starts.n)]
        if len(stay):
            self._keep(hashes[stay], self.starts.n)
            lengths = at[stay + 1] - at[stay]
            if not self.text_at.n:
                self.text_at.add(np.zeros(1, np.int64))
            self.text_at.add(self.text.n + np.cumsum(lengths))
            self.text.add(gathered(words, at[stay], lengths))
            size = length[stay]
            self.starts.add(self.ids.n + np.cumsum(size) - size)
            self.sizes.add(size)
            self.ids.add(gathered(source, begin[stay], size))
        each = coded.indices.to_numpy()
        lengths = length[each]
        out = gathered(source, begin[each], lengths)
        row_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[np.searchsorted(bounds, offsets)]
        return out, row_at


def encoder(path: str, kind: str = "library") -> PieceEncoder:
    """This Python worker's encoder for a tokenizer file, kept over tasks. kind: library or numpy."""
    key = (path, kind)
    if key not in worker_keeps:
        drop_kept()
        if kind == "library":
            encode = library_encoder(path)
        else:
            from sievelake.llm.numpy_bpe import NumpyBpe

            encode = NumpyBpe(path).encode
        worker_keeps[key] = PieceEncoder(encode)
    return worker_keeps[key]
