"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every adjacent pair of a word is looked up by
binary search in the sorted pair keys; each word merges all places of its lowest-ranked pair (from the left,
without overlap), and the array is closed up. Words are done when no pair of theirs is in the table. A table
in which a pair may rank below one that its parts need gets one merge a round and word, as rank order asks.

Reads the tokenizer's own file: NFC, white space, lower case, pre-token pattern, byte symbols, end-of-word
mark. Results for the special cases: null and empty texts, and texts of white space only, have no ids and
decode to the empty string; special tokens spelled out in a text become their ids, as the library has it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievelake.llm.common import bounded_batches, slices, texts
from sievelake.llm.encoding import PLAIN, encoder

END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def unassigned() -> re.Pattern[str]:
    """Finds characters that Python's Unicode data don't know: whether they are letters depends on the library's data."""
    bounds = [c for c in range(1, 0x110000) if (unicodedata.category(chr(c)) == "Cn") != (unicodedata.category(chr(c - 1)) == "Cn")]
    runs = zip(bounds[::2], [*bounds[1::2], 0x110000], strict=False)
    return re.compile("[" + "".join(f"{chr(i)}-{chr(j - 1)}" for i, j in runs) + "]")


class NumpyBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.splits = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.unsettled = unassigned()
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [b""] * self.size
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token.encode()
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + self.end] for s in signs], np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        born = np.full(self.size, -1, np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.at_once = bool(np.all((born[left] < np.arange(len(left))) & (born[right] < np.arange(len(left)))))
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bytes_of = {ord(s): b for b, s in enumerate(signs)}

    def normalized(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if text.isascii():
            return text.lower()
        return "".join([c.lower() for c in text])  # each by itself: the library knows no final sigma

    def words_of(self, text: str) -> list[str]:
        """The normalized words of a text; the library's own normalizer and pre-tokenizer where Unicode data may differ."""
        if text.isascii() or not self.unsettled.search(text):
            return self.words.findall(self.normalized(text))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.bytes_of[ord(c)] for c in w]).decode() for w, _ in found]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none of them empty) end to end, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        none = len(self.keys)
        while len(symbols):
            pairs = symbols[:-1] * self.size + symbols[1:]
            where = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
            hit = (self.keys[where] == pairs) & (word[:-1] == word[1:])
            rank = np.full(len(symbols), none, np.int64)
            rank[:-1][hit] = self.ranks[where[hit]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(word)]))
            open_ = lowest < none
            if not open_.all():  # these words are done
                done_ids.append(symbols[~open_])
                done_word.append(word[~open_])
            chosen = open_ & (rank == lowest)
            places = np.flatnonzero(chosen)
            if not len(places):
                break
            if self.at_once:  # of touching places take every other one, from the left
                new_run = np.r_[True, places[1:] != places[:-1] + 1]
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
            else:
                places = places[np.r_[True, word[places[1:]] != word[places[:-1]]]]
            symbols[places] = self.made[where[places]]
            keep = open_
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and where each piece's start and how many they are."""
        words: list[bytes] = []
        counts = np.zeros(len(pieces), np.int64)  # words in each piece; a special token is one that needs no merging
        fixed: list[tuple[int, int]] = []
        for k, piece in enumerate(pieces):
            before = len(words)
            if PLAIN.fullmatch(piece):
                words.append(piece[1:].lower().encode())
            else:
                for part in self.splits.split(piece) if self.splits else [piece]:
                    if part in self.special:
                        fixed.append((len(words), self.special[part]))
                        words.append(b"!")
                    elif part:
                        words += [w.encode() for w in self.words_of(part)]
            counts[k] = len(words) - before
        ids, sizes = self.merge(words)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        for k, special in fixed:
            ids[at[k]] = special
        ends = at[np.cumsum(counts)]
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        return ids.astype(np.uint32), starts, ends - starts


_tables: dict[str, np.ndarray] = {}


def token_table(path: str) -> np.ndarray:
    """The token of each id, as an object array of bytes."""
    if path not in _tables:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder") is not None:
            raise ValueError("decoding is for files without a decoder section, whose tokens are parted by spaces")
        pairs = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
        table = np.full(max(i for _, i in pairs) + 1, b"", object)
        for token, i in pairs:
            table[i] = token.encode()
        _tables[path] = table
    return _tables[path]


def decode(table: np.ndarray, ids: np.ndarray) -> bytes:
    """As the library decodes without a decoder of its own: the tokens, parted by spaces."""
    return b" ".join(table[ids].tolist())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of each row: the operator's general output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(path, "numpy"), token_table(path)
        for b in slices(batches, "text", 2 << 20, keeps=True):
            ids, at = enc.rows(b.column("text"))
            back = [decode(table, ids[i:j]).decode() for i, j in zip(at[:-1], at[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, without the ids leaving their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(path, "numpy"), token_table(path)
        for b in slices(batches, "text", 2 << 20, keeps=True):
            ids, at = enc.rows(b.column("text"))
            ids = ids.astype("<u4")
            of = [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            sums = [hashlib.sha256(x.tobytes()).hexdigest() for x in of]
            back = [hashlib.sha256(decode(table, x)).hexdigest() for x in of]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(sums, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
