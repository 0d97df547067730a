"""Statistics of whole texts from flat byte buffers, for many documents at once.

Words are the runs [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes. Lines and windows are compared by 64-bit hashes of
their bytes and words, never across documents.
"""

from __future__ import annotations

import numpy as np

from sievelake.llm.common import WORD_BYTE, hashed_spans, mix64, word_spans

WINDOW = 8


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOL = _bytes("#*$%&|<>")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _bytes("0123456789")
MARK = _bytes(".,;:'\"()-")
SHOUT = _bytes("!?")
HEAD = np.ones(256, bool)  # first byte of a code point
HEAD[0x80:0xC0] = False
WIDE = ~HEAD | (np.arange(256) >= 0xC0)

#: In the order of the columns of features().
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "shout_share", "wide_share", "distinct_share", "log_line")
#: -1: a larger value never makes a document better.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs at least twice, and places whose key occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    again = np.r_[False, same] if len(s) else np.zeros(0, bool)
    twice = again | (np.r_[same, False] if len(s) else again)
    return order[twice], order[again]


def base_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for features(), n_lines and n_distinct of each row."""
    rows = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    hashes = hashed_spans(data, starts, ends)
    out = {"n_words": np.bincount(row, minlength=rows)}
    out["word_chars"] = _per_row(WORD_BYTE[data] & HEAD[data], offsets)
    out["n_symbols"] = _per_row(SYMBOL[data], offsets)

    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.r_[offsets[:-1], breaks + 1])
    line_row = np.searchsorted(offsets[:-1], begin, side="right") - 1
    # empty rows share their offset with the next row; a break at a row's very end opens an empty line: neither has a word
    end = np.r_[np.maximum(begin[1:] - 1, 0), len(data)] if len(begin) else begin
    edge = np.isin(np.r_[begin[1:], len(data)], offsets) if len(begin) else np.zeros(0, bool)
    nl = np.zeros(len(data) + 1, bool)
    nl[breaks + 1] = True
    end = np.where(edge & ~nl[np.r_[begin[1:], len(data)]], np.r_[begin[1:], len(data)], end) if len(begin) else end
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, line_row = begin[worded], end[worded], line_row[worded]
    salt = mix64(np.arange(rows, dtype=np.uint64) + np.uint64(7))
    _, again = _repeated(mix64(hashed_spans(data, begin, end) ^ salt[line_row]))
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    out["n_lines"] = np.bincount(line_row, minlength=rows)

    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        n = len(starts) - WINDOW + 1
        window = np.zeros(n, np.uint64)
        for k, factor in enumerate(mix64(np.arange(11, 11 + WINDOW, dtype=np.uint64)) | np.uint64(1)):
            window += hashes[k : k + n] * factor
        own = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        twice, _ = _repeated(mix64(window[own] ^ salt[row[own]]))
        np.add.at(covered, own[twice], 1)
        np.subtract.at(covered, own[twice] + WINDOW, 1) if len(twice) else None
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=rows)
    _, again = _repeated(mix64(hashes ^ salt[row]))
    out["n_distinct"] = out["n_words"] - np.bincount(row[again], minlength=rows)
    return out


def features(data: np.ndarray, offsets: np.ndarray, stats: dict[str, np.ndarray]) -> np.ndarray:
    """The matrix of FEATURES of each row."""
    words = np.maximum(stats["n_words"], 1)
    chars = np.maximum(stats["word_chars"], 1)
    lines = np.maximum(stats["n_lines"], 1)
    columns = [
        np.log1p(stats["n_words"]), stats["word_chars"] / words, stats["n_symbols"] / chars, stats["n_dup_lines"] / lines, stats["n_repeat_words"] / words,
        *(_per_row(kind[data], offsets) / chars for kind in (UPPER, DIGIT, MARK, SHOUT, WIDE)), stats["n_distinct"] / words, np.log1p(words / lines),
    ]
    return np.stack(columns, axis=1) if len(offsets) > 1 else np.zeros((0, len(FEATURES)))
