"""Suffix-array dedup of repeated strings, by two-stage suffix sorting.

A string of `size` bytes that starts in two places is a repeat, and every byte that a repeat covers is removed.
The suffix array is built only where repeats can be, and in pieces that hold all of a repeat's places:

1. In every window of `size` bytes the q-gram with the least hash (the leftmost of equals) is the window's
   anchor. Equal windows have equal anchors at the same offset, so a window belongs to exactly one anchor and
   all its equals belong to anchors with the same hash.
2. Anchors whose hash occurs once are done. Each other one gives its context: the bytes of its windows, which
   start next to each other. Equal contexts are counted, not repeated.
3. The contexts of a hash meet in one task. There the suffixes that are smaller than their successors are
   sorted directly; all others are induced from these by scanning the buckets of first bytes in order; then the
   common prefixes of neighbours tell which windows have an equal. A hash with more than HOT contexts is dealt
   in runs of PIECE windows by the hash of the bytes that all windows of the run share.
4. What was found goes back to the contexts' places, becomes spans of each document, and the rest is kept.

Strings may be of a number of words instead of bytes: then each word stands in the text as UNIT bytes of its hash, the
first of which says where a word begins, and strings and q-grams begin there. What lies between words doesn't count, but goes
with the words around it. Words are told apart by 55 bits, so a string of other words passes for a repeat only
if it collides in each word that differs. A character of a script that puts no spaces between words is a word.

Documents never run into each other. Results for the special cases: null and empty texts have no bytes; texts
shorter than `size` lose nothing; rows equal in id and text are each other's repeat like any two documents; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.llm.common import BYTE_CODES, bounded_batches, checkpointed, flat, hashed_spans, prefix_hash, remove_path, row_key, scratch_path, shuffle_partitions, shuffles_freed, slices, span_hash, spread_join, texts, word_spans
from sievelake.llm.minhash import whole_groups

GRAM = 32
HOT, PIECE = 4000, 8
BLOCK_BYTES = 512 << 10  # of contexts in one suffix array; a larger group is one by itself
SEGMENT = 1 << 20  # window starts of a long text taken at once
PLACE_BITS = np.uint64(24)
SEEN = 100_000  # contexts that a task remembers, to send their bytes once
UNIT = 8  # bytes that stand for a word
#: First and last code points of kana, Bopomofo, Han and Yi, which are written without spaces; fixed values of Unicode.
UNSPACED = ((0x2E80, 0x312F), (0x3190, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))

# --- words as bytes ---------------------------------------------------------------------------------


def unit_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans(), with words cut before and after every character of UNSPACED."""
    starts, ends, rows = word_spans(data, offsets)
    lead = np.flatnonzero(data >= 0xE2)
    if not len(lead):
        return starts, ends, rows
    long = data[lead] >= 0xF0
    byte = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F
    point = (data[lead].astype(np.int64) & np.where(long, 0x07, 0x0F)) << 12 | byte(1) << 6 | byte(2)
    point = np.where(long, point << 6 | byte(3), point)
    own = np.zeros(len(lead), bool)
    for first, last in UNSPACED:
        own |= (point >= first) & (point <= last)
    after = (lead + 3 + long)[own]
    after = after[after < len(data)]
    cut = np.union1d(starts, np.concatenate([lead[own], after]))
    word = np.searchsorted(starts, cut, side="right") - 1
    inside = cut < ends[word]
    cut, word = cut[inside], word[inside]
    return cut, np.minimum(ends[word], np.append(cut[1:], len(data))), rows[word]


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words as UNIT bytes each: the first from 0x80 to 0xBF, the others below 0x80."""
    starts, ends, rows = unit_spans(data, offsets)
    codes = hashed_spans(data, starts, ends).astype("<u8").view(np.uint8).reshape(-1, UNIT) & np.uint8(0x7F)
    codes[:, 0] = codes[:, 0] & np.uint8(0x3F) | np.uint8(0x80)
    return codes.ravel(), UNIT * np.searchsorted(rows, np.arange(len(offsets)))


def as_they_are(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def byte_runs(body: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in a text's word_codes() as runs in its bytes."""
    starts, ends, _ = unit_spans(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    return [(int(starts[a // UNIT]), int(ends[b // UNIT - 1])) for a, b in runs]


# --- 1. anchors -------------------------------------------------------------------------------------


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, v.dtype)
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, size: int, step: int = 1) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, anchor's hash, first window's start in the row, how many bytes windows
    start in, and how far the anchor is from that start. Windows and q-grams start at multiples of `step`."""
    gram, pace = min(GRAM, size), SEGMENT // step * step
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(len(data) - size + 1, 0), pace):
        part = data[begin : begin + pace + size - 1]
        prefix = prefix_hash(BYTE_CODES[part])
        at = np.arange(0, len(part) - gram + 1, step)
        h = span_hash(prefix, at, at + gram)
        marked = (h >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
        least = sliding_min(marked, (size - gram) // step + 1)
        place = begin + step * np.arange(len(least))
        row = np.searchsorted(offsets, place, side="right") - 1
        start = np.flatnonzero(place + size <= offsets[row + 1])
        if not len(start):
            continue
        where = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (where[1:] != where[:-1]) | (row[start[1:]] != row[start[:-1]])
        first = np.flatnonzero(new)
        r, many = row[start[first]], np.diff(np.append(first, len(start)))
        found.append((r, h[where[first] // step].view(np.int64), place[start[first]] - offsets[r], step * (many - 1) + 1, where[first] - step * start[first]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(size: int, form, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            row, h, start, n, lead = anchors(*form(*flat(b.column("body"))), size, step)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row)), pa.array(h), pa.array(start), pa.array(n), pa.array(lead)], ["key", "gram", "start", "n", "lead"])

    return run


# --- 2. contexts ------------------------------------------------------------------------------------


def _context_rows(size: int, form):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches, "body"):
            out: list[tuple] = []
            data, offsets = form(*flat(b.column("body")))
            for key, begin, end, runs in zip(b.column("key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), b.column("runs"), strict=True):
                of, body = runs.values, data[begin:end].tobytes()
                for gram, start, n, lead in zip(*(of.field(k).to_pylist() for k in range(4)), strict=True):
                    context = body[start : start + n - 1 + size]
                    digest = hashlib.blake2b(context, digest_size=16).digest()
                    if digest in seen:
                        context = None
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                    out.append((key, gram, digest, start, n, lead, context))
            if out:
                key, gram, digest, start, n, lead, context = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(gram, pa.int64()), pa.array(digest, pa.binary()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(lead, pa.int64()), pa.array(context, pa.binary())], ["key", "gram", "digest", "start", "n", "lead", "context"])

    return run


# --- 3. two-stage suffix sorting --------------------------------------------------------------------


def two_stage_order(t: np.ndarray, active: np.ndarray, depth: int) -> np.ndarray:
    """The active places of t in the order of their suffixes, exact for the first `depth` bytes.

    t ends with its least value. Every active place must be smaller than its successor, which its end counts
    as, or be followed by an active place.
    """
    n = len(t)
    change = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    following = np.minimum.accumulate(change[::-1])[::-1]
    following = np.where(following < n, following, n - 2)
    smaller = np.ones(n, bool)
    smaller[:-1] = t[following] < t[following + 1]

    # stage one: sort these directly, by three words of eight bytes, and equals by what follows
    direct = np.flatnonzero(active & smaller)
    padded = np.concatenate([t, np.zeros(depth + 32, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 24, 8), (1, 1))
    keys = [np.ascontiguousarray(words[direct + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(3)]
    order = np.lexsort(keys[::-1])
    direct = direct[order]
    same = np.ones(max(len(direct) - 1, 0), bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    raw = padded.tobytes()
    heads = np.flatnonzero(np.r_[True, ~same]) if len(direct) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(direct)))
    for head, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        ties = direct[head : head + size].tolist()
        ties.sort(key=lambda p: raw[p + 24 : p + depth])
        direct[head : head + size] = ties

    # stage two: scan the buckets in order; each place induces the one before it if that is larger than its successor
    larger = active & ~smaller
    first = t[direct]
    cuts = np.searchsorted(first, np.arange(257))
    pending: dict[int, list[np.ndarray]] = {}
    out = []
    for c in range(256):
        wave = np.concatenate(pending.pop(c)) if c in pending else np.zeros(0, np.int64)
        if not len(wave) and cuts[c] == cuts[c + 1]:
            continue
        bucket = []
        while len(wave):  # runs of one byte induce each other inside their bucket
            bucket.append(wave)
            before = wave - 1
            before = before[before >= 0]
            wave = before[larger[before] & (t[before] == c)]
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole - 1
        before = before[before >= 0]
        before = before[larger[before] & (t[before] > c)]
        byte = t[before]
        stable = np.argsort(byte, kind="stable")
        before, byte = before[stable], byte[stable]
        edges = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else []
        for b, part in zip(byte[edges].tolist(), np.split(before, edges[1:]), strict=True) if len(byte) else ():
            pending.setdefault(b, []).append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def neighbours_agree(t: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Whether each place in `order` has `size` bytes in common with the one before it."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(t), 8), (1, 1))
    out = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    at = 0
    while at + 8 <= size and len(left):
        a, b = (np.ascontiguousarray(words[order[left - k] + at]).view(np.uint64).ravel() for k in (1, 0))
        left = left[a == b]
        at += 8
    for k in range(at, size):
        left = left[t[order[left - 1] + k] == t[order[left] + k]]
    out[left] = True
    return out


def repeated_windows(contexts: list[bytes], counts: np.ndarray, size: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: context's number, where the first starts, how many bytes they start in. counts: the
    places of each context. Windows start at multiples of `step`.

    The contexts are all different; a window is repeated if it has an equal in any of them, or if its context
    has several places.
    """
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    # bytes are raised by one, above the end mark; UTF-8 has no 255
    t = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)
    start = np.cumsum(lengths + 1) - (lengths + 1)
    windows = (lengths - size) // step + 1
    total = int(windows.sum())
    of = np.repeat(np.arange(len(contexts)), windows)
    place = np.repeat(start - step * (np.cumsum(windows) - windows), windows) + step * np.arange(total)
    active = np.zeros(len(t), bool)
    active[place] = True
    # beyond the last of neighbours, up to the first place that is smaller than its successor
    more = start + windows if step == 1 else place + 1
    rising = np.flatnonzero(np.r_[t[:-1] < t[1:], True])
    stop = rising[np.searchsorted(rising, more - 1)] + 1
    extra = np.maximum(stop - more, 0)
    active[np.repeat(more - (np.cumsum(extra) - extra), extra) + np.arange(int(extra.sum()))] = True
    number = np.full(len(t), -1)
    number[place] = np.arange(total)
    order = two_stage_order(t, active, size + 1)
    order = order[number[order] >= 0]
    agree = neighbours_agree(t, order, size)
    hit = counts[of] > 1
    hit[number[order[agree]]] = True
    hit[number[order[np.flatnonzero(agree) - 1]]] = True
    edge = np.r_[True, of[1:] != of[:-1]] if total else np.zeros(0, bool)
    begins = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]])) if total else np.zeros(0, np.int64)
    ends = np.flatnonzero(hit & np.r_[~hit[1:] | edge[1:], True]) if total else begins
    first = np.cumsum(windows) - windows
    return of[begins], step * (begins - first[of[begins]]), step * (ends - begins) + 1


def _window_rows(size: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cuts in whole_groups(batches, ["dealt"]):
            lengths = np.diff(flat(b.column("context"))[1])
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
            at = 0
            while at < len(cuts) - 1:  # several groups in one suffix array
                to = max(at + 1, int(np.searchsorted(ends[cuts], ends[cuts[at]] + BLOCK_BYTES, side="right")) - 1)
                part = b.slice(int(cuts[at]), int(cuts[to] - cuts[at]))
                bodies = part.column("context").dictionary_encode()
                which = bodies.indices.to_numpy()
                places = np.bincount(which, np.asarray(part.column("places")), len(bodies.dictionary)).astype(np.int64)
                text, first, n = repeated_windows(bodies.dictionary.to_pylist(), places, size, step)
                # a context's runs go to all rows that have it
                runs = np.bincount(text, minlength=len(bodies.dictionary))
                base = np.cumsum(runs) - runs
                rows = np.repeat(np.arange(part.num_rows), runs[which])
                each = np.repeat(base[which] - (np.cumsum(runs[which]) - runs[which]), runs[which]) + np.arange(len(rows))
                taken = pa.array(rows)
                skip = np.asarray(part.column("skip"))[rows]
                yield pa.RecordBatch.from_arrays([part.column("gram").take(taken), part.column("digest").take(taken), pa.array(first[each] + skip), pa.array(n[each])], ["gram", "digest", "first", "windows"])
                at = to

    return run


# --- 4. spans ---------------------------------------------------------------------------------------


def repeats(docs: DataFrame, size: int, words: int | None = None) -> DataFrame:
    """key (of a row's id and text) and spans, an array of (begin, end) in bytes, for each row with a repeat.

    With `words`, repeats are of so many words, and spans are in bytes of word_codes()."""
    spark = docs.sparkSession
    size, least, form, step = (UNIT * words, 2 * words - 1, word_codes, UNIT) if words else (size, size, as_they_are, 1)
    whole = PIECE * step
    bounded_batches(spark)
    bodies = keyed(docs)
    mine, theirs = scratch_path(spark, "anchors"), scratch_path(spark, "contexts")
    anchored = bodies.filter(F.octet_length("body") >= least).mapInArrow(_anchor_rows(size, form, step), "key binary, gram long, start long, n long, lead long")
    anchored.write.option("compression", "zstd").parquet(mine)
    found = spark.read.parquet(mine)
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    several = spread_join(found, counts, "gram", F.xxhash64("key", "start"), found.count())
    runs = several.groupBy("key").agg(F.collect_set(F.struct("gram", "start", "n", "lead")).alias("runs"))
    cut = bodies.join(runs, "key").select("key", "body", "runs").mapInArrow(_context_rows(size, form), "key binary, gram long, digest binary, start long, n long, lead long, context binary")
    with shuffles_freed(spark):
        cut.write.option("compression", "zstd").parquet(theirs)

    places = spark.read.parquet(theirs)
    hot = checkpointed(places.groupBy("gram").agg(F.approx_count_distinct("digest").alias("m")).filter(F.col("m") > HOT).select("gram", F.lit(True).alias("hot")))
    contexts = places.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("places"), F.max("context").alias("context"), F.max("n").alias("n"), F.max("lead").alias("lead"))
    contexts = contexts.withColumn("hot", F.lit(False)) if hot.isEmpty() else contexts.join(hot, "gram", "left")
    # hot contexts are cut where a window's distance from the anchor is a multiple of a whole run, so equal windows are cut alike
    last, offset = F.col("n") - 1, F.pmod(F.col("lead"), F.lit(whole))
    inner = F.when(offset <= last, F.sequence(offset, last, F.lit(whole).cast("long"))).otherwise(F.array().cast("array<long>"))
    skips = F.when(F.col("hot"), F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), inner))).otherwise(F.array(F.lit(0).cast("long")))
    cut = contexts.select("gram", "digest", "places", "context", "n", "lead", "hot", F.explode(skips).alias("skip"))
    past = F.pmod(F.col("skip") - F.col("lead"), F.lit(whole))
    windows = F.when(F.col("hot"), F.least(whole - past, F.col("n") - F.col("skip"))).otherwise(F.col("n"))
    piece = lambda skip, length: F.substring("context", skip.cast("int") + 1, length.cast("int"))
    # the bytes that all windows of a run have in common decide where it goes
    core = piece(F.col("skip") - past + whole - 1, F.lit(size - whole + 1)) if size > whole else F.lit("").cast("binary")
    dealt = F.when(F.col("hot"), F.xxhash64("gram", F.col("skip") - F.col("lead") - past, core)).otherwise(F.xxhash64("gram"))
    rows = cut.select("gram", "digest", "places", "skip", piece(F.col("skip"), windows + size - 1).alias("context"), dealt.alias("dealt"))
    rows = rows.repartition(shuffle_partitions(spark), "dealt").sortWithinPartitions("dealt")
    told = rows.mapInArrow(_window_rows(size, step), "gram long, digest binary, first long, windows long")

    begin = F.col("start") + F.col("first")
    spans = places.select("key", "gram", "digest", "start").join(told, ["gram", "digest"]).select("key", begin.alias("begin"), (begin + F.col("windows") + size - 1).alias("end"))
    out = checkpointed(spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")))
    remove_path(spark, mine)
    remove_path(spark, theirs)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes, and a key of both."""
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("body"))
    return rows.withColumn("key", row_key(F.col("doc_id"), F.col("body")))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["begin"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["begin"], s["end"]))
    return out


def kept_bytes(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *[x for run in runs for x in run], len(body)]
    return b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            removed, n_spans, digests, left = [], [], [], []
            for body, spans in zip(b.column("body").to_pylist(), b.column("spans").to_pylist(), strict=True):
                runs = merged(spans or [])
                removed.append(sum(e - s for s, e in runs))
                n_spans.append(len(runs))
                kept = kept_bytes(body, runs)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    left.append(kept.decode(errors="ignore"))
            sizes = np.diff(flat(b.column("body"))[1])
            columns = [b.column("doc_id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.string())] * with_text, names + ["text"] * with_text)

    return run


def repeat_digests(docs: DataFrame, size: int = 400, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that are left, and on demand the text that they are, of each row.

    Of a character that is cut through, the rest counts for kept_sha256 but isn't in text."""
    rows = keyed(docs).join(repeats(docs, size), "key", "left").select("doc_id", "body", "spans")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(_kept(with_text), kind + (", text string" if with_text else ""))


def cut_repeats(docs: DataFrame, size: int = 400, words: int | None = None) -> DataFrame:
    """`docs` with repeats cut out of text, and n_chars (if there is such a column) as the new text's length.

    Repeats are of `size` bytes, and of a character that is cut through, the rest goes too; or, if given, of `words`
    words, which go from the first one's start to the last one's end. Null texts stay null.
    """
    own, other = "sievelake key", "sievelake spans of"
    rows = docs.withColumn(own, row_key(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")).cast("binary")))
    found = repeats(docs, size, words).select(F.col("key").alias(other), F.col("spans").alias("sievelake spans"))
    names = docs.columns
    lower = [n.lower() for n in names]
    text, chars = lower.index("text"), lower.index("n_chars") if "n_chars" in lower else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(len(names))
            hit = np.flatnonzero(np.asarray(spans.is_valid().to_numpy(zero_copy_only=False)))
            columns = [b.column(k) for k in range(len(names))]
            if len(hit):
                bodies = columns[text].to_pylist()
                lengths = columns[chars].to_pylist() if chars is not None else []
                for k in hit.tolist():
                    body, gone = bodies[k].encode(), merged(spans[k].as_py())
                    bodies[k] = kept_bytes(body, byte_runs(body, gone) if words else gone).decode(errors="ignore")
                    if chars is not None:
                        lengths[k] = len(bodies[k])
                columns[text] = pa.array(bodies, columns[text].type)
                if chars is not None:
                    columns[chars] = pa.array(lengths, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    joined = rows.join(found, F.col(own) == F.col(other), "left").select(*[rows[f"`{c}`"] for c in names], "sievelake spans")
    plain = joined.toDF(*[f"c{k}" for k in range(len(names) + 1)])  # mapInArrow doesn't take every name
    return plain.mapInArrow(run, T.StructType(plain.schema.fields[:-1])).toDF(*names)
