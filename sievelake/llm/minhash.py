"""MinHash near-dedup with odd sketches.

1. One pass over the texts: each document's set of word shingles, its MinHash samples, bands of samples as
   candidate buckets, and the odd sketch of the samples: a parity bitmap in which every sample flips one bit.
   The bits in which two sketches differ tell how many samples do, most precisely at high similarity.
2. Documents with equal sets are one class, known by a 128-bit hash of the set; only classes go on.
3. In each bucket the classes' sketches are compared by XOR and population count, and the bucket gives a
   spanning forest of what may be similar, not its pairs. The forests' components are the candidate clusters.
4. The full sets of a cluster meet in a task, where every pair is confirmed exactly; again only a spanning forest
   of the links goes on. Its components are the result.
5. A cluster too large for a task is dealt into blocks around hubs first: each class goes to one block of the least
   class that it shares a bucket with, and a few classes of a hub are in all its blocks. What that confirms makes
   most of such a cluster one component at the cost of one text for each class. Only classes that still have a
   similar sketch in another component meet again, as pairs of blocks, which no pair escapes.

No bucket, cluster or set of partners is cut short. A link is missed only if no band of its two documents
agrees or its sketches differ beyond MOST_DIFFERING: for a similarity of 0.8 less than 3 times in 10**7.

Results for the special cases: null and empty texts and texts of white space have no shingles and are linked
with nothing; with fewer words than a shingle the whole sequence is one; rows equal in id are documents of
their own; a class without any id has a null component_id, and null equals null in `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import bounded_batches, checkpointed, flat, hashed_spans, mix64, row_key, shuffle_partitions, slices, spread_join, texts, word_spans
from sievelake.llm.components import components

SAMPLES, ROWS, BANDS = 128, 4, 32  # MinHash samples; of them in a band; bands
SKETCH_BITS = 512
MOST_DIFFERING = 88  # bits of two sketches; a similarity of 0.85 has about 53, of 0.6 about 84
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 2048, 512, 1_000_000
BRIDGES = 16  # classes of a hub that are in all its blocks

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_BAND_FACTORS = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(31)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each row, sorted within the row, end to end, and each row's offset."""
    rows = len(offsets) - 1
    data = _LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    hashes = hashed_spans(data, starts, ends)
    n_words = np.bincount(row, minlength=rows)
    factors = mix64(np.arange(3, 3 + words, dtype=np.uint64)) | np.uint64(1)
    padded = np.append(hashes, np.zeros(words - 1, np.uint64))
    size = np.minimum(n_words, words)[row] if len(row) else row
    last = np.cumsum(n_words)[row] - np.arange(len(row))  # words from here to the row's end
    total = np.zeros(len(row), np.uint64)
    for k in range(words):
        total += np.where(k < size, padded[k : k + len(row)], np.uint64(k + 1)) * factors[k]
    whole = last >= size
    h, r = mix64(total[whole]), row[whole]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(r, minlength=rows))])


def class_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each row's set, as two columns; equal for equal sets."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    for k, salt in enumerate((0x51ED270B, 0x2545F491)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))), out=total[1:])
        out[:, k] = mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))
    return out


def minhash_samples(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """row x SAMPLES; rows without shingles have zeros."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, SAMPLES), np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    work = np.empty_like(low)
    for k in range(SAMPLES):
        np.multiply(low, _FACTORS[k], out=work)
        np.add(work, _ADDENDS[k], out=work)
        if len(full):
            out[full, k] = np.minimum.reduceat(work, at[:-1][full])
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """row x BANDS: a bucket of each band; the band's number is part of it."""
    wide = samples[:, : ROWS * BANDS].astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), wide.shape[:2]).copy()
    for k in range(ROWS):
        total += mix64(wide[:, :, k] + np.uint64(1)) * _BAND_FACTORS[k]
    return mix64(total).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """row x SKETCH_BITS / 64: each sample flips the bit that it and its number choose."""
    bit = mix64(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flips = np.bincount((bit.astype(np.int64) + np.arange(len(samples))[:, None] * SKETCH_BITS).ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view(np.uint64)


def similarity(differing: int | np.ndarray) -> np.ndarray:
    """What two odd sketches that differ in so many bits say of the Jaccard similarity."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / SKETCH_BITS, 1e-9))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * width), pa.py_buffer(raw.tobytes())])


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, at = shingle_sets(*flat(b.column("text")), words)
            samples = minhash_samples(h, at)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), pa.array(band_hashes(samples).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(np.diff(at)), fixed_binary(class_keys(h, at)), fixed_binary(odd_sketches(samples)), bands], ["doc_id", "key", "n_shingles", "cls", "sketch", "bands"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by `keys` as batches of whole groups, with the offsets of the groups."""
    rest: list[pa.RecordBatch] = []

    def starts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            if pa.types.is_binary(c.type):
                c = np.frombuffer(b"".join(c.to_pylist()), "V16") if b.num_rows else np.zeros(0, "V16")
                c = c.view(np.uint64).reshape(-1, 2)
                new[1:] |= (c[1:] != c[:-1]).any(axis=1)
            else:
                c = np.asarray(c)
                new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(rest).combine_chunks().to_batches()[0] if len(rest) > 1 else rest[0]

    for b in batches:
        if not b.num_rows:
            continue
        if rest and all(rest[-1].column(k)[rest[-1].num_rows - 1] == b.column(k)[0] for k in keys) and not len(starts(b)):
            rest.append(b)
            continue
        rest.append(b)
        whole = joined()
        cuts = starts(whole)
        if len(cuts):
            yield whole.slice(0, int(cuts[-1])), np.concatenate([np.zeros(1, np.int64), cuts])
            rest = [whole.slice(int(cuts[-1]))]
        else:
            rest = [whole]
    if rest:
        whole = joined()
        yield whole, np.concatenate([np.zeros(1, np.int64), starts(whole), [whole.num_rows]])


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a symmetric boolean matrix links: stars around the first of each component."""
    left = np.ones(len(linked), bool)
    edges = []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            u = stack.pop()
            reached = np.flatnonzero(linked[u] & left)
            left[reached] = False
            edges += [(root, int(v)) for v in reached]
            stack += reached.tolist()
    return edges


PAIR_SIZES = 6  # groups up to this many rows are compared together


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the similar sketches of each bucket; of classes with labels, of those whose labels differ."""
    for b, cuts in whole_groups(batches, ["bucket", "i", "j"]):
        keys = np.frombuffer(b"".join(b.column("cls").to_pylist()), np.uint64).reshape(-1, 2)
        label = np.arange(len(keys))
        if "label" in b.schema.names:
            label = np.unique(np.frombuffer(b"".join(b.column("label").to_pylist()), np.uint64).reshape(-1, 2), axis=0, return_inverse=True)[1].ravel()
        sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(len(keys), -1)
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        small = np.repeat(np.diff(cuts) <= PAIR_SIZES, np.diff(cuts))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, PAIR_SIZES):
            p = np.flatnonzero((group[d:] == group[:-d]) & small[d:]) if len(group) > d else np.zeros(0, np.int64)
            near = (np.bitwise_count(sketch[p] ^ sketch[p + d]).sum(axis=1) <= MOST_DIFFERING) & (label[p] != label[p + d])
            left.append(p[near])
            right.append(p[near] + d)
        for g in np.flatnonzero(np.diff(cuts) > PAIR_SIZES):
            s, of = sketch[cuts[g] : cuts[g + 1]], label[cuts[g] : cuts[g + 1]]
            linked = np.stack([(np.bitwise_count(s ^ one).sum(axis=1) <= MOST_DIFFERING) & (of != mine) for one, mine in zip(s, of, strict=True)])
            forest = np.array(spanning_forest(linked), np.int64).reshape(-1, 2) + cuts[g]
            left.append(forest[:, 0])
            right.append(forest[:, 1])
        a, z = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays([fixed_binary(keys[a]), fixed_binary(keys[z])], ["a", "b"])


def shared_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of any two different sets of hashes (the diagonal is of no use)."""
    m = len(at) - 1
    owner = np.repeat(np.arange(m), np.diff(at))
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1 if len(h) else new
    column, owner = column[several], owner[several]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((m, m))
    slab = max(256, (1 << 22) // max(m, 1))
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0), slab))
    for begin, end in zip(cuts, [*cuts[1:], len(column)], strict=True):
        part = np.zeros((m, slab), np.float32)
        part[owner[begin:end], column[begin:end] % slab] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _cluster_edges(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cuts in whole_groups(batches, ["cluster", "i", "j"]):
            found = []
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(int(begin), int(end - begin))
                keys = np.frombuffer(b"".join(part.column("cls").to_pylist()), np.uint64).reshape(-1, 2)
                h, at = shingle_sets(*flat(part.column("text")), words)
                _, own = np.unique(keys.byteswap(), axis=0, return_index=True)  # a row may be there several times; in the order of the bytes
                if len(own) < 2:
                    continue
                sizes = np.diff(at)[own]
                take = np.repeat(at[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                shared = shared_counts(h[take], np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))
                linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
                forest = np.array(spanning_forest(linked), np.int64).reshape(-1, 2)
                found.append(keys[own][forest])
            pairs = np.concatenate(found) if found else np.zeros((0, 2, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([fixed_binary(pairs[:, 0]), fixed_binary(pairs[:, 1])], ["a", "b"])

    return run


def block_pairs(blocks: Column, key: Column) -> Column:
    """The pairs (i, j), i <= j, of blocks in which a row takes part, its own block being `key` modulo `blocks`."""
    own = F.pmod(key, blocks)
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))


def _same(block: Column) -> list[Column]:
    """A block that meets only itself."""
    return [block.cast("long").alias("i"), block.cast("long").alias("j")]


def _similar(met: DataFrame, *label: str) -> DataFrame:
    """Edges a, b between classes with similar sketches in a bucket. met: bucket, m (its classes), cls and sketch."""
    blocks = F.ceil(F.col("m") / BUCKET_BLOCK).cast("long")
    dealt = met.select("bucket", "cls", "sketch", *label, F.explode(block_pairs(blocks, F.xxhash64("cls"))).alias("p")).select("bucket", "p.i", "p.j", "cls", "sketch", *label)
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cls")  # so that stars are around the least class
    return dealt.mapInArrow(_bucket_edges, "a binary, b binary")


def _blocked(rows: DataFrame) -> DataFrame:
    """rows (cls, n and cluster) with the number of blocks that their cluster needs."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CLUSTER_BLOCK, F.sum("n") / CLUSTER_SHINGLES)).cast("long")
    sizes = rows.groupBy("cluster").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("m"))
    sizes = checkpointed(sizes)
    total = sizes.agg(F.sum("m")).first()[0] or 0
    return spread_join(rows, sizes, "cluster", F.col("cls"), total).drop("m")


def _around_hubs(large: DataFrame, inside: DataFrame) -> DataFrame:
    """cls, cluster (the hub), i and j: each class in a block of its hub, and a hub's least classes in all its blocks."""
    hubs = inside.groupBy("bucket").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    told = spread_join(inside, hubs, "bucket", F.xxhash64("cls", "bucket"), inside.count())
    members = checkpointed(_blocked(told.groupBy("cls").agg(F.min("hub").alias("cluster")).join(large.select("cls", "n"), "cls")))
    own = members.select("cls", "cluster", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("i"))
    least = members.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy("cls"))).filter(F.col("nth") <= BRIDGES)
    bridges = least.select("cls", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    return own.unionByName(bridges).distinct().withColumn("j", F.col("i"))


def _confirmed(full: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges a, b of what is linked in a block or a pair of blocks. full: cluster, i, j, cls and text."""
    dealt = full.select("cluster", "i", "j", "cls", "text").repartition(shuffle_partitions(full.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(_cluster_edges(words, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Links documents whose sets of shingles of `words` words are similar by `percent` or more.
    """
    return _components(docs, words, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns as they are, but of each component only the row with the least id (then key).

    Rows equal in id and text stay or go together.
    """
    own, other = "sievelake key", "sievelake gone"
    rows = docs.withColumn(own, row_key(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")).cast("binary")))
    found = checkpointed(_components(docs, words, percent).filter("n_shingles > 0").select("doc_id", "key", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = found.groupBy("root").agg(F.min(order).alias("first"), F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("m"))
    # only components with several keys lose rows
    several = first.filter("least < most").select("root", F.col("first.key").alias("keeper"), "m")
    gone = spread_join(found.select("root", "key"), several, "root", F.col("key"), found.count()).filter("key <> keeper").select(F.col("key").alias(other))
    return rows.join(gone, F.col(own) == F.col(other), "left_anti").select(*[rows[f"`{c}`"] for c in docs.columns])


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, key (of id and text), n_shingles, component_id, root (the component's name; null without shingles) of each row."""
    bounded_batches(docs.sparkSession)
    named = texts(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text").cast("binary")))
    signed = checkpointed(named.mapInArrow(_signatures(words), "doc_id long, key binary, n_shingles long, cls binary, sketch binary, bands array<long>"))
    classes = checkpointed(signed.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("first_key"), F.min("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("m")))

    # buckets with more than one class
    rows = classes.select("cls", F.explode("bands").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = spread_join(rows, counts, "bucket", F.xxhash64("cls", "bucket"), BANDS * classes.count()).join(classes.select("cls", "sketch"), "cls")
    clusters = components(_similar(met)).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    wanted = checkpointed(_blocked(classes.select("cls", "n", F.col("first_key").alias("key")).join(clusters, "cls")))

    large = wanted.filter("blocks > 1")
    small = wanted.filter("blocks = 1").select("key", "cls", "cluster", *_same(F.lit(0)))
    if large.isEmpty():
        linked = components(_confirmed(named.select("key", "text").join(small, "key"), words, percent))
    else:
        full = checkpointed(named.select("key", "text").join(wanted.select("key", "cls"), "key").select("cls", "text"))
        inside = checkpointed(classes.join(large.select("cls"), "cls", "left_semi").select("cls", F.explode("bands").alias("bucket")))
        labels = components(_confirmed(full.join(small.drop("key").unionByName(_around_hubs(large, inside)), "cls"), words, percent)).select(F.col("node").alias("of"), F.col("root").alias("label"))
        labelled = checkpointed(inside.join(labels, F.col("cls") == F.col("of"), "left").select("bucket", "cls", F.coalesce("label", "cls").alias("label")))
        several = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("bucket", "m")
        open_ = spread_join(labelled, several, "bucket", F.xxhash64("cls", "bucket"), labelled.count()).join(classes.select("cls", "sketch"), "cls")
        again = components(_similar(open_, "label")).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
        linked = labels.select(F.col("of").alias("node"), F.col("label").alias("root"))
        if not again.isEmpty():
            left = _blocked(large.select("cls", "n").join(again, "cls"))
            pairs = left.select("cls", "cluster", F.explode(block_pairs(F.col("blocks"), F.xxhash64("cls"))).alias("p")).select("cls", "cluster", "p.i", "p.j")
            stars = linked.select(F.col("node").alias("a"), F.col("root").alias("b"))
            linked = components(stars.unionByName(_confirmed(full.join(pairs, "cls"), words, percent)))

    ids = linked.join(classes.select("cls", "first_id"), F.col("node") == F.col("cls")).select("cls", "root", "first_id")
    roots = ids.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named_ids = spread_join(ids.select("cls", "root"), roots, "root", F.col("cls"), ids.count()).drop("m")
    told = classes.select("cls", "first_id", "m").join(named_ids, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"), "m")
    shingled = signed.filter("n_shingles > 0").select("doc_id", "key", "n_shingles", "cls")
    out = spread_join(shingled, checkpointed(told), "cls", F.col("key"), shingled.count()).select("doc_id", "key", "n_shingles", "component_id", "root")
    return out.unionByName(signed.filter("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root")))
