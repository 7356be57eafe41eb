"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets, star edges.

A document's set holds its distinct word shingles. One hash function deals the shingles to BINS bins;
each bin keeps its smallest hash, and an empty bin copies the bin that a fixed random sequence of its
own reaches first (optimal densification). Bands of several bins make the bucket keys.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.components import connected_components
from tabsieve.llm.stages import tidy, written
from tabsieve.llm.words import groups, hash_windows, hash_words, lower_ascii, mix, signed, spans, utf8

BINS = 256
#: Probability at which a link of exactly the required similarity may share no bucket.
MISS = 1e-4
#: Buckets up to this size are completed pair by pair, larger ones in blocks of BLOCK documents.
SMALL_BUCKET, BLOCK = 64, 256
_TRIES = 4096
_DONORS = (mix(np.arange(BINS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
               + np.arange(_TRIES, dtype=np.uint64)[:, None] * np.uint64(0x85EBCA6B7F4A7C15)) % np.uint64(BINS)).astype(np.int64)


def _row_keys(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, shingle hash) of a group of documents."""
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(row)) - firsts[row]
    full = np.flatnonzero(pos + k <= counts[row])
    rows, values = row[full], hash_windows(hashes, k)[full] if len(full) else np.zeros(0, np.uint64)
    for r in np.flatnonzero((counts > 0) & (counts < k)):  # the whole short sequence is one shingle
        rows = np.append(rows, r)
        values = np.append(values, mix(hash_windows(hashes[firsts[r]:firsts[r] + counts[r]], int(counts[r]), 1)))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[fresh], values[fresh]


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(texts)
    for lo, hi in groups(offsets):
        part = lower_ascii(data[offsets[lo]:offsets[hi]])
        starts, ends, bounds = spans(part, offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi, *_row_keys(hash_words(part, starts, ends), bounds[:-1], np.diff(bounds), k)


def signatures(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n x BINS minima with all empty bins filled; rows without values stay zero."""
    out, full = np.zeros((n, BINS), dtype=np.uint64), np.zeros((n, BINS), dtype=bool)
    bins = ((values >> np.uint64(48)) * np.uint64(BINS) >> np.uint64(16)).astype(np.int64)
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1])
    out[rows[first], bins[first]], full[rows[first], bins[first]] = values[first], True
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    tried = 0
    while len(r):
        donor = _DONORS[tried % _TRIES, b] if tried < _TRIES else (b + tried) % BINS
        found = full[r, donor]
        out[r[found], b[found]] = out[r[found], donor[found]]
        r, b, tried = r[~found], b[~found], tried + 1
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, bins of a band): the longest bands that miss a link with probability MISS at most."""
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISS]
    rows = max(fits, default=1)
    return BINS // rows, rows


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[:, :bands * rows].reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out


def _sign(k: int, percent: int) -> Callable:
    shape = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, rows, values in _sets(batch.column(1), k):
                n = hi - lo
                sizes = np.bincount(rows, minlength=n)
                key = np.zeros((2, n), dtype=np.uint64)
                if len(rows):
                    np.add.at(key[0], rows, mix(values))
                    np.add.at(key[1], rows, mix(values ^ np.uint64(0xA0761D6478BD642F)))
                bands = _band_keys(signatures(rows, values, n), *shape)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(sizes.astype(np.int64)), pa.array(signed(key[0])), pa.array(signed(key[1])),
                     pa.FixedSizeListArray.from_arrays(pa.array(signed(bands.ravel())), shape[0]).cast(pa.list_(pa.int64()))],
                    names=["doc", "n", "k1", "k2", "bands"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("").view(pa.large_binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([press.compress(t.as_buffer()) for t in texts], pa.binary())], names=["doc", "packed"])


def _unpacked(k: int) -> Callable[[bytes], np.ndarray]:
    """From a packed text to its sorted shingle hashes, with the latest sets kept."""
    unpack, cache = zstandard.ZstdDecompressor(), OrderedDict()

    def one(packed: bytes) -> np.ndarray:
        have = cache.get(packed)
        if have is None:
            text = pa.array([unpack.decompress(packed)], pa.large_binary()).view(pa.large_string())
            have = np.concatenate([v for *_, v in _sets(text, k)])
            cache[packed] = have
            if len(cache) > 64:
                cache.popitem(last=False)
        return have
    return one


def _confirm(k: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _unpacked(k)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = one(a.as_py()), one(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
    return run


def _block(k: int, percent: int) -> Callable:
    """Links across components inside one block pair, one per pair of components: exact overlaps of all
    members by products of the shingle incidence matrix, a slice of shingles at a time."""
    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        docs, labels = table["doc"].to_numpy(), table["label"].to_numpy()
        _, at = np.unique(docs, return_index=True)
        docs, labels = docs[at], labels[at]
        texts = pa.array([unpack.decompress(p.as_py()) for p in table["packed"].take(pa.array(at))],
                         pa.large_binary()).view(pa.large_string())
        parts = [(rows + lo, values) for lo, _, rows, values in _sets(texts, k)]
        rows, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        sizes = np.bincount(rows, minlength=len(docs))
        _, token, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[token] > 1
        rows, token = rows[shared], np.unique(token[shared], return_inverse=True)[1]
        order = np.argsort(token, kind="stable")
        rows, token = rows[order], token[order]
        both, width = np.zeros((len(docs), len(docs)), dtype=np.float32), 8192
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            i, j = np.searchsorted(token, [lo, lo + width])
            some = np.zeros((len(docs), width), dtype=np.float32)
            some[rows[i:j], token[i:j] - lo] = 1
            both += some @ some.T
        link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        a, b = np.nonzero(link & (labels[:, None] < labels[None, :]))
        _, one = np.unique(np.stack([labels[a], labels[b]]), axis=1, return_index=True)
        return pa.table({"a": docs[a[one]], "b": docs[b[one]]})
    return run


def _similar_size(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets (ASCII
    lower case, words by ASCII blanks); component_id is the smallest key reachable over links.

    Equal sets are one class and only its smallest key goes on. In each bucket all members are tested
    against the smallest key (a star: as many pairs as members, never all pairs), the confirmed links
    give components, and buckets that still hold several components are completed: small ones pair by
    pair across components, large ones in blocks whose overlaps are counted by matrix products without
    emitting pairs. Every link is confirmed on the full sets. What the buckets miss is the MinHash
    error, at most MISS for a link of exactly `percent`.

    Null and empty texts have no shingles and are linked with nothing. Rows without a key are linked
    with nothing and have a null component; they are kept. Rows that repeat a key are one node. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    signed_docs = written(docs.mapInArrow(tidy(_sign(shingle, percent)), "doc long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    usable = signed_docs.filter(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = written(usable.groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands")), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc"), "n")
    stars = written(members.groupBy("bucket").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("size"))
                    .filter("size > 1"), "stars")
    met = written(members.join(stars, "bucket"), "met")  # only buckets of two documents or more
    links = _links(docs, met, shingle, percent)
    nodes = connected_components(links, "a", "b")
    named = classes.join(nodes, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    placed = signed_docs.join(written(named, "named"), ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return placed.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def _links(docs: DataFrame, met: DataFrame, shingle: int, percent: int) -> DataFrame:
    edges = written(met.filter(F.col("doc") != F.col("hub")).select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges
    wanted = met.select("doc").distinct()
    texts = written(docs.filter(F.col("doc").isNotNull()).mapInArrow(tidy(_pack), "doc long, packed binary")
                    .join(written(wanted, "wanted"), "doc", "left_semi").dropDuplicates(["doc"]), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        one = pairs.join(texts.withColumnRenamed("doc", "a").withColumnRenamed("packed", "pa"), "a")
        two = one.join(texts.withColumnRenamed("doc", "b").withColumnRenamed("packed", "pb"), "b")
        return written(two.select("a", "b", "pa", "pb").mapInArrow(tidy(_confirm(shingle, percent)), "a long, b long"), name)

    links = confirmed(edges, "links")
    labels = written(connected_components(links, "a", "b"), "labels")
    inside = written(
        met.join(labels, F.col("doc") == F.col("node"), "left")
        .select("bucket", "doc", "n", "size", F.coalesce("component", "doc").alias("label")), "inside")
    mixed = written(inside.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                    .filter("lo < hi").select("bucket"), "mixed")
    rest = written(inside.join(mixed, "bucket"), "rest")
    small = rest.filter(F.col("size") <= SMALL_BUCKET)
    left = small.select("bucket", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = small.select("bucket", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = (left.join(right, "bucket").filter((F.col("la") < F.col("lb")) & _similar_size(percent))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
             .join(edges, ["a", "b"], "left_anti"))
    links = links.union(confirmed(pairs, "more"))
    large = rest.filter(F.col("size") > SMALL_BUCKET)
    if large.isEmpty():
        return links
    slots = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), slots).cast("int")
    blocks = (large.select("bucket", "doc", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("other"))
              .select("bucket", "doc", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    found = (blocks.join(texts, "doc").groupBy("bucket", "i", "j")
             .applyInArrow(_block(shingle, percent), "a long, b long"))
    return links.union(written(found, "blocks"))


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest key (null last).

    Rows without shingles are linked with nothing and all stay. Where keys are null or repeated, a row's identity is a
    64-bit hash of key and text: every text of a repeated key is a node of its own, rows equal in key and text are
    one and the one with the smallest hash of its other columns stays. An empty table stays empty.
    """
    odd = df.groupBy(F.col(key).cast("bigint").alias("k")).count().filter("k IS NULL OR count > 1")
    if odd.isEmpty():
        gone = written(near_components(df, key, text, shingle, percent).filter(~F.col("kept"))
                       .select(F.col(key).alias("_gone")).distinct(), "gone")
        return df.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    taken = {c.lower() for c in df.columns}
    node = next(n for n in (f"_node_{k}" for k in range(len(taken) + 1)) if n not in taken)
    hashed = F.xxhash64(F.col(key).cast("bigint"), F.coalesce(F.col(text), F.lit("")), F.col(key).isNull())
    rows = df.withColumn(node, hashed)
    parts = near_components(rows.select(node, text), node, text, shingle, percent)
    first = F.struct(F.col("k").isNull(), "k", "n")
    keys = rows.select(F.col(node).alias("n"), F.col(key).cast("bigint").alias("k")).distinct()
    named = written(parts.select(F.col(node).alias("n"), "component_id").distinct().join(keys, "n"), "nodes")
    stays = named.groupBy("component_id").agg(F.min(first).alias("x")).select(F.col("x.n").alias("n"))
    gone = written(named.select("n").join(stays, "n", "left_anti"), "gone")
    left = rows.join(gone, F.col(node) == F.col("n"), "left_anti")
    again = written(left.groupBy(node).count().filter("count > 1").select(F.col(node).alias("n")), "again")
    one = left.join(again, F.col(node) == F.col("n"), "left_semi").groupBy(node).agg(
        F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("row")).select("row.*")
    return left.join(again, F.col(node) == F.col("n"), "left_anti").select(df.columns).unionAll(one)
