"""Repeated passages: difference-cover anchors find them, whole windows around the anchors decide.

Positions in a document count from 0. An anchor is a run of ANCHOR words that starts at a position
whose remainder modulo PERIOD is in COVER. COVER is a difference cover: for any two positions i and j
some shift below PERIOD brings both onto it. So two equal windows of WINDOW = PERIOD + ANCHOR - 1 words
share an anchor whatever their positions are, and a window without a shared anchor needs no look.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.stages import written
from tabsieve.llm.words import groups, hash_windows, hash_words, signed, spans, utf8

# A perfect difference set modulo 31.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
WINDOW = 50

Emit = Callable[[list[bytes], np.ndarray], tuple]


def kept_words(words: list[bytes], keep: np.ndarray) -> tuple:
    """The words that stay, joined by one space."""
    return (b" ".join([w for w, k in zip(words, keep, strict=True) if k]).decode(errors="replace"),)


def kept_digest(words: list[bytes], keep: np.ndarray) -> tuple:
    return (hashlib.sha256(b" ".join([w for w, k in zip(words, keep, strict=True) if k])).hexdigest(),)


def _hashed(batch: pa.RecordBatch, least: int, whole: bool = False) -> Iterator[tuple]:
    """(ids, first words of the rows, their numbers of words, all words' hashes) by groups of rows."""
    data, offsets = utf8(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for lo, hi in [(0, len(ids))] if whole else groups(offsets):
        part, local = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, bounds = spans(part, local)
        if len(starts) >= least:
            yield ids[lo:hi], bounds[:-1], np.diff(bounds), hash_words(part, starts, ends)


def _within(firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word: its row, its position in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - firsts[row]


def _anchors(window: int) -> Callable:
    anchor = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, firsts, counts, hashes in _hashed(batch, window):
                row, pos = _within(firsts, counts)
                at = np.flatnonzero(cover[pos % PERIOD] & (pos + anchor <= counts[row]) & (counts[row] >= window))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(hash_windows(hashes, anchor)[at])), pa.array(ids[row[at]]),
                         pa.array(pos[at].astype(np.int32))], names=["anchor", "doc", "pos"])
    return run


def _windows(window: int) -> Callable:
    """All windows that hold a shared anchor; `later` where some anchor also starts in a smaller document."""
    reach = PERIOD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _rows(batch):
                ids, texts, hits, later = part
                for _, firsts, counts, hashes in _hashed(
                        pa.RecordBatch.from_arrays([pa.array(ids), texts], names=["doc", "text"]), window, whole=True):
                    total = len(hashes)
                    marks = np.zeros((2, total + 1), dtype=np.int32)
                    for r, (pos, late) in enumerate(zip(hits, later, strict=True)):
                        lo = firsts[r] + np.maximum(pos - reach, 0)
                        hi = firsts[r] + np.minimum(pos, counts[r] - window) + 1
                        ok = hi > lo
                        np.add.at(marks[0], lo[ok], 1)
                        np.add.at(marks[0], hi[ok], -1)
                        ok &= late
                        np.add.at(marks[1], lo[ok], 1)
                        np.add.at(marks[1], hi[ok], -1)
                    covered = np.cumsum(marks, axis=1)[:, :total] > 0
                    at = np.flatnonzero(covered[0])
                    row, pos = _within(firsts, counts)
                    for cut in range(0, len(at), 1 << 18):
                        some = at[cut:cut + (1 << 18)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(signed(hash_windows(hashes, window, 1)[some])),
                             pa.array(hash_windows(hashes, window, 2)[some].astype(np.uint32).view(np.int32)),
                             pa.array(ids[row[some]]), pa.array(pos[some].astype(np.int32)),
                             pa.array(covered[1][some])], names=["head", "tail", "doc", "pos", "later"])
    return run


def _rows(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[tuple]:
    """Unpacked rows in groups of about `limit` bytes: ids, texts, hit positions, hit flags."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    packed, hits = batch.column(1), batch.column(2)
    out: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    unpack = zstandard.ZstdDecompressor()
    for i in range(batch.num_rows):
        text = unpack.decompress(packed[i].as_py())
        code = hits[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
        out[0].append(ids[i])
        out[1].append(text)
        out[2].append(code >> 1)
        out[3].append((code & 1) == 1)
        size += len(text)
        if size >= limit or i == batch.num_rows - 1:
            yield np.array(out[0], dtype=np.int64), pa.array(out[1], pa.binary()).cast(pa.large_binary()).view(
                pa.large_string()), out[2], out[3]
            out, size = ([], [], [], []), 0


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).view(pa.large_binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([press.compress(t.as_buffer()) for t in texts], pa.binary())], names=["doc", "packed"])


def _whole(emit: Emit, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("").view(pa.large_binary())
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = text.as_py().split()
                rows.append((doc, len(words), 0, *emit(words, np.ones(len(words), dtype=bool))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def _cut(emit: Emit, window: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, packed, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = unpack.decompress(packed.as_py()).split()
                step = np.zeros(len(words) + 1, dtype=np.int32)
                at = np.unique(places.values.to_numpy(zero_copy_only=False))
                at = at[at + window <= len(words)]
                step[at] += 1
                step[at + window] -= 1
                keep = np.cumsum(step)[:-1] == 0
                rows.append((doc, len(words), int((~keep).sum()), *emit(words, keep)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   emit: Emit = kept_words, emitted: str = "kept_text string") -> DataFrame:
    """One row per document: key, n_words, n_removed and what `emit` makes of the words that stay.

    A word goes if it lies in a window (`window` consecutive words of one document) whose words also
    start, in the same order, in a document with a smaller key. Windows are judged on the input.
    `emit(words, keep)` returns the columns declared in `emitted`; by default the text that stays.

    Steps: anchors of all documents are counted by hash (map-side minimum and maximum of the key);
    anchors found in two documents mark the windows around them; only these windows are hashed whole
    (96 bits) and compared by the smallest key that has them. Only documents with a shared anchor have
    their text moved again. No pairs are formed, so a passage in n documents costs n rows.

    Null and empty texts have no words: n_words 0, n_removed 0. Rows without a key neither remove nor
    lose words. Rows that repeat a key count as one document: neither removes words of the other, and
    both lose the positions found in either. Other columns are ignored; an empty table stays empty.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be above {PERIOD}")
    spark = df.sparkSession
    fields = [f.split() for f in emitted.split(",")]
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        *[(n, _ARROW[t]) for n, t in fields]])
    ddl = f"doc long, n_words long, n_removed long, {emitted}"
    docs = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    known = docs.filter(F.col("doc").isNotNull() & (F.length("text") >= 2 * window - 1))
    anchors = known.mapInArrow(_anchors(window), "anchor long, doc long, pos int")
    shared = written(
        anchors.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        .filter("lo < hi").select("anchor", "lo"), "anchors")
    code = F.col("pos") * 2 + (F.col("doc") > F.col("lo")).cast("int")
    hits = written(
        anchors.join(shared, "anchor").groupBy("doc").agg(F.collect_list(code).alias("hits")), "hits")
    packed = known.mapInArrow(_pack, "doc long, packed binary")
    texts = written(packed.join(hits, "doc").select("doc", "packed", "hits"), "texts")
    windows = texts.mapInArrow(_windows(window), "head long, tail int, doc long, pos int, later boolean")
    first = written(
        windows.groupBy("head", "tail").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        .filter("lo < hi").select("head", "tail", "lo"), "windows")
    places = (
        windows.filter("later").select("head", "tail", "doc", "pos").join(first, ["head", "tail"])
        .filter(F.col("doc") > F.col("lo")).groupBy("doc").agg(F.collect_list("pos").alias("places")))
    cut = written(texts.select("doc", "packed").join(written(places, "places"), "doc").select("doc", "packed", "places")
                  .mapInArrow(_cut(emit, window, schema), ddl), "cut")
    whole = docs.mapInArrow(_whole(emit, schema), ddl)
    out = whole.alias("w").join(cut.alias("c"), "doc", "left")
    pick = [F.when(F.col("c.n_words").isNotNull(), F.col(f"c.{n}")).otherwise(F.col(f"w.{n}")).alias(n)
            for n in ("n_removed", *[n for n, _ in fields])]
    return out.select(F.col("doc").alias(key), F.col("w.n_words").alias("n_words"), *pick)
