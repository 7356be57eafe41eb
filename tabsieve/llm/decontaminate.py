"""Benchmark passages in training documents, found through a distributed positional inverted index.

Documents are indexed in segments of a few megabytes. A row of the index is the posting list of one term in
one segment: the ascending word numbers (counted through the segment) at which the term stands. A segment
holds whole documents, so a phrase is found inside one segment and posting lists of a common term are
spread over all of them. The index is a plain table; queries read the terms that they ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.packed import ranges, strings, unvarints, varints
from tabsieve.llm.stages import written
from tabsieve.llm.words import groups, hash_words, lower_ascii, spans, utf8

WINDOW = 10
#: Places by which a word may be off in a proximity match.
SLOP = 1
#: Bytes of text of a segment (more only for one longer document).
SEGMENT = 8 << 20
#: Words of benchmark items that one pass over the index looks for.
BLOCK = 500_000
#: Words of a piece of an item; longer items are looked for in overlapping pieces.
PIECE = 4096
#: Places of phrases in documents that are intersected at a time.
_CHUNK = 1 << 19

# Words are runs of digits, letters and bytes above 127.
GAP = np.ones(256, dtype=bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_INDEX = "segment long, term string, n long, postings binary"


def _index(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in groups(offsets, size):
                part = lower_ascii(data[offsets[lo]:offsets[hi]])
                starts, ends, bounds = spans(part, offsets[lo:hi + 1] - offsets[lo], GAP)
                keys = batch.column(0).slice(lo, hi - lo)
                listing = np.stack([keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False),
                                    np.diff(bounds)]).astype("<i8")
                hashes = hash_words(part, starts, ends)
                order = np.argsort(hashes, kind="stable")
                new = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order][:1]) != 0)
                cuts = np.append(new, len(order))
                first = order[new]
                terms = pa.concat_arrays([pa.nulls(1, pa.large_string()), strings(part, starts[first], ends[first])])
                lists = pa.concat_arrays([pa.array([listing.tobytes()], pa.large_binary()), varints(order, cuts)])
                sizes = np.concatenate([[hi - lo], np.diff(cuts)])
                for at in range(0, len(terms), 50_000):
                    n = min(50_000, len(terms) - at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, segment)), terms.slice(at, n).cast(pa.string()), pa.array(sizes[at:at + n]),
                         lists.slice(at, n).cast(pa.binary())], names=["segment", "term", "n", "postings"])
                segment += 1
    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional inverted index of all words of all documents, as a written table.

    Columns: segment, term (A-Z lower-cased; null for the segment's list of documents), n (postings, or
    documents) and postings. Every row of `docs` is listed, whatever its key: null and repeated keys are
    documents of their own, null and empty texts have no words. Other columns are ignored. Terms of a segment
    are grouped by 64-bit hashes: two of a segment's n distinct terms are mixed up with a chance of n^2 / 2^65.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return written(rows.mapInArrow(_index(SEGMENT), _INDEX), "index")


def _listing(raw: bytes) -> np.ndarray:
    """Keys, flags of known keys and numbers of words of a segment's documents."""
    return np.frombuffer(raw, dtype="<i8").reshape(3, -1)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys, known, sizes = _listing(raw.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), segment)), pa.array(np.arange(len(keys))),
                 pa.array(keys, mask=known == 0), pa.array(sizes)], names=["segment", "place", "key", "n_words"])


def indexed_documents(index: DataFrame) -> DataFrame:
    """segment, place (row in the segment), key and n_words of every indexed document."""
    return index.filter("term IS NULL").select("segment", "postings").mapInArrow(
        _listed, "segment long, place long, key long, n_words long")


def _pieces(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            data = lower_ascii(data)
            starts, ends, bounds = spans(data, offsets, GAP)
            words = strings(data, starts, ends).cast(pa.string())
            rows = []
            for item, lo, hi in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                for at in range(lo, max(hi - window + 1, lo + (hi > lo)), PIECE):
                    rows.append((item, int(at - lo), words.slice(at, min(PIECE + window - 1, hi - at)).to_pylist()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["item", "first", "words"])
    return run


class _Plan:
    """Items of one block as codes of terms, one after the other."""

    def __init__(self, items: list[str], words: pa.ListArray) -> None:
        self.items = items
        coded = words.values.dictionary_encode()
        self.terms: list[str] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.bounds = words.offsets.to_numpy().astype(np.int64)
        self.item = np.repeat(np.arange(len(items)), np.diff(self.bounds))

    def rarest(self, counts: np.ndarray, window: int) -> np.ndarray:
        """For every window its place with the shortest posting list, without windows of a missing term."""
        cost = counts[self.codes]
        sizes = np.diff(self.bounds)
        found = []
        if len(cost) >= window:
            low = np.argmin(np.lib.stride_tricks.sliding_window_view(cost, window), axis=1) + np.arange(len(cost) - window + 1)
            inside = self.item[:len(low)] == self.item[window - 1:]
            found.append(low[inside])
        short = np.flatnonzero((sizes < window)[self.item])
        if len(short):
            order = short[np.lexsort((cost[short], self.item[short]))]
            found.append(order[np.diff(self.item[order], prepend=-1) != 0])
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return at[cost[at] > 0]


def _runs(plan: _Plan, keys: np.ndarray, edges: np.ndarray, at: np.ndarray, pos: np.ndarray, shift: int, window: int,
          slop: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and behind each candidate (item place `at`, word `pos`, laid `shift` words further)
    stand at their places, at most `slop` off: posting lists, shifted by the words' distance, are intersected outwards."""
    doc = np.searchsorted(edges, pos, side="right")
    low, high = edges[doc - 1], edges[doc] - 1
    item = plan.item[at]
    out = []
    for sign, limit in ((-1, plan.bounds[item]), (1, plan.bounds[item + 1] - 1)):
        run = np.zeros(len(at), dtype=np.int64)
        alive = np.arange(len(at))
        for step in range(1, window):
            alive = alive[sign * (limit[alive] - at[alive]) >= step]
            if not len(alive):
                break
            code = plan.codes[at[alive] + sign * step] << 32
            place = pos[alive] + shift + sign * step
            lo, hi = np.maximum(place - slop, low[alive]), np.minimum(place + slop, high[alive])
            found = np.searchsorted(keys, code | lo)
            ok = lo <= hi
            ok &= keys[np.minimum(found, len(keys) - 1)] <= (code | np.maximum(hi, 0))
            ok &= found < len(keys)
            alive = alive[ok]
            run[alive] = step
        out.append(run)
    return out[0], out[1]


def _match(shared: object, window: int, slops: tuple[int, ...]) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        plan: _Plan = shared.value
        code = table["code"].to_numpy()
        order = np.argsort(code, kind="stable")
        rows = table.take(pa.array(order)).combine_chunks()
        code, sizes = code[order], rows["n"].to_numpy()
        lists = rows["postings"].combine_chunks().cast(pa.large_binary())
        keys_, known, words = _listing(lists[0].as_py())  # code -1: the documents
        edges = np.concatenate([[0], np.cumsum(words)])
        offsets = np.frombuffer(lists.buffers()[1], dtype=np.int64)
        body = np.frombuffer(lists.buffers()[2], dtype=np.uint8)[offsets[1]:offsets[-1]] if len(lists) > 1 else np.zeros(0, np.uint8)
        keys = np.repeat(code[1:], sizes[1:]) << 32 | unvarints(body, sizes[1:])
        counts = np.zeros(len(plan.terms), dtype=np.int64)
        counts[code[1:]] = sizes[1:]
        begins = np.cumsum(counts) - counts
        chosen = plan.rarest(counts, window)
        cost = counts[plan.codes[chosen]]
        least = np.minimum(np.diff(plan.bounds), window)
        out = []
        cut = 0
        while cut < len(chosen):
            end = max(cut + 1, int(np.searchsorted(np.cumsum(cost[cut:]), _CHUNK, side="right")) + cut)
            at = np.repeat(chosen[cut:end], cost[cut:end])
            pos = keys[ranges(begins[plan.codes[chosen[cut:end]]], cost[cut:end])] & 0xFFFFFFFF
            for slop, shift in [(s, d) for s in slops for d in range(-s, s + 1)]:
                before, behind = _runs(plan, keys, edges, at, pos, shift, window, slop)
                hit = np.flatnonzero(before + behind + 1 >= least[plan.item[at]])
                if len(hit):
                    doc = np.searchsorted(edges, pos[hit], side="right") - 1
                    out.append(np.stack([doc, plan.item[at[hit]], pos[hit] + shift - before[hit] - edges[doc],
                                         (before + behind + 1)[hit], np.full(len(hit), slop)]))
            cut = end
        doc, item, first, many, slop = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((5, 0), np.int64)
        segment = table["segment"][0].as_py()
        return pa.table({
            "segment": np.full(len(doc), segment), "place": doc, "key": pa.array(keys_[doc], mask=known[doc] == 0),
            "item": pa.array(plan.items, pa.string()).take(pa.array(item)), "first": first, "words": many, "slop": slop})
    return run


_MATCH = "segment long, place long, key long, item string, first long, words long, slop long"


def matches(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW,
            slops: tuple[int, ...] = (0,)) -> DataFrame:
    """Runs of an item's words in documents: segment, place and key of the document, item (the item's id as a
    string), first (word of the document from 0), words (length of the run) and slop.

    A run has at least `window` words, or all words of an item that has fewer. With slop 0 these are exact
    phrases: every window of the item that occurs in a document lies in a run, and every run of at most
    2 * window - 1 words around its rarest word is listed, so longer passages give overlapping runs. With a
    greater slop these are proximity matches: for some place of the run in the document (`first`, which may be
    negative) every word stands at most `slop` words from where it would be.

    Per segment and window the search begins at the term with the shortest posting list and intersects it with
    the lists of the other terms, shifted by their distance. Items go through in blocks of BLOCK words; only the
    block's words travel, whatever the size of the table. Items without words, with a null id or text match
    nothing; rows that repeat an id count as further windows of that item. Empty tables give an empty result.
    """
    spark = index.sparkSession
    rows = items.select(F.col(key).cast("string").alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL")
    pieces = written(rows.mapInArrow(_pieces(window), "item string, first long, words array<string>"), "items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // BLOCK)
    parts = []
    for block in range(n_blocks):
        some = pieces.filter(F.pmod(F.xxhash64("item", "first"), F.lit(n_blocks)) == block).select("item", "words").toArrow()
        some = some.combine_chunks()
        if not some.num_rows:
            continue
        plan = _Plan(some["item"].to_pylist(), some["words"].combine_chunks())
        terms = spark.createDataFrame([(None, -1), *zip(plan.terms, range(len(plan.terms)), strict=True)], "t string, code long")
        wanted = index.join(F.broadcast(terms), F.col("term").eqNullSafe(F.col("t"))).select("segment", "code", "n", "postings")
        shared = spark.sparkContext.broadcast(plan)
        parts.append(wanted.groupBy("segment").applyInArrow(_match(shared, window, slops), _MATCH))
    if not parts:
        return spark.createDataFrame([], _MATCH)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per document: key, n_words, n_hit (words inside an occurrence of a window of an item), n_items
    and items_sha256 (items with occurring windows; their ids as strings, sorted, comma-joined) and contaminated
    (n_hit > 0). With a slop (SLOP is a good choice) also n_near_items: items that only a proximity match finds.

    Odd input is treated as in `build_index` and `matches`: every row of `docs` gives one row, nulls have no words,
    no match gives 0 hits and the digest of the empty string.
    """
    index = build_index(docs, key, text)
    runs = matches(index, items, item_key, item_text, window, (0, slop) if slop else (0,))
    exact = F.col("slop") == 0
    per = runs.groupBy("segment", "place").agg(
        F.array_sort(F.collect_set(F.when(exact, F.struct("first", "words")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(exact, F.col("item")))).alias("hit"), F.collect_set("item").alias("near"))
    reach = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["first"] + x["words"] - F.greatest(x["first"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["first"] + x["words"]).alias("end")))
    found = per.select("segment", "place", reach["n"].alias("n_hit"), "hit", F.size(F.array_except("near", "hit")).alias("near"))
    none = F.array().cast("array<string>")
    return indexed_documents(index).join(found, ["segment", "place"], "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("hit", none)).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("hit", none)), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near_items")] if slop else []))
