"""Alignment of two tokenizers, with corpus-wide counts of linked token pairs by external spill counting.

Every document is encoded by a byte-level BPE (side A) and a sentence-piece model (side B). Tokens are byte
ranges of the same text, so an A token and a B token are linked where their ranges overlap. Map tasks buffer
the records (B id, A id, document, times) of a few megabytes of text, radix-partition them by the B id and spill
each part as a run: sorted, B first, compressed. Counting merges the runs of a part with a k-way heap. As the
order is B first, all pairs of a B id pass one after the other and its highest count is known when it ends.
The counts then go back over the same runs, whose records add them up for every document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.packed import pack, unpack
from tabsieve.llm.stages import written

#: Parts by B id; the pairs of one part, counted, must fit into a task.
PARTS = 16
#: Bytes of text and documents whose records are spilled as one set of runs.
SPILL_BYTES, SPILL_DOCS = 8 << 20, 60_000
#: Bytes of text that the tokenizers get at a time; longer texts are cut for side A where no token can cross.
PORTION = 1 << 19
#: Runs merged by one task.
FAN = 64

_ID = 20
_RUN = "pairs binary, totals binary"
_ENCODED = ("run long, place long, key long, n_a long, n_b long, n_groups long, n_links long, groups string, "
            f"part int, {_RUN}, many binary, docs binary, times binary")
_NAMES = [f.split()[0] for f in _ENCODED.split(", ")]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Aligner:
    """Both tokenizers of one worker, with the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # Byte-level vocabularies write the bytes that do not print as the characters from 256 on.
        print_ = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in print_]
        char = {chr(x): x for x in print_} | {chr(256 + i): x for i, x in enumerate(rest)}
        added = {t["id"]: t["content"] for t in json.loads(a_json)["added_tokens"]}
        size_a = self.a.get_vocab_size()
        bytes_a = [added[i].encode() if i in added else bytes(map(char.__getitem__, self.a.id_to_token(i) or ""))
                   for i in range(size_a)]
        size_b = self.b.get_piece_size()
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                   else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size_b)]
        if max(size_a, size_b) > 1 << _ID:
            raise ValueError(f"vocabularies of at most {1 << _ID} ids")
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.len_a = np.array([len(x) for x in bytes_a])
        self.len_b = np.array([len(x) for x in bytes_b])
        self.size_a, self.size_b = size_a, size_b
        # Decimal ids with what follows them: inside a side, at the end of the A side, at the end of the group.
        self.written = pa.array(
            [f"{i}{c}".encode() for n, c in ((size_a, ","), (size_a, "|"), (size_b, ","), (size_b, ";")) for i in range(n)],
            pa.large_binary())

    def _cut(self, text: str) -> list[str]:
        """Parts of the text that side A encodes independently: a cut lies between a letter and a space with a
        letter behind it, which no match of the pattern crosses."""
        out, start = [], 0
        while len(text) - start > PORTION:
            at = text.find(" ", start + PORTION // 2)
            while at > 0 and not (text[at - 1].isalpha() and text[at + 1:at + 2].isalpha()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            out.append(text[start:at])
            start = at
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, one text after the other, and the numbers of ids per text; 0 where the joined
        tokens of a side are not the space and the text."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            for part in self._cut(" " + t):
                parts.append(part)
                owner.append(i)
        found = self.a.encode_batch_fast(parts, add_special_tokens=False)
        a = np.concatenate([np.array(e.ids, dtype=np.int64) for e in found]) if found else np.zeros(0, np.int64)
        n_a = np.bincount(owner, weights=[len(e) for e in found], minlength=len(texts)).astype(np.int64)
        lists = self.b.encode(texts, out_type=int, num_threads=1)
        b = np.concatenate([np.array(x, dtype=np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        n_b = np.array([len(x) for x in lists], dtype=np.int64)
        raw = [b" " + t.encode() for t in texts]
        right = _equal(raw, a, n_a, self.len_a, self.bytes_a) & _equal(raw, b, n_b, self.len_b, self.bytes_b)
        return a[np.repeat(right, n_a)], np.where(right, n_a, 0), b[np.repeat(right, n_b)], np.where(right, n_b, 0)

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> dict[str, Any]:
        """Groups and links of texts whose ids lie one after the other: `groups` as text with its offsets,
        n_groups per text, and the text, A id and B id of every link."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        total = int(ends_a[-1]) if len(a) else 0
        mark_a, mark_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        mark_a[ends_a] = mark_b[ends_b] = True
        common, edges = np.flatnonzero(mark_a & mark_b), np.flatnonzero(mark_a | mark_b)
        doc_ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + self.size_a * mark_b[ends_a]
        codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = (
            2 * self.size_a + b + self.size_b * mark_a[ends_b])
        shown = self.written.take(pa.array(codes))
        offsets = np.frombuffer(shown.buffers()[1], dtype=np.int64)[:len(codes) + 1]
        cuts = offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        return {
            "groups": memoryview(shown.buffers()[2]) if len(codes) else memoryview(b""), "cuts": cuts,
            "n_groups": np.diff(np.searchsorted(common, np.concatenate([[0], doc_ends]), side="right")),
            "doc": np.searchsorted(doc_ends, edges), "a": a[np.searchsorted(ends_a, edges)], "b": b[np.searchsorted(ends_b, edges)]}


def _equal(raw: list[bytes], ids: np.ndarray, counts: np.ndarray, lens: np.ndarray, table: pa.Array) -> np.ndarray:
    """Which texts the joined tokens spell."""
    if not len(ids):
        return np.zeros(len(raw), dtype=bool)
    bounds = np.concatenate([[0], np.cumsum(lens[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    joined = memoryview(table.take(pa.array(ids)).buffers()[2]).cast("B")
    return np.array([joined[lo:hi] == r for r, lo, hi in zip(raw, bounds[:-1], bounds[1:], strict=True)], dtype=bool)


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(shared: Any) -> Aligner:
    name = hash(shared.value)
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(*shared.value)
    return _ALIGNERS[name]


def group_digest(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest()


def group_text(groups: bytes) -> str:
    return bytes(groups).decode()


class _Spill:
    """Documents and records of one set of runs."""

    def __init__(self, run: int) -> None:
        self.run, self.rows, self.links, self.size = run, [], [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows = [[self.run, i, *r] + [None] * 6 for i, r in enumerate(self.rows)]
        keys = np.sort(np.concatenate(self.links)) if self.links else np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
        times = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        part = (keys >> 2 * _ID) % PARTS
        for p in range(PARTS):
            some = part == p
            if some.any():
                pairs, docs, n = keys[some] >> _ID, keys[some] & (1 << _ID) - 1, times[some]
                new = np.flatnonzero(np.diff(pairs, prepend=-1) != 0)
                rows.append([self.run, *[None] * 7, p, pack(pairs[new], True), pack(np.add.reduceat(n, new)),
                             pack(np.diff(np.append(new, len(pairs)))), pack(docs), pack(n)])
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
        columns = [pa.array([r[i] for r in rows], kinds[f.split()[1]]) for i, f in enumerate(_ENCODED.split(", "))]
        whole = pa.RecordBatch.from_arrays(columns, names=_NAMES)
        for at in range(0, len(rows), 10_000):
            yield whole.slice(at, 10_000)


def _encode(shared: Any, show: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _aligner(shared)
        spill = _Spill(TaskContext.get().partitionId() << 32)
        keys: list = []
        texts: list[str] = []

        def work() -> None:
            at = [i for i, t in enumerate(texts) if t]
            a, n_a, b, n_b = both.encode([texts[i] for i in at])
            found = both.align(a, n_a, b, n_b)
            base = len(spill.rows)
            links = np.bincount(found["doc"], minlength=len(at))
            rows = [[k, 0, 0, 0, 0, ""] for k in keys]
            for j, i in enumerate(at):
                if n_a[j]:
                    lo, hi = found["cuts"][j], found["cuts"][j + 1]
                    rows[i][1:] = [int(n_a[j]), int(n_b[j]), int(found["n_groups"][j]), int(links[j]),
                                   show(found["groups"][lo:hi - 1])]
            spill.rows += rows
            place = base + np.array(at, dtype=np.int64)[found["doc"]] if at else np.zeros(0, np.int64)
            spill.links.append((found["b"] << 2 * _ID) | (found["a"] << _ID) | place)
            spill.size += sum(map(len, texts))
            keys.clear()
            texts.clear()

        for batch in batches:
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= PORTION:
                    work()
                    size = 0
                    if spill.size >= SPILL_BYTES or len(spill.rows) >= SPILL_DOCS:
                        yield from spill.batches()
                        spill = _Spill(spill.run + 1)
            work()
            if spill.size >= SPILL_BYTES or len(spill.rows) >= SPILL_DOCS:
                yield from spill.batches()
                spill = _Spill(spill.run + 1)
        yield from spill.batches()
    return run


def _merge(table: pa.Table) -> pa.Table:
    """One run out of many: a heap over their smallest pairs adds up the counts, B id by B id; `best` marks the
    pairs with the highest count of their B id."""
    runs = [zip(unpack(p.as_py(), True).tolist(), unpack(t.as_py()).tolist(), strict=True)
            for p, t in zip(table["pairs"], table["totals"], strict=True)]
    pairs: list[int] = []
    totals: list[int] = []
    best: list[bool] = []
    for _, same in groupby(heapq.merge(*runs), key=lambda x: x[0] >> _ID):
        start, now = len(pairs), -1
        for pair, n in same:
            if pair == now:
                totals[-1] += n
            else:
                pairs.append(pair)
                totals.append(n)
                now = pair
        top = max(totals[start:])
        best += [n == top for n in totals[start:]]
    return pa.table({
        "part": pa.array([table["part"][0].as_py()], pa.int32()), "salt": pa.array([table["salt"][0].as_py()], pa.int64()),
        "pairs": [pack(np.array(pairs), True)], "totals": [pack(np.array(totals))], "best": [pack(np.array(best))]})


def _give_back(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """For every run the counts of its documents' links: how many are the best of their B id, and the sum."""
    pairs = unpack(counts["pairs"][0].as_py(), True)
    totals = unpack(counts["totals"][0].as_py()).astype(np.int64)
    best = unpack(counts["best"][0].as_py()).astype(np.int64)
    rows = []
    for run, p, many, docs, times in zip(*[runs[c] for c in ("run", "pairs", "many", "docs", "times")], strict=True):
        at = np.repeat(np.searchsorted(pairs, unpack(p.as_py(), True)), unpack(many.as_py()).astype(np.int64))
        docs, times = unpack(docs.as_py()).astype(np.int64), unpack(times.as_py()).astype(np.int64)
        n_best, total = np.zeros(docs.max() + 1, dtype=np.int64), np.zeros(docs.max() + 1, dtype=np.int64)
        np.add.at(n_best, docs, times * best[at])
        np.add.at(total, docs, times * totals[at])
        rows.append((run.as_py(), pack(n_best), pack(total)))
    return pa.table({"run": pa.array([r[0] for r in rows], pa.int64()), "n_best": pa.array([r[1] for r in rows], pa.binary()),
                     "count_sum": pa.array([r[2] for r in rows], pa.binary())})


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _finish(docs: pa.Table, given: pa.Table) -> pa.Table:
    place = docs["place"].to_numpy()
    n = int(place.max()) + 1 if len(place) else 0
    sums = np.zeros((2, n), dtype=np.int64)
    for best, total in zip(given["n_best"], given["count_sum"], strict=True):
        for i, raw in enumerate((best, total)):
            values = unpack(raw.as_py()).astype(np.int64)
            sums[i, :len(values)] += values
    return pa.table({"key": docs["key"], **{c: docs[c] for c in _SUMS}, "n_best": sums[0][place], "count_sum": sums[1][place],
                     "groups": docs["groups"]})


def spilled(df: DataFrame, a_json: bytes, b_model: bytes, key: str = "doc_id", text: str = "text",
            show: Callable = group_text) -> DataFrame:
    """The written table of encoded documents (rows without `part`) and of runs (rows with it)."""
    shared = df.sparkSession.sparkContext.broadcast((a_json, b_model))  # as large as the vocabulary files
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return written(rows.mapInArrow(_encode(shared, show), _ENCODED), "encoded")


def pair_counts(runs: DataFrame) -> DataFrame:
    """part, pairs, totals and best of every part of the runs: all linked pairs of the corpus, counted, as packed
    lists. Runs are merged FAN at a time, level by level, so no task reads more than FAN of them."""
    width = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    merged = runs.select("part", F.col("run").alias("salt"), "pairs", "totals")
    while True:
        salts = max(1, -(-width // FAN))
        merged = merged.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(salts)).cast("bigint")).groupBy("part", "salt")
        merged = written(merged.applyInArrow(_merge, f"part int, salt long, {_RUN}, best binary"), "counts")
        if salts == 1:
            return merged.drop("salt")
        width = salts
        merged = merged.drop("best")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, t, b in zip(*batch.columns, strict=True):
            pairs = unpack(p.as_py(), True).astype(np.int64)
            for at in range(0, len(pairs), 100_000):
                some = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[some] & (1 << _ID) - 1), pa.array(pairs[some] >> _ID),
                     pa.array(unpack(t.as_py())[some].astype(np.int64)), pa.array(unpack(b.as_py())[some] > 0)],
                    names=["a", "b", "n", "best"])


def linked_pairs(counts: DataFrame) -> DataFrame:
    """a, b, n (links of this pair of ids in the corpus) and best (n is the highest of b) from `pair_counts`."""
    return counts.select("pairs", "totals", "best").mapInArrow(_listed, "a long, b long, n long, best boolean")


def align(df: DataFrame, a_json: bytes, b_model: bytes, key: str = "doc_id", text: str = "text", show: Callable = group_text,
          shown: str = "groups") -> DataFrame:
    """One row per document: key, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair has the
    highest count of its B id in the corpus, ties included), count_sum (the counts of all links) and what `show`
    makes of the aligned groups, by default their text `a1,a2|b1;a3|b2,b3`.

    Side A encodes the text with a space before it, side B adds that space itself. Null and empty texts and texts
    that the joined tokens of a side do not spell have no tokens: zeros and an empty string. Null and repeated keys
    are rows of their own. Other columns are ignored; an empty table gives an empty result.

    A B id may have any share of the records: its part is split over the runs, counted within FAN runs at a time and
    read back in the same portions; only the distinct pairs of a part (not their records) meet in one task.
    """
    table = spilled(df, a_json, b_model, key, text, show)
    runs = table.filter("part IS NOT NULL")
    counts = pair_counts(runs.select("part", "run", "pairs", "totals"))
    width = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-width // FAN))
    salted = runs.select("part", F.pmod(F.xxhash64("run"), F.lit(salts)).alias("salt"), "run", "pairs", "many", "docs", "times")
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    given = salted.groupBy("part", "salt").cogroup(copies.select("part", "salt", "pairs", "totals", "best").groupBy("part", "salt"))
    back = given.applyInArrow(_give_back, "run long, n_best binary, count_sum binary")
    docs = table.filter("part IS NULL").select("run", "place", "key", *_SUMS, "groups")
    out = docs.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(
        _finish, "key long, " + "".join(f"{c} long, " for c in _SUMS) + "n_best long, count_sum long, groups string")
    return out.withColumnsRenamed({"key": key, "groups": shown})
