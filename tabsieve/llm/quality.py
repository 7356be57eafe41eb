"""Quality rules as a short-circuit cascade: rules run in the order of rejections per second of cost,
both estimated on a sample, and each rule looks only at documents that no earlier rule rejected."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.packed import ranges
from tabsieve.llm.stages import tidy
from tabsieve.llm.words import SPACE, groups, hash_windows, hash_words, mix, spans, utf8

#: Documents on which cost and selectivity are estimated; the order of the rules changes no result.
SAMPLE_ROWS = 1000
REPEAT_WINDOW = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _LOWER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91], _LOWER[97:123] = True, True
_LETTER = _UPPER | _LOWER
_LETTER[128:] = True
_INNER = np.zeros(256, dtype=bool)
_INNER[0x80:0xC0] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Texts:
    """A group of documents with its base counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.starts, self.ends, bounds = spans(data, offsets)
        self.firsts, self.n_words = bounds[:-1], np.diff(bounds)
        self.hashes = hash_words(data, self.starts, self.ends)
        self.word_chars = _sums(~SPACE[data] & ~_INNER[data], offsets)
        self.n_symbols = _sums(_SYMBOL[data], offsets)
        self.n_lines, self.n_dup_lines = self._lines()
        self.n_repeat_words = self._repeats()
        self.base_failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.n_words)
        lines, copies, raw = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), self.data.tobytes()
        for i in np.flatnonzero(self.n_words):
            worded = [x for x in raw[self.offsets[i]:self.offsets[i + 1]].split(b"\n") if x and not x.isspace()]
            lines[i] = len(worded)
            copies[i] = len(worded) - len(set(worded))
        return lines, copies

    def _repeats(self) -> np.ndarray:
        k, n = REPEAT_WINDOW, len(self.hashes)
        row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        at = np.flatnonzero(np.arange(n) - self.firsts[row] + k <= self.n_words[row])
        if not len(at):
            return np.zeros(len(self.n_words), dtype=np.int64)
        key = mix(hash_windows(self.hashes, k)[at] ^ mix(row[at].astype(np.uint64)))
        _, group, times = np.unique(key, return_inverse=True, return_counts=True)
        again = at[times[group] > 1]
        step = np.zeros(n + 1, dtype=np.int32)
        step[again] += 1
        np.subtract.at(step, again + k, 1)
        return np.bincount(row[np.cumsum(step)[:-1] > 0], minlength=len(self.n_words))

    def bytes_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some documents and their offsets."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        local = np.concatenate([[0], np.cumsum(sizes)])
        return self.data[ranges(self.offsets[rows], sizes)], local


def _symbols(t: Texts, rows: np.ndarray) -> np.ndarray:
    """More than one symbol for ten words."""
    return 100 * t.n_symbols[rows] > 10 * t.n_words[rows]


def _lines(t: Texts, rows: np.ndarray) -> np.ndarray:
    """More than half of the lines repeat an earlier one."""
    return 100 * t.n_dup_lines[rows] > 50 * t.n_lines[rows]


def _length(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Words of less than 2 or more than 20 code points on average."""
    return (t.word_chars[rows] < 2 * t.n_words[rows]) | (t.word_chars[rows] > 20 * t.n_words[rows])


def _shouting(t: Texts, rows: np.ndarray) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    data, offsets = t.bytes_of(rows)
    upper, lower = _sums(_UPPER[data], offsets), _sums(_LOWER[data], offsets)
    return upper > lower


def _stutter(t: Texts, rows: np.ndarray) -> np.ndarray:
    """More than 30 in 100 words equal the word before."""
    sizes = t.n_words[rows]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = t.hashes[ranges(t.firsts[rows], sizes)]
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    same[bounds[:-1][sizes > 0]] = False
    return 100 * _sums(same, bounds) > 30 * sizes


def _letters(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Fewer than half of the words hold a letter (ASCII, or any character beyond ASCII)."""
    data, offsets = t.bytes_of(rows)
    starts, ends, bounds = spans(data, offsets)
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    return 100 * _sums(total[ends] > total[starts], bounds) < 50 * t.n_words[rows]


RULES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {
    "symbols": _symbols, "lines": _lines, "length": _length, "shouting": _shouting, "stutter": _stutter, "letters": _letters}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Texts]]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in groups(offsets):
            yield batch.column(0).slice(lo, hi - lo), Texts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spent, hit = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
    for _, texts in _groups(batches):
        rows = np.flatnonzero(~texts.base_failed)
        for name, rule in RULES.items():
            start = time.perf_counter()
            hit[name] += int(rule(texts, rows).sum())
            spent[name] += time.perf_counter() - start
    yield pa.RecordBatch.from_pydict({"rule": list(RULES), "seconds": list(spent.values()), "rejected": list(hit.values())})


def rule_order(df: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on at most `sample_rows` documents, picked by hash of the key."""
    chosen = df.select(F.col(key).alias("_key")).filter("_key is not null").orderBy(F.xxhash64("_key"), "_key").limit(sample_rows)
    sample = df.join(F.broadcast(chosen.distinct()), F.col(key) == F.col("_key"), "left_semi").select(key, text)
    sample = sample.limit(sample_rows)  # rows that repeat a chosen key count as well
    seen = sample.mapInArrow(tidy(_measure), "rule string, seconds double, rejected long").groupBy("rule").agg(
        F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in seen}
    return sorted(RULES, key=lambda name: -gain.get(name, 0.0))


def _judge(order: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, t in _groups(batches):
            alive = np.flatnonzero(~t.base_failed)
            for name in order:
                if len(alive):
                    alive = alive[~RULES[name](t, alive)]
            kept = np.zeros(len(t.n_words), dtype=bool)
            kept[alive] = True
            counts = [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c.astype(np.int64)) for c in counts], pa.array(t.base_failed), pa.array(kept)],
                names=["doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    return run


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: key, the base counts, base_failed and kept.

    Base counts come from every whole text. `kept` is false if the base check fails or any rule of RULES
    rejects; rules run as a cascade in the order of `rule_order`. The order only saves work: the verdict
    is the same in any order.

    Null and empty texts have zero counts and fail the base check. Null and repeated keys are passed
    through, one row each. Other columns are ignored; an empty table gives an empty result.
    """
    order = rule_order(df, key, text, sample_rows)
    out = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(
        tidy(_judge(order)), "doc long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean")
    return out.withColumnRenamed("doc", key)


def _filter(order: list[str], at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _judge(order)
        for batch in batches:
            _, offsets = utf8(batch.column(at))
            for lo, hi in groups(offsets):
                part = batch.slice(lo, hi - lo)
                pair = pa.RecordBatch.from_arrays([pa.nulls(hi - lo, pa.int64()), part.column(at)], names=["doc", "text"])
                yield part.filter(pa.concat_arrays([x.column(7) for x in judged(iter([pair]))]))
    return run


def passing(df: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that `judge` keeps, with all their columns; no shuffle. Rows are judged one by one: null and empty
    texts go, null and repeated keys and repeated rows make no difference, an empty table stays empty."""
    order = rule_order(df, key, text, sample_rows)
    return df.mapInArrow(tidy(_filter(order, df.columns.index(text))), df.schema)
