"""Phrases that stand together more often than their parts, counted over a prefix-free parse.

Texts become streams of words and piece ends. A stream is cut where the hash of OVERLAP = longest - 1 tokens is
0 modulo PERIOD, so equal passages are cut alike wherever they stand. Neighbouring chunks share the trigger's
tokens; a phrase belongs to the chunk in which it starts before the shared tokens, so it is counted once. The
distinct chunks with their frequencies are the dictionary; phrases are counted inside dictionary chunks only,
weighted by the frequencies.

The dictionary lies in blocks of a few megabytes. A block sends its phrases as sorted runs of 64-bit hashes,
radix-partitioned; merged parts send back which of them are frequent. Blocks then send longer phrases whose word
pairs are all frequent (a phrase is never more frequent than its parts), and one block of each frequent phrase
writes its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.llm.packed import pack, ranges, strings, unpack
from tabsieve.llm.stages import written
from tabsieve.llm.words import groups, hash_windows, hash_words, lower_ascii, mix, spans, utf8

LONGEST = 4
#: Average distance of triggers, in tokens.
PERIOD = 16
#: Bytes of dictionary chunks in a block.
BLOCK = 8 << 20
#: Blocks whose phrases one part of the hashes holds, on average.
BLOCKS_A_PART = 2
#: Keys over which the ranking of a language is spread before its last step.
SALTS = 64

UNKNOWN = "und"
_BREAK = 0x0A
_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _SPLIT.copy()
_GAP[[0x20, 0x09]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x20] = True
_BREAK_HASH = mix(np.array([0x5851F42D4C957F2D], dtype=np.uint64))[0]

_BLOCKS = "block long, langs array<string>, n array<long>, codes binary, sizes binary, times binary, chunks binary"
_RUNS = "block long, part int, keys binary, totals binary"
_FOUND = "lang string, words int, phrase string, f long"


def _parse(period: int, longest: int) -> Callable:
    overlap = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in groups(offsets, 1 << 20):
                part = lower_ascii(data[offsets[lo]:offsets[hi]])
                starts, ends, bounds = spans(part, offsets[lo:hi + 1] - offsets[lo], _GAP)
                if not len(starts):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                piece = np.cumsum(_SPLIT[part], dtype=np.int64)[starts]
                new_doc = np.diff(doc, prepend=-1) != 0
                breaks = (new_doc | (np.diff(piece, prepend=-1) != 0)).astype(np.int64)
                last = np.append(new_doc[1:], True)
                # A document: a break, its words with breaks between pieces, `overlap` breaks.
                tokens = breaks + 1 + overlap * last
                at = np.cumsum(tokens) - tokens + breaks
                total = int(tokens.sum())
                hashes = np.full(total, _BREAK_HASH, dtype=np.uint64)
                hashes[at] = hash_words(part, starts, ends)
                wide = np.full(total, 2, dtype=np.int64)
                wide[at] = ends - starts + 1
                byte = np.zeros(total + 1, dtype=np.int64)
                np.cumsum(wide, out=byte[1:])
                body = np.full(int(byte[-1]), 0x20, dtype=np.uint8)
                body[byte[:-1][wide == 2]] = _BREAK  # one-letter words are written over it
                body[ranges(byte[at], ends - starts)] = part[ranges(starts, ends - starts)]
                of = np.repeat(doc, tokens)
                begin = np.flatnonzero(np.diff(of, prepend=-1) != 0)
                end = np.append(begin[1:], total)
                cut = np.zeros(total, dtype=bool)
                cut[:total - overlap + 1] = hash_windows(hashes, overlap) % np.uint64(period) == 0
                cut[ranges(end - overlap, np.full(len(end), overlap))] = False
                cut[begin] = True
                first = np.flatnonzero(cut)
                stop = np.append(first[1:], total) + overlap
                closing = np.append(of[first[1:]] != of[first[:-1]], True)
                stop[closing] -= overlap
                word = np.zeros(total + 1, dtype=np.int64)
                word[at + 1] = 1
                word = np.cumsum(word)
                langs = batch.column(0).slice(lo, hi - lo).take(pa.array(of[first]))
                chunks = strings(body, byte[first], byte[stop]).cast(pa.string())
                n = pa.array(word[stop - overlap] - word[first])
                for i in range(0, len(first), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [langs.slice(i, 10_000), chunks.slice(i, 10_000), n.slice(i, 10_000)], names=["lang", "chunk", "n"])
    return run


def _blocks(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        held_size = 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            coded = rows["lang"].combine_chunks().dictionary_encode()
            codes = coded.indices.to_numpy()
            times = rows["times"].to_numpy()
            n = np.zeros(len(coded.dictionary), dtype=np.int64)
            np.add.at(n, codes, rows["n"].to_numpy() * times)
            data, offsets = utf8(rows["chunk"])
            body = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(data).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([n]),
                 pa.array([pack(codes)]), pa.array([pack(np.diff(offsets))]), pa.array([pack(times)]), pa.array([body])],
                names=[f.split()[0] for f in _BLOCKS.split(", ")])

        for batch in batches:
            held.append(batch)
            held_size += batch.nbytes
            if held_size >= size:
                yield packed()
                held, held_size, block = [], 0, block + 1
        if held_size:
            yield packed()
    return run


class _Block:
    """The chunks of a block as tokens."""

    def __init__(self, row: dict, longest: int) -> None:
        self.langs = row["langs"]
        body = zstandard.ZstdDecompressor().decompress(row["chunks"])
        self.data = np.frombuffer(body, dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum(unpack(row["sizes"]).astype(np.int64))])
        self.starts, self.ends, bounds = spans(self.data, offsets, _BLANK)
        sizes = np.diff(bounds)
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        self.code = unpack(row["codes"]).astype(np.int64)[chunk]
        self.times = unpack(row["times"]).astype(np.int64)[chunk]
        seed = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs]
        self.seed = np.array(seed, dtype=np.uint64)[self.code]
        self.hashes = hash_words(self.data, self.starts, self.ends)
        # A phrase starts before the tokens that the next chunk shares, and holds no break.
        self.own = np.ones(len(self.starts), dtype=bool)
        self.own[ranges(bounds[1:] - longest + 1, np.full(len(sizes), longest - 1))] = False
        broken = np.concatenate([[0], np.cumsum(self.data[self.starts] == _BREAK)])
        self.fits = {}
        for n in range(1, longest + 1):
            m = max(len(self.starts) - n + 1, 0)
            self.fits[n] = self.own[:m] & (broken[n:n + m] == broken[:m])

    def keys(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of n words that start at these tokens."""
        return mix(hash_windows(self.hashes, n)[at] ^ self.seed[at] ^ mix(np.array([n], dtype=np.uint64)))

    def run(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order and their weighted counts."""
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        return keys[new], np.add.reduceat(self.times[at][order], new) if len(new) else np.zeros(0, np.int64)

    def phrases(self, n: int, at: np.ndarray) -> pa.Array:
        return strings(self.data, self.starts[at], self.ends[at + n - 1]).cast(pa.string())


def _parts(block: int, keys: np.ndarray, totals: np.ndarray, n_parts: int) -> list[tuple]:
    """The run cut by ranges of the hash."""
    cuts = np.searchsorted(keys, np.array([(i << 64) // n_parts for i in range(n_parts)], dtype=np.uint64))
    return [(block, i, pack(keys[a:b], True), pack(totals[a:b]))
            for i, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(keys)), strict=True)) if b > a]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def _short(n_parts: int, longest: int) -> Callable:
    """Runs of single words and word pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, longest)
                at = [np.flatnonzero(block.fits[n]) for n in (1, 2)]
                keys = np.concatenate([block.keys(n, x) for n, x in zip((1, 2), at, strict=True)])
                rows = _parts(row["block"], *block.run(keys, np.concatenate(at)), n_parts)
                if rows:
                    yield pa.RecordBatch.from_arrays(_columns(rows), names=["block", "part", "keys", "totals"])
    return run


def _frequent(least: int, to_all: bool) -> Callable:
    """Of a part's runs, the keys that reach `least` in all: with their count for the first block that has one,
    and, with `to_all`, with 0 for the others."""
    def run(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        lists = [unpack(k.as_py(), True) for k in table["keys"]]
        source = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        keys = np.concatenate(lists)
        totals = np.concatenate([unpack(t.as_py()).astype(np.int64) for t in table["totals"]])
        order = np.argsort(keys, kind="stable")
        keys, source = keys[order], source[order]
        new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        sums = np.add.reduceat(totals[order], new)
        count = np.zeros(len(keys), dtype=np.int64)
        count[new] = sums
        some = np.repeat(sums >= least, np.diff(np.append(new, len(keys)))) if to_all else count >= least
        keys, source, count = keys[some], source[some], count[some]
        by = np.argsort(source, kind="stable")
        cuts = np.searchsorted(source[by], np.arange(len(lists) + 1))
        rows = [(int(blocks[i]), 0, pack(keys[by[a:b]], True), pack(count[by[a:b]]))
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.Table.from_arrays(_columns(rows), names=["block", "part", "keys", "totals"]).drop_columns("part")
    return run


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpack(k.as_py(), True) for k in table["keys"]])
    totals = np.concatenate([unpack(t.as_py()).astype(np.int64) for t in table["totals"]])
    order = np.argsort(keys)
    return keys[order], totals[order]


def _found(block: _Block, sizes: tuple[int, ...], keys: np.ndarray, totals: np.ndarray) -> list[pa.Array]:
    """lang, words, phrase and f of the keys that this block writes."""
    keys, totals = keys[totals > 0], totals[totals > 0]
    out = []
    for n in sizes:
        at = np.flatnonzero(block.fits[n])
        if not len(keys) or not len(at):
            continue
        have = block.keys(n, at)
        place = np.minimum(np.searchsorted(keys, have), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == have)
        which, where = np.unique(place[hit], return_index=True)
        at = at[hit[where]]
        out.append((pa.array(block.langs, pa.string()).take(pa.array(block.code[at])),
                    pa.array(np.full(len(at), n, dtype=np.int32)), block.phrases(n, at), pa.array(totals[which])))
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return [pa.concat_arrays([o[i] for o in out]) if out else pa.nulls(0, k) for i, k in enumerate(kinds)]


def _long(n_parts: int, longest: int) -> Callable:
    """What a block knows after the first round: its frequent words and pairs, and the runs of longer phrases
    whose pairs are all frequent."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0] if blocks.num_rows else None
        rows: list[tuple] = []
        found = [pa.nulls(0, k) for k in (pa.string(), pa.int32(), pa.string(), pa.int64())]
        if row and answers.num_rows:
            block = _Block(row, longest)
            keys, totals = _answers(answers)
            found = _found(block, (1, 2), keys, totals)
            # Pairs in tokens shared with the next chunk are counted there: this block takes them as frequent.
            good = ~block.own
            pairs = np.flatnonzero(block.fits[2])
            have = block.keys(2, pairs)
            good[pairs[keys[np.minimum(np.searchsorted(keys, have), len(keys) - 1)] == have]] = True
            good = np.concatenate([[0], np.cumsum(good)])
            at, parts = [], []
            for n in range(3, longest + 1):
                start = np.flatnonzero(block.fits[n])
                start = start[good[start + n - 1] - good[start] == n - 1]
                at.append(start)
                parts.append(block.keys(n, start))
            if at:
                rows = _parts(row["block"], *block.run(np.concatenate(parts), np.concatenate(at)), n_parts)
        n, m = len(rows), len(found[0])
        left, right = _columns(rows), found
        return pa.Table.from_arrays(
            [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in left] + [pa.concat_arrays([pa.nulls(n, c.type), c]) for c in right],
            names=["block", "part", "keys", "totals", "lang", "words", "phrase", "f"])
    return run


def _last(longest: int) -> Callable:
    """The frequent longer phrases that a block writes."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        found = [pa.nulls(0, k) for k in (pa.string(), pa.int32(), pa.string(), pa.int64())]
        if blocks.num_rows and answers.num_rows:
            found = _found(_Block(blocks.to_pylist()[0], longest), tuple(range(3, longest + 1)), *_answers(answers))
        return pa.Table.from_arrays(found, names=["lang", "words", "phrase", "f"])
    return run


def dictionary(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, period: int = PERIOD) -> DataFrame:
    """The prefix-free parse: lang, chunk, times (how often it occurs) and n (words that start in it). A chunk is its
    tokens, each with a space behind it; a newline stands for the end of a piece or text. Null languages are `und`."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("t"))
    return rows.mapInArrow(_parse(period, longest), "lang string, chunk string, n long").groupBy("lang", "chunk").agg(
        F.count(F.lit(1)).alias("times"), F.first("n").alias("n"))


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = 30,
                     period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of every phrase of 1 to `longest` words with f >= least, and (lang, n), all words.

    A-Z are lower-cased; phrases lie inside pieces (cut at `.,;:!?` and line ends); words are separated by spaces and
    tabs; f counts all occurrences of all rows. Null and empty texts have no words; null languages count as `und`;
    repeated rows count as often as they occur; other columns are ignored; empty tables give empty results. Phrases
    are told apart by 64-bit hashes: two of n distinct ones are mixed up with a chance of n^2 / 2^65.
    """
    if longest < 2:
        raise ValueError("phrases of two words at least")
    blocks = written(dictionary(df, text, lang, longest, period).select("lang", "chunk", "n", "times").mapInArrow(
        _blocks(BLOCK), _BLOCKS), "blocks")
    n_parts = max(1, -(-blocks.count() // BLOCKS_A_PART))
    words = blocks.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(
        F.sum("x.n").alias("n"))
    runs = blocks.mapInArrow(_short(n_parts, longest), _RUNS)
    answers = runs.groupBy("part").applyInArrow(_frequent(least, True), "block long, keys binary, totals binary")
    second = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _long(n_parts, longest), f"{_RUNS}, {_FOUND}"), "phrases")
    runs = second.filter("part IS NOT NULL").select("block", "part", "keys", "totals")
    answers = runs.groupBy("part").applyInArrow(_frequent(least, False), "block long, keys binary, totals binary")
    longer = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_last(longest), _FOUND)
    short = second.filter("phrase IS NOT NULL").select("lang", "words", "phrase", "f")
    return written(short.unionAll(longer), "frequent"), words


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = 30,
                 top: int = 2000, scale: int = 2_000_000, inside: int = 80) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count (at least `least`), n the language's words. Cut after its first k words the phrase scores
    floor(scale * a / (l + r)), l and r being the counts of the two parts; its lowest cut counts, the smallest k of
    equals. A phrase goes if its words lie inside a longer phrase with 100 * count >= inside * a, whatever becomes
    of that one. Order: score and a descending, then the phrase's bytes. Products are decimals of 38 digits.

    Odd input is treated as in `frequent_phrases`. A language is ranked in SALTS portions first, so that at most
    SALTS * top rows of one meet in a task.
    """
    found, words = frequent_phrases(df, text, lang, longest, least)
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    phrases = found.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def words_of(first: str, size: str) -> F.Column:
        return F.concat_ws(" ", F.expr(f"slice(w, {first}, {size})"))

    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "lang", "phrase", "a", "k", words_of("1", "k").alias("left"), words_of("k + 1", "words - k").alias("right"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "count": "l"}), ["lang", "left"])
    cuts = cuts.join(parts.withColumnsRenamed({"part": "right", "count": "r"}), ["lang", "right"])
    score = F.expr(f"(cast({scale} as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    hidden = (
        phrases.filter("words > 2").withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
        .withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
        .groupBy("lang", words_of("at", "size").alias("phrase")).agg(F.max("a").alias("longer")))
    kept = scored.join(hidden, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | F.expr(f"100 * cast(longer as decimal(19, 0)) < {inside} * cast(a as decimal(19, 0))"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "x.score", "x.l", "x.r", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
