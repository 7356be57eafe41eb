"""Byte-level BPE in DuckDB: a recursive query per batch of distinct words, an ordered aggregation back.

A task holds the merge table (left token, right token, merged token) and a table of token positions. The
recursive query joins every pair of neighbours to the merge table and contracts the leftmost pair of the
lowest rank of each word, until no word has a pair left. Token ids are the ranks of the vocabulary file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from typing import Any

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.packed import ranges
from tabsieve.llm.stages import tidy

#: Steps of one recursive query. Words that need more go into the next one, so that the rows which a
#: recursion keeps stay bounded however long a word is.
STEPS = 24
#: Token positions that one recursive query starts with (more only for a single longer word).
POSITIONS = 100_000
#: Bytes that a worker spends on remembered pieces: the older half that was not met again is forgotten beyond it,
#: all of them when the task ends.
REMEMBERED = 64 << 20
#: Bytes of text that are encoded at a time.
PORTION = 1 << 20
#: Longer words are encoded in segments of this many bytes, whose joints are mended.
SEGMENT = 32

# `loc` is word * 2^32 + position, `after` the loc of the next token and `nxt` that token; `key` is
# rank * 2^32 + position of the pair that begins here, null without a merge. Only the contracted token and the one
# before it look their pair up again.
_STEP_SQL = f"""
WITH RECURSIVE t AS (
    SELECT 0 AS step, word, loc, loc + 1 AS after, tok, nxt, m.id * 4294967296 + loc % 4294967296 AS key
    FROM start LEFT JOIN merges m ON m.pair = tok * 1048576 + nxt
    UNION ALL
    (WITH c AS MATERIALIZED (
         SELECT word, min(key) AS best, arg_min(after, key) AS gone FROM t WHERE key IS NOT NULL AND step < {STEPS} GROUP BY word),
     g AS MATERIALIZED (
         SELECT c.word, best // 4294967296 AS made, c.word * 4294967296 + best % 4294967296 AS place, gone,
                t.nxt AS far, t.after AS beyond FROM c JOIN t ON t.loc = gone),
     n AS (SELECT step + 1 AS step, t.word, loc, CASE WHEN loc = place THEN beyond ELSE after END AS after,
                  CASE WHEN loc = place THEN made ELSE tok END AS tok,
                  CASE WHEN loc = place THEN far WHEN after = place THEN made ELSE nxt END AS nxt,
                  key, loc = place OR after = place AS changed
           FROM t JOIN g ON g.word = t.word WHERE loc <> gone)
     SELECT n.step, n.word, n.loc, n.after, n.tok, n.nxt, CASE WHEN changed THEN m.id * 4294967296 + loc % 4294967296 ELSE key END
     FROM n LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN n.tok * 1048576 + n.nxt END)
), last AS (SELECT word, max(step) AS step FROM t GROUP BY word)
SELECT t.word, t.tok, t.step FROM t JOIN last ON t.word = last.word AND t.step = last.step ORDER BY t.loc
"""

_STOP = re.compile(r"([.,])(?<=[^\W_][.,])(?=\0|\Z)")

_DECODE_SQL = """
SELECT doc, array_to_string(list(v.chars ORDER BY pos), '') AS chars FROM ids JOIN vocab v ON v.id = ids.tok GROUP BY doc
"""


def read_ranks(path: str) -> bytes:
    """The vocabulary file as it is: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Vocabulary tables of one worker."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        # White space by Unicode property, as the pattern's own engine has it.
        self.words = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(
            r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"))
        self.byte_ids = np.array([self.ids.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.apart: dict[tuple[int, int], bool] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs, merged = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    merged.append(rank)
        if max(self.ids.values()) >= 1 << 20:
            raise ValueError("ranks below 2^20")
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "id": pa.array(merged, pa.int64())})
        # A byte travels as the character of its number.
        vocab = pa.table({"id": pa.array(list(self.ids.values()), pa.int32()), "chars": [t.decode("latin-1") for t in self.ids]})
        self.tokens = {i: t for t, i in self.ids.items()}
        for name, table in (("merges", merges), ("vocab", vocab)):
            self.db.register("source", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
            self.db.unregister("source")

    def forget(self) -> None:
        """Give back what the pieces of earlier texts take."""
        self.known, self.older, self.apart, self.held = {}, {}, {}, 0

    def _fixpoint(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        tok = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int64)
        while len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ends = np.append(first[1:], len(word))
            nxt = np.append(tok[1:], -1)
            nxt[ends - 1] = -1
            loc = (word << 32) + np.arange(len(word)) - np.repeat(first, ends - first)
            self.db.register("start", pa.table({"word": word, "loc": loc, "tok": tok, "nxt": nxt}))
            found = self.db.execute(_STEP_SQL).fetchnumpy()
            self.db.unregister("start")
            word, tok = np.ascontiguousarray(found["word"]), np.ascontiguousarray(found["tok"])
            open_ = found["step"] >= STEPS
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ends = np.append(first[1:], len(word))
            raw, done = tok.astype("<u4").tobytes(), ~open_[first]
            for n, a, b in zip(word[first][done].tolist(), (4 * first[done]).tolist(), (4 * ends[done]).tolist(), strict=True):
                out[n] = raw[a:b]
            word, tok = word[open_], tok[open_]
        return out

    def _batched(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, in portions of POSITIONS bytes."""
        out: list[bytes] = []
        for lo, hi in _portions(np.array([len(w) for w in words]), POSITIONS):
            out += self._fixpoint(words[lo:hi])
        return [np.frombuffer(x, dtype="<u4").tolist() for x in out]

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def _long(self, words: list[bytes]) -> list[bytes]:
        """Ids of words beyond SEGMENT bytes. Tokens side by side are the word's encoding exactly if each two
        neighbours are the encoding of their own bytes: the merges of a word reach no state that those of the
        pair would not. So segments are encoded apart, and where the tokens at a joint are not such neighbours, the
        tokens around it are encoded again, more of them each time."""
        cut = [[w[i:i + SEGMENT] for i in range(0, len(w), SEGMENT)] for w in words]
        segments = list({s: None for c in cut for s in c})
        ids = dict(zip(segments, self._batched(segments), strict=True))
        parts = [[ids[s] for s in c] for c in cut]
        todo, around = list(range(len(words))), 4
        while todo:
            joints = {(x[-1], y[0]) for n in todo for x, y in zip(parts[n][:-1], parts[n][1:], strict=True)}
            new = [p for p in joints if p not in self.apart]
            self.apart.update(
                (p, tuple(found) == p) for p, found in zip(new, self._batched([self._bytes(list(p)) for p in new]), strict=True))
            again, windows = [], []
            for n in todo:
                rows, out, bad = parts[n], [parts[n][0]], False
                for right in rows[1:]:
                    left = out[-1]
                    if left and not self.apart[left[-1], right[0]]:
                        # The window stays empty until it is encoded, so the joint behind it waits for the next turn.
                        bad = True
                        windows.append((n, left[-around:] + right[:around]))
                        out[-1:] = [x for x in (left[:-around],) if x] + [[]]
                        out += [x for x in (right[around:],) if x]
                    else:
                        out.append(right)
                parts[n] = out
                if bad:
                    again.append(n)
            filled = iter(self._batched([self._bytes(w) for _, w in windows]))
            for n in again:
                parts[n] = [x or next(filled) for x in parts[n]]
            todo, around = again, around * 2 if around < 64 else around + 1
        return [np.array([i for p in rows for i in p], dtype="<u4").tobytes() for rows in parts]

    def _marked(self, text: str) -> str:
        """The text with \\0 between parts whose matches are those of the whole text. Where all white space is single
        spaces and newlines between words, these are the words with the space before them, without a full stop or
        comma behind a letter or digit."""
        bare = text.split()
        gaps = len(bare) - 1
        if gaps < 0 or len(text) - sum(map(len, bare)) != gaps or text.count(" ") + text.count("\n") != gaps:
            return "\0".join(self.words.findall(text))
        return _STOP.sub("\0\\1", text.replace("\n", "\0\n\0").replace(" ", "\0 "))

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The numbers of parts of the texts and all parts."""
        if any("\0" in t for t in texts):
            split = [self.words.findall(t) for t in texts]
            return np.array([len(x) for x in split]), pa.array([p for x in split for p in x], pa.large_string()).dictionary_encode()
        lists = pc.split_pattern(pa.array([self._marked(t) for t in texts], pa.large_string()), "\0")
        return np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()

    def learn(self, pieces: list[str]) -> None:
        """Make the ids of all these distinct pieces known."""
        if self.held > REMEMBERED // 2:
            known = self.known
            self.forget()
            self.older = known
        known, older = self.known, self.older
        todo: dict[str, bytes] = {}
        long: dict[str, bytes] = {}
        mixed: list[tuple[str, list[str]]] = []
        new = [p for p in pieces if p not in known]
        again = [p for p in new if p in older]
        known.update((p, older[p]) for p in again)
        for piece in set(new).difference(again) if again else new:
            if not piece:
                known[piece] = b""
                continue
            words = [piece] if piece.isalpha() or piece[1:].isalpha() and piece[0] == " " else self.words.findall(piece)
            if len(words) > 1:
                mixed.append((piece, words))
            for w in words:
                if w not in known:
                    raw = w.encode()
                    whole = self.ids.get(raw)
                    if whole is not None:
                        known[w] = whole.to_bytes(4, "little")
                    elif len(raw) <= 2 * SEGMENT:
                        todo[w] = raw
                    else:
                        long[w] = raw
        words, raws = list(todo), list(todo.values())
        for lo, hi in _portions(np.array([len(r) for r in raws]), POSITIONS):
            known.update(zip(words[lo:hi], self._fixpoint(raws[lo:hi]), strict=True))
        if long:
            known.update(zip(long, self._long(list(long.values())), strict=True))
        for piece, words in mixed:
            known[piece] = b"".join([known[w] for w in words])
        self.held += sum(map(len, new)) * 2 + 250 * len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the n + 1 offsets of the texts."""
        counts, coded = self._pieces(texts)
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        found = [self.known[p] for p in distinct]
        sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
        table, begins = np.frombuffer(b"".join(found), dtype="<i4"), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return table[ranges(begins[codes], sizes[codes])], ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, by an ordered aggregation over its positions."""
        out = [b""] * len(lists)
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        if not sizes.sum():
            return out
        tok = np.concatenate(lists).astype(np.int32)
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
        self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(tok), dtype=np.int64), "tok": tok}))
        for i, chars in self.db.execute(_DECODE_SQL).fetchall():
            out[i] = chars.encode("latin-1")
        self.db.unregister("ids")
        return out


def _portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if len(sizes) > first:
        yield first, len(sizes)


def _task(shared: Any, pattern: str, work: Callable) -> Callable:
    """A task with a codec of its own. Spark keeps the worker for later tasks, so the codec goes when the task ends
    and the pages that it took go back to the system."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        try:
            for batch in batches:
                yield from work(codec, batch)
        finally:
            codec.db.close()
            codec.__dict__.clear()
    return tidy(run)


def _encoded(codec: Codec, keys: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids and offsets of portions of the texts."""
    texts = texts.fill_null("")
    for lo, hi in _portions(pc.binary_length(texts).to_numpy(zero_copy_only=False), PORTION):
        yield keys.slice(lo, hi - lo), *codec.encode(texts.slice(lo, hi - lo).to_pylist())


def _decoded(codec: Codec, values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    out: list[bytes] = []
    for lo, hi in _portions(np.diff(offsets), 200_000):
        out += codec.decode([values[offsets[i]:offsets[i + 1]] for i in range(lo, hi)])
    return out


def _encode(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for keys, flat, offsets in _encoded(codec, batch.column(0), batch.column(1)):
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([keys, ids], names=["doc", "ids"])


def _decode(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    for lo, hi in _portions(np.diff(offsets), 200_000):
        part = pa.array(_decoded(codec, values, offsets[lo:hi + 1]), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids.slice(lo, hi - lo), part], names=["doc", "ids", "bytes"])


def _both(emit: Callable, names: list[str]) -> Callable:
    def work(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for keys, flat, offsets in _encoded(codec, batch.column(0), batch.column(1)):
            rows = [emit(flat[a:b], raw) for a, b, raw in
                    zip(offsets[:-1], offsets[1:], _decoded(codec, flat, offsets), strict=True)]
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=["doc", *names])
    return work


def round_trip(df: DataFrame, ranks: bytes, pattern: str, emit: Callable, emitted: str, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """key and the columns `emitted` of every row: what `emit(ids, decoded)` returns for the ids of the whole text and
    the bytes that they decode to. Texts are encoded and decoded by one codec in the same task; rows are treated as
    in `encode`."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    names = [f.split()[0] for f in emitted.split(", ")]
    return df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(
        _task(shared, pattern, _both(emit, names)), f"doc long, {emitted}").withColumnRenamed("doc", key)


def encode(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and `ids` (array of int) of every row: the BPE ids of the whole text, without special tokens.

    Each match of `pattern` is encoded by itself; a match that is a token as a whole is that token. A word of any
    length is encoded whole, in time near-linear to its length (see `Codec._long`). Null
    texts are empty; empty texts have no ids. Null and repeated keys are passed through, one row each;
    other columns are ignored; an empty table gives an empty result. Rows stay in their partitions.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    return df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(
        _task(shared, pattern, _encode), "doc long, ids array<int>").withColumnRenamed("doc", key)


def decode(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids and `bytes`, the concatenated tokens. Null ids count as none; unknown ids add nothing."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    return df.select(F.col(key).cast("bigint").alias("doc"), F.col(ids).alias("ids")).mapInArrow(
        _task(shared, pattern, _decode), "doc long, ids array<int>, bytes binary").withColumnRenamed("doc", key)
