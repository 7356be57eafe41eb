"""Language identification of code-switched text: a linear-chain CRF over words.

Emissions sum learned weights of affixes, byte n-grams and the word itself (hashed features); transitions
between languages are learned. Forward-backward gives each word's language probabilities; a document's
language is the one with the largest expected number of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsieve.llm.words import groups, hash_words, mix, spans, utf8

UNKNOWN = "und"
#: Bound of the labelled sample on which the model is fitted: documents of each language, words of each
#: document (a run that starts at a hashed place). Languages beyond MOST_LANGUAGES are refused.
TRAIN_DOCUMENTS, TRAIN_WORDS, MOST_LANGUAGES = 500, 120, 500
#: Hashed feature slots, words of a training sequence, passes over the sample.
SLOTS, SEQUENCE, EPOCHS = 1 << 17, 60, 12
#: Words of the pieces into which long documents are cut; their transfer matrices keep the result exact.
PIECE = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words and the n + 1 places at which the words' features begin."""
    n, sizes = len(starts), ends - starts
    padded = sizes + 2
    first = np.concatenate([[0], np.cumsum(padded)])
    text = np.zeros(first[-1] + 4, dtype=np.uint64)
    inner = np.repeat(first[:-1] + 1 - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    text[inner] = data[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
    text[first[:-1]], text[first[1:] - 1] = 1, 2
    word = np.repeat(np.arange(n), padded)
    left = np.repeat(first[1:], padded) - np.arange(first[-1])  # bytes up to the word's end
    owners, slots = [np.arange(n)], [hashes ^ np.uint64(0x51)]
    for k in (2, 3, 4):  # n-grams; those at the word's ends hold its mark and so are its affixes
        at = np.flatnonzero(left >= k)
        value = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            value = value << np.uint64(8) | text[at + j]
        owners.append(word[at])
        slots.append(value)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    slot = (mix(np.concatenate(slots)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)[order]
    return slot, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _emissions(weights: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) == 1:
        return np.zeros((0, weights.shape[1]), dtype=np.float32)
    sums = np.add.reduceat(weights[slots], bounds[:-1], axis=0)
    return np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -60, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def _both_ways(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors and expected transitions of a batch of equally long sequences."""
    n, length, k = e.shape
    ahead = np.zeros_like(e)
    a = np.full((n, k), 1.0 / k)
    for t in range(length):
        a = _unit((a @ move) * e[:, t])
        ahead[:, t] = a
    b, post, expected = np.ones((n, k)), np.zeros_like(e), np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        post[:, t] = _unit(ahead[:, t] * b)
        if t:
            out = e[:, t] * b
            joint = ahead[:, t - 1][:, :, None] * move[None] * out[:, None, :]
            expected += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
            b = _unit(out @ move.T)
    return post, expected


def fit(texts: list[str], labels: list[str], seed: int = 42) -> Model:
    """Maximum likelihood by AdaGrad on sequences of SEQUENCE words; every second sequence switches to
    another document once, so that transitions between languages are seen."""
    languages = sorted(set(labels))
    data, offsets = utf8(pa.array(texts, pa.string()))
    starts, ends, bounds = spans(data, offsets)
    hashes = hash_words(data, starts, ends)
    distinct, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    slots, edges = features(data, starts[at], ends[at], distinct)
    gold_of = np.repeat([languages.index(x) for x in labels], np.diff(bounds)) if len(starts) else np.zeros(0, np.int64)
    k, rng = len(languages), np.random.default_rng(seed)
    weights, moves = np.zeros((SLOTS, k)), np.zeros((k, k))
    if k < 2 or not len(starts):
        return Model(languages, weights.astype(np.float32), np.full((k, k), 1.0 / max(k, 1)))
    usable = np.flatnonzero(np.diff(bounds) > 0)
    seen_w, seen_m, half = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6), SEQUENCE // 2

    def run(doc: int) -> np.ndarray:
        size = bounds[doc + 1] - bounds[doc]
        return bounds[doc] + (rng.integers(size) + np.arange(half)) % size

    for _ in range(EPOCHS):
        order = rng.permutation(usable)
        for batch in np.array_split(order, max(1, len(order) // 128)):
            rows = np.stack([np.concatenate([run(d), run(rng.choice(usable) if i % 2 else d)]) for i, d in enumerate(batch)])
            move = _unit(np.exp(moves - moves.max(axis=1, keepdims=True)))
            used, inverse = np.unique(number[rows], return_inverse=True)
            inverse = inverse.ravel()
            sizes = np.diff(edges)[used]
            ends_of = np.cumsum(sizes)
            place, back = np.unique(slots[np.repeat(edges[used] - ends_of + sizes, sizes) + np.arange(ends_of[-1])], return_inverse=True)
            e = _emissions(weights[place], back, np.concatenate([[0], ends_of]))[inverse].reshape(*rows.shape, k)
            post, expected = _both_ways(e, move)
            gold = np.eye(k)[gold_of[rows]]
            surplus = np.stack([np.bincount(inverse, (post - gold)[:, :, j].ravel(), len(used)) for j in range(k)], 1)
            owner = np.repeat(np.arange(len(used)), sizes)
            gradient = np.stack([np.bincount(back, surplus[owner, j], len(place)) for j in range(k)], 1) + 1e-3 * weights[place]
            seen_w[place] += gradient**2
            weights[place] -= 0.2 * gradient / np.sqrt(seen_w[place])
            pairs = np.zeros((k, k))
            np.add.at(pairs, (gold_of[rows[:, :-1]].ravel(), gold_of[rows[:, 1:]].ravel()), 1)
            slope = move * expected.sum(axis=1, keepdims=True) - pairs
            seen_m += slope**2
            moves -= 0.2 * slope / np.sqrt(seen_m)
    return Model(languages, weights.astype(np.float32), _unit(np.exp(moves - moves.max(axis=1, keepdims=True))))


def expected_words(e: np.ndarray, counts: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected number of words of each language in each document, by exact forward-backward.

    Documents are cut into pieces that run side by side: first each piece's transfer matrix, then the
    messages from piece to piece, then both passes inside all pieces."""
    k, docs = move.shape[0], np.flatnonzero(counts)
    first_word = np.concatenate([[0], np.cumsum(counts)])[:-1]
    pieces = -(-counts[docs] // PIECE)
    owner = np.repeat(docs, pieces)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first_word[owner] + index * PIECE
    size = np.minimum(PIECE, counts[owner] - index * PIECE)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(PIECE), side="left")  # pieces longer than t, first in order
    long = np.repeat(pieces > 1, pieces)
    start, stop = np.full((len(owner), k), 1.0 / k), np.ones((len(owner), k))
    if long.any():
        some = order[long[order]]
        count = np.searchsorted(-size[some], -np.arange(PIECE), side="left")
        transfer = np.broadcast_to(np.eye(k), (len(some), k, k)).copy()
        for t in range(PIECE):
            m = count[t]
            if not m:
                break
            part = (transfer[:m] @ move) * e[begin[some[:m]] + t][:, None, :]
            transfer[:m] = part / np.maximum(part.sum(axis=(1, 2), keepdims=True), 1e-300)
        matrix = np.zeros((len(owner), k, k))
        matrix[some] = transfer
        most = int(pieces.max())
        for i in range(1, most):
            at = np.flatnonzero(long & (index == i))
            start[at] = _unit((start[at - 1][:, None, :] @ matrix[at - 1])[:, 0])
        for i in range(most - 2, -1, -1):
            at = np.flatnonzero(long & (index == i))
            at = at[at + 1 < len(owner)]
            at = at[owner[at + 1] == owner[at]]
            stop[at] = _unit((matrix[at + 1] @ stop[at + 1][:, :, None])[:, :, 0])
    ahead = np.zeros(e.shape, dtype=np.float32)
    a = start[order]
    for t in range(PIECE):
        m = active[t]
        if not m:
            break
        at = begin[order[:m]] + t
        a = _unit((a[:m] @ move) * e[at])
        ahead[at] = a
    total, b = np.zeros((len(owner), k)), stop[order]
    for t in range(PIECE - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        at = begin[order[:m]] + t
        total[order[:m]] += _unit(ahead[at] * b[:m])
        b[:m] = _unit((e[at] * b[:m]) @ move.T)
    out = np.zeros((len(counts), k))
    np.add.at(out, owner, total)
    return out


def _predict(shared: Any) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in groups(offsets):
                part = data[offsets[lo]:offsets[hi]]
                starts, ends, bounds = spans(part, offsets[lo:hi + 1] - offsets[lo])
                hashes = hash_words(part, starts, ends)
                distinct, at, number = np.unique(hashes, return_index=True, return_inverse=True)
                counts = np.diff(bounds)
                share = np.zeros((hi - lo, 0))
                if model.languages:
                    e = _emissions(model.weights, *features(part, starts[at], ends[at], distinct))[number]
                    share = expected_words(e, counts, model.transitions)
                lettered = np.array([
                    t is not None and bool(model.languages) and _LETTER.search(t) is not None
                    for t in batch.column(1).slice(lo, hi - lo).to_pylist()], dtype=bool)
                best = share.argmax(axis=1) if model.languages else np.zeros(hi - lo, dtype=np.int64)
                score = share.max(axis=1, initial=0.0) / np.maximum(counts, 1)
                names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()),
                     pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0)),
                     pa.FixedSizeListArray.from_arrays(pa.array(share.ravel()), max(len(model.languages), 1)).cast(pa.list_(pa.float64()))
                     if model.languages else pa.array([[]] * (hi - lo), pa.list_(pa.float64()))],
                    names=["doc", "lang_pred", "score", "words"])
    return run


def training_sample(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    documents: int = TRAIN_DOCUMENTS, words: int = TRAIN_WORDS) -> tuple[list[str], list[str]]:
    """At most `documents` runs of `words` words for each language, in order of a hash of the key.

    Language counts give the share of keys that is about twice what is needed; only those rows are ranked.
    """
    rows = df.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30))
    limit = F.lit(0)
    for name, n in counts.items():
        limit = F.when(F.col(lang) == name, F.lit(int(min(1.0, (2.0 * documents + 50) / n) * (1 << 30)))).otherwise(limit)
    split = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(lang).orderBy("_draw", key))
    picked = (
        rows.withColumn("_draw", draw).filter(F.col("_draw") < limit).withColumn("_rank", rank).filter(F.col("_rank") <= documents)
        .withColumn("_split", split).filter(F.size("_split") > 0)
        .withColumn("_from", F.pmod(F.xxhash64(key), F.greatest(F.size("_split") - words + 1, F.lit(1))).cast("int") + 1)
        .select(lang, F.array_join(F.slice("_split", F.col("_from"), F.lit(words)), " ").alias("run"), "_draw", key)
        .orderBy(lang, "_draw", key).select(lang, "run").collect())
    return [r["run"] for r in picked], [r[lang] for r in picked]


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             learn: Column | None = None) -> DataFrame:
    """One row per input row: key, lang_pred, score, words (expected words of each learned language, by name).

    The model is fitted on a bounded labelled sample (TRAIN_DOCUMENTS runs of TRAIN_WORDS words for each
    language) of the rows where `learn` holds and `lang` is not null; the prediction sees the whole text
    and nothing else. `score` is the expected share of the text's words in the predicted language.

    Null texts and texts without a letter get `und` with score 0, and so does every text if nothing could
    be learned. Null and repeated keys are passed through, one row each; other columns are ignored; an
    empty table gives an empty result. A broadcast model has SLOTS weights for each language.
    """
    model = fit(*training_sample(df, F.lit(True) if learn is None else learn, key, text, lang))
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.transitions))
    out = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(
        _predict(shared), "doc long, lang_pred string, score double, words array<double>")
    return out.withColumnRenamed("doc", key)
