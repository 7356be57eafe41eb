import hashlib
import random
import re

import pytest

from tabsieve.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            k = min(window, len(p))
            for i in range(len(p) - k + 1 if p and item is not None else 0):
                for j in range(len(w) - k + 1):
                    if w[j:j + k] == p[i:i + k]:
                        hit.update(range(j, j + k))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def near(text, passage, window, slop):
    """A window of the passage can be laid on the text so that every word is at most `slop` off."""
    w, p = words(text), words(passage)
    k = min(window, len(p))
    return any(
        all(any(0 <= q < len(w) and w[q] == p[i + o] for q in range(j + o - slop, j + o + slop + 1)) for o in range(k))
        for i in range(len(p) - k + 1 if p else 0) for j in range(-slop, len(w)))


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string, segment string, place string, term string")


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocab = ["the", "of", "Rust", "été", "x9", "naïve", "ab", "cd"]
    passage = [" ".join(rng.choices(vocab, k=n)) for n in (3, 9, 10, 14, 40)]
    items = [*enumerate(passage), (7, passage[2]), (3, "a second row of item three with words of its own here"), (8, None),
             (9, "..., !"), (None, passage[3]), (11, "only")]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(i + 40, f"Start, {p.upper()}; end. {p}") for i, p in enumerate(passage)]
    docs += [(50, None), (50, ""), (None, passage[4]), (51, passage[4]), (51, passage[4]), (52, "ONLY only! lonely only"),
             (53, "a second row of item three with words of its own here")]
    return docs, items


def test_equals_brute_force_at_any_segment_and_block_size(spark, tables, monkeypatch):
    docs, items = tables
    left = frame(spark, [(*d, "x", "y", "z") for d in docs], "doc_id").repartition(3)
    right = frame(spark, [(*d, "x", "y", "z") for d in items], "item_id")
    want = brute(docs, items)
    assert sum(r[-1] for r in want) > 10
    for segment, block, piece in ((8 << 20, 500_000, 4096), (64, 30, 5)):
        monkeypatch.setattr(decontaminate, "SEGMENT", segment)
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        out = decontaminate.contaminated(left, right)
        assert sorted((tuple(r) for r in out.collect()), key=str) == want


def test_proximity_matches(spark, tables):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(4)]
    docs = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        docs += [(10 * i, text), (10 * i + 1, " ".join(w[:6] + ["new"] + w[6:])), (10 * i + 2, " ".join(w[:5] + w[6:])),
                 (10 * i + 3, " ".join(w[:4] + ["a", "b", "c"] + w[4:])), (10 * i + 4, " ".join(rng.choices(vocab, k=80)))]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for slop in (1, 2):
        found = decontaminate.matches(index, spark.createDataFrame(items, "item_id long, text string"), slops=(slop,))
        got = {(r["key"], int(r["item"])) for r in found.collect()}
        assert got == {(d, i) for d, t in docs for i, p in items if near(t, p, 10, slop)}
        assert len(got) > 8
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"), slop=1)
    assert {r["doc_id"] % 10 for r in out.filter("n_near_items > 0 AND n_hit = 0").collect()} >= {1}


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    long = spark.createDataFrame([(1, "filler " * 60_000 + "one two three four five six seven eight nine ten"), (2, "filler")],
                                 "doc_id long, text string")
    assert decontaminate.contaminated(none, items).count() == 0
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contaminated(long, items).collect()}
    assert rows == {1: (60_010, 10), 2: (1, 0)}
    empty = decontaminate.contaminated(long, none.withColumnRenamed("doc_id", "item_id")).collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in empty] == [(0, 0, False)] * 2


def test_posting_lists_are_a_table(spark):
    index = decontaminate.build_index(spark.createDataFrame([(1, "A b a"), (2, "b")], "doc_id long, text string").coalesce(1))
    assert {(r["term"], r["n"]) for r in index.collect()} == {(None, 2), ("a", 2), ("b", 2)}
