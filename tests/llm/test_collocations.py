import random
import re
from collections import Counter

import pytest

from tabsieve.llm import collocations


def pieces(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, longest=4, least=30, top=2000, scale=2_000_000, inside=80):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    frequent = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        if any(x == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= inside * a
               for (x, q), b in frequent.items()):
            continue
        score, k = min((scale * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])), frequent, n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["a", "New", "york", "city", "hall", "été", "x_1", "the", "\U0001F600", "zz"]
    texts = [" ".join(rng.choices(vocab, weights=range(1, 11), k=rng.randint(0, 50))) for _ in range(60)]
    texts = [re.sub(r" (?=the)", lambda m: rng.choice([" ", ". ", "\n", ",\t", "  "]), t) for t in texts]
    out = [(t, rng.choice(["en", "en", "fr", None, "und"])) for t in texts]
    return out + [out[0]] * 20 + [(None, "en"), ("", "fr"), (" .,;", None), ("new york city hall " * 40, "en"), ("alone", "xx"),
                                  ("a\x00b \x0b c d\x0cc d", "en")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, rows, monkeypatch, small):
    if small:  # many blocks and parts, triggers everywhere
        monkeypatch.setattr(collocations, "BLOCK", 2000)
        monkeypatch.setattr(collocations, "PERIOD", 2)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, phrase string, part int, block int").repartition(4)
    for args in ({"least": 5}, {"least": 2, "top": 7, "inside": 60}, {"least": 3, "longest": 3}):
        want, frequent, words = brute(rows, **args)
        out = collocations.collocations(frame, **args)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == want
        assert len(want) > 10
    found, n = collocations.frequent_phrases(frame, longest=3, least=3, period=5)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in found.collect()} == frequent
    assert {r["lang"]: r["n"] for r in n.collect() if r["n"]} == {k: v for k, v in words.items() if v}


def test_parse_counts_every_phrase_start_once(spark, rows):
    frame = spark.createDataFrame(rows, "text string, lang string")
    for period in (1, 4, 1000):
        parse = collocations.dictionary(frame, period=period).collect()
        assert sum(r["times"] * r["n"] for r in parse) == sum(len(w) for t, _ in rows for w in pieces(t))
    # A passage in two texts gives the same chunks but at its ends.
    passage = " ".join(f"w{i}" for i in range(400))
    two = spark.createDataFrame([("x y " + passage + " z", "en"), (passage + " u", "en")], "text string, lang string")
    assert sum(r["times"] == 2 for r in collocations.dictionary(two).collect()) > 15


def test_large_counts_and_empty_table(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    frame = spark.createDataFrame([("a b", "en")] * 40, "text string, lang string")
    assert [tuple(r) for r in collocations.collocations(frame, scale=10**17).collect()] == [("en", 1, "a b", 40, 40, 40, 80, 5 * 10**16)]
