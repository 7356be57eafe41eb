"""Quality rules, mixing, BPE, language ID, license scans against brute force."""

import base64
import collections
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabsieve.llm import bpe, langid, license_scan, mixing, quality

tiktoken = pytest.importorskip("tiktoken")
ODD = [(901, None), (902, ""), (903, " \n\t "), (904, "one"), (904, "one"), (None, "a null key here"), (905, "\x85 \xa0 漢字 é\n\né")]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute_quality(text):
    text, w = text or "", split(text)
    n, grams = len(w), collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(n - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if split(x)]
    chars, symbols, copies = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    bad = (100 * symbols > 10 * n or 100 * copies > 50 * len(lines) or chars < 2 * n or chars > 20 * n
           or len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text))
           or 100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 30 * n
           or 100 * sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w) < 50 * n)
    return n, chars, symbols, copies, len(covered), failed, not (failed or bad)


def test_quality(documents):
    rng = random.Random(2)
    rows = list(ODD)
    for i in range(120):
        pool = rng.choice([["a", "b", "cd"], ["Lorem", "IPSUM", "dolor", "sit", "été", "#x", "$$", "1234", "-"], ["WORD", "LOUD", "x"],
                           [f"w{j}" for j in range(300)], ["#", "*ok", "fine"], ["12", "34", "x" * 30]])
        rows.append((i, "".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\n\n", " "]) for _ in range(rng.choice([5, 12, 40, 200])))))
    rows.append((500, "long words here " * 60_000))
    got = sorted((tuple(r) for r in quality.judge(documents(rows)).collect()), key=str)
    assert got == sorted(((k, *brute_quality(t)) for k, t in rows), key=str)
    assert any(r[-1] for r in got) and quality.judge(documents([])).count() == 0
    kept = quality.passing(documents(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, t in rows if brute_quality(t)[-1])


@pytest.mark.parametrize("order", [list(quality.RULES), list(quality.RULES)[::-1]])
def test_quality_is_the_same_in_any_order(documents, order, monkeypatch):
    monkeypatch.setattr(quality, "rule_order", lambda *a, **k: order)
    rows = [(i, f"{'WORD ' * (i % 7)}{'some more words of text ' * 2}{i} # {'x ' * (i % 5)}") for i in range(40)]
    got = sorted(tuple(r) for r in quality.judge(documents(rows)).collect())
    assert got == sorted((k, *brute_quality(t)) for k, t in rows)


def test_mixing(documents):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["b", "b", "b", "a", "é", None])) for i in range(600)]
    rows += [(601, None, "en", "empty"), (602, "", "en", "empty"), (603, "x " * 40, "en", "tiny"), (603, "x " * 40, "en", "tiny")]
    got = [r.asDict() for r in mixing.mixed(documents(rows)).collect()]
    assert len(got) == len(rows) and got and sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    again = mixing.mixed(documents(rows[::-1])).collect()
    assert sorted(map(str, (sorted(r.items()) for r in got))) == sorted(map(str, (sorted(r.asDict().items()) for r in again)))
    by = collections.defaultdict(list)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        by[source[r["doc_id"]]].append(r)
        assert r["taken"] in [n * r["size"] for n in range(4)]
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(sum(r["size"] for r in got))
    for v in by.values():
        size = sum(r["size"] for r in v)
        assert v[0]["source_size"] == size and v[0]["target"] <= 3 * size
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)
    assert mixing.mixed(documents([])).count() == 0
    copies = collections.Counter(r.doc_id for r in mixing.repeated(documents(rows)).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in got if r["doc_id"] != 603)


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 100, None: 100}, 300) == {"a": 187.5, "b": 75.0, None: 37.5}
    # "a" stops at three times its size; the rest is shared 2 : 1
    assert mixing.quotas({"a": 10, "b": 100, None: 190}, 300) == {"a": 30.0, "b": 180.0, None: 90.0}


def test_flow_over_overlapping_sources():
    # the shared pattern serves "b", which has nothing else; "a" repeats its own documents only as needed
    used = mixing.cheapest_flow({("a",): 100, ("a", "b"): 50}, {"a": 90, "b": 60})
    assert used == {("a",): 90, ("a", "b"): 60}
    rerouted = mixing.cheapest_flow({("a", "b"): 10, ("b", "c"): 10}, {"a": 30, "b": 20, "c": 10})
    assert rerouted == {("a", "b"): 30, ("b", "c"): 30}


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_round_trip(documents, ranks):
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
    rng = random.Random(6)
    pool = [chr(x) for x in [*range(0, 400), *range(0x2000, 0x2070), 0x3000, 0x85, 0xA0, 0x1680, 0x180E, 0x1F600, 0x4E00, 0xAC00, 0xFEFF]]
    rows = [*ODD, (1, "a" * 3000), (2, " " * 400 + "x"), (3, "<|endoftext|> don't I'll 12345"), (4, "ab" * 800)]
    rows += [(10 + i, "".join(rng.choices(pool, k=rng.randint(0, 80)))) for i in range(200)]
    encoded = bpe.encode(documents(rows), ranks, public_tokenizers.PATTERN)
    got = bpe.decode(encoded, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in got), key=str) == sorted(
        ((k, known.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows), key=str)
    assert bpe.encode(documents([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_recursion_is_continued(ranks, monkeypatch):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    word = "x" + "qzj" * 15
    want = codec.encode([word])[0].tolist()
    codec.forget()
    monkeypatch.setattr(bpe, "_STEP_SQL", bpe._STEP_SQL.replace(f"step < {bpe.STEPS}", "step < 3"))
    monkeypatch.setattr(bpe, "STEPS", 3)
    assert codec.encode([word])[0].tolist() == want


def test_bpe_of_very_long_words(ranks):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
    rng = random.Random(2)
    letters = [chr(i) for i in range(97, 123)]
    words = ["".join(rng.choices(letters, k=100_000)), "a" * 3001, "=" * 4097, "abcdefg" * 1500, "the" * 900 + "ing" * 500,
             "\u4e2d\u56fd\u4eba\u6c11" * 700, "\xe9" * 2000]
    words += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60)) for _ in range(200)] + [
        "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(9000))]
    words += ["".join(rng.choices(["tion", "ment", "er", "un", "q", "anti"], k=400)) for _ in range(20)]
    start = time.perf_counter()
    flat, offsets = codec.encode(words)
    assert time.perf_counter() - start < 60
    for w, lo, hi in zip(words, offsets[:-1], offsets[1:], strict=True):
        assert flat[lo:hi].tolist() == known.encode_ordinary(w)
    codec.forget()
    assert not codec.known


def brute_posteriors(e, move):
    n, k = e.shape
    a, b = np.zeros((n, k)), np.ones((n, k))
    v = np.full(k, 1 / k)
    for t in range(n):
        v = (v @ move) * e[t]
        v = v / v.sum()
        a[t] = v
    for t in range(n - 2, -1, -1):
        b[t] = move @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    return (p / p.sum(axis=1, keepdims=True)).sum(axis=0)


def test_forward_backward_in_pieces(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 8)
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 8, 9, 40, 1, 17, 0, 64])
    e = rng.random((counts.sum(), 3)) + 1e-3
    move = langid._unit(rng.random((3, 3)))
    got, at = langid.expected_words(e.astype(np.float32), counts, move), 0
    for i, n in enumerate(counts):
        want = brute_posteriors(e[at:at + n], move) if n else np.zeros(3)
        assert got[i] == pytest.approx(want, abs=1e-4)
        at += n


def test_language_id(documents):
    rng = random.Random(8)
    vocab = {"xx": ["kora", "melu", "tiso", "bena", "oru"], "yy": ["schnitt", "zwerg", "pflug", "krass", "wicht"]}
    rows = [(i, " ".join(rng.choices(vocab[x], k=30)), x, "s") for i in range(300) for x in [rng.choice(["xx", "yy"])]]
    rows += [(1000, None, "xx", "s"), (1001, "12 -- 34", "yy", "s"), (1002, "", None, "s"), (None, "zwerg krass", None, "s"), (1, "kora melu", "yy", "s")]
    rows += [(2000, " ".join(rng.choices(vocab["yy"], k=700)) + " kora melu", None, "s")]
    got = langid.identify(documents(rows), learn=~langid.held_out()).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r for r in got}
    true = {r[0]: r[2] for r in rows[:300] if r[0] != 1}
    assert sum(named[k].lang_pred == v for k, v in true.items()) >= 0.98 * len(true)
    assert all(named[k].lang_pred == "und" and named[k].score == 0 for k in (1000, 1001, 1002))
    assert named[2000].lang_pred == "yy" and named[None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(documents([(1, "word", None, "s")])).collect()} == {"und"}
    assert langid.identify(documents([])).count() == 0


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_license_scan(documents):
    texts = {1: "Released under the MIT License.", 2: "the mit-license, mit license MIT LICENSE", 3: "Apache\nLicense general public licence",
             4: "This work is licensed under the GNU General Public License, version 3. General public license",
             5: "Licensed under CC BY-NC 4.0.", 6: "mit x license", 7: None, 8: "", 9: "mit", 10: "été mit\x85license MIT\xa0license",
             11: "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following "
                 "conditions are met", 12: "general public license " * 3000, 13: "licensed under the", None: "mit license"}
    rows = [*texts.items(), (14, "mit license"), (14, "mit license")]
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan_documents(documents(rows)).collect()}
    for key, text in texts.items():
        w = license_words(text)
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        r = got[(key, len(w))]
        assert r.n_base == len(places), key
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None)), key
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    labels = {key: r.labels for (key, _), r in got.items()}
    assert (labels[5], labels[11], labels[13]) == ("cc-by-nc", "bsd", "")
    assert license_scan.scan_documents(documents([])).count() == 0


def test_many_patterns_are_planned_in_spark(spark, documents, monkeypatch):
    rng = random.Random(9)
    names = [None, "a", "b", "é", "z", *[f"s{i}" for i in range(40)]]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 9, 40])), None, rng.choice(names)) for i in range(600)]
    docs = documents(rows)
    want = sorted(map(tuple, mixing.mixed(docs).collect()), key=str)
    pairs = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.array("source", F.lit("a"))).when(
        F.pmod("doc_id", F.lit(7)) == 0, F.array("source", F.lit("z"))).otherwise(F.array("source"))
    key = lambda r: (r["doc_id"], r["_times"])
    both = mixing.mix(docs, pairs)
    flow, targets = sorted(map(key, both[0].collect())), sorted(map(tuple, both[1].collect()), key=str)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 10)
    assert sorted(map(tuple, mixing.mixed(docs).collect()), key=str) == want
    again = mixing.mix(docs, pairs)
    assert sorted(map(tuple, again[1].collect()), key=str) == targets
    # Several flows may be as cheap; each source's words and the passes of a group are the same.
    taken = [{s: sum(r["_size"] * r["_times"] for r in got if s in r["_members"]) for s in names} for got in (both[0].collect(), again[0].collect())]
    assert sum(r[1] for r in flow) > 0 and all(abs(taken[0][s] - taken[1][s]) <= 80 for s in names)


def test_own_names_may_clash(documents):
    docs = documents([(1, "a b c", None, "s"), (2, "d e", None, "t"), (3, None, None, None)])
    for name in ("_size", "_ROW", "_p"):
        mixed = mixing.repeated(docs.withColumnRenamed("kept", name))
        assert mixed.columns == docs.withColumnRenamed("kept", name).columns
        assert sorted(r[0] for r in mixed.collect()) == sorted(r[0] for r in mixing.repeated(docs).collect())


def test_thirty_thousand_sources(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "'one two three' AS text", "concat('host', pmod(id, 30000)) AS source")
    rows = mixing.mixed(docs).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("most")).first()
    assert rows["n"] == 60_000 and rows["most"] <= 18 and abs(rows["taken"] - 180_000) < 60_000
