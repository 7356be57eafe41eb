"""Exact, substring and near duplicates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tabsieve.llm import components, exact_dedup, near_dedup, substring_dedup, words

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def split(text):
    return [w for w in re.split(f"[{BLANKS}]+", text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghiéßñ漢") for _ in range(rng.randint(1, 9))) for _ in range(n)]


ODD = [(901, None), (902, ""), (903, " \n\t "), (904, "one"), (905, "one"), (906, "\x85a\xa0b c"), (None, "lonely null key"), (None, None),
       (907, "two words"), (907, "two words")]


def test_words_by_bytes():
    texts = [None, "", "  a b\tc ", "x", "\x0b\x0cé y  z\r\n", "end"]
    data, offsets = words.utf8(__import__("pyarrow").array(texts))
    starts, ends, bounds = words.spans(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in texts for w in split(t)]
    assert list(np.diff(bounds)) == [len(split(t)) for t in texts]
    hashes = words.hash_words(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(got))


def test_window_hashes_do_not_depend_on_place():
    v = np.arange(1, 1 << 19, dtype=np.uint64) % np.uint64(97)
    h = words.hash_windows(v, 20)
    assert len(h) == len(v) - 19
    assert (h[97:] == h[:-97]).all()
    assert len(np.unique(h)) == 97


def brute_exact(rows):
    by = collections.defaultdict(list)
    for key, text in rows:
        by[re.sub(f"[{BLANKS}]", "", text or "")].append((-len(text or ""), key is None, key or 0, key))
    out = []
    for key, text in rows:
        norm = re.sub(f"[{BLANKS}]", "", text or "")
        keep = min(by[norm])[3]
        out.append((key, keep, len(by[norm]), key == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(documents):
    rows = [*ODD, (1, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (-5, "ab\n"), (6, "b" * 200_000), (7, "b " * 200_000)]
    got = exact_dedup.exact_groups(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)
    assert exact_dedup.exact_groups(documents([])).count() == 0
    kept = exact_dedup.drop_copies(documents([(1, "a b"), (2, "ab"), (3, "c")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert kept.columns[0] == "doc_id" and "component" in kept.columns


def brute_substring(rows, window=50):
    first = {}
    for key, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1 if key is not None else 0):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, key), key)
    out = []
    for key, text in rows:
        w = split(text)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1 if key is not None else 0):
            if first[tuple(w[i:i + window])] < key:
                keep[i:i + window] = [False] * window
        out.append((key, len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return sorted(out, key=str)


def test_remove_repeats(documents):
    rng = random.Random(5)
    vocab = vocabulary(rng)
    passage = [rng.choice(vocab) for _ in range(120)]
    rows = list(ODD)
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 260))]
        if i % 3 == 0:
            n, at = rng.choice([48, 49, 50, 51, 77, 120]), rng.randint(0, len(body))
            body[at:at] = passage[:n] if i % 2 else passage[-n:]
        rows.append((i * 7 % 61 - 20, " ".join(body)))
    rows += [(500, rows[12][1]), (501, rows[12][1] + " tail"), (502, "a " * 300), (503, "a " * 50), (504, "a " * 49)]
    got = [tuple(r) for r in substring_dedup.remove_repeats(documents(rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == brute_substring(rows)
    assert substring_dedup.remove_repeats(documents([])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(documents([]), window=31)


def test_cover_meets_every_shift():
    cover = set(substring_dedup.COVER)
    period = substring_dedup.PERIOD
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def brute_near(rows, k=3, percent=85):
    sets = {}
    for key, text in rows:
        w = split(lower(text))
        sets[key] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((key, len(sets[key]), find(key), find(key) == key) for key in sets)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_components(documents, k, percent):
    rng = random.Random(11)
    vocab = vocabulary(rng)
    rows = [r for r in ODD if r[0] not in (None, 907)]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 8, 20, 60, 200, 500]))]
        for c in range(6):
            body = list(base)
            for _ in range(int(len(body) * rng.choice([0, 0.01, 0.03, 0.06, 0.1]))):
                body[rng.randrange(len(body))] = rng.choice(vocab)
            rows.append((g * 6 + c, " ".join(w.upper() if c % 2 else w for w in body)))
    got = sorted(tuple(r) for r in near_dedup.near_components(documents(rows), shingle=k, percent=percent).collect())
    assert got == brute_near(rows, k, percent)


def test_near_components_in_blocks(documents, monkeypatch):
    """Buckets over the small size go through the block products and give the same components."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(3)
    base = [rng.choice(vocabulary(rng)) for _ in range(150)]
    rows = []
    for i in range(30):
        body = list(base)
        for _ in range(rng.randint(0, 9)):
            body[rng.randrange(len(body))] = f"w{rng.random()}"
        rows.append((i, " ".join(body)))
    assert sorted(map(tuple, near_dedup.near_components(documents(rows)).collect())) == brute_near(rows)


def test_near_odd_rows(documents):
    got = {r.n_shingles: tuple(r) for r in near_dedup.near_components(documents([(None, "a b c d"), (None, None)])).collect()}
    assert got == {2: (None, 2, None, True), 0: (None, 0, None, True)}
    assert near_dedup.near_components(documents([])).count() == 0
    twice = near_dedup.near_components(documents([(1, "a b c"), (1, "a b c"), (2, "A B C")])).collect()
    assert sorted(map(tuple, twice)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    kept = near_dedup.drop_near_copies(documents([(1, "a b c"), (2, "A B C"), (3, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 300)]
    edges += [(500, x) for x in range(400, 480)] + [(1, 1), (7, None), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "s long, d long"), "s", "d").collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components.connected_components(spark.createDataFrame([], "s long, d long"), "s", "d").count() == 0


def test_copies_are_rows_not_keys(documents):
    rows = [(0, "b"), (1, "b"), (1, "a"), (2, "x y"), (2, "x y"), (None, "n"), (None, "n"), (None, "m"), (3, None), (4, "")]
    kept = exact_dedup.drop_copies(documents(rows))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(0, "b"), (1, "a"), (2, "x y"), (None, "n"), (None, "m"), (3, None)], key=str)
    assert kept.columns == documents(rows).columns
    assert exact_dedup.drop_copies(documents([])).count() == 0


def test_near_copies_are_rows_not_keys(documents):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(0, long), (1, long + " end"), (1, "quite another text"), (2, "p q r s"), (2, "p q r s"), (None, long + " z"), (None, None),
            (None, "alone here now"), (None, "alone here now"), (5, "")]
    kept = near_dedup.drop_near_copies(documents(rows))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(0, long), (1, "quite another text"), (2, "p q r s"), (None, None), (None, "alone here now"), (5, "")], key=str)
    unique = near_dedup.drop_near_copies(documents([r for r in rows if r[0] in (0, 5)]))
    assert {r.doc_id for r in unique.collect()} == {0, 5}
