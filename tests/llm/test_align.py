import hashlib
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tabsieve.llm import align

FILES = [align.read_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def byte_of():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 256
    for x in range(256):
        if x in visible:
            table[chr(x)] = x
        else:
            table[chr(extra)] = x
            extra += 1
    return table


def brute(texts):
    """Token by token: byte ranges, links by comparing all ranges, groups by common ends."""
    a_side = Tokenizer.from_buffer(FILES[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_proto=FILES[1])
    table = byte_of()

    def ranges(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    docs, counts = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a = a_side.encode(" " + text, add_special_tokens=False)
        b = b_side.encode(text)
        raw_a = [bytes(table[c] for c in t) for t in a.tokens]
        raw_b = []
        for i in b:
            p = b_side.id_to_piece(i)
            raw_b.append(bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append(None)
            continue
        ra, rb = ranges(raw_a), ranges(raw_b)
        links = [(x, y) for x, (s, e) in zip(a.ids, ra, strict=True) for y, (p, q) in zip(b, rb, strict=True) if s < q and p < e]
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, lo = [], 0
        for hi in common:
            groups.append(",".join(str(x) for x, (s, e) in zip(a.ids, ra, strict=True) if lo <= s and e <= hi) + "|"
                          + ",".join(str(y) for y, (s, e) in zip(b, rb, strict=True) if lo <= s and e <= hi))
            lo = hi
        counts.update(links)
        docs.append((len(a.ids), len(b), groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
                        sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts, top


TEXTS = ["Hello world, hello there", "", None, "a  b ", " x", "▁y <s> <0x41>", "　a\t\n", "é ﬁ café",
         "\x00 a", "中文\U0001F600 text", "<|endoftext|> is text", "the the the the the", "don't   stop\n\n\nnow 12345",
         "Hello world, hello there"] + [f"word{i % 7} and the {i * i} of it" for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, run string, part string, groups string").repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(docs, monkeypatch, small):
    if small:  # many runs, several merge levels
        for name, value in (("SPILL_DOCS", 3), ("PORTION", 40), ("FAN", 2)):
            monkeypatch.setattr(align, name, value)
    want, counts, top = brute([*TEXTS, TEXTS[0]])
    keys = [None if i == 5 else i for i in range(len(TEXTS))] + [0]
    out = align.align(docs, *FILES, show=align.group_digest, shown="groups_sha256")
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((k, *w) for k, w in zip(keys, want, strict=True)), key=str)
    runs = align.spilled(docs, *FILES).filter("part IS NOT NULL")
    pairs = align.linked_pairs(align.pair_counts(runs.select("part", "run", "pairs", "totals"))).collect()
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs} == {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_long_text_is_cut_where_no_token_crosses(spark, monkeypatch):
    text = "some words, 'and' it's été a  b 12 " * 300 + "z" * 3000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = align.align(frame, *FILES).collect()
    monkeypatch.setattr(align, "PORTION", 50)
    assert align.align(frame, *FILES).collect() == whole
    a = Tokenizer.from_buffer(FILES[0]).encode(" " + text, add_special_tokens=False)
    assert whole[0]["n_a"] == len(a.ids)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(none, *FILES).count() == 0
    assert [r["n_links"] for r in align.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), *FILES).collect()] == [0]
