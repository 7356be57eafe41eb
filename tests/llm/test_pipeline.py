"""The pipeline against brute force over its stages, and the registered queries on the small tables."""

import base64
import collections
import hashlib

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tabsieve.llm import bpe, mixing
from tests.llm.test_dedup import brute_exact, brute_near
from tests.llm.test_text import brute_quality

tiktoken = pytest.importorskip("tiktoken")
SF = "/root/testdata/sf0.001"


def brute_mix(rows):
    """Copies of each document in the mix, by the contract's rules on whole sources."""
    sizes, by = collections.Counter(), collections.defaultdict(list)
    for key, text, source in rows:
        n = len((text or "").encode().split())
        sizes[source] += n
        h = int(hashlib.md5(f"42|{key}".encode()).hexdigest()[:15], 16)
        by[source].append((h, key, n))
    target = mixing.quotas(dict(sizes), sum(sizes.values()))
    out = {}
    for source, docs in by.items():
        passes, rest = divmod(int(target[source]), sizes[source]) if sizes[source] else (1, 0)
        total = 0
        for _, key, n in sorted(docs):
            total += n
            out[key] = passes + int(rest > 0 and 2 * total - n <= 2 * rest)
    return out


def test_pipeline(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if brute_quality(r[1])[-1]]
    kept = {key for key, _, _, stays, _ in brute_exact([r[:2] for r in rows]) if stays}
    rows = [r for r in rows if r[0] in kept]
    kept = {key for key, _, _, stays in brute_near([r[:2] for r in rows], 5, 80) if stays}
    rows = [r for r in rows if r[0] in kept]
    copies = brute_mix(rows)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})
    want = collections.Counter()
    for key, text, _ in rows:
        tokens = known.encode_ordinary(text)
        digest = hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in tokens)).hexdigest()
        want[(key, len(tokens), digest, hashlib.sha256(text.encode()).hexdigest())] += copies[key]
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and len(got) > 20


def test_stages_keep_the_columns(spark, documents):
    odd = [(1, None), (2, ""), (None, "words " * 3), (3, "some plain words that are long enough to stay in the corpus"), (3, None)]
    for rows in ([], odd):
        docs = documents(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("name", [n for n in contract.queries() if n[:2] == "op" and n in contract.oracle_sql()])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    res = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in res.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
