"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import align, bpe, collocations, decontaminate, exact_dedup, html_text, langid, license_scan, mixing, near_dedup, quality, substring_dedup, url_filter
from tabsieve.llm.license_scan import CAPITALS, SMALL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


@_query("op1_exact_dedup", EXACT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_dedup.exact_groups(_documents(spark, sf))
    return out.withColumnRenamed("keep_key", "keep_id")


SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM k),
gone AS (SELECT doc_id, list(DISTINCT j) AS js
         FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE lo < doc_id) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM words LEFT JOIN (SELECT doc_id, unnest(js) AS j FROM gone) g USING (doc_id, j) WHERE g.j IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@_query("op2_substring_dedup", SUBSTRING_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(
        _documents(spark, sf), emit=substring_dedup.kept_digest, emitted="kept_sha256 string")


NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q USING (g)
                           WHERE p.doc_id <> q.doc_id GROUP BY 1, 2) x
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.lo AS component_id, d.doc_id = c.lo AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS lo FROM r GROUP BY 1) c USING (doc_id)
"""


@_query("op3_near_dedup", NEAR_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_components(_documents(spark, sf))


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM k WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT d.doc_id, t, w, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g'))
            OR 100 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 30 * n_words
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < 50 * n_words) AS kept
FROM f
"""


@_query("op5_quality_rules", QUALITY_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(_documents(spark, sf))


MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS size,
                  ('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
      FROM d GROUP BY source),
o AS (SELECT *, sum(ss) OVER () AS total, sum(w) OVER () AS ws, row_number() OVER (ORDER BY 3.0 * ss / w, source NULLS LAST) AS k,
             sum(3 * ss) OVER q - 3 * ss AS capped, sum(w) OVER q - w AS wc
      FROM s WINDOW q AS (ORDER BY 3.0 * ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT k, total - capped AS rest, ws - wc AS wr FROM o WHERE (total - capped) * w <= 3 * ss * (ws - wc) ORDER BY k LIMIT 1),
t AS (SELECT source, ss, CASE WHEN o.k < c.k THEN (3 * ss)::DOUBLE ELSE (rest * w)::DOUBLE / wr::DOUBLE END AS target FROM o, c),
n AS (SELECT source, ss, target, CASE WHEN ss > 0 THEN floor(target)::BIGINT // ss ELSE 1 END AS passes,
             CASE WHEN ss > 0 THEN floor(target)::BIGINT % ss ELSE 0 END AS rest FROM t),
x AS (SELECT d.*, n.*, sum(size) OVER (PARTITION BY n.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, ss AS source_size, target,
       (size * (passes + CASE WHEN rest > 0 AND 2 * cum - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""


@_query("op6_source_mixing", MIXING_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _digests(ids: np.ndarray, decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes, one row per row of `docs`. Null and empty texts have no
    tokens; null and repeated keys and repeated rows are rows of their own; an empty table stays empty."""
    ranks = bpe.read_ranks(public_tokenizers.path(vocabulary))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


@_query("op8_byte_bpe")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return token_digests(_documents(spark, sf))

_RULE_VALUES = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in url_filter.RULES)
_HOST_SQL = f"translate(regexp_extract(coalesce({{u}}, ''), '^.*?://([^/?#]*)', 1, 's'), '{CAPITALS}', '{SMALL}')"
_PATH_SQL = "regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_NODE_SQL = _HOST_SQL + " || regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^#]*)', 1, 's')"
_FIT_SQL = """(SELECT {what} FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))"""

# The twin takes absolute and rooted link targets; the tables hold no others.
URL_SQL = rf"""
WITH RECURSIVE rules(rv, rh, rp, r) AS (VALUES {_RULE_VALUES}),
t AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0),
                                         '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                          regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0),
                                         '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS x FROM pages),
e AS (SELECT url AS src, CASE WHEN contains(x, '://') THEN x ELSE 'http://' || {_HOST_SQL.format(u='url')} || x END AS dst
      FROM t WHERE x <> '' AND contains(coalesce(url, ''), '://')),
k AS (SELECT {_NODE_SQL.format(u='src')} AS a, {_NODE_SQL.format(u='dst')} AS b, src, dst FROM e),
u AS (SELECT a, b FROM k UNION SELECT b, a FROM k UNION SELECT a, a FROM k UNION SELECT b, b FROM k),
c AS (SELECT a, b FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a),
n AS (SELECT a AS node, {_HOST_SQL.format(u='src')} AS host, {_PATH_SQL.format(u='src')} AS path FROM k
      UNION SELECT b, {_HOST_SQL.format(u='dst')}, {_PATH_SQL.format(u='dst')} FROM k),
v AS (SELECT node, {_FIT_SQL.format(what="arg_max(rv, length(r))")} AS rv FROM n),
al AS (SELECT c.a AS node, bool_or(rv = 'allow') AS allowed FROM c JOIN v ON v.node = c.b WHERE rv IS NOT NULL GROUP BY 1),
p AS (SELECT page_id, {_HOST_SQL.format(u='url')} AS host, {_PATH_SQL.format(u='url')} AS path,
             {_NODE_SQL.format(u='url')} AS node FROM pages),
j AS (SELECT p.*, {_FIT_SQL.format(what="arg_max(r, length(r))")} AS rule, {_FIT_SQL.format(what="arg_max(rv, length(r))")} AS rv FROM p)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN al USING (node)
"""


@_query("op4_url_filters", URL_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_pages(_pages(spark, sf))


_PAIR_VALUES = ", ".join(
    f"({n}, '{x}', {str(e).lower()}, {m}, {j}, '{a}', '{b}')" for n, x, e, m, j, a, b in license_scan.template_list())

LICENSE_SQL = rf"""
WITH tp(t, label, exact, m, j, a, b) AS (VALUES {_PAIR_VALUES}),
d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS i, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT doc_id, t, label, exact, m, i - j AS g, bit_or((1::BIGINT << j)) AS mask, min(i) AS i FROM p JOIN tp USING (a, b)
      GROUP BY 1, 2, 3, 4, 5, 6),
s AS (SELECT x.doc_id, x.t, x.label, x.exact, x.m, x.g, min(y.i) AS i,
             bit_count(bit_or(y.mask)) / x.m AS share
      FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.t = y.t AND (abs(x.g - y.g) <= {license_scan.NEAR} AND NOT x.exact OR x.g = y.g)
      GROUP BY 1, 2, 3, 4, 5, 6),
f AS (SELECT * FROM s WHERE exact AND share = 1 OR NOT exact AND share >= {license_scan.COVERAGE} AND NOT EXISTS (
        SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.t = s.t AND abs(o.g - s.g) <= {license_scan.NEAR}
          AND (o.share > s.share OR o.share = s.share AND o.g < s.g))),
r AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(i) FILTER (exact) AS first_word, max(i) FILTER (exact) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM f GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (doc_id)
"""


@_query("op10_license_scans", LICENSE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_documents(_documents(spark, sf))


@_query("op9_language_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = langid.identify(_documents(spark, sf), learn=~langid.held_out())
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query("op7_html_extraction")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = html_text.extract(_pages(spark, sf))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


# Windows of the items and of the documents are joined as texts, by their number of words.
LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS k,
             unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 2, 2))) AS i FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
s AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
m AS (SELECT s.doc_id, s.i, s.k, q.item_id FROM s JOIN q ON q.k = s.k AND q.g = array_to_string(s.w[s.i:s.i + s.k - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS x FROM m GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(x), 0) AS n_items,
       sha256(coalesce(array_to_string(x, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@_query("op11_benchmark_decontamination", LEAK_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@_query("op12_tokenizer_alignment")
def _(spark: SparkSession, sf: str) -> DataFrame:
    a_json, b_model = (align.read_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(_documents(spark, sf), a_json, b_model, show=align.group_digest, shown="groups_sha256")


COLLOCATION_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
k AS (SELECT *, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * k.a // (l.a + r.a))::BIGINT AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, array_to_string(w[i:i + q - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c)) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@_query("op13_phrase_collocations", COLLOCATION_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf))
