"""License scans by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of every text is joined by hash to the places of that pair in the
templates. A hit of text position i with template position j votes for the diagonal i - j. Votes of one
diagonal, and then of its neighbours, are merged; a template is found where enough of its pairs agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count wherever their words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Longer wordings; a share of their word pairs on neighbouring diagonals is enough.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}
#: Diagonals this near count as one match with a few words inserted or left out.
NEAR = 3
#: Share of a template's word pairs that a match must hold.
COVERAGE = 0.8
#: Word pairs of a template fit the bits of one number; the table of all of them is broadcast up to MOST_ROWS.
MOST_PAIRS, MOST_ROWS = 62, 100_000


def _template_rows(phrases: Mapping[str, str], templates: Mapping[str, str]) -> list[tuple]:
    rows = []
    for number, (wording, label, exact) in enumerate(
            [(w, x, True) for w, x in phrases.items()] + [(w, x, False) for w, x in templates.items()]):
        words = wording.split()
        if not 2 <= len(words) <= MOST_PAIRS + 1:
            raise ValueError(f"a template has 2 to {MOST_PAIRS + 1} words: {wording!r}")
        rows += [(number, label, exact, len(words) - 1, j, a, b) for j, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return rows


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
         templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per verified match: key, template (number), label, exact, start (word), words, share.

    Phrases (`exact`) need all their word pairs on one diagonal, so their words stand consecutively from
    `start` on. Templates need `coverage` of their pairs within NEAR diagonals; of neighbouring diagonals
    that pass, only the one with the most pairs, then the first, is a match. Hash hits are confirmed on
    the words themselves.

    The template table is broadcast (its size is checked); texts are never shuffled, only hits are. Null and empty texts have no match. Matches of rows that repeat a key, or
    have none, are reported for that key together. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = _template_rows(phrases, templates)
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} word pairs in all templates")
    table = F.broadcast(spark.createDataFrame(
        rows, "template int, label string, exact boolean, pairs int, place int, first string, second string",
    ).withColumn("_hash", F.xxhash64("first", "second")))
    words = _words(text)
    pairs = (
        df.select(F.col(key).alias("_key"), words.alias("_words")).filter(F.size("_words") >= 2)
        .select("_key", F.posexplode(F.arrays_zip(
            F.col("_words").alias("a"), F.slice("_words", F.lit(2), F.size("_words") - 1).alias("b"))).alias("_at", "_pair"))
        .select("_key", "_at", F.col("_pair.a").alias("a"), F.col("_pair.b").alias("b"), F.xxhash64("_pair.a", "_pair.b").alias("_hash")))
    hits = pairs.join(table, "_hash").filter((F.col("a") == F.col("first")) & (F.col("b") == F.col("second")))
    votes = hits.groupBy("_key", "template", "label", "exact", "pairs", (F.col("_at") - F.col("place")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("_mask"), F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    own = Window.partitionBy("_key", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    merged = votes.withColumns({
        "_mask": F.when(F.col("exact"), F.col("_mask")).otherwise(F.bit_or("_mask").over(own)),
        "_from": F.when(F.col("exact"), F.col("_from")).otherwise(F.min("_from").over(own)),
        "_to": F.when(F.col("exact"), F.col("_to")).otherwise(F.max("_to").over(own))})
    scored = merged.withColumn("share", F.bit_count("_mask") / F.col("pairs"))
    rank = F.struct("share", -F.col("diagonal"))
    best = F.max(rank).over(own)
    found = scored.withColumn("_best", best).filter(
        F.when(F.col("exact"), F.col("share") == 1.0)
        .otherwise((F.col("share") >= coverage) & (rank == F.col("_best"))))
    return found.select(
        F.col("_key").alias(key), "template", "label", "exact", F.col("_from").alias("start"),
        (F.col("_to") - F.col("_from") + 2).alias("words"), "share")


def _words(text: str):
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def _joined(flag) -> object:
    return F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("label")))), ",")


def scan_documents(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
                   templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `score` is the best share of a template's word pairs found (1 for a phrase), 0 without a match.
    """
    base = F.col("exact")
    found = scan(df, key, text, phrases, templates).groupBy(F.col(key).alias("_key")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), _joined(base).alias("base_labels"),
        _joined(F.lit(True)).alias("labels"), F.max("share").alias("score"))
    counts = df.select(F.col(key), F.size(_words(text)).cast("bigint").alias("n_words"))
    return counts.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def template_list(phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> Sequence[tuple]:
    """The template table as rows, for the SQL twin."""
    return _template_rows(phrases, templates)
