"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.stages import written

BLANKS = " \t\n\x0b\x0c\r"
_ID_SPAN = 2**64


def without_blanks(text: Column) -> Column:
    """The text without any of `[\\x20\\x09-\\x0D]`; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _wide(number: Column | str) -> Column:
    return (F.col(number) if isinstance(number, str) else number).cast("decimal(38,0)")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_key, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks. The row with the longest original text
    (in code points), then the smallest key, stays. The content hash (MD5, 128 bits) finds the groups;
    the grouping then also compares the normalised bytes, so colliding texts stay apart. Copies
    collapse in the map tasks, hence a group of any size sends one row per task. Rows look their group
    up by hash alone, unless some hash was seen to hold several texts: then by a second digest as well.

    Null texts are empty texts, and all of them are one group. A null key sorts after every other key.
    Rows that repeat a key with the same text all get the same answer. Other columns are ignored. An
    empty table gives an empty result.
    """
    return _decided(df, key, text).select(
        F.col("_key").alias(key), "keep_key", "group_size", F.col("_key").eqNullSafe(F.col("keep_key")).alias("kept"), "text_sha256")


def _decided(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key and _len of every row with keep_key, keep_len, group_size and text_sha256 of its group."""
    rows = df.select(
        F.col(key).cast("bigint").alias("_key"), without_blanks(F.col(text)).alias("_norm"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("_len"))
    rows = rows.withColumn("_hash", F.md5("_norm"))
    # One number orders a group: longer texts first, then smaller keys; a null key comes last.
    place = F.coalesce(_wide("_key") + _wide(F.lit(str(2**63))), _wide(F.lit(str(_ID_SPAN - 1))))
    rank = _wide("_len") * _wide(F.lit(str(_ID_SPAN))) - place
    groups = rows.withColumn("_rank", rank).groupBy("_hash", "_norm").agg(
        F.max("_rank").alias("_best"), F.max("_len").alias("keep_len"), F.count(F.lit(1)).alias("group_size"))
    place = F.pmod(-F.col("_best"), _wide(F.lit(str(_ID_SPAN))))
    reps = written(groups.select(
        "_hash", F.sha2("_norm", 256).alias("text_sha256"), "group_size", "keep_len",
        F.when(place != _wide(F.lit(str(_ID_SPAN - 1))), (place - _wide(F.lit(str(2**63)))).cast("bigint"))
        .alias("keep_key")), "groups")
    collided = written(reps.groupBy("_hash").count().filter("count > 1").select("_hash"), "collided")
    if collided.isEmpty():
        found = rows.select("_key", "_len", "_hash").join(reps, "_hash")
    else:
        digest = F.sha2("_norm", 256).alias("text_sha256")
        found = rows.select("_key", "_len", "_hash", digest).join(reps, ["_hash", "text_sha256"])
    return found.select("_key", "_len", "keep_key", "keep_len", "group_size", "text_sha256")


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the longest original text, then the smallest
    key (null last). Rows are told apart by key, length and text digest, so a repeated or null key takes no other
    text with it; rows equal in all three (repeated rows, for one) leave the one with the smallest text and then
    the smallest hash of its other columns. Null texts are empty texts. An empty table stays empty.
    """
    taken = {c.lower() for c in df.columns}
    names = [next(n for n in (f"_{i}_{k}" for k in range(len(taken) + 1)) if n not in taken) for i in ("key", "len", "sha")]
    own = [F.col(key).cast("bigint"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint"),
           F.sha2(without_blanks(F.col(text)), 256)]
    rows = df.withColumns(dict(zip(names, own, strict=True)))
    found = written(_decided(df, key, text).select(
        *[F.col(c).alias(n) for c, n in zip(("_key", "_len", "text_sha256"), ("k", "l", "s"), strict=True)],
        (F.col("_key").eqNullSafe(F.col("keep_key")) & (F.col("_len") == F.col("keep_len"))).alias("stays")), "decided")
    same = F.lit(True)
    for n, c in zip(names, ("k", "l", "s"), strict=True):
        same = same & F.col(n).eqNullSafe(F.col(c))
    gone = written(found.filter(~F.col("stays")).select("k", "l", "s").distinct(), "gone")
    again = written(found.filter("stays").groupBy("k", "l", "s").count().filter("count > 1").select("k", "l", "s"), "again")
    left = rows.join(gone, same, "left_anti")
    if again.isEmpty():
        return left.select(df.columns)
    repeated = left.join(again, same, "left_semi")
    first = F.min_by(F.struct(*df.columns), F.struct(F.col(text), F.xxhash64(*[c for c in df.columns if c != text])))
    one = repeated.groupBy(*names).agg(first.alias("row")).select("row.*")
    return left.join(again, same, "left_anti").select(df.columns).unionAll(one)
