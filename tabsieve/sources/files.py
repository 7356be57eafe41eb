"""Dataset registry, CSV scans, file integrity and normalised loading."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import NativeFile
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.operators.clean import (
    IntegrityError, align, clean, feature_columns, numeric_columns, recode_label, sentinel_to_null,
)


@dataclass(frozen=True)
class Dataset:
    """Where a labelled table lives and how to read it."""

    name: str
    path: str
    target: str
    positive: object = 1
    sentinel: float | None = None
    drop: tuple[str, ...] = ()
    suspicious: str | None = None
    schema: T.StructType | str | None = None
    sha256: dict[str, str] = field(default_factory=dict)
    on_mismatch: str = "fail"
    common: dict[str, str] = field(default_factory=dict)


# The three published tables the protocol was designed for, with the names of their
# six shared features. Paths are filled in by `register`.
COMMON_FEATURES = {
    "long_url": ("length_url", "URLLength", "url_len"),
    "long_dominio": ("domain_length", "DomainLength", "dom_len"),
    "dominio_es_ip": ("domain_in_ip", "IsDomainIP", "is_ip"),
    "n_interrogacion": ("qty_questionmark_url", "NoOfQMarkInURL", "qm_cnt"),
    "n_igual": ("qty_equal_url", "NoOfEqualsInURL", "eq_cnt"),
    "n_ampersand": ("qty_and_url", "NoOfAmpersandInURL", "amp_cnt"),
}


def known_datasets(root: str) -> dict[str, Dataset]:
    def shared(i: int) -> dict[str, str]:
        return {k: v[i] for k, v in COMMON_FEATURES.items()}

    return {
        "vrbancic": Dataset("vrbancic", f"{root}/vrbancic", "phishing", 1, -1.0, on_mismatch="warn", common=shared(0)),
        "phiusiil": Dataset("phiusiil", f"{root}/phiusiil", "label", 0, None,
                            ("FILENAME", "URL", "Domain", "TLD", "Title"), "URLSimilarityIndex", common=shared(1)),
        "urlphish": Dataset("urlphish", f"{root}/urlphish", "label", 1, None, ("url", "dom", "tld"), common=shared(2)),
    }


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header (a UTF-8 byte-order mark is accepted). Give a schema: inference is a second scan."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


#: Bytes of a read. Blocks of a file, as well, have this size.
READ = 1 << 20
# Schemes that tasks can open for ranged reads; files of other schemes are read whole by Spark.
RANGED = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def _open(path: str) -> NativeFile:
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    found, name = FileSystem.from_uri(f"{RANGED[scheme]}:{quote(rest, safe='/:@%')}")
    return found.open_input_file(name)


def _digest_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the range of each row, READ bytes at a time."""
    for batch in batches:
        digests = []
        for path, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digest = hashlib.sha256()
            with _open(path) as source:
                source.seek(offset)
                while size > 0:
                    part = source.read(min(READ, size))
                    if not part:
                        raise IntegrityError(f"{path} ended {size} bytes early")
                    digest.update(part)
                    size -= len(part)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "offset", "bytes", "sha256"])


_RANGE = "path string, offset long, bytes long, sha256 string"


def _file() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("file")


def _listed(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(path, length) of the files, without their content, and whether tasks can open them for ranged reads."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    schemes = {r["s"] for r in found.select(F.split("path", ":")[0].alias("s")).distinct().collect()}
    return found, schemes <= set(RANGED)


def _dealt(rows: DataFrame) -> DataFrame:
    """One range a task where there are cores for it: listings come in few partitions."""
    return rows.repartition(max(1, min(rows.count(), 4 * rows.sparkSession.sparkContext.defaultParallelism)), "path", "offset")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) per file of any size. SHA-256 has an order, so a file is one task, which streams it in reads
    of 1 MiB; `file_blocks` spreads a file over tasks. Empty files are not listed."""
    found, ranged = _listed(spark, path)
    if ranged:
        whole = found.select("path", F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("bytes"))
        return _dealt(whole).mapInArrow(_digest_ranges, _RANGE).select(_file(), "bytes", "sha256")
    raw = spark.read.format("binaryFile").load(path)  # up to 2 GB a file
    return raw.select(_file(), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_blocks(spark: SparkSession, path: str, block: int = READ) -> DataFrame:
    """(file, offset, bytes, sha256) of every block of every file, dealt over tasks; an empty file has no block."""
    found, ranged = _listed(spark, path)
    if not ranged:
        raise ValueError(f"blocks need one of the schemes {sorted(RANGED)}")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint")))
    blocks = found.filter("length > 0").withColumn("offset", starts).select(
        "path", "offset", F.least(F.lit(block).cast("bigint"), F.col("length") - F.col("offset")).alias("bytes"))
    return _dealt(blocks).mapInArrow(_digest_ranges, _RANGE).select(_file(), "offset", "bytes", "sha256")


def verify_files(spark: SparkSession, path: str, manifest: dict[str, str], on_mismatch: str = "fail") -> DataFrame:
    """Compare file hashes with a manifest {file: sha256}; policy 'warn' reports, 'fail' raises."""
    if on_mismatch not in ("warn", "fail"):
        raise ValueError("on_mismatch must be 'warn' or 'fail'")
    want = spark.createDataFrame(list(manifest.items()), "file string, expected string")
    out = file_hashes(spark, path).join(F.broadcast(want), "file", "right").withColumn(
        "ok", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))
    if on_mismatch == "fail":
        bad = [r["file"] for r in out.filter(~F.col("ok")).select("file").collect()]  # manifest-sized
        if bad:
            raise IntegrityError(f"content differs from the manifest: {sorted(bad)}")
    return out


def normalise(df: DataFrame, cfg: Dataset, label: str = "label", only_common: bool = False,
              drop_conflicts: bool = False, key: str | None = None) -> DataFrame:
    """Recode the label, drop identifiers and text, sentinel to NULL, exact duplicates out."""
    df = recode_label(df, cfg.target, cfg.positive, label)
    if only_common:
        df = align(df, cfg.common, keep=[*([key] if key else []), label])
    features = feature_columns(df, label, [*cfg.drop, *([key] if key else [])])
    numeric = set(numeric_columns(df))
    features = [c for c in features if c in numeric]
    if cfg.sentinel is not None:
        df = sentinel_to_null(df, features, cfg.sentinel)
    return clean(df, features, label, drop_conflicts=drop_conflicts, key=key)


def load(spark: SparkSession, cfg: Dataset, only_common: bool = False, drop_conflicts: bool = False) -> DataFrame:
    if cfg.sha256:
        verify_files(spark, cfg.path, cfg.sha256, cfg.on_mismatch)
    return normalise(read_csv(spark, cfg.path, cfg.schema), cfg, only_common=only_common,
                     drop_conflicts=drop_conflicts)


def without_suspicious(df: DataFrame, cfg: Dataset) -> DataFrame:
    return df.drop(cfg.suspicious) if cfg.suspicious else df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; splits follow the session's file settings (`spark.sql.files.*`)."""
    return spark.read.parquet(path)
