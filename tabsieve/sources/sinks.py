"""Materialised stages, decisions, result tables, the experiment log and the lineage register."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabsieve.functions.scalar import iso_utc
from tabsieve.session import ensure_checkpoint_dir

EVERYTHING = "*"
#: Of a stage that many fits read: files for each core, and the fewest rows that are worth a file.
FILES_A_CORE = 4
ROWS_A_FILE = 50_000
# The published result tables name their columns bloque, tecnica, modelo, datos, metricas,
# hiperparametros, semilla, notas, origen, filas, columnas, descripcion, motivo and fecha_utc.


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _complete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """A stage that is read more than once, as compressed columns below the session's shared checkpoint folder: cuts the
    lineage like `checkpoint()`, at a fraction of its bytes, and readers take only the columns they need.

    A source of one row group is written by one task, and its one file would be read by one again: with `rows`, the
    number of rows, files hold a share of them that leaves every core a few, or ROWS_A_FILE."""
    path = scratch_path(df.sparkSession, name)
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = 0 if rows is None else max(ROWS_A_FILE, rows // (FILES_A_CORE * cores))
    df.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(root: str, name: str, params: Mapping | None = None) -> str:
    """Stage folder; the parameters that shaped the stage are part of its identity."""
    if not params:
        return f"{root}/{name}"
    digest = hashlib.sha256(json.dumps(dict(params), sort_keys=True, default=str).encode()).hexdigest()[:12]
    return f"{root}/{name}-{digest}"


def checkpointed(spark: SparkSession, root: str, name: str, compute: Callable[[], DataFrame],
                 force: Collection[str] = (), params: Mapping | None = None,
                 partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Read a finished stage, or compute, write and read it back. Cuts lineage at a table on shared storage."""
    path = stage_path(root, name, params)
    if EVERYTHING in force or name in force or not _complete(spark, path):
        writer = compute().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def checkpointed_split(spark: SparkSession, root: str, name: str, compute: Callable[[], DataFrame],
                       force: Collection[str] = (), params: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    """A (train, test) stage in one table partitioned by `split`: each side reads only its folder."""
    both = checkpointed(spark, root, name, compute, force, params, partition_by=("split",))
    return both.filter(F.col("split") == "train").drop("split"), both.filter(F.col("split") == "test").drop("split")


def decision(spark: SparkSession, root: str, name: str, compute: Callable[[], Mapping],
             force: Collection[str] = ()) -> dict:
    """A small human-readable decision, stored as one JSON record."""
    path = stage_path(root, name)
    if EVERYTHING in force or name in force or not _complete(spark, path):
        text = json.dumps(dict(compute()), sort_keys=True)
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)
    return json.loads(spark.read.text(path).first()["value"])


def result_table(df: DataFrame, path: str) -> None:
    """A result table as CSV with header (small by nature; adaptive execution merges its partitions)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def log_experiment(spark: SparkSession, path: str, block: str, technique: str, model: str,
                   metrics: Mapping[str, float], params: Mapping | None = None, data: str = "",
                   seed: int = 42, notes: str = "") -> None:
    """Append one record; metrics are rounded to 5 decimals and stored as JSON."""
    rounded = {k: round(float(v), 5) for k, v in metrics.items()}
    row = spark.createDataFrame(
        [(block, technique, model, data, json.dumps(rounded, sort_keys=True),
          json.dumps(dict(params or {}), sort_keys=True, default=str), seed, notes)],
        "bloque string, tecnica string, modelo string, datos string, metricas string, hiperparametros string, "
        "semilla int, notas string")
    row.select(iso_utc(F.current_timestamp()).alias("fecha_utc"), "*").write.mode("append").parquet(path)


def log_metrics_frame(results: DataFrame, path: str, block: str, keys: tuple[str, ...] = ("model",)) -> None:
    """Append many results at once: every column outside `keys` goes into the JSON metrics."""
    metrics = [c for c in results.columns if c not in keys]
    results.select(
        iso_utc(F.current_timestamp()).alias("fecha_utc"), F.lit(block).alias("bloque"), *keys,
        F.to_json(F.struct(*[F.round(c, 5).alias(c) for c in metrics])).alias("metricas"),
    ).write.mode("append").parquet(path)


def write_version(spark: SparkSession, df: DataFrame, root: str, version: str, origin: str, description: str,
                  reason: str) -> DataFrame:
    """Write a named immutable version and its lineage row; rows are counted while writing."""
    seen = Observation(f"rows-{version}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{root}/{version}")
    row = spark.createDataFrame(
        [(version, origin, int(seen.get["n"]), len(df.columns), description, reason)],
        "version string, origen string, filas bigint, columnas int, descripcion string, motivo string")
    row.withColumn("fecha_utc", iso_utc(F.current_timestamp())).write.mode("append").parquet(f"{root}/lineage")
    return spark.read.parquet(f"{root}/{version}")


def read_lineage(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/lineage")
