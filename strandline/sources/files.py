"""Readers and writers: CSV, Parquet, JDBC tables and keyed sets of frames through Spark; Feather and Excel on the driver."""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_path(root: str, name: str, extension: str = "", folder: str | None = None, key: str | None = None, dated: bool = False) -> str:
    """root/folder/name_key_date.extension"""
    parts = "_".join(x for x in (name, key, date.today().strftime("%Y%m%d") if dated else None) if x)
    return os.path.join(*(x for x in (root, folder, parts + extension) if x))


def save(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", partition: str | None = None) -> None:
    writer = df.write.mode(mode).format(format)
    writer = writer.option("header", True) if format == "csv" else writer
    (writer.partitionBy(partition) if partition else writer).save(path)


def load(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(format).options(**({"header": "true"} if format == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def load_panel_csv(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A long panel; of rows on one (ts, asset) one stays."""
    return load(spark, path, "csv", "ts date, asset string, value double", dateFormat=date_format).dropDuplicates(["ts", "asset"])


def save_keyed(frames: dict[str, DataFrame], path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Frames of one schema as one dataset, a partition for each key."""
    every = None
    for key, df in frames.items():
        part = df.withColumn("key", F.lit(key))
        every = part if every is None else every.unionByName(part)
    save(every, path, format, mode, "key")


def load_keyed(spark: SparkSession, path: str, keys: list[str] | None = None, format: str = "parquet", schema: str | None = None) -> dict[str, DataFrame]:
    """One frame a key; only its partition is read."""
    df = load(spark, path, format, f"{schema}, key string" if schema else None)
    names = keys if keys is not None else sorted(r["key"] for r in df.select("key").distinct().collect())
    return {k: df.filter(F.col("key") == k).drop("key") for k in names}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Old rows and new ones; on equal keys the new (last) or the old (first) stay."""
    if keep == "first":
        old, new = new, old
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dedupe(df: DataFrame, keys: list[str], order: str, keep: str = "last") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc() if keep == "last" else F.col(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def update(spark: SparkSession, df: DataFrame, path: str, keys: list[str], keep: str = "last", format: str = "parquet") -> None:
    """Upserts into a dataset: written beside it first, so that it is never read and overwritten at once."""
    merged = upsert(load(spark, path, format, None if format == "parquet" else df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")), df, keys, keep)
    save(merged, path + ".next", format)
    save(load(spark, path + ".next", format, df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")), path, format)


def save_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "replace", **properties: str) -> None:
    """replace, append, fail, or truncate (empties the table but keeps its definition)."""
    mode = {"replace": "overwrite", "truncate": "overwrite", "append": "append", "fail": "error"}[if_exists]
    df.write.format("jdbc").options(url=url, dbtable=table, truncate=str(if_exists == "truncate").lower(), **properties).mode(mode).save()


def load_jdbc(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, query: bool = False, **properties: str) -> DataFrame:
    """A table or query; columns and filters are pushed to the database."""
    df = spark.read.format("jdbc").options(url=url, **{"query" if query else "dbtable": table}, **properties).load()
    return df.select(*columns) if columns else df


def save_feather(df: DataFrame, path: str) -> None:
    """For small results: Arrow on the driver."""
    import pyarrow.feather

    pyarrow.feather.write_feather(df.toArrow(), path)


def load_feather(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow.feather

    return spark.createDataFrame(pyarrow.feather.read_table(path))


def append_feather(spark: SparkSession, df: DataFrame, path: str, keys: list[str], keep: str = "last") -> None:
    save_feather(upsert(load_feather(spark, path), df, keys, keep), path)


def save_excel(frames: dict[str, DataFrame], path: str) -> None:
    """For small results: a sheet each. Needs an Excel writer of pandas."""
    import pandas as pd

    with pd.ExcelWriter(path) as out:
        for name, df in frames.items():
            df.toPandas().to_excel(out, sheet_name=name, index=False)


def load_excel(spark: SparkSession, path: str, sheets: list[str]) -> dict[str, DataFrame]:
    import pandas as pd

    return {s: spark.createDataFrame(pd.read_excel(path, sheet_name=s)) for s in sheets}


def without_time_zone(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Through Hadoop's file systems, so that any store works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(p)
    return sorted(s.getPath().toString() for s in found)
