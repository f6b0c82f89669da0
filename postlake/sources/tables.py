"""Reading and writing postings, examples and normalisation stats (SC1-SC5)."""

from __future__ import annotations

import json
from functools import reduce

from py4j.protocol import Py4JJavaError

from pyspark.errors import AnalysisException, PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postlake.schemas import EXAMPLE, NORM_STATS, RAW_POSTING, check_same_columns, conform

SPLITS = ["train", "val", "test"]


def scan_postings(spark: SparkSession, folder: str) -> DataFrame:
    """SC1: every Parquet file of a folder; columns a file lacks read as NULL.

    The stored types are cast: whole-number salaries or a boolean `remote` are as good
    as the types of RAW_POSTING. Footers are merged by Spark's own job; where files
    disagree on a type, a footer table (file, schema) is built by one more job over all
    files, and every group of files of one schema is read with its own types.
    """
    try:
        spark.read.parquet(folder)
    except AnalysisException as failure:
        raise FileNotFoundError(f"no parquet files in {folder}") from failure
    try:
        return _typed(spark, [folder], spark.read.option("mergeSchema", "true").parquet(folder).schema)
    except (SparkException, Py4JJavaError):
        files = spark.read.schema(RAW_POSTING).parquet(folder).inputFiles()
    groups = footer_table(spark, files).groupBy("schema").agg(F.sort_array(F.collect_list("file")).alias("files"))
    parts = [_typed(spark, row["files"], StructType.fromJson(json.loads(row["schema"])))
             for row in groups.orderBy("schema").collect()]
    return reduce(DataFrame.unionByName, parts)


def footer_table(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, schema (Spark's JSON form) of every Parquet file, read from footers by executors.

    Each task opens only the footers of its files, by the file system their URI names.
    """
    def read(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import from_arrow_schema

        for frame in batches:
            schemas = []
            for uri in frame["file"]:
                system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                with system.open_input_file(path) as handle:
                    schemas.append(from_arrow_schema(pq.read_schema(handle)).json())
            yield frame.assign(schema=schemas)

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism))).mapInPandas(
        read, "file string, schema string")


def _typed(spark: SparkSession, paths: list[str], stored: StructType) -> DataFrame:
    """Files that agree on their types, cast to RAW_POSTING."""
    known = {f.name: f for f in stored}
    schema = StructType([known.get(f.name, f) for f in RAW_POSTING])
    return conform(spark.read.schema(schema).parquet(*paths), RAW_POSTING)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add a stable unique key to a table scanned from Parquet files.

    For postings that carry no id: file and position in it do not change when
    a task is retried, and identical copies get different keys.
    """
    return df.select(
        "*",
        F.xxhash64("_metadata.file_path").alias("file_key"),
        F.col("_metadata.row_index").alias("row_no"),
    )


def scan_examples(spark: SparkSession, folder: str, splits: list[str] = SPLITS) -> DataFrame:
    """SC2: the tables `<folder>/<split>.parquet` as one, with a `split` column."""
    tables = [
        spark.read.schema(EXAMPLE).parquet(f"{folder}/{split}.parquet")
        .withColumn("split", F.lit(split))
        for split in splits
    ]
    return reduce(DataFrame.unionByName, tables)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores if the input has fewer partitions than cores.

    For costly per-row work on small or badly split files. A large table has more
    partitions than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_examples(df: DataFrame, path: str) -> None:
    """SC3: replace a table. `path` must not be one `df` is read from."""
    df.write.mode("overwrite").parquet(path)


def append_examples(new: DataFrame, path: str) -> None:
    """SC4: add rows to a stored table; its old files are neither read nor rewritten."""
    check_same_columns(new.sparkSession.read.parquet(path), new)
    new.write.mode("append").parquet(path)


def union_append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SP5: existing and new rows together, duplicates kept."""
    return existing.unionByName(new, allowMissingColumns=True)


def write_stats(stats: DataFrame, path: str) -> None:
    """SC5: one JSON row per target."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """SC5"""
    return spark.read.schema(NORM_STATS).json(path)
