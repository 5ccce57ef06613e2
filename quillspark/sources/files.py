"""File sources with explicit schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import strip

GOLDEN_SCHEMA = (
    "question string, reference_answer string, reference_context array<string>, reference_cids array<long>, "
    "intent string, is_negative boolean, legal_type string, doc_id long, tier string, "
    "critic struct<answerability:int,correctness:int,clarity:int,reasoning:string,error:string>"
)


def read_columns(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths).select(*columns)


def read_shards(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """All files of a folder that match a glob, in one scan."""
    return spark.read.option("pathGlobFilter", pattern).parquet(folder)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text, quoted line breaks allowed."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.option("inferSchema", False).csv(path)


def read_golden(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Golden records.  Lenient: damaged lines and rows without question or context are skipped."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(GOLDEN_SCHEMA).option("mode", mode).json(path)
    if strict:
        return rows
    return rows.where((strip(F.coalesce("question", F.lit(""))) != "") & (F.size("reference_context") > 0))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds data, asked of the file system that owns the path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(target))
