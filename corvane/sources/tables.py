"""Typed readers, and the projection of the stored tables onto the corpus model."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_hash

#: The corpus table's columns in order.
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("id", T.StringType()), ("joke_id", T.StringType()), ("url", T.StringType()), ("archive_url", T.StringType()),
            ("source_page", T.StringType()), ("year", T.IntegerType()), ("month", T.IntegerType()), ("date", T.StringType()),
            ("section", T.StringType()), ("genre", T.StringType()), ("text", T.StringType()), ("text_clean", T.StringType()),
            ("text_norm_hash", T.StringType()), ("text_length_chars", T.IntegerType()), ("text_length_words", T.IntegerType()),
            ("rating", T.IntegerType()), ("author", T.StringType()), ("author_url", T.StringType()),
            ("tags_raw", T.ArrayType(T.StringType())), ("tags_norm", T.ArrayType(T.StringType())), ("macro_tags", T.ArrayType(T.StringType())),
            ("tag_count", T.IntegerType()), ("macro_tag_count", T.IntegerType()), ("primary_macro_tag", T.StringType()),
            ("selected_rank_in_month", T.IntegerType()), ("candidate_count_tagged_month", T.IntegerType()), ("parsed_at", T.StringType()),
        )
    ]
)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table with header, quoted line breaks and doubled quotes; columns are inferred without a schema."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', quote='"', encoding="utf-8")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def with_text_hash(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Check the text and id columns, and add text_norm_hash where the table lacks it."""
    require(df, [text, key])
    return df if "text_norm_hash" in df.columns else df.withColumn("text_norm_hash", text_hash(F.col(text)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in whatever store it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def preferred(spark: SparkSession, *paths: str) -> DataFrame:
    """The first table that exists: the reduced matrix before the raw one."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(PurePosixPath(p).name for p in paths))


def missing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Which of the artifacts are absent."""
    return [p for p in paths if not exists(spark, p)]


def project(df: DataFrame, schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """Exactly the schema's columns; absent ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus rows: id, ord, year, month, text, lang, source, cl, tags."""
    labels = parquet(spark, sf_dir, "labels")
    docs = parquet(spark, sf_dir, "documents")
    tags = F.array_compact(
        F.array(
            F.when(F.col("lang") != "en", F.col("lang")),
            F.when(F.col("doc_id") % 3 == 0, F.col("source")),
            F.when(F.col("quality") == 1, "hq").when(F.col("quality") == 0, "lq"),
            F.when(F.col("toxic") == 1, "toxic"),
        )
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("ord"),
        (1996 + F.col("doc_id") % 31).cast("long").alias("year"),
        (1 + F.col("doc_id") % 12).cast("long").alias("month"),
        "text",
        "lang",
        "source",
        (F.substring("source", 4, 9).cast("int") % 12).cast("int").alias("cl"),
        tags.alias("tags"),
    )
