"""Writers. Tables stay Parquet between steps; CSV, JSON and Markdown are for the edge."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Header, UTF-8 and line feeds; arrays as JSON text. One file only for tables known to be small."""
    flat = df.select(*(F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes))
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").options(header=True, escape='"', lineSep="\n", encoding="UTF-8").csv(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """(id, vector) rows as Parquet, vectors as floats."""
    df.select(*(F.col(c).cast("array<float>") if k.startswith("array") else F.col(c) for c, k in df.dtypes)).write.mode("overwrite").parquet(path)


def write_hashes(df: DataFrame, path: str, key: str = "id") -> None:
    df.select(F.col(key).alias("id"), "text_norm_hash").write.mode("overwrite").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Nothing happens if the target exists."""
    df.write.mode("ignore").parquet(path)


def replace_table(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """A new version of a table beside the old one, which is never overwritten while it is read; returns its path."""
    version = 1
    while exists(spark, f"{path}.v{version}"):
        version += 1
    change(spark.read.parquet(path if version == 1 else f"{path}.v{version - 1}")).write.parquet(f"{path}.v{version}")
    return f"{path}.v{version}"


def write_runs(results: Callable[[DataFrame], DataFrame], configs: DataFrame, path: str, key: str = "config_id") -> DataFrame:
    """Run configurations that have no result below ``path`` yet and append theirs; returns all results."""
    spark = configs.sparkSession
    todo = configs.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if exists(spark, path) else configs
    results(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def markdown(title: str, parts: Iterable[tuple[str, DataFrame, int]]) -> str:
    """A report: each part is a heading, a table and how many of its rows to show."""
    out = [f"# {title}", ""]
    for heading, df, most in parts:
        out += [f"## {heading}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.limit(most).collect()]
        out.append("")
    return "\n".join(out)
