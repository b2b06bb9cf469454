"""Ordered tag mapping, two-level hierarchy and manifests: small files of the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mapping of the stored tables' tags, in order.
MACROS: dict[str, list[str]] = {
    "romance": ["fr", "es"],
    "germanic": ["de"],
    "quality": ["hq", "lq"],
    "safety": ["toxic"],
    "src_low": [f"src{i}" for i in range(7)],
    "src_mid": [f"src{i}" for i in range(7, 14)],
}
HIERARCHY: dict[str, list[str]] = {"language": ["romance", "germanic"], "content": ["quality", "safety"], "origin": ["src_low", "src_mid", "other"]}
OTHER = "other"
#: Keys of a manifest that tell whether a result is still valid.
IDENTITY = ("dataset_path", "dataset_row_count", "model_id", "normalized", "seed", "text_hash_checksum")


def load_mapping(path: str) -> dict[str, list[str]]:
    """Category -> tags, in the file's order."""
    import yaml

    return {str(k): [str(t) for t in v or []] for k, v in (yaml.safe_load(Path(path).read_text("utf-8")) or {}).items()}


def load_hierarchy(path: str) -> dict[str, list[str]]:
    """Broad category -> categories; a category in two places is an error."""
    import yaml

    return check_hierarchy({k: list(v["level2"]) for k, v in yaml.safe_load(Path(path).read_text("utf-8")).items()})


def check_hierarchy(found: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    seen: dict[str, str] = {}
    for broad, fine in found.items():
        for tag in fine:
            if tag in seen:
                raise ValueError(f"{tag} is below {seen[tag]} and {broad}")
            seen[tag] = broad
    return {k: list(v) for k, v in found.items()}


def plain_tag(tag: Any) -> str:
    """The normal form of a tag, as ``functions.text.normalize_tag`` has it for columns."""
    return " ".join(str(tag or "").casefold().split())


def mapping_table(spark: SparkSession, mapping: Mapping[str, Sequence[str]] = MACROS) -> DataFrame:
    """(pos, macro, tag) with tags in normal form, blank ones left out; of a tag that stands twice, the later place holds. It is as small as its file."""
    by_tag = {plain_tag(t): (i, macro) for i, (macro, tags) in enumerate(mapping.items()) for t in tags if plain_tag(t)}
    return spark.createDataFrame([(i, macro, t) for t, (i, macro) in by_tag.items()], "pos int, macro string, tag string")


def hierarchy_table(spark: SparkSession, hierarchy: Mapping[str, Sequence[str]] = HIERARCHY) -> DataFrame:
    """(l1, l2)."""
    return spark.createDataFrame([(a, b) for a, fine in check_hierarchy(hierarchy).items() for b in fine], "l1 string, l2 string")


def read_manifest(path: str) -> dict[str, Any] | None:
    """The manifest, or None if it is absent or malformed."""
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def manifest_matches(path: str, expected: Mapping[str, Any], keys: Sequence[str] = IDENTITY) -> bool:
    found = read_manifest(path)
    return found is not None and all(found.get(k) == expected.get(k) for k in keys)


def assemble_manifest(identity: Mapping[str, Any], vectors: DataFrame, reduced: DataFrame | None = None, tokens: DataFrame | None = None, **facts: Any) -> dict[str, Any]:
    """Identity keys first, then shapes, time, statistics of ``tokens`` (n, truncated), and what else is known.

    ``vectors`` and ``reduced`` have v; each is one aggregation, and a number or two of it reach the driver.
    """
    absent = [k for k in IDENTITY if k not in identity]
    if absent:
        raise KeyError(f"identity lacks {absent}")

    def shape(of: DataFrame | None) -> list[int] | None:
        found = of.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first() if of is not None else None
        return [found["n"], found["d"] or 0] if found else None

    stats, truncated = None, None
    if tokens is not None:
        t = tokens.agg(F.min("n").alias("min"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("max"), F.count_if("truncated").alias("truncated")).first()
        stats, truncated = {k: t[k] for k in ("min", "median", "mean", "max")}, t["truncated"]
    made = {"embedding_shape": shape(vectors), "pca_shape": shape(reduced), "created_at": datetime.now(UTC).isoformat(), "token_length_stats": stats, "truncated_text_count": truncated}
    return {k: identity[k] for k in IDENTITY} | made | facts


def write_manifest(path: str, values: Mapping[str, Any]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True) + "\n", "utf-8")


def append_progress(path: str, line: str) -> None:
    """One more line of a log."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("a", encoding="utf-8") as f:
        f.write(line.rstrip("\n") + "\n")


def notebook_counts(path: str) -> dict[str, int]:
    """Code cells, those that ran, and their outputs, of a notebook file."""
    cells = [c for c in json.loads(Path(path).read_text("utf-8")).get("cells", []) if c.get("cell_type") == "code"]
    return {
        "code_cells": len(cells),
        "executed": sum(c.get("execution_count") is not None for c in cells),
        "outputs": sum(len(c.get("outputs", [])) for c in cells),
    }
