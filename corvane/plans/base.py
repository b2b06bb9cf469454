"""Shared SQL of the oracles, and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import map_tags
from ..sources.config import MACROS, mapping_table
from ..sources.tables import corpus

DIGITS = 6

_MAP = ", ".join(f"({i}, '{macro}', '{t}')" for i, (macro, tags) in enumerate(MACROS.items()) for t in tags)

#: corpus, map and cm (id, cl, macros, mask) as common tables.
CTE = f"""WITH corpus AS (
  SELECT d.doc_id AS id, d.doc_id AS ord, CAST(1996 + d.doc_id % 31 AS BIGINT) AS year, CAST(1 + d.doc_id % 12 AS BIGINT) AS month,
    d.text, d.lang, d.source, CAST(CAST(substr(d.source, 4) AS INT) % 12 AS INT) AS cl,
    list_filter([CASE WHEN d.lang <> 'en' THEN d.lang END, CASE WHEN d.doc_id % 3 = 0 THEN d.source END,
      CASE l.quality WHEN 1 THEN 'hq' WHEN 0 THEN 'lq' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
map AS (SELECT * FROM (VALUES {_MAP}) AS t(pos, macro, tag)),
et AS (SELECT id, ord, cl, year, unnest(tags) AS tag, unnest(range(len(tags))) AS at FROM corpus),
e AS (SELECT id, cl, unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE tags END) AS tag FROM corpus),
j AS (SELECT e.id, e.cl, macro, min(pos) AS pos FROM e LEFT JOIN map ON e.tag = map.tag GROUP BY ALL),
cm AS (SELECT id, cl, coalesce(list(macro ORDER BY pos) FILTER (macro IS NOT NULL), ['other']) AS macros,
  CAST(coalesce(bit_or(CAST(1 AS BIGINT) << pos) FILTER (pos IS NOT NULL), 64) AS BIGINT) AS mask FROM j GROUP BY id, cl),
em AS (SELECT id, cl, unnest(macros) AS macro FROM cm)
"""

#: The normal form of a text (composition changes nothing in the stored tables), and its folded form.
NORM = r"trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g'), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), ' ')"
FOLD = "replace(lower({0}), 'ß', 'ss')"


def norm_sql(column: str) -> str:
    return NORM.format(column)


def fold_sql(column: str) -> str:
    return FOLD.format(column)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded: sums differ in their last digits with the order of the rows."""
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cl, macros, mask, unmapped) of the corpus."""
    return map_tags(corpus(spark, sf_dir), mapping_table(spark))


def with_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows with macros and mask."""
    return corpus(spark, sf_dir).join(labelled(spark, sf_dir).drop("cl"), "id")
