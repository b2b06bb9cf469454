"""Tags and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as ops
from ..sources.config import hierarchy_table, mapping_table
from ..sources.tables import corpus
from .base import CTE, labelled, rounded
from .registry import query
from .scans import _H

# stand-ins for reviewed lists: tags that are debatable, and (categories, tags) that are formal or wide
DEBATABLE, FORMAL, BROAD = ("hq", "src3"), (("safety",), ("src5",)), (("src_low",), ("de",))
_BRANCH = "CASE WHEN tag IN ('hq', 'src3') THEN {0} WHEN coalesce(macro, 'other') = 'safety' OR tag = 'src5' THEN {1} WHEN coalesce(macro, 'other') = 'src_low' OR tag = 'de' THEN {2} WHEN macro IS NULL THEN {3} ELSE {4} END"
_STATUS, _RATIONALE = (_BRANCH.format(*(f"'{x}'" for x in values)) for values in (ops.STATUSES, ops.RATIONALES))


@query(CTE + "SELECT id, cl, array_to_string(macros, '|') AS macros, mask FROM cm")
def tag_macro_map(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "cl", F.array_join("macros", "|").alias("macros"), "mask")


#: The mapping with tags as people type them, blank ones, and one that stands twice.
TYPED = {"romance": ["FR", "  Es "], "germanic": [" dE"], "quality": ["HQ", "Lq", " "], "safety": ["toxic", "src 1"], "origin": ["SRC  1", "Src2"]}


@query(CTE + """, typed AS (SELECT id, cl, unnest(list_concat(list_transform(tags, lambda t: CASE WHEN starts_with(t, 'src') THEN ' Src  ' || t[4:] ELSE upper(t) || ' ' END), ['  '])) AS tag FROM corpus),
norm AS (SELECT id, cl, tag, lower(regexp_replace(trim(tag), ' +', ' ', 'g')) AS t FROM typed),
hit AS (SELECT id, cl, tag, t, CASE WHEN t IN ('fr', 'es') THEN 0 WHEN t = 'de' THEN 1 WHEN t IN ('hq', 'lq') THEN 2 WHEN t = 'toxic' THEN 3 WHEN t = 'src 1' THEN 4 END AS pos FROM norm)
SELECT id, cl, coalesce(string_agg(DISTINCT pos::VARCHAR, '' ORDER BY pos::VARCHAR) FILTER (pos IS NOT NULL), 'other') AS places, CAST(coalesce(bit_or(1::BIGINT << pos) FILTER (pos IS NOT NULL), 32) AS BIGINT) AS mask,
coalesce(string_agg(DISTINCT tag, '|' ORDER BY tag) FILTER (pos IS NULL AND t <> ''), '') AS unmapped FROM hit GROUP BY id, cl""")
def tag_map_normalized(spark, sf_dir):
    """Mapping and row tags in other cases and with blanks meet all the same."""
    typed = F.transform("tags", lambda t: F.when(t.startswith("src"), F.concat(F.lit(" Src  "), F.substring(t, 4, 9))).otherwise(F.concat(F.upper(t), F.lit(" "))))
    rows = corpus(spark, sf_dir).withColumn("tags", F.concat(typed, F.array(F.lit("  "))))
    found = ops.map_tags(rows, mapping_table(spark, TYPED))
    place = F.transform("macros", lambda m: F.coalesce(F.create_map(*(F.lit(x) for i, k in enumerate(TYPED) for x in (k, str(i))))[m], m))
    return found.select("id", "cl", F.array_join(place, "").alias("places"), "mask", F.array_join("unmapped", "|").alias("unmapped"))


@query(CTE + """SELECT id, tags[1] AS tag FROM corpus WHERE len(tags) = 1""")
def single_label_rows(spark, sf_dir):
    """The filter on labels stored as JSON text."""
    stored = corpus(spark, sf_dir).select("id", F.to_json("tags").alias("tags"))
    return ops.single_label(stored, "tags").select("id", F.from_json("tags", "array<string>")[0].alias("tag"))


@query(CTE + "SELECT tag, CAST(count(*) AS BIGINT) AS n FROM et WHERE tag NOT IN (SELECT tag FROM map) GROUP BY tag")
def unmapped_tags(spark, sf_dir):
    return ops.unmapped_tags(corpus(spark, sf_dir), mapping_table(spark))


@query(CTE + "SELECT tag, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM corpus), 6) AS share FROM et GROUP BY tag")
def tag_distribution(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return rounded(ops.distribution(ops.exploded(rows), rows))


@query(CTE + "SELECT macro, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM cm), 6) AS share FROM em GROUP BY macro")
def macro_distribution(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rounded(ops.distribution(rows.select(F.explode("macros").alias("macro")), rows, "macro"))


@query(CTE + "SELECT CAST(len(tags) AS INT) AS tag_count, CAST(len(macros) AS INT) AS macro_count, CAST(count(*) AS BIGINT) AS n FROM corpus JOIN cm USING (id) GROUP BY ALL")
def tag_count_distribution(spark, sf_dir):
    rows = corpus(spark, sf_dir).join(labelled(spark, sf_dir).drop("cl"), "id")
    return rows.groupBy(F.size("tags").alias("tag_count"), F.size("macros").alias("macro_count")).agg(F.count("*").alias("n")).orderBy("tag_count", "macro_count")


_COMPARE = """, before AS (SELECT tag AS macro, count(*) AS n FROM (SELECT id, CASE WHEN tag IN ('fr', 'es', 'de') THEN 'language' ELSE 'other' END AS tag FROM et) GROUP BY tag),
after AS (SELECT macro, count(*) AS n FROM em GROUP BY macro)
"""


@query(CTE + _COMPARE + """SELECT macro, CAST(coalesce(b.n, 0) AS BIGINT) AS before, CAST(coalesce(a.n, 0) AS BIGINT) AS after, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS delta,
round(coalesce((coalesce(b.n, 0) - coalesce(a.n, 0)) / nullif(coalesce(b.n, 0), 0), 0), 6) AS reduction FROM before b FULL JOIN after a USING (macro)""")
def remap_before_after(spark, sf_dir):
    old = F.when(F.col("tag").isin("fr", "es", "de"), "language").otherwise("other")
    before = ops.counted(ops.exploded(corpus(spark, sf_dir)).select(old.alias("macro")), "macro")
    after = ops.counted(labelled(spark, sf_dir).select(F.explode("macros").alias("macro")), "macro")
    return rounded(ops.compare(before, after, "macro"))


@query(CTE + "SELECT c.id, coalesce(string_agg(DISTINCT u.tag, '|' ORDER BY u.tag), '') AS unmapped FROM corpus c LEFT JOIN (SELECT id, tag FROM et WHERE tag NOT IN (SELECT tag FROM map)) u ON c.id = u.id GROUP BY c.id")
def remap_unmapped_rows(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", F.array_join("unmapped", "|").alias("unmapped"))


_AUDIT = f""", t AS (SELECT tag, count(*) AS n FROM et GROUP BY tag),
x AS (SELECT tag, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS examples FROM (SELECT tag, id, row_number() OVER (PARTITION BY tag ORDER BY id) AS r FROM (SELECT DISTINCT tag, id FROM et)) WHERE r <= 5 GROUP BY tag),
au AS (SELECT tag AS tag_norm, tag AS tag_raw, CAST(n AS BIGINT) AS n, examples, coalesce(macro, 'other') AS macro, {_STATUS} AS status, {_RATIONALE} AS rationale FROM t JOIN x USING (tag) LEFT JOIN map USING (tag))
"""


def _audit(spark, sf_dir):
    return ops.audit(corpus(spark, sf_dir), mapping_table(spark), DEBATABLE, FORMAL, BROAD)


@query(CTE + _AUDIT + "SELECT * FROM au")
def tag_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(CTE + _AUDIT + "SELECT status, macro, CAST(count(*) AS BIGINT) AS n FROM au GROUP BY ALL")
def audit_status_counts(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy("status", "macro").agg(F.count("*").alias("n"))


@query(CTE + f", h AS (SELECT * FROM (VALUES {_H}) AS t(l1, l2)) SELECT id, array_to_string(list_sort(list(DISTINCT l1)), '|') AS level1 FROM em JOIN h ON macro = l2 GROUP BY id")
def hierarchy_rollup(spark, sf_dir):
    each = labelled(spark, sf_dir).select("id", F.explode("macros").alias("macro"))
    return ops.roll_up(each, hierarchy_table(spark)).select("id", F.array_join("level1", "|").alias("level1"))


@query(CTE + f"SELECT DISTINCT macro FROM em WHERE macro NOT IN (SELECT l2 FROM (VALUES {_H}) AS t(l1, l2))")
def missing_in_hierarchy(spark, sf_dir):
    return ops.not_in_hierarchy(labelled(spark, sf_dir).select(F.explode("macros").alias("macro")), hierarchy_table(spark))


@query(CTE + "SELECT 'observed' AS side, CAST(count(DISTINCT tag) AS BIGINT) AS n FROM et UNION ALL SELECT 'not mapped', CAST(count(DISTINCT tag) AS BIGINT) FROM et WHERE tag NOT IN (SELECT tag FROM map)")
def observed_tags(spark, sf_dir):
    seen = ops.exploded(corpus(spark, sf_dir)).select("tag").distinct()
    rest = seen.exceptAll(mapping_table(spark).select("tag").intersect(seen))
    return seen.agg(F.count("*").alias("n")).select(F.lit("observed").alias("side"), "n").unionByName(rest.agg(F.count("*").alias("n")).select(F.lit("not mapped").alias("side"), "n"))


