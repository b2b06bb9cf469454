"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crf_language, decontaminate, line_templates, order_minhash, pieces, repair, sharding, sketch, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_language": crf_language.query,
    "op2_histogram_sort": sharding.query,
    "op3_warc_derivatives": warc.query,
    "op4_association_rules": url_rules.query,
    "op5_line_templates": line_templates.query,
    "op6_scaled_sketch": sketch.query,
    "op7_distinct_chunks": pieces.query,
    "op8_re_pair": repair.query,
    "op9_winnowing": decontaminate.query,
    "op10_order_minhash": order_minhash.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_derivatives": warc.SQL,
    "op5_line_templates": line_templates.SQL,
    "op9_winnowing": decontaminate.SQL,
}
