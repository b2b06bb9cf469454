"""WARC derivatives: a metadata record and a plain-text conversion record for each response.

Both refer to the response by its record id, and the metadata record names the conversion. The metadata block (warc-fields)
preserves the response's HTTP status and headers, payload length and digest, and gives title and outlinks. Record ids are
digests of the response's id, so that a repeated run gives the same records. Digests are ``sha1:`` and base32, as the format has them.
All steps are expressions over one row; character references alone are resolved by the standard library in Arrow batches.
"""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._common import table

DATE = "1970-01-01T00:00:00Z"  # for pages that were stored without a date

_DROPPED = ("script", "style", "noscript", "template")
_BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|title|article|nav|footer|header|section|aside|main|blockquote|pre|hr|dl|dt|dd"
_RESPONSE = ("record_id", "target_uri", "warc_date", "status", "headers", "body")
_DERIVED = ("record_type", "refers_to", "content_type", "content_length", "block_digest", "source_payload_digest", "block")
_HTML = ("text/html", "application/xhtml+xml")


def base32_sha1(data: Column) -> Column:
    """``sha1:`` and the digest in base32: five bytes at a time are eight digits."""
    digest = F.sha1(data)
    digits = F.concat(*(F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)))
    return F.concat(F.lit("sha1:"), F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def urn(of: Column) -> Column:
    h = F.md5(of)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def plain_text(body: Column) -> Column:
    """Text of HTML: comments, scripts and styles go, block tags end lines, other tags go, references are resolved, blanks are evened out."""
    t = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    for name in _DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    t = F.regexp_replace(t, r"[ \t\r\n\f]+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"</?[a-zA-Z!][^>]*>", "")
    return F.regexp_replace(F.regexp_replace(_unescape(t), r"[ \t\n]*\n[ \t\n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of stored pages: page_id, record_id, target_uri, warc_date, status, headers, body."""
    body = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    name = F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.col("url"), F.sha1(body.cast("binary")))
    return pages.select(
        "page_id",
        urn(name.cast("binary")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit("HTTP/1.1 200 OK").alias("status"),
        headers.alias("headers"),
        F.col("html").alias("body"),
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records, two rows a response at most.

    Columns of ``found`` other than those of ``responses`` stay, unless they bear a result column's name. A response of another content type than HTML
    or plain text, or of a null body, gets a metadata record alone, as does one of null headers; a null URI stays null and
    makes no outlink absolute; a response of a null record id is named by a digest of its URI, date and body; a null status leaves its line empty; line
    ends inside a line of the block become blanks; repeated responses give repeated records; an empty table gives an empty result.
    """
    name = F.concat_ws("|", F.lit("response"), F.col("target_uri"), F.col("warc_date"), F.sha1(F.coalesce("body", F.lit("")).cast("binary")))
    found = found.withColumn("record_id", F.coalesce("record_id", urn(name.cast("binary"))))
    kept = [c for c in found.columns if c not in _RESPONSE + _DERIVED]
    payload = F.coalesce("body", F.lit(""))
    kind = F.lower(F.trim(F.regexp_extract("headers", r"(?im)^content-type:[ \t]*([^;\r\n]*)", 1)))
    convertible = F.col("body").isNotNull() & kind.isin(*_HTML, "text/plain")
    base = F.regexp_extract(F.coalesce("target_uri", F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\r\n\f]+", " "))
    links = F.expr(r"""regexp_extract_all(coalesce(body, ''), '(?i)<a\\s[^>]*?href="([^"\\r\\n]*)"', 1)""")
    outlinks = F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.when(x.startswith("/") & ~x.startswith("//"), F.concat(base, x)).otherwise(x)))
    ids = found.withColumns(
        {
            "__conversion_id": F.when(convertible, urn(F.concat(F.lit("conversion|"), "record_id").cast("binary"))),
            "__text": F.when(convertible, F.when(kind == "text/plain", payload).otherwise(plain_text(payload))),
            "__payload_digest": base32_sha1(payload.cast("binary")),
        }
    )
    lines = F.concat(
        F.array(
            F.concat(F.lit("source-status: "), F.coalesce("status", F.lit(""))),
            F.concat(F.lit("source-payload-length: "), F.octet_length(payload).cast("string")),
            F.concat(F.lit("source-payload-digest: "), F.col("__payload_digest")),
            F.concat(F.lit("conversion: "), F.coalesce("__conversion_id", F.lit("none"))),
            F.concat(F.lit("title: "), title),
        ),
        F.transform(F.filter(F.split(F.coalesce("headers", F.lit("")), "\r\n"), lambda h: h != ""), lambda h: F.concat(F.lit("source-header: "), h)),
        outlinks,
    )
    lines = F.transform(lines, lambda x: F.regexp_replace(x, "[\r\n]+", " "))
    block = F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n"))
    record = lambda t, i, c, b: F.struct(F.lit(t).alias("record_type"), i.alias("record_id"), F.lit(c).alias("content_type"), b.alias("block"))
    both = F.array(
        record("metadata", urn(F.concat(F.lit("metadata|"), "record_id").cast("binary")), "application/warc-fields", block),
        record("conversion", F.col("__conversion_id"), "text/plain", F.col("__text")),
    )
    return (
        ids.select(*kept, F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "__payload_digest", F.explode(both).alias("r"))
        .where(F.col("r.record_id").isNotNull())
        .select(
            *kept,
            "r.record_type",
            "r.record_id",
            "refers_to",
            "target_uri",
            "warc_date",
            "r.content_type",
            F.octet_length("r.block").cast("long").alias("content_length"),
            base32_sha1(F.col("r.block").cast("binary")).alias("block_digest"),
            F.col("__payload_digest").alias("source_payload_digest"),
            "r.block",
        )
    )


def serialize(records: DataFrame) -> DataFrame:
    """Add ``record``: the record as it stands in a WARC file. Null fields are left out, and line ends in a field are percent-encoded."""
    fields = (
        ("WARC-Type", "record_type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"),
        ("WARC-Source-Payload-Digest", "source_payload_digest"),
        ("Content-Type", "content_type"),
        ("Content-Length", "content_length"),
    )
    one_line = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = reduce(
        lambda a, b: F.concat(a, b),
        (F.coalesce(F.concat(F.lit(f"{name}: "), one_line(c), F.lit("\r\n")), F.lit("")) for name, c in fields),
        F.lit("WARC/1.1\r\n"),
    )
    return records.withColumn("record", F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


_B32 = """'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(sha1({0}), 10 * (i // 8) + 1, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')"""
_URN = "'<urn:uuid:' || regexp_replace(md5({0}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>'"

SQL = rf"""
WITH p AS (SELECT page_id, url, html, coalesce(html, '') AS body FROM pages),
r AS (SELECT *, {_URN.format("'response|' || coalesce(CAST(page_id AS VARCHAR) || '|', '') || coalesce(url || '|', '') || sha1(body)")} AS rid,
  regexp_extract(coalesce(url, ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS base FROM p),
t1 AS (SELECT *, regexp_replace(body, '(?s)<!--.*?-->', '', 'g') AS t FROM r),
t2 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b.*?</script\s*>', '', 'g'),
  '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<noscript\b.*?</noscript\s*>', '', 'g'), '(?is)<template\b.*?</template\s*>', '', 'g') AS t) FROM t1),
t3 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\n\f]+', ' ', 'g'), '(?i)</?(?:{_BLOCKS})\b[^>]*>', chr(10), 'g'), '</?[a-zA-Z!][^>]*>', '', 'g') AS t) FROM t2),
t4 AS (SELECT * REPLACE (replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t) FROM t3),
t5 AS (SELECT * REPLACE (regexp_replace(regexp_replace(t, '[ \t\n]*\n[ \t\n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS t), {_B32.format("body")} AS digest,
  {_URN.format("'conversion|' || rid")} AS cid, trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n\f]+', ' ', 'g'), ' ') AS title,
  list_transform(regexp_extract_all(body, '(?i)<a\s[^>]*?href="([^"\r\n]*)"', 1),
    lambda x: 'outlink: ' || CASE WHEN starts_with(x, '/') AND NOT starts_with(x, '//') THEN regexp_replace(base, '[\r\n]+', ' ', 'g') || x ELSE x END) AS links FROM t4),
m AS (SELECT page_id, 'metadata' AS record_type, {_URN.format("'metadata|' || rid")} AS record_id, rid, url, 'application/warc-fields' AS content_type, digest,
  array_to_string(list_concat(['source-status: HTTP/1.1 200 OK', 'source-payload-length: ' || strlen(body), 'source-payload-digest: ' || digest,
    'conversion: ' || CASE WHEN html IS NULL THEN 'none' ELSE cid END, 'title: ' || title, 'source-header: Content-Type: text/html; charset=utf-8',
    'source-header: Content-Length: ' || strlen(body)], links), chr(13) || chr(10)) || chr(13) || chr(10) AS block FROM t5
  UNION ALL SELECT page_id, 'conversion', cid, rid, url, 'text/plain', digest, t FROM t5 WHERE html IS NOT NULL)
SELECT page_id, record_type, record_id, rid AS refers_to, url AS target_uri, '{DATE}' AS warc_date, content_type, CAST(strlen(block) AS BIGINT) AS content_length,
  {_B32.format("block")} AS block_digest, digest AS source_payload_digest, block FROM m
"""
