"""Rows out of stored HTML pages: links, text blocks and dated records, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_url, normalize_tag, normalize_text, parse_date, parse_rating, text_hash

_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK_SCHEMA = "box int, source_id string, kind string, body string, tags array<string>, title string, author string, author_href string, votes string, rates string"


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.links: list[tuple[str, str]] = []
        self.open: list[str] | None = None
        self.href = ""

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.close_link()
            self.href, self.open = href, []

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)

    def handle_endtag(self, tag):
        if tag == "a":
            self.close_link()

    def close_link(self):
        if self.open is not None:
            self.links.append((self.href, "".join(self.open)))
            self.open = None


class _Boxes(HTMLParser):
    """Boxes of one class, each with its text, tags, title, author and votes; nesting is kept on a stack."""

    def __init__(self) -> None:
        super().__init__()
        self.boxes: list[dict] = []
        self.stack: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        inside = bool(self.boxes) and any(role == "box" for _, role in self.stack)
        role = ""
        if tag == "div" and "topicbox" in classes:
            role = "box"
            self.boxes.append({"source_id": a.get("data-id"), "kind": a.get("data-t"), "body": None, "tags": [], "title": None, "author": None, "author_href": None, "votes": None, "rates": None})
        elif inside:
            box = self.boxes[-1]
            if tag == "div" and "text" in classes and box["body"] is None:
                role, box["body"] = "body", ""
            elif tag == "div" and "tags" in classes:
                role = "tags"
            elif tag == "a" and "/tags/" in (a.get("href") or "") and any(r == "tags" for _, r in self.stack):
                role = "tag"
                box["tags"].append("")
            elif tag == "p" and "title" in classes and box["title"] is None:
                role, box["title"] = "title", ""
            elif tag == "a" and "auth" in classes and box["author"] is None:
                role, box["author"], box["author_href"] = "author", "", a.get("href")
            elif "num" in classes and box["votes"] is None:
                role, box["votes"] = "votes", ""
            elif "rates" in classes and a.get("data-r") is not None:
                box["rates"] = a["data-r"]
        if tag == "br" and self.role() == "body":
            self.boxes[-1]["body"] += "\n"
        if tag not in _VOID:
            self.stack.append((tag, role))

    def role(self) -> str:
        return next((r for _, r in reversed(self.stack) if r), "")

    def handle_data(self, data):
        role = self.role()
        if role in ("body", "title", "author", "votes"):
            self.boxes[-1][role] += data
        elif role == "tag":
            self.boxes[-1]["tags"][-1] += data

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break


def parse_links(html: str | None) -> list[tuple[str, str]]:
    p = _Links()
    p.feed(html or "")
    p.close()
    p.close_link()
    return p.links


def parse_boxes(html: str | None) -> list[dict]:
    p = _Boxes()
    p.feed(html or "")
    p.close()
    return p.boxes


def _table(pages: DataFrame, key: str, parse: Callable[[str | None], list[tuple]], names: list[str], schema: str) -> DataFrame:
    kind = dict(pages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *row) for k, html in zip(frame[key], frame["html"], strict=True) for row in parse(html)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, {schema}")


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, at, href, label) of every link."""
    return _table(pages, key, lambda h: [(i, a, b) for i, (a, b) in enumerate(parse_links(h))], ["at", "href", "label"], "at int, href string, label string")


def link_dictionary(found: DataFrame, base: str, key: str = "page_id") -> DataFrame:
    """(tag_norm, tag_raw, url) of labelled links, the first of each normal form, sorted."""
    each = found.select(key, "at", "href", F.trim("label").alias("tag_raw")).where("tag_raw <> ''").withColumn("tag_norm", normalize_tag(F.col("tag_raw")))
    first = each.groupBy("tag_norm").agg(F.min(F.struct(key, "at", "tag_raw", "href")).alias("f"))
    return first.select("tag_norm", "f.tag_raw", join_url(base, F.col("f.href")).alias("url")).orderBy("tag_norm")


def blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Boxes of every page as they stand."""
    names = ["box", "source_id", "kind", "body", "tags", "title", "author", "author_href", "votes", "rates"]
    return _table(pages, key, lambda h: [(i, *(b[n] for n in names[1:])) for i, b in enumerate(parse_boxes(h))], names, BLOCK_SCHEMA)


def records(found: DataFrame, year: int, month: int, base: str) -> DataFrame:
    """Corpus records of boxes: those of kind ``j`` that have a text and a tag; all others are rejected early."""
    body = normalize_text(F.col("body"))
    tags = F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != ""))
    kept = found.where("body IS NOT NULL AND coalesce(kind, 'j') = 'j' AND size(tags) > 0").withColumns({"text": body, "tags_raw": tags}).where("text <> '' AND size(tags_raw) > 0")
    made = F.substring(text_hash(F.concat(F.lit(f"{year}-{month}-"), F.col("text"))), 1, 16)
    return kept.select(
        F.coalesce("source_id", made).alias("id"),
        F.lit(year).alias("year"),
        F.lit(month).alias("month"),
        parse_date(F.coalesce("title", F.lit("")), F.lit(year), F.lit(month)).alias("date"),
        "text",
        F.char_length("text").alias("text_length_chars"),
        parse_rating(F.col("votes"), F.col("rates")).alias("rating"),
        F.trim("author").alias("author"),
        join_url(base, F.col("author_href")).alias("author_url"),
        "tags_raw",
    )


def long_texts(found: DataFrame, least: int = 30) -> DataFrame:
    """Every box text above a length, whatever its tags."""
    return found.select("page_id", "box", normalize_text(F.col("body")).alias("text")).where(F.char_length("text") > least)


def first_source(candidates: DataFrame, group: str, order: str, content: str) -> DataFrame:
    """The first candidate of each group whose content is not empty."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return candidates.where(F.col(content).isNotNull() & (F.trim(content) != "")).withColumn("__r", rank).where("__r = 1").drop("__r")
