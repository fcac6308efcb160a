"""Small sources: rosters whose cells are links, price series cut from a large CSV, listing pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import category, status
from .releases import blank


def anchor(cell: Column) -> tuple[Column, Column]:
    """Name and target of a cell that is one link; a cell without one is a name."""
    link = F.regexp_extract(cell, r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]*>", " "), r"\s+", " "))
    return blank(name), blank(link)


def roster(spark: SparkSession, path: str, cell: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of a roster CSV with name and website from its link cell; rows without a name are left out."""
    rows = spark.read.csv(path, header=True, encoding=encoding, escape='"', multiLine=True)
    name, site = anchor(F.col(f"`{cell}`"))
    return rows.withColumns({"name": name, "website": site}).where("name is not null")


def price_index(spark: SparkSession, path: str, where: dict[str, str], period: str = "REF_DATE", value: str = "VALUE") -> DataFrame:
    """(quarter, value) of the rows of a large CSV with the given values; months give their quarter. Empty values are left out."""
    rows = spark.read.csv(path, header=True, escape='"')
    names = {re.sub("^﻿", "", c).strip(): c for c in rows.columns}
    for column, wanted in where.items():
        rows = rows.where(F.col(f"`{names[column]}`") == wanted)
    when, number = F.col(f"`{names[period]}`"), F.col(f"`{names[value]}`").try_cast("double")
    year, month = F.substring(when, 1, 4), F.substring(when, 6, 2).try_cast("int")
    quarter = F.concat(year, F.lit("-Q"), F.floor((month - 1) / 3 + 1).cast("string"))
    return rows.select(quarter.alias("quarter"), number.alias("value")).where("quarter is not null and value is not null")


class Listing(HTMLParser):
    """Rows of a page's tables: the first link that looks like a notice's, and the text of the cells."""

    def __init__(self, hint: str):
        super().__init__(convert_charrefs=True)
        self.hint = re.compile(hint, re.IGNORECASE)
        self.rows: list[tuple[str, str, list[str]]] = []
        self.link: str | None = None
        self.title: list[str] = []
        self.cells: list[list[str]] = []
        self.in_link = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.link, self.title, self.cells, self.in_link = None, [], [], False
        elif tag in ("td", "th"):
            self.cells.append([])
        elif tag == "a" and self.link is None and self.hint.search(dict(attrs).get("href") or ""):
            self.link, self.in_link = dict(attrs)["href"], True

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag == "tr":
            title = " ".join("".join(self.title).split())
            if self.link and title:
                self.rows.append((self.link, title, [" ".join("".join(c).split()) for c in self.cells]))
            self.link = None

    def handle_data(self, data: str) -> None:
        if self.in_link:
            self.title.append(data)
        if self.cells:
            self.cells[-1].append(data)


def listings(pages: DataFrame, hint: str = r"/tender/detail/|/notice/", now: Column | None = None) -> DataFrame:
    """Notices of listing pages (url, html, buyer_name, region): each row of a table with a notice's link, once by target.

    The closing time is the first cell that reads like "Tuesday, August 18, 2026 2:00:00 PM". Pages without such rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                reader = Listing(hint)
                reader.feed(row["html"] or "")
                reader.close()
                out += [(row["url"], urljoin(row["url"] or "", link), title, cells, k, row["buyer_name"], row["region"]) for k, (link, title, cells) in enumerate(reader.rows)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "notice_url", "title", "cells", "pos", "buyer_name", "region"])

    rows = pages.select("url", "html", "buyer_name", "region").mapInArrow(run, "page string, notice_url string, title string, cells array<string>, pos int, buyer_name string, region string")
    stamp = r"([A-Z][a-z]+) (\d{1,2}), (\d{4}) (\d{1,2}):(\d{2})(?::\d{2})? ?([AP]M)"
    part = lambda c, k: F.regexp_extract(c, stamp, k)
    said = F.transform("cells", lambda c: F.when(part(c, 1) != "", F.concat_ws(" ", part(c, 1), part(c, 2), part(c, 3), part(c, 4), part(c, 5), part(c, 6))))
    rows = rows.withColumn("closing", F.try_to_timestamp(F.get(F.array_compact(said), F.lit(0)), F.lit("MMMM d yyyy h m a")))
    host = F.regexp_replace(F.coalesce(F.parse_url(F.col("notice_url"), F.lit("HOST")), F.lit("")), r"^www\.", "")
    last = F.element_at(F.filter(F.split(F.regexp_replace("notice_url", "[?#].*$", ""), "/"), lambda x: x != ""), -1)
    rows = rows.withColumn("source_id", F.concat(host, F.lit(":"), last)).groupBy("source_id").agg(F.min_by(F.struct("notice_url", "title", "closing", "buyer_name", "region"), F.struct("page", "pos")).alias("r")).select("source_id", "r.*")
    now = F.current_timestamp() if now is None else now
    none = F.lit(None).cast("string")
    return rows.select("source_id", "title", "notice_url", "buyer_name", F.lit("municipal").alias("buyer_type"), category(none, none, F.col("title"), none, F.array().cast("array<string>")).alias("category_normalized"), F.coalesce("region", F.lit("ON")).alias("region"), F.col("closing").alias("closing_date"), status(F.lit("open"), F.col("closing"), now).alias("status"))
