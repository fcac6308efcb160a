"""Notices from pages that list documents of tenders: links grouped by the tender's number, dates and states from the smallest element around.

pages has slug, buyer_name, url, html and documents_open. A page is read once, a batch at a time in Python, into its links and its row-like
elements with a link; an element's text is kept only up to MOST_ROW signs, so nested containers cost no more than the page. Grouping, titles,
rows and dates are column expressions. A link counts once by its target, at its first place. Null html has no notices; documents without a
number and notices without a title are left out; repeated pages give their notices once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.normalize import status
from ..functions.text import fold
from ..operators.census import EXTENSIONS, HOSTS, TENDER, on_platform

#: The number in front of a tender, what ends an amendment's name, labels, states and dates of listing rows.
NUMBER = r"(?i)(?<![a-z0-9])((?:rfp|rfq|rft|itt|itb|cr|pw|t|q)[-_ ]?\d{2,4}[-_ ]?\d{1,4})"
ADDENDUM = r"(?i)[-_ ](?:addendum|addenda|amendment|amd|revision|rev|update)[-_ ]?\d*$"
CLOSING_LABEL = r"(?i)clos(?:es|ing|ed)?\s*(?:date|on)?\s*[:\-]?\s*(.{0,40})"
ROW_STATUS = r"(?i)\b(?:closed|cancelled|canceled|awarded|unofficial results|open|accepting submissions|now accepting)\b"
DATE_TEXT = r"[A-Za-z]+ \d{1,2},? \d{4}(?: \d{1,2}:\d{2} ?[APap]\.?[Mm]\.?)?|\d{4}-\d{2}-\d{2}"
OVER = "closed|cancel|awarded|unofficial results"
ROWS = ("tr", "li", "dd", "p", "div", "article", "section")
MOST_ROW = 600
#: Elements without an end, and those whose text is not shown.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
UNSEEN = ("script", "style", "template")


class Reader(HTMLParser):
    """links: (href, text); rows: texts of row-like elements with a link, no longer than MOST_ROW."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.said: list[str] = []
        self.signs = 0
        self.stack: list[list] = []  # tag, first text, signs before, link inside, href
        self.links: list[tuple[int, str, str]] = []
        self.rows: list[str] = []
        self.unseen = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        href = dict(attrs).get("href") if tag == "a" else None
        if href is not None:
            for element in self.stack:
                element[3] = True
        if tag not in VOID:
            self.stack.append([tag, len(self.said), self.signs, False, href, len(self.links)])
            self.unseen += tag in UNSEEN
            if href is not None:
                self.links.append((len(self.links), href, ""))

    def handle_endtag(self, tag: str) -> None:
        if any(element[0] == tag for element in self.stack):
            while self._closed() != tag:
                pass

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not self.unseen:
            self.said.append(data)
            self.signs += len(data) + 1

    def _closed(self) -> str:
        tag, first, signs, linked, href, place = self.stack.pop()
        self.unseen -= tag in UNSEEN
        if href is not None:
            self.links[place] = (place, href, " ".join(self.said[first:]))
        elif linked and tag in ROWS and self.signs - signs <= 4 * MOST_ROW:
            text = re.sub(r"\s+", " ", " ".join(self.said[first:]))
            if 0 < len(text) <= MOST_ROW:
                self.rows.append(text)
        return tag

    def close(self) -> None:
        super().close()
        while self.stack:
            self._closed()


def stem(name: str) -> str:
    return PurePosixPath(name).stem


def read_page(html: str | None, base: str | None) -> dict:
    page, seen, links = Reader(), set(), []
    page.feed(html or "")
    page.close()
    for _, href, text in page.links:
        try:
            url = urljoin(base or "", href.strip())
            path = urlparse(url).path
        except ValueError:  # an href that is no URL leads nowhere
            continue
        if href.strip() and path.casefold().endswith(EXTENSIONS) and url not in seen:
            seen.add(url)
            name = path.rsplit("/", 1)[-1]
            words = re.sub(r"[-_]+", " ", stem(name)).strip()
            links.append({"url": url, "text": text, "filename": name, "file_stem": stem(name), "text_stem": stem(text), "file_title": words[:200].title() if len(words) > 6 else ""})
    return {"links": links, "rows": page.rows}


def contents(html: Column, base: Column) -> Column:
    link = [("url", pa.string()), ("text", pa.string()), ("filename", pa.string()), ("file_stem", pa.string()), ("text_stem", pa.string()), ("file_title", pa.string())]
    kind = pa.struct([("links", pa.list_(pa.struct(link))), ("rows", pa.list_(pa.string()))])

    @arrow_udf(f"struct<links:array<struct<{','.join(f'{n}:string' for n, _ in link)}>>,rows:array<string>>")
    def of(pages: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([read_page(h, b) for h, b in zip(pages.to_pylist(), bases.to_pylist(), strict=True)], kind)

    return of(html, base)


def number_of(c: Column) -> Column:
    """The tender's number in a text, in lower case with hyphens; null if there is none."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(c, NUMBER, 1), "[-_ ]", "-")), F.lit(""))


def is_addendum(c: Column) -> Column:
    return c.rlike(ADDENDUM)


def date_of(c: Column) -> Column:
    """The first date of a text as a timestamp: a month's name, day, year and perhaps a time, or year, month and day."""
    found = F.regexp_extract(fold(c), r"([a-z]+ \d{1,2},? \d{4}(?: \d{1,2}:\d{2} ?[ap]m)?|\d{4}-\d{2}-\d{2})", 1)
    plain = F.initcap(F.regexp_replace(F.replace(found, F.lit(","), F.lit("")), r"(\d) ?([ap]m)$", "$1 $2"))
    clock = F.regexp_replace(F.regexp_replace(plain, "Am$", "AM"), "Pm$", "PM")
    return F.coalesce(*(F.try_to_timestamp(clock, F.lit(form)) for form in ("MMMM d yyyy h:m a", "MMMM d yyyy", "MMM d yyyy", "yyyy-MM-dd")))


def notices(pages: DataFrame, now: Column, hosts: tuple[str, ...] = HOSTS) -> DataFrame:
    """A row for each notice: slug, url, notice_id, title, documents (packages first), closing_text and status_text."""
    key = ["slug", "url", "number"]
    read = pages.select("slug", "url", contents(F.col("html"), F.col("url")).alias("c"))
    link = read.select("slug", "url", F.posexplode("c.links").alias("pos", "d")).select("slug", "url", "pos", "d.*")
    link = link.toDF("slug", "url", "pos", "document", *link.columns[4:]).where(~on_platform(F.col("document"), hosts) & F.concat_ws(" ", "filename", "text").rlike(f"(?i){TENDER}"))
    link = link.withColumns({"number": F.coalesce(number_of(F.col("file_stem")), number_of(F.col("text_stem"))), "package": ~is_addendum(F.col("file_stem"))}).where("number is not null")
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    titled = (F.length(said) > 12) & ~F.lower(said).rlike("^(download|click|pdf)")
    link = link.withColumn("title", F.when(titled, F.substring(said, 1, 200)).otherwise(F.col("file_title")))
    order = F.struct("package", F.length("title").alias("n"), (-F.col("pos")).alias("p"))
    document = F.struct(F.when(F.col("package"), 0).otherwise(1).alias("k"), F.col("document").alias("url"), "filename", F.col("text").alias("link_text"))
    grouped = link.groupBy(*key).agg(F.max_by("title", F.when(F.col("title") != "", order)).alias("title"), F.array_sort(F.collect_set(document)).alias("d"))
    grouped = grouped.where(F.col("title") != "").withColumn("documents", F.transform("d", lambda x: F.struct(x["url"].alias("url"), x["filename"].alias("filename"), x["link_text"].alias("link_text"), F.when(x["k"] == 0, "package").otherwise("addendum").alias("kind"))))

    row = read.select("slug", "url", F.explode("c.rows").alias("text")).withColumn("number", number_of(F.col("text"))).where("number is not null")
    labelled = F.when(F.col("text").rlike(CLOSING_LABEL), F.regexp_extract("text", CLOSING_LABEL, 1)).otherwise(F.col("text"))
    least = lambda c: F.min(F.when(c != "", F.struct(F.length("text").alias("n"), F.col("text").alias("t"), c.alias("v"))))["v"]
    facts = row.groupBy(*key).agg(least(F.trim(F.regexp_extract(labelled, DATE_TEXT, 0))).alias("closing_text"), least(F.lower(F.regexp_extract("text", ROW_STATUS, 0))).alias("status_text"))
    return grouped.join(facts, key, "left").select("slug", "url", F.upper("number").alias("notice_id"), "title", "documents", "closing_text", "status_text")


def records(pages: DataFrame, now: Column, hosts: tuple[str, ...] = HOSTS) -> DataFrame:
    """Notices as unified records with their documents. A row that says a notice is over outranks its date; without either it is unknown."""
    place = pages.groupBy("slug", "url").agg(F.first("buyer_name").alias("buyer_name"), F.first("documents_open").alias("documents_open"))
    rows = notices(pages, now, hosts).join(place, ["slug", "url"]).withColumn("closing_date", date_of(F.col("closing_text")))
    over = F.coalesce(F.col("status_text").rlike(OVER), F.lit(False))
    state = F.when(over, "closed").when(F.col("closing_date").isNotNull(), status(F.lit("open"), F.col("closing_date"), now)).otherwise("unknown")
    return rows.select(
        F.lit("municipal_site").alias("source"), F.concat("slug", F.lit(":"), F.lower("notice_id")).alias("source_id"), "title", "buyer_name", F.lit("municipal").alias("buyer_type"), F.lit("ON").alias("region"), "closing_date",
        F.col("url").alias("notice_url"), "documents_open", state.alias("status"), "notice_id", "documents", "closing_text", "status_text",
    )
