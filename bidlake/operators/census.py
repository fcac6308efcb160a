"""A census of procurement pages: links scored, pages judged, a page found from a homepage, one verdict a place, populations joined.

Nothing is fetched here: pages have url and html, a crawl has one row for each url with final_url, status, error, robots_ok and html as well.
Null html is an empty page. Links are parsed a batch at a time in Python, as hrefs are resolved by the rules of URLs; all the rest are column
expressions. Words, weights, hosts and paths are parameters.
"""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser
from operator import add
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import fold
from .shared import bounded_batches

#: Words of links and what each is worth.
WEIGHTS = (
    ("bids and tenders", 14), ("bids-and-tenders", 14), ("bid opportunit", 12), ("tender", 10), ("request for proposal", 9), ("request for quotation", 9), (" rfp", 8), ("rfp", 6), ("rfq", 6),
    ("procurement", 7), ("bidding", 6), ("bid", 4), ("purchasing", 3), ("business opportunit", 5), ("doing business", 5), ("supplier", 3), ("vendor", 3),
    ("budget", -6), ("by-law", -5), ("bylaw", -5), ("policy", -4), ("policies", -4), ("minutes", -5), ("agenda", -5), ("council", -3), ("career", -6), ("employment", -6), ("job", -5), ("news", -4),
    ("surplus", -3), ("auction", -3), ("tax", -3), ("forbidden", -10),
)
LEAST_SCORE, STRONG_SCORE = 4, 10
#: Paths tried where a homepage links nothing.
PATHS = ("/tenders", "/bids", "/procurement", "/bids-and-tenders", "/business/tenders", "/rfp")
#: What names a platform, the class of a page that points there, and the platform's name.
PLATFORMS = (
    ("bidsandtenders.ca", "bids_and_tenders", "bidsandtenders"), ("bidsandtenders.com", "bids_and_tenders", "bidsandtenders"), ("biddingo.com", "biddingo", "biddingo"), ("biddingo", "biddingo", "biddingo"),
    ("bidnetdirect", "bidnet_or_other_platform", "bidnet"), ("merx.com", "bidnet_or_other_platform", "merx"), ("bonfirehub", "bidnet_or_other_platform", "bonfire"), ("gobonfire", "bidnet_or_other_platform", "bonfire"),
    ("ariba.com", "bidnet_or_other_platform", "ariba"), ("jaggaer", "bidnet_or_other_platform", "jaggaer"), ("questcdn", "bidnet_or_other_platform", "questcdn"), ("ionwave", "bidnet_or_other_platform", "ionwave"),
)
#: Hosts of platforms.
HOSTS = (
    "bidsandtenders.ca", "bidsandtenders.com", "biddingo.com", "bidnetdirect.ca", "bidnetdirect.com", "merx.com", "bonfirehub.ca", "bonfirehub.com", "gobonfire.com", "ariba.com", "jaggaer.com", "questcdn.com",
    "ionwave.net", "procurementsolutions.ca",
)
#: Files that are documents, and what marks tender documents, policies, pages behind a login and opportunities.
EXTENSIONS = (".pdf", ".doc", ".docx", ".zip", ".xls", ".xlsx")
TENDER = (
    r"(?:(?<![a-z])(?:t|q|rfp|rfq|rft|itt|itb|cr|pw)[-_ ]?\d{2,4}[-_ ]?\d{1,4})|tender|request for proposal|request for quotation|quotation|invitation to (?:bid|tender)"
    r"|bid (?:package|document|opportunit)"
)
POLICY = (
    r"policy|policies|by[-_ ]?law|terms and conditions|guideline|procedure|standard|report|minutes|agenda|form|checklist|insurance|safety|manual|code of conduct|strategy|plan\b"
)
GATED = (
    r"create an? (?:vendor|supplier|bidder)? ?account|vendor registration|supplier registration|register (?:to bid|as a (?:vendor|supplier|bidder))|registered vendors|bidding system|log ?in to view"
    r"|must be registered to (?:bid|submit)|sign in to (?:view|bid)|plan ?takers|vendor portal|bidder portal"
)
OPPORTUNITIES = ("tender", "request for proposal", "request for quotation", "bid opportunit", "current opportunit", "closing date")
PROCUREMENT = ("tender", "request for proposal", "bid opportunit", "procurement")
#: Fragments that tell a content system.
SYSTEMS = (
    ("esolutionsgroup", "esolutionsgroup"), ("escribe", "escribe"), ("civicplus", "civicplus"), ("civiclive", "civiclive"), ("granicus", "granicus"), ("wordpress", "wordpress"), ("drupal", "drupal"),
    ("squarespace", "squarespace"), ("/media/", "media-hash-cms"),
)
#: Buckets of classes.
BUCKETS = {
    "bids_and_tenders": ("bids_and_tenders",), "unknown": ("no_procurement_page_found", "fetch_failed", "no_website_listed", "robots_disallowed"), "notices_gated": ("own_site_notices",),
    "other_platforms": ("biddingo", "bidnet_or_other_platform"), "open": ("own_site_open",),
}
#: Words of a status in a place's name, and what a slug ends in for each; and statuses that end names.
STATUS_ENDS = (
    ("regional municipality", "region"), ("united counties", "united-counties"), ("separated town", "town"), ("township", "township"), ("municipality", "municipality"), ("village", "village"),
    ("county", "county"), ("district", "district"), ("city", "city"), ("town", "town"),
)
STATUSES = "district municipality|regional municipality|united counties|separated town|township|town|city|municipality|village|county|district|borough"
REDIRECTED = "redirected to a procurement platform"


class Anchors(HTMLParser):
    """href and text of the links of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, list[str]]] = []
        self.open: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.open = []
            self.links.append(((dict(attrs).get("href") or "").strip(), self.open))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open.append(data)


def page_links(html: str | None, base: str | None) -> list[dict[str, str]]:
    page, out = Anchors(), []
    page.feed(html or "")
    page.close()
    for href, text in page.links:
        try:
            url = urljoin(base or "", href)
        except ValueError:  # an href that is no URL leads nowhere
            continue
        if href:
            out.append({"href": href, "url": url, "text": " ".join(" ".join(text).split())})
    return out


def anchors(html: Column, base: Column) -> Column:
    """array<struct<href, url, text>> of the links that have an href, resolved against the page's url."""
    kind = pa.list_(pa.struct([("href", pa.string()), ("url", pa.string()), ("text", pa.string())]))

    @arrow_udf("array<struct<href:string,url:string,text:string>>")
    def of(pages: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([page_links(h, b) for h, b in zip(pages.to_pylist(), bases.to_pylist(), strict=True)], kind)

    return of(html, base)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def same_host(a: Column, b: Column) -> Column:
    bare = lambda c: F.regexp_replace(host(c), r"^www\.", "")
    return (bare(a) != "") & (bare(a) == bare(b))


def on_platform(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether the host is one of these or below one."""
    return F.exists(F.array(host(url)), lambda u: reduce(lambda a, b: a | b, ((u == h) | u.endswith(f".{h}") for h in hosts), F.lit(False)))  # parsed once


def link_score(href: Column, text: Column, weights=WEIGHTS) -> Column:
    """Sum of the weights of words that the folded href and text hold; hyphens and underscores count as blanks."""
    said = lambda c: F.regexp_replace(F.replace(fold(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit(" ")), r"[\s_]+", " ")
    hay = F.concat(F.lit(" "), said(href), F.lit(" "), said(text), F.lit(" "))
    return F.transform(F.array(hay), lambda h: reduce(add, (F.when(h.contains(term), points).otherwise(0) for term, points in weights)))[0]  # folded once


def links(pages: DataFrame, hosts: tuple[str, ...] = HOSTS, weights=WEIGHTS, least: int = LEAST_SCORE) -> DataFrame:
    """url, link, text, score, is_platform, same_host, first: links of each page worth least or more, once a target with its best text.

    Of equal scores the first text on the page stays. Best links come first by score descending, shorter ones first, then by first.
    """
    each = pages.select("url", F.posexplode(anchors(F.col("html"), F.col("url"))).alias("pos", "a")).select("url", "pos", F.col("a.href").alias("href"), F.col("a.url").alias("link"), F.col("a.text").alias("text"))
    web = each.where(F.col("link").rlike("(?i)^https?:") & ~F.col("href").startswith("#")).withColumn("score", link_score(F.col("href"), F.col("text"), weights)).where(F.col("score") >= least)
    best = web.groupBy("url", "link").agg(F.max_by("text", F.struct("score", -F.col("pos"))).alias("text"), F.max("score").alias("score"), F.min("pos").alias("first"))
    return best.withColumns({"is_platform": on_platform(F.col("link"), hosts), "same_host": same_host(F.col("link"), F.col("url"))})


def better() -> Column:
    """Smallest for the best link."""
    return F.struct(-F.col("score"), F.length("link"), "first")


def bare_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style).*?</\1>", " "), "<[^>]+>", " ")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(text), lambda t: reduce(lambda a, b: a | b, (t.contains(w) for w in words)))


def judge(pages: DataFrame, hosts: tuple[str, ...] = HOSTS, platforms=PLATFORMS) -> DataFrame:
    """pages with class, platform, confidence, n_tender, n_policy, gated, documents (tender documents' urls) and system.

    A page that links or names a platform is of the platform's class, whatever documents it has; else tender documents make it open, other
    documents or words of opportunities make it one with notices. Open pages are sure from two tender documents on, more than policies, and
    unless there are fewer than five beside words of registration.
    """
    text = F.lower(F.coalesce("html", F.lit("")))
    kind = lambda c: F.coalesce(*(F.when(c.contains(part), F.struct(F.lit(name).alias("class"), F.lit(whose).alias("platform"))) for part, name, whose in platforms))
    path = lambda c: F.lower(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")))
    bounded_batches(pages.sparkSession)
    rows = pages.withColumn("_links", anchors(F.col("html"), F.col("url")))
    linked = F.get(F.filter(F.transform("_links", lambda a: kind(F.lower(a["url"]))), lambda k: k.isNotNull()), 0)
    files = F.filter("_links", lambda a: path(a["url"]).rlike(rf"(?:{'|'.join(e.replace('.', '[.]') for e in EXTENSIONS)})$") & ~on_platform(a["url"], hosts))
    rows = rows.withColumns({"_kind": F.coalesce(linked, kind(text)), "_files": files})
    once = F.filter("_files", lambda a, i: F.array_position(F.transform("_files", lambda b: b["url"]), a["url"]) == i + 1)
    named = F.transform(once, lambda a: F.struct(a["url"].alias("url"), F.concat_ws(" ", F.element_at(F.split(F.try_parse_url(a["url"], F.lit("PATH")), "/"), -1), a["text"]).alias("name")))
    rows = rows.withColumn("_files", named)
    tender = lambda d: d["name"].rlike(f"(?i){TENDER}")
    rows = rows.withColumns({"_tenders": F.filter("_files", tender), "n_policy": F.size(F.filter("_files", lambda d: ~tender(d) & d["name"].rlike(f"(?i){POLICY}"))), "gated": bare_text(F.coalesce("html", F.lit(""))).rlike(f"(?i){GATED}")})
    n, platform = F.size("_tenders"), F.col("_kind").isNotNull()
    noticed = (F.size("_files") > 0) | holds(fold(bare_text(F.coalesce("html", F.lit("")))), OPPORTUNITIES)
    sure = (n >= 2) & (n > F.col("n_policy")) & ~(F.col("gated") & (n < 5))
    return rows.select(
        *pages.columns,
        F.when(platform, F.col("_kind.class")).when(n > 0, "own_site_open").when(noticed, "own_site_notices").otherwise("no_procurement_page_found").alias("class"),
        F.col("_kind.platform").alias("platform"),
        F.when(platform | (n > 0) & sure, "high").when((n > 0) | noticed, "low").alias("confidence"),
        F.when(~platform, n).otherwise(0).alias("n_tender"), F.when(~platform, F.col("n_policy")).otherwise(0).alias("n_policy"), "gated",
        F.when(~platform, F.transform("_tenders", lambda d: d["url"])).otherwise(F.array().cast("array<string>")).alias("documents"),
        F.coalesce(*(F.when(text.contains(part), name) for part, name in SYSTEMS)).alias("system"),
    )


def fetched_well() -> Column:
    return F.col("error").isNull() & F.coalesce(F.col("status").between(200, 299), F.lit(False))


def find(sites: DataFrame, crawl: DataFrame, hosts: tuple[str, ...] = HOSTS, strong: int = STRONG_SCORE) -> DataFrame:
    """For each of sites (slug, website): page_url, page_html, page_score, platform_link, robots_ok, home_status, home_error.

    A platform linked from the homepage ends the search. Else the best two links of the same host are looked up, the first that was fetched
    (or leads to a platform) counts; a page reached by a weak link gives way to the best stronger link on it, if that was fetched. Where no
    link was fetched, conventional paths are tried in order, and the first that speaks of procurement counts. No site's links are gathered.
    """
    seen = crawl.select(F.col("url").alias("asked"), F.coalesce(F.nullif("final_url", F.lit("")), "url").alias("reached"), "status", "error", F.coalesce("robots_ok", F.lit(True)).alias("robots_ok"), F.coalesce("html", F.lit("")).alias("html"))
    home = sites.select("slug", "website").join(seen.withColumnRenamed("asked", "website"), "website", "left").withColumn("ok", fetched_well() & F.col("robots_ok"))
    state = home.select("slug", F.coalesce("robots_ok", F.lit(True)).alias("robots_ok"), F.col("status").alias("home_status"), F.col("error").alias("home_error"))
    start = home.where("ok").select("slug", F.col("reached").alias("url"), "html")
    linked = start.select("slug", "url").join(links(start.select("url", "html").dropDuplicates(["url"]), hosts), "url")
    platform = linked.where("is_platform").groupBy("slug").agg(F.min_by("link", better()).alias("platform_link"))
    order = Window.partitionBy("slug").orderBy(F.col("score").desc(), F.length("link"), "first")
    tried = linked.where("same_host and not is_platform").withColumn("place", F.row_number().over(order)).where("place <= 2").select("slug", "place", "score", "link")
    tried = tried.join(seen.withColumnRenamed("asked", "link"), "link").withColumn("away", F.coalesce(F.col("error") == REDIRECTED, F.lit(False))).where(F.col("away") | fetched_well())
    first = tried.groupBy("slug").agg(F.min_by(F.struct("away", "reached", "score", "html"), "place").alias("f")).select("slug", "f.*")
    weak = first.where(~F.col("away") & (F.col("score") < strong)).select("slug", F.col("reached").alias("url"), F.col("score").alias("had"), "html")
    deeper = weak.select("slug", "url", "had").join(links(weak.select("url", "html").dropDuplicates(["url"]), hosts), "url").where("same_host and not is_platform and score > had and link != url")
    deeper = deeper.groupBy("slug").agg(F.min_by(F.struct("link", "score"), better()).alias("d")).select("slug", F.col("d.link").alias("asked"), F.col("d.score").alias("deep_score"))
    deeper = deeper.join(seen.where(fetched_well()), "asked").select("slug", "deep_score", F.col("reached").alias("deep_url"), F.col("html").alias("deep_html"))
    root = F.regexp_extract("url", "^[^:]+://[^/?#]*", 0)
    open_ = start.join(platform, "slug", "left_anti").join(first, "slug", "left_anti")
    paths = open_.select("slug", root.alias("root"), F.posexplode(F.array(*map(F.lit, PATHS))).alias("nth", "path")).select("slug", "nth", F.concat("root", "path").alias("asked"))
    paths = paths.join(seen.where(fetched_well()), "asked").where(holds(fold(F.regexp_replace("html", "<[^>]+>", " ")), PROCUREMENT))
    paths = paths.groupBy("slug").agg(F.min_by(F.struct("reached", "html"), "nth").alias("p")).select("slug", F.col("p.reached").alias("path_url"), F.col("p.html").alias("path_html"))
    rows = state.join(platform, "slug", "left").join(first, "slug", "left").join(deeper, "slug", "left").join(paths, "slug", "left")
    direct, stays = F.col("platform_link").isNotNull(), ~F.coalesce("away", F.lit(False))
    pick = lambda deep, near, path: F.when(~direct & stays, F.coalesce(deep, near, path))
    return rows.select(
        "slug", pick(F.col("deep_url"), F.col("reached"), F.col("path_url")).alias("page_url"), pick(F.col("deep_html"), F.col("html"), F.col("path_html")).alias("page_html"),
        pick(F.col("deep_score"), F.col("score"), F.when(F.col("path_url").isNotNull(), LEAST_SCORE)).alias("page_score"),
        F.coalesce("platform_link", F.when(F.col("away"), F.col("reached"))).alias("platform_link"), "robots_ok", "home_status", "home_error",
    )


def verdicts(sites: DataFrame, crawl: DataFrame, hosts: tuple[str, ...] = HOSTS) -> DataFrame:
    """slug, class, confidence, platform, procurement_url, evidence_url of each of sites (slug, website).

    No website, forbidden by robots, a platform linked, no page (failed if the homepage was), or what the page found is.
    """
    listed = sites.withColumn("website", F.nullif(F.trim("website"), F.lit("")))
    found = find(listed.where("website is not null"), crawl, hosts)
    judged = judge(found.where("page_url is not null").select("slug", F.col("page_url").alias("url"), F.col("page_html").alias("html")), hosts).select("slug", F.col("class").alias("page_class"), F.col("platform").alias("page_platform"), F.col("confidence").alias("page_confidence"))
    rows = listed.select("slug", "website").join(found.drop("page_html"), "slug", "left").join(judged, "slug", "left")
    link = F.lower("platform_link")
    link_class = F.coalesce(*(F.when(link.contains(part), name) for part, name, _ in PLATFORMS), F.lit("bidnet_or_other_platform"))
    link_name = F.coalesce(*(F.when(on_platform(F.col("platform_link"), (h,)), h) for h in hosts), F.lit("unknown"))
    failed = F.col("home_error").isNotNull() | F.coalesce(F.col("home_status") >= 400, F.lit(False))
    cases = (  # condition, class, confidence, platform, evidence
        (F.col("website").isNull(), F.lit("no_website_listed"), F.lit(None), F.lit(None), F.lit(None)),
        (~F.col("robots_ok"), F.lit("robots_disallowed"), F.lit(None), F.lit(None), F.col("website")),
        (F.col("platform_link").isNotNull(), link_class, F.lit("high"), link_name, F.col("platform_link")),
        (F.col("page_url").isNotNull(), F.col("page_class"), F.col("page_confidence"), F.col("page_platform"), F.col("page_url")),
        (failed, F.lit("fetch_failed"), F.lit(None), F.lit(None), F.col("website")),
    )
    pick = lambda k, other: reduce(lambda c, case: c.when(case[0], case[k]), cases[1:], F.when(cases[0][0], cases[0][k])).otherwise(other).cast("string")
    none = F.lit(None)
    reached = F.when(F.col("robots_ok") & F.col("platform_link").isNull(), F.col("page_url"))
    return rows.select("slug", pick(1, F.lit("no_procurement_page_found")).alias("class"), pick(2, none).alias("confidence"), pick(3, none).alias("platform"), reached.alias("procurement_url"), pick(4, F.col("website")).alias("evidence_url"))


def repaired(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 read aright; other texts as they are."""
    twice = F.when(c.rlike("[ÃÂ]") & c.rlike(r"^[\x00-\xff]*$"), F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")))
    return F.coalesce(twice, c)


def _bare_name(folded: Column) -> Column:
    name = F.regexp_replace(folded, rf",\s*(?:{STATUSES})\s*(?:of)?\s*$", "")
    return F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""), r"^[ .,]+|[ .,]+$", "")


def place_name(c: Column) -> Column:
    """A place's name folded, without its status and a type in brackets at the end."""
    return _bare_name(fold(repaired(F.coalesce(c, F.lit("")))))


def name_forms(c: Column) -> Column:
    """The names a place may be listed under, in order: the whole, each side of a blank-slash-blank, and the whole with blanks for hyphens."""
    c = F.coalesce(c, F.lit(""))
    parted = F.split(fold(repaired(F.replace(c, F.lit(" / "), F.lit("\x01")))), "\x01")  # a sign that folding leaves
    sides = F.when(c.contains(" / "), F.transform(parted, lambda side: _bare_name(F.trim(side)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(place_name(c)), sides, F.array(F.replace(place_name(c), F.lit("-"), F.lit(" ")))), lambda n: n != ""))


def place_slug(c: Column) -> Column:
    """The folded name before a comma, with hyphens, ended by the status that follows the comma."""
    name = fold(c)
    base = F.regexp_replace(F.regexp_replace(F.substring_index(name, ",", 1), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    status = F.regexp_extract(name, "^[^,]*,(.*)$", 1)
    end = F.coalesce(*(F.when(status.contains(word), F.lit(f"-{ending}")) for word, ending in STATUS_ENDS), F.lit(""))
    return F.coalesce(F.nullif(F.concat(base, end), F.lit("")), F.lit("unnamed"))


def with_population(roster: DataFrame, places: DataFrame) -> DataFrame:
    """roster (slug, name, tier, area) with population and rule: division, subdivision, county, ambiguous or missing.

    places has pos, name, level ("division" or "subdivision"), code (a division's own, a subdivision's parent's) and population; null ones
    are left out. Upper tiers are divisions. Others are the one subdivision of their names; of several, the first that lies in the division
    named by area, else none. Single tiers without any subdivision, and upper tiers without a division, go by the other level.
    """
    known = places.where("population is not null").select("pos", "level", "code", "population", F.posexplode(name_forms(F.col("name"))).alias("nth", "key"))
    divisions = known.where("level = 'division'").groupBy("key").agg(F.min_by(F.struct("code", "population"), F.struct("pos", "nth")).alias("d")).select("key", "d.*")
    subdivisions = known.where("level = 'subdivision'").select("key", "pos", "code", "population")
    keys = roster.select("slug", F.posexplode(name_forms(F.col("name"))).alias("nth", "key"))
    area = roster.select("slug", F.posexplode(name_forms(F.col("area"))).alias("nth", "key")).join(divisions, "key").groupBy("slug").agg(F.min_by("code", "nth").alias("wanted"))
    own = keys.join(divisions, "key").groupBy("slug").agg(F.min_by("population", "nth").alias("division"))
    each = subdivisions.groupBy("key").agg(F.count("*").alias("n"), F.min_by("population", "pos").alias("first"))
    inside = subdivisions.groupBy("key", F.col("code").alias("wanted")).agg(F.min_by("population", "pos").alias("inside"))
    several = keys.join(each, "key").join(area, "slug", "left").join(inside, ["key", "wanted"], "left").groupBy("slug").agg(
        F.sum("n").alias("n"), F.min_by("first", "nth").alias("first"), F.min_by("inside", F.when(F.col("inside").isNotNull(), F.col("nth"))).alias("inside")
    )
    rows = roster.join(own, "slug", "left").join(several, "slug", "left")
    upper, whole = (F.col("tier") == "upper") & F.col("division").isNotNull(), F.col("n").isNull() & (F.col("tier") == "single") & F.col("division").isNotNull()
    rule = F.when(upper | whole, "division").when(F.col("n") == 1, "subdivision").when(F.col("inside").isNotNull(), "county").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    value = F.when(rule == "division", F.col("division")).when(rule == "subdivision", F.col("first")).when(rule == "county", F.col("inside"))
    return rows.select(*(c for c in roster.columns if c not in ("population", "rule")), value.alias("population"), rule.alias("rule"))


def distribution(places: DataFrame, left_out: list[str] | None = None) -> DataFrame:
    """class, places, population, unmatched, shares of both in percent, and open figures without the slugs of left_out; by population.

    corrected_places and corrected_population are null for classes other than own_site_open.
    """
    out = F.col("slug").isin(list(left_out or [""]))
    rows = places.groupBy("class").agg(
        F.count("*").alias("places"), F.coalesce(F.sum("population"), F.lit(0)).alias("population"), F.count(F.when(F.col("population").isNull(), 1)).alias("unmatched"),
        F.count(F.when(~out, 1)).alias("kept"), F.coalesce(F.sum(F.when(~out, F.col("population"))), F.lit(0)).alias("kept_population"),
    )
    every = Window.partitionBy()  # a row a class
    share = lambda c: F.coalesce(F.round(100.0 * F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0)), 1), F.lit(0.0))
    mine = F.col("class") == "own_site_open"
    return rows.select(
        "class", "places", share("places").alias("share_of_places"), "population", share("population").alias("share_of_population"), "unmatched",
        F.when(mine, F.col("kept")).alias("corrected_places"), F.when(mine, F.col("kept_population")).alias("corrected_population"),
    ).orderBy(F.col("population").desc())


def bucketed(classes: DataFrame, buckets: dict[str, tuple[str, ...]] = BUCKETS) -> DataFrame:
    """bucket, population and share of all people, from distribution(); the open bucket takes the corrected figure. Empty buckets stay, as 0."""
    spark = classes.sparkSession
    named = spark.createDataFrame([(i, b, c) for i, (b, all_) in enumerate(buckets.items()) for c in all_], "nth int, bucket string, class string")
    total = classes.agg(F.greatest(F.coalesce(F.sum("population"), F.lit(0)), F.lit(1)).alias("total"))  # one row
    sums = named.join(classes, "class", "left").groupBy("nth", "bucket").agg(F.coalesce(F.sum(F.coalesce("corrected_population", "population")), F.lit(0)).alias("population"))
    return sums.join(F.broadcast(total), how="cross").orderBy("nth").select("bucket", "population", F.round(100.0 * F.col("population") / F.col("total"), 2).alias("share_of_population"))


def pending(places: DataFrame, resume: bool = True, before: Column | None = None, classes: list[str] | None = None) -> DataFrame:
    """Places with a website still to be judged, by population, unknown ones last: never checked or pending; checked before; of classes."""
    due = F.col("checked_at").isNull() | F.coalesce(F.col("class") == "pending", F.lit(False))
    if before is not None:
        due = due | F.coalesce(F.col("checked_at") < before, F.lit(False))
    if classes:
        due = due | F.coalesce(F.col("class").isin(list(classes)), F.lit(False))
    rows = places.where(F.coalesce(F.col("website") != "", F.lit(False)))
    return (rows.where(due) if resume else rows).orderBy(F.col("population").desc_nulls_last(), "name")


#: Words of links that lead to a notice's documents.
DOCUMENT_HINT = r"(?i)attachment|document|download|bid[\s_-]*package"


def document_links(html: Column, url: Column) -> Column:
    """array<string>: where the page's links to documents lead, in order, each once: by the file's ending, or by a word of the link."""
    path = lambda c: F.lower(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")))
    ends = rf"(?:{'|'.join(e.replace('.', '[.]') for e in EXTENSIONS)})$"
    found = F.filter(anchors(html, url), lambda a: path(a["url"]).rlike(ends) | F.concat_ws(" ", a["text"], a["href"]).rlike(DOCUMENT_HINT))
    return F.array_distinct(F.transform(found, lambda a: a["url"]))


def run_report(runs: DataFrame, places: DataFrame) -> DataFrame:
    """Runs of a crawl (slug, status, ...) with their places' name, class and confidence, the sure ones first, then by name."""
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "low", 1).otherwise(2)
    return runs.join(places.select("slug", "name", "class", "confidence"), "slug").orderBy(order, "name", "slug")


#: Hosts of directories, and paths on which a firm speaks of itself.
DIRECTORIES = r"(?i)(linkedin|facebook|instagram|yelp|yellowpages|pagesjaunes|bbb\.org|indeed|glassdoor|crunchbase|dnb\.com|opencorporates)\."
USEFUL = r"(?i)/(services?|about|projects?|work|realisations?|apropos|a-propos)"


def select_pages(hits: DataFrame, by: list[str], limit: int = 4) -> DataFrame:
    """by, url, score and place of the search hits (by, pos, url) worth reading: no directories, a site's root, useful paths and https first.

    Equal scores keep the order of the hits; a url counts once; what is no URL is left out.
    """
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit(""))
    scheme = F.lower(F.try_parse_url(F.col("url"), F.lit("PROTOCOL")))
    score = F.when(path.isin("", "/"), 3).otherwise(0) + F.when(path.rlike(USEFUL), 2).otherwise(0) + F.when(scheme == "https", 1).otherwise(0)
    rows = hits.where(scheme.isNotNull() & ~F.col("url").rlike(DIRECTORIES)).groupBy(*by, "url").agg(F.min("pos").alias("pos")).withColumn("score", score)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "pos"))).where(F.col("place") <= limit).select(*by, "url", "score", "place")
