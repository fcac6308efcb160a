"""Main text of web pages by two passes over blocks.

Pass one decides each block by its share of stop words, its length and its share of link text, beside what the markup says outright
(menus, footers, forms; class and id words of adverts, notices and comments). Pass two lets undecided blocks, mostly short ones, take the
label of the nearest decided neighbour in the same article; if neighbours on both sides are as near, main text wins inside an article and
loses outside. Where a page marks an article or main element with text, only that counts, and an article, or a whole page, without any
decided block is kept whole.

The listed stop words judge only pages in a language they belong to: where they are under PAGE_STOPS of a page's words, its long blocks
with few links are main text whatever their words. A class or id marks boilerplate if a token of it is made of boilerplate words alone, or
of these and words of layout ("comment-list", "ad_box2"); "legal-history" or "market-share" say nothing.

Null, empty or unreadable html gives the empty text; null urls pass through; malformed and cut-off markup is read as far as it goes;
repeated rows are each extracted. An empty table gives no rows; columns other than page_id, url and html are ignored. Nothing is capped:
the work is proportional to the page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis"
    " le la les de des du et un une que qui en dans est pour pas par sur au avec ce il sont plus ne se son ou elle on leur nous aux cette être"
    " el los las y del al se con su para como más pero sus lo ha fue este ya entre cuando muy sin sobre también me hasta hay donde desde todo nos durante".split()
)
#: Elements whose content is not markup or never text, elements that hold blocks but no main text, and block elements.
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
DROPPED = frozenset("nav footer aside form menu dialog noscript template svg math select button canvas object audio video head map datalist fieldset".split())
MAIN = frozenset({"article", "main"})
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal overlay newsletter subscribe share sharing social related recommended comment comments respond disqus login signup search widget toolbar pagination pager tags copyright legal disclaimer".split())
LAYOUT_WORDS = frozenset("a area article bar block body bottom box btn button buttons col column container content count cta fixed footer form global group header heading holder icon icons id inline inner item items js left link links list main mobile module more nav new outer page panel post posts primary region right row secondary section site slot small social sticky story text thread title top unit view widget wp wrap wrapper zone".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Thresholds: characters of a short and of a long block, shares of stop words, share of link text.
SHORT, LONG, FEW_STOPS, MANY_STOPS, LINKED = 70, 140, 0.10, 0.20, 0.5
#: Share of stop words among the words of a page's long blocks from which it counts as in a listed language.
PAGE_STOPS = 0.05

TAG = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^><]*>.*?(?:</(?P=raw)\s*[^><]*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/><]*)(?P<attrs>(?:"[^"<]*"|'[^'<]*'|[^>"'<])*|[^><]*)>|<[!?/][^><]*>""",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
UNCLOSED = re.compile(r"<[a-zA-Z/!?][^<]*\Z")
WORD = re.compile(r"[^\W\d_]+")
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: float
    area: int  # number of the article or main element around it, 0 for none
    dropped: bool


def boilerplate(attrs: str, in_main: bool) -> bool:
    for name, *values in NAMED.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in SPLIT.split(token)} - {""}
                said = words & (BOILERPLATE_WORDS if in_main else BOILERPLATE_WORDS | {"header"})
                if said and words <= said | LAYOUT_WORDS:
                    return True
    return False


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    pieces: list[str] = []
    linked: list[int] = []
    stack: list[tuple[str, int, bool]] = []  # element, area, dropped
    area, dropped, areas, anchors, at = 0, False, 0, 0, 0

    def end_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, sum(linked) / max(1, sum(len(p) for p in pieces)), area, dropped))
            pieces, linked = [], []

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            linked.append(len(text) if anchors else 0)

    for m in TAG.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                pieces.append(" ")
                linked.append(0)
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            anchors = 0 if m["close"] else 1
        if name in BLOCKS or name in DROPPED:
            end_block()
            anchors = 0
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in VOID and name != "p" and not m["attrs"].endswith("/"):
                _, area_now, dropped_now = stack[-1] if stack else ("", 0, False)
                if name in MAIN and not dropped_now:
                    if not area_now:
                        areas += 1
                        area_now = areas
                dropped_now = dropped_now or name in DROPPED or name == "header" and not area_now or name not in ("html", "body") and boilerplate(m["attrs"], bool(area_now))
                if name == "li":
                    while stack and stack[-1][0] == "li":
                        stack.pop()
                stack.append((name, area_now, dropped_now))
            _, area, dropped = stack[-1] if stack else ("", 0, False)
            if name == "p" and not m["close"] and boilerplate(m["attrs"], bool(area)):
                dropped = True
    cut = UNCLOSED.search(html, at)
    add(html[at : cut.start()] if cut else html[at:])
    end_block()
    return out


def listed_language(found: list[Block]) -> bool:
    """Whether the stop words can judge the page: whether its long blocks that aren't links or boilerplate have enough of them."""
    words = stops = 0
    for b in found:
        if not b.dropped and b.linked <= LINKED and len(b.text) >= SHORT:
            said = WORD.findall(b.text.lower())
            words += len(said)
            stops += sum(w in STOP_WORDS for w in said)
    return stops >= PAGE_STOPS * words


def first_pass(b: Block, judged: bool = True) -> bool | None:
    """True: main text; False: not; None: undecided. judged: by stop words too."""
    if b.dropped or b.linked > LINKED:
        return False
    if len(b.text) < SHORT:
        return None if b.area or not b.linked else False
    if not judged:
        return True if len(b.text) >= LONG or b.area else None
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= MANY_STOPS:
        return True if len(b.text) >= LONG else None if not b.area else True
    if stops >= FEW_STOPS or b.area:
        return None
    return False


def second_pass(all_blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one in their area; if both sides are as near, main text wins in an area."""
    out = [bool(x) for x in labels]
    by_area: dict[int, list[int]] = {}
    for i, b in enumerate(all_blocks):
        if not b.dropped or labels[i] is not False:
            by_area.setdefault(b.area, []).append(i)
    for area, members in by_area.items():
        n = len(members)
        before, after = [-1] * n, [-1] * n
        last = -1
        for k in range(n):
            last = k if labels[members[k]] is not None else last
            before[k] = last
        last = -1
        for k in range(n - 1, -1, -1):
            last = k if labels[members[k]] is not None else last
            after[k] = last
        for k, i in enumerate(members):
            if labels[i] is None:
                near = [(abs(k - x), not labels[members[x]] if area else bool(labels[members[x]])) for x in (before[k], after[k]) if x >= 0]
                out[i] = (not min(near)[1] if area else min(near)[1]) if near else True
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    judged = listed_language(found)
    labels = [first_pass(b, judged) for b in found]
    if any(b.area and not b.dropped for b in found):
        labels = [label if b.area else False for b, label in zip(found, labels, strict=True)]
    return "\n".join(b.text for b, keep in zip(found, second_pass(found, labels), strict=True) if keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("page_id", "url", "html")}
        texts = [main_text(x.as_py()) for x in columns["html"]]
        yield pa.RecordBatch.from_arrays([columns["page_id"], columns["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
