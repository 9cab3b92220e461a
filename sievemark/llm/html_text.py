"""Main text of web pages by two-pass block rules.

A linear scanner cuts the page into blocks at block-level tags and notes, for each, the elements
around it, its link text and its words. Pass 1 decides blocks: those inside menus, headers, footers,
sidebars, forms, notices, adverts or comments and those of mostly link text are boilerplate; long
blocks rich in stop words are content. What is left (short blocks, and long ones with few stop words)
is ambiguous, and in pass 2 inherits the label of the nearest decided neighbour in the same region.
A page with ``article`` or ``main`` has its content there: every block of it that isn't banned or
mostly links is good or inherits good, so density matters on other pages only. Where no block of such
a page is decided good, the undecided ones stay, rather than none.

Defined results: null or empty html gives an empty text; an unclosed tag, comment or script runs to
the end of the page, an unclosed link to the end of its paragraph or enclosing element; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored. Scanning takes time
in proportion to the page: every element is pushed and popped once, and a closing tag that opens
nothing is found by a count of open names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import read_table

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is that it was for on are with as be at by this had not but from or have an they which one you were all her she there would their we him been has when who will no more if out so what up said about than into them can only other time new some could these two may first then do any like my now over such our
    der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei
    le la les de des et en un une du est que dans qui par pour au sur pas plus ce il elle ne se sont avec son ses aux ou mais comme nous vous leur cette ont été même aussi
    el los las del y que en un una por con no para es al lo como más su se o pero sus le ha este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante""".split()
)
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template head title select button textarea iframe svg object canvas audio video datalist math".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|comments?|replies|reply|disqus|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|share|sharing|social|related|recommended|widget|footer|copyright|toolbar|masthead|topbar|site-header|page-header)(?:$|[\s_-])",
    re.I,
)
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu|menubar)\b", re.I)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TAG = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_WORD = re.compile(r"[^\W\d_]+")

LONG, STOP_HIGH, LINKS_HIGH = 70, 0.12, 0.5


@dataclass
class Block:
    text: str
    links: int
    region: int  # 0 outside an article, else its number
    banned: bool
    heading: bool
    label: str = ""


def _hidden(attributes: str) -> bool:
    if not attributes:
        return False
    if ROLES.search(attributes):
        return True
    return any(NAMES.search(next(g for g in m.groups() if g is not None)) for m in _NAMED.finditer(attributes))


def _tag_end(page: str, at: int, last_double: int, last_single: int) -> int:
    """The place of the '>' that ends the tag at ``at``, past quoted values; -1 if there is none."""
    end = page.find(">", at)
    for quote, last in (('"', last_double), ("'", last_single)):
        if end >= 0 and page.count(quote, at, end) % 2 and end < last and page[page.find(quote, at) - 1] == "=":
            close = page.find(quote, end)
            later = page.find(">", close)
            if later >= 0:
                end = later
    return end


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # element, is boilerplate, article number before it
    text: list[str] = []
    links = articles = region = banned = heading = skip = 0
    anchor: tuple[int, bool] | None = None  # of the open link: the stack's depth, and whether a paragraph holds it
    paragraph = False
    open_names: Counter[str] = Counter()
    at, size = 0, len(page)
    last_double, last_single = page.rfind('"'), page.rfind("'")

    def close() -> None:
        nonlocal links, heading
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, links, region, banned > 0, heading > 0))
            text.clear()
        links = 0

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not skip:
            text.append(page[at:lt])
            if anchor:
                links += lt - at
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        found = _TAG.match(page, lt + 1)
        if not found:
            if page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                if not skip:
                    text.append("<")
                at = lt + 1
            continue
        end = _tag_end(page, lt, last_double, last_single)
        if end < 0:
            break
        name, closing = found[1].lower(), page[lt + 1] == "/"
        at = end + 1
        if name in RAW and not closing and page[end - 1] != "/":
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = size if stop is None else stop.end()
            continue
        if name == "br":
            if not skip:
                text.append("\n")
            continue
        if name == "a":
            anchor = None if closing else (len(stack), paragraph)
            continue
        if name not in BLOCK and name not in SKIPPED:
            continue
        if name in BLOCK:
            close()
        if name == "p":
            anchor, paragraph = None if anchor and anchor[1] else anchor, not closing
            continue
        if name in VOID:
            continue
        if closing:
            if open_names[name]:
                while stack:
                    top, bad, before = stack.pop()
                    open_names[top] -= 1
                    banned -= bad
                    region = before
                    skip -= top in SKIPPED
                    heading -= top[0] == "h" and top[1:].isdigit()
                    if top == name:
                        break
                paragraph = False
                if anchor and anchor[0] > len(stack):
                    anchor = None
            continue
        bad = name in BOILERPLATE or (name == "header" and not region) or (name not in ("body", "html") and name not in ("article", "main") and _hidden(page[found.end() : end]))
        stack.append((name, bad, region))
        open_names[name] += 1
        banned += bad
        skip += name in SKIPPED
        heading += name[0] == "h" and name[1:].isdigit()
        if name in ("article", "main"):
            articles += 1
            region = articles
    close()
    return out


def classify(found: list[Block]) -> list[Block]:
    """Sets each block's label to good or bad."""
    inside = any(b.region and not b.banned for b in found)
    for b in found:
        words = _WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.banned or (inside and not b.region):
            b.label = "bad"
        elif b.links / max(1, len(b.text)) > LINKS_HIGH:
            b.label = "bad"
        elif len(b.text) >= LONG and density >= STOP_HIGH:
            b.label = "good"
        elif not inside and not words:
            b.label = "bad"
    if not inside and not any(b.label == "good" for b in found):
        for b in found:
            b.label = b.label or "good"
    fall_back = "good" if inside else "bad"
    # On a page with an article, what lies outside or is banned says nothing about the blocks beside it.
    voices = [bool(b.label) and not (inside and b.label == "bad") for b in found]
    ahead: list[int | None] = [None] * len(found)
    nearest = None
    for i in range(len(found) - 1, -1, -1):
        nearest = i if voices[i] else nearest
        ahead[i] = nearest
    behind, inherited = None, {}
    for i, b in enumerate(found):
        behind = i if voices[i] else behind
        if not b.label:
            near = [j for j in (behind, ahead[i]) if j is not None and found[j].region == b.region]
            inherited[i] = found[min(near, key=lambda j: (abs(j - i), found[j].label != "good"))].label if near else fall_back
    for i, label in inherited.items():
        found[i].label = label
    return found


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
