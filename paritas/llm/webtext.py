"""Main text of web pages: nearest-URL differencing, with the page's structure where it speaks.

Pages become lines, one per block of text. Within a host, pages are ordered by URL path and each is
paired with the neighbour whose path is nearest. The lines of both are aligned by longest common
subsequence, and lines that both share are template and deleted.

Lines inside an article are not deleted: neighbours also share passages of their articles, and whole
articles, which must stay. Lines in menus, footers, adverts and the like always are: those unique to
a page are boilerplate as well. Differencing decides about all other lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import counted_broadcast, text_or_empty

#: Rows of the URL order per bucket in which neighbours are looked up.
BUCKET_ROWS = 4_096

# Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "title", "object", "audio", "video", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split())
#: Elements whose lines are boilerplate, and those that hold the article.
ASIDE = frozenset("nav footer aside form button select dialog menu search head".split())
ARTICLE = frozenset(("article", "main"))
#: Words in class, id or role that mark boilerplate.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|"
    r"dialog|disqus|footer|form|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|popup|promo|promoted|"
    r"related|replies|reply|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget|complementary|contentinfo)"
    r"(?:$|[\s_-])", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.DOTALL)
SPACES = re.compile(r"\s+")
ARTICLE_LINE, OTHER_LINE, ASIDE_LINE = 0, 1, 2
#: A start tag of the first closes an open one of the second, as browsers do.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

PARSED = "page_id long, url string, host string, path string, lines array<string>, kinds array<int>, shape array<long>"


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, tag, attributes) of every tag; raw elements are skipped as a whole."""
    at, length = 0, len(page)
    while at < length:
        m = TOKEN.search(page, at)
        if not m:
            break
        before, tag = page[at:m.start()], (m[2] or "").lower()
        at = m.end()
        if tag in RAW and not m[1] and not (m[3] or "").endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else length
            tag = ""
        yield before, m[1] or "", tag, m[3] or ""
    if at < length:
        yield page[at:], "", "", ""


def boilerplate(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    return any(MARKED.search(a or b or c) for _, a, b, c in ATTRIBUTE.findall(attributes)) if attributes and tag not in ("html", "body") else False


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The lines of a page (blocks with white space made single) and their kinds.

    A header element is boilerplate outside of an article; inside, it holds the headline.
    """
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, in an article, in boilerplate

    def state() -> tuple[bool, bool]:
        return (open_[-1][1], open_[-1][2]) if open_ else (False, False)

    def flush() -> None:
        text = SPACES.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            article, aside = state()
            lines.append(text)
            kinds.append(ASIDE_LINE if aside else ARTICLE_LINE if article else OTHER_LINE)

    for before, slash, tag, attributes in tokens(page):
        if before:
            held.append(before)
        if tag == "br":
            held.append(" ")
        if not tag:
            continue
        marked = not slash and boilerplate(tag, attributes)
        if tag in BLOCKS or tag in ARTICLE or marked or any(t == tag and a for t, _, a in open_[-1:]):
            flush()
        if slash:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    if open_[k][2] != (open_[k - 1][2] if k else False):
                        flush()
                    del open_[k:]
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in CLOSES.get(tag, ()):
                    del open_[k:]
                    break
                if open_[k][0] in ("ul", "ol", "dl", "table", "select", "article", "main"):
                    break
            article, aside = state()
            aside = aside or marked or (tag == "header" and not article)
            open_.append((tag, article or (tag in ARTICLE and not aside), aside))
    flush()
    return lines, kinds


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a lie on a longest common subsequence with b.

    Bit-parallel: row k is a bit string over a after k lines of b, so that memory is the product of
    both lengths in bits.
    """
    on = np.zeros(len(a), bool)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for x in b.tolist():
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:  # prefix i + 1 gains nothing over prefix i
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            on[i] = True
            i, j = i - 1, j - 1
    return on


def shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Every page with its lines, kinds and the hashes of the lines that differencing may delete.

    url is split into host and path; a null or odd url has the empty host. ``row`` identifies rows.
    """
    import xxhash  # noqa: F401  the workers import it as well

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            found = [page_lines(p) for p in batch["html"]]
            places = [re.match(r"^[a-z]+://([^/?#]*)([^?#]*)", u or "", re.IGNORECASE) for u in batch["url"]]
            out = batch[["page_id", "url"]].copy()
            out["host"], out["path"] = [m[1].lower() if m else "" for m in places], [m[2] if m else "" for m in places]
            out["lines"], out["kinds"] = [x for x, _ in found], [k for _, k in found]
            out["shape"] = [[xxh3_64_intdigest(t) - (1 << 63) for t, c in zip(x, k) if c == OTHER_LINE] for x, k in found]
            yield out

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"))
    return cut_lineage(picked.mapInPandas(run, PARSED).withColumn("row", F.monotonically_increasing_id()))


def neighbours(parsed: DataFrame) -> DataFrame:
    """row with the path and shape of the pages before and after it in its host's URL order.

    The order is global: range-partitioned, numbered with per-partition offsets, and looked up in
    buckets of bounded size whose edge rows stand in both, so one large host is many tasks. Only
    pages with lines to decide about take part, and of equal shapes in a row one.
    """
    keys = parsed.filter(F.size("shape") > 0).select("row", "host", "path", "page_id", "shape")
    placed = cut_lineage(keys.repartitionByRange("host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row")
                         .withColumn("mark", F.monotonically_increasing_id()))
    placed = placed.withColumn("slice", F.shiftright("mark", 33))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("slice").agg(F.count("*").alias("n")).select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.join(counted_broadcast(offsets), "slice").withColumn("at", F.col("offset") + F.col("mark").bitwiseAND((1 << 33) - 1))
    home = F.floor(F.col("at") / BUCKET_ROWS)
    spots = F.array_distinct(F.array(home, F.floor((F.col("at") - 1) / BUCKET_ROWS), F.floor((F.col("at") + 1) / BUCKET_ROWS)))
    spread = numbered.withColumn("home", home).withColumn("bucket", F.explode(spots))
    order = W.partitionBy("bucket").orderBy("at")

    def beside(step: int) -> list:
        same = F.lag("host", step).over(order) == F.col("host")
        return [F.when(same, F.lag(c, step).over(order)).alias(f"{c}_{'before' if step > 0 else 'after'}") for c in ("path", "shape")]

    return spread.select("row", "bucket", "home", *beside(1), *beside(-1)).filter("bucket = home").drop("bucket", "home")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Blocks of the article stay in page order, joined by two line ends. A null or empty page, or one
    without such blocks, has the empty text; a page without an article keeps the lines that its
    nearest neighbour doesn't share; one whose lines equal its neighbour's is its copy and not
    compared with it. Repeated rows give equal rows; an empty table gives none. Other columns are
    not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path, lines, kinds, shape, *beside in batch[
                    ["path", "lines", "kinds", "shape", "path_before", "shape_before", "path_after", "shape_after"]].itertuples(index=False):
                kinds, own = np.array(kinds, int), np.array(shape, np.int64)
                others = [(shared_start(path, p), np.array(s, np.int64)) for p, s in zip(beside[::2], beside[1::2]) if s is not None]
                others = [(k, s) for k, s in others if not np.array_equal(s, own) or (kinds == ARTICLE_LINE).any()]
                keep = kinds == ARTICLE_LINE
                other = kinds == OTHER_LINE
                if others and len(own):
                    _, partner = max(others, key=lambda x: x[0])
                    keep[np.flatnonzero(other)[~common_lines(own, partner)]] = True
                else:
                    keep |= other
                texts.append("\n\n".join(t for t, k in zip(lines, keep) if k))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})

    parsed = parsed_pages(pages)
    joined = parsed.join(neighbours(parsed), "row", "left").drop("row", "host")
    return joined.mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
