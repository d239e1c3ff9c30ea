"""Main text of web pages: nearest-URL page differencing, checked by structure.

A page is read into text blocks. Pages are sorted by host and URL path, and each is aligned with its nearest neighbour of the same host
by longest common subsequences of blocks; what both share is template and goes. Two checks by structure follow. Blocks inside ``article`` or ``main`` are
the article's: they are put back, because pages of one host quote each other's lines, and if there are any, they are the text. Elements that
never hold the article (menus, headers, footers, asides, forms, hidden ones, and those whose class, id or role names an advert, a notice,
comments and the like) go also where they differ from page to page. They are aligned apart from the other blocks, so that a menu that moved
costs no match."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.shared import bound_batches, materialize, tidy

# The HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("head nav footer aside form button dialog menu search".split())
NAMES_LEFT_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login paywall related recommended recirc share sharing social breadcrumb breadcrumbs menu nav navbar navigation pagination pager toolbar widget "
    "footer copyright masthead topbar skip search".split()
)
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SELF_CLOSING = {"p": BLOCK - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME = re.compile(r"[A-Za-z]+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _role(tag: str, given: str, inside: bool) -> str:
    """'out', 'in' (the article's) or ''."""
    of = _attributes(given)
    if tag in LEFT_OUT or tag == "header" and not inside or "hidden" in of or of.get("aria-hidden") == "true" or of.get("role", "").lower() in ROLES_LEFT_OUT:
        return "out"
    if tag not in ("html", "body", "main", "article"):
        named = {x.lower() for x in NAME.findall(f"{of.get('class', '')} {of.get('id', '')}")}
        if named & NAMES_LEFT_OUT or "display:none" in of.get("style", "").replace(" ", "").lower():
            return "out"
    if tag in ("article", "main") or of.get("role", "").lower() in ("main", "article") or of.get("itemprop", "").lower() == "articlebody":
        return "in"
    return ""


#: Roles of blocks, in the low bits of their hashes.
PLAIN, ARTICLE, TEMPLATE = 0, 1, 2


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of each block of a page, in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements with their role
    left_out = inside = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((TEMPLATE if left_out else ARTICLE if inside else PLAIN, text))

    def close(depth: int) -> None:
        nonlocal left_out, inside
        while len(stack) > depth:
            _, role = stack.pop()
            left_out -= role == "out"
            inside -= role == "in"

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        upto = m.start() if m else size
        if upto > at:
            parts.append(page[at:upto])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(role or name in BLOCK for name, role in stack[depth:]):
                        flush()
                    close(depth)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else size
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        for depth in range(len(stack) - 1, -1, -1):
            name = stack[depth][0]
            if tag in SELF_CLOSING.get(name, ()):
                close(depth)
                break
            if name in BLOCK:
                break
        role = _role(tag, m[3], inside > 0)
        if role and tag not in BLOCK:
            flush()
        stack.append((tag, role))
        left_out += role == "out"
        inside += role == "in"
    flush()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """Indices in ``a`` of one longest common subsequence of both."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k] = j
                last[k] = link
    out, link = set(), last[-1] if last else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def blocks(page: str) -> list[tuple[bool, str]]:
    """(whether it is the article's, text) of each block that structure doesn't rule out, in page order."""
    return [(role == ARTICLE, text) for role, text in page_blocks(page) if role != TEMPLATE]


def block_hashes(own: list[tuple[int, str]]) -> np.ndarray:
    """For each block 62 bits of its text's hash, then its role."""
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) & ~3 | role for role, t in own], dtype="<u8")


def shared_blocks(own: np.ndarray, other: np.ndarray) -> set[int]:
    """Indices of the blocks that a neighbour's page has too, in an alignment of what structure rules out and one of the rest."""
    out: set[int] = set()
    for ruled_out in (False, True):
        at = np.flatnonzero((own & np.uint64(3) == TEMPLATE) == ruled_out)
        mate = other[(other & np.uint64(3) == TEMPLATE) == ruled_out]
        out.update(at[sorted(common((own[at] >> np.uint64(2)).tolist(), (mate >> np.uint64(2)).tolist()))].tolist())
    return out


def main_text(own: list[tuple[bool, str]], shared: set[int] | None) -> str:
    """The page's text, given its blocks and the indices of those that its neighbour shares."""
    article = any(mine for mine, _ in own)
    return "\n".join(t for i, (mine, t) in enumerate(own) if (mine if article else i not in (shared or ())))


def _path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "", parts.path or "/")
    except ValueError:
        return "", url or ""


def _neighbours(lists: DataFrame) -> DataFrame:
    """``host, key, other``: the hashes of the neighbour of each of ``lists(host, path, url, page_id, key, hashes)`` whose path begins most like its own.

    Lists of a host are distinct, so the neighbours in the sort are the nearest different ones. Ranges of the sort are linked by
    their first and last rows, one of each a range."""
    order = ["host", "path", "url", "page_id", "key"]
    ranged = lists.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged.select(F.struct(*order, "hashes").alias("row"), "range"), "page-ranges")
    edges = ranged.groupBy("range").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    over = Window.orderBy("range")  # one row a range
    edges = edges.select("range", F.lag("last").over(over).alias("last"), F.lead("first").over(over).alias("first"))
    within = Window.partitionBy("range").orderBy("row")
    near = ranged.select("row", "range", F.lag("row").over(within).alias("before"), F.lead("row").over(within).alias("after")).join(edges, "range", "left")
    near = near.select("row", F.coalesce("before", "last").alias("before"), F.coalesce("after", "first").alias("after"))

    def alike(host: str, path: str, other: dict | None) -> int:
        if other is None or other["host"] != host:
            return -1
        n = 0
        for x, y in zip(path, other["path"], strict=False):
            if x != y:
                break
            n += 1
        return n

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chosen = batch.column(0).to_pylist(), []
            for row, before, after in zip(rows, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                one, two = alike(row["host"], row["path"], before), alike(row["host"], row["path"], after)
                chosen.append(None if max(one, two) < 0 else (before if one >= two else after)["hashes"])
            yield pa.RecordBatch.from_arrays([pa.array([r["host"] for r in rows], pa.string()), pa.array([r["key"] for r in rows], pa.binary()), pa.array(chosen, pa.binary())], ["host", "key", "other"])

    return near.mapInArrow(tidy(choose), "host string, key binary, other binary")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars`` (code points), ``n_shared, n_restored``. White space inside a block is one space, blocks are joined by a line feed.

    n_shared counts the blocks of the whole page, menus and the like included, that its neighbour shares; n_restored those of them that are
    the article's and stay. Null or empty html and pages of nothing but template give an empty text. Each page, with an article or without, is compared with the
    neighbour (in the order of host, path, url, id) whose path begins most like its own. Pages of a host that are the same but for what structure rules out count once,
    where the first of them stands, and have the same text; pages without other blocks are nobody's neighbour. Pages with a null URL are a host of their own. Whole pages are read;
    they are read twice, so that no text is stored. Repeated rows give repeated results; null ids are kept; other columns are ignored; an empty table gives an empty result."""

    def parsed(url: str | None, page: str | None) -> tuple[str, str, list[tuple[int, str]], np.ndarray, bytes | None]:
        """(host, path, blocks, their hashes, key of those that structure doesn't rule out)"""
        own = page_blocks(page or "")
        hashes = block_hashes(own)
        kept = hashes[hashes & np.uint64(3) != TEMPLATE]
        return *_path(url), own, hashes, xxhash.xxh3_128_digest(kept.tobytes()) if len(kept) else None

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[4] for x in found], pa.binary()), pa.array([x[3].tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "host", "path", "key", "hashes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            found = [parsed(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            held = [squeeze.compress("\n".join(t for role, t in x[2] if role != TEMPLATE).encode("utf-8", "surrogatepass")) for x in found]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[4] for x in found], pa.binary()), pa.array([x[3].tobytes() for x in found], pa.binary()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "host", "key", "hashes", "held"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widen = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, n_shared, n_restored = [], [], []
            for hashes, held, other in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                own = np.frombuffer(hashes, "<u8")
                roles = (own & np.uint64(3)).astype(np.int64)
                shared = shared_blocks(own, np.frombuffer(other, "<u8")) if other else set()
                kept = np.flatnonzero(roles != TEMPLATE).tolist()
                lines = widen.decompress(held, max_output_size=1 << 31).decode("utf-8", "surrogatepass").split("\n") if kept else []
                texts.append(main_text([(roles[i] == ARTICLE, t) for i, t in zip(kept, lines, strict=True)], {at for at, i in enumerate(kept) if i in shared}))
                n_shared.append(len(shared))
                n_restored.append(sum(roles[i] == ARTICLE for i in shared))
            columns = [pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in (list(map(len, texts)), n_shared, n_restored)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_chars", "n_shared", "n_restored"])

    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    outlines = rows.mapInArrow(tidy(outline), "page_id long, url string, host string, path string, key binary, hashes binary").where("key is not null")
    lists = outlines.groupBy("host", "key").agg(F.min(F.struct("path", "url", "page_id", "hashes")).alias("first")).select("host", "key", "first.*")
    near = materialize(_neighbours(lists).where("other is not null"), "page-neighbours")
    texts = rows.mapInArrow(tidy(read), "page_id long, url string, host string, key binary, hashes binary, held binary")
    out = texts.join(near, ["host", "key"], "left").select("page_id", "url", "hashes", "held", "other")
    return out.mapInArrow(tidy(differ), "page_id long, url string, text string, n_chars long, n_shared long, n_restored long")
