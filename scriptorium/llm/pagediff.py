"""The main text of web pages: structure first, then differencing against the page with the nearest URL.

A page is read into blocks. What HTML marks as furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
comments) goes. Every page is then held, within its host and by URL path, against its next two neighbours on each side, nearest
(longest common beginning of the paths) first; lines are aligned by longest common subsequence.

Where a page marks no article, the lines shared with the nearest, the furniture of the host, are deleted. A neighbour with
nearly the same lines is a copy, and one that shares none has other furniture; then the next nearest is taken.

Where a page marks its article, the article's blocks are its lines. Articles of one host may repeat one another's lines, which
are text; so what the nearest page shares is only a candidate, if three neighbours or more are no versions of the article (over
half of the lines shared) and all of them share the line. An exact check follows: a candidate is furniture if at least half of
the host's different pages hold it, and goes from all of the host's marked articles. An article is never deleted whole.

Defined results: a null html is an empty one and has an empty text. A null URL has an empty host and path; such pages are
neighbours of one another. Repeated rows are extracted each. An empty table gives an empty result. Only the id, url and html
are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, neighbours, ordered
from .urlrules import host_of, path_of

#: Tags that start and end a block, tags whose content never is text, and names of furniture. Fixed values.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form head script style noscript template iframe svg button select option textarea dialog menu title object embed canvas audio video datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Classes and ids, or what they begin with up to a hyphen or underscore: has-sidebar and entry-header are none.
NAMES = re.compile(
    r"(?:^|\s)(?:ad|ads|adv|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe\w*|signup"
    r"|sidebar|side|menu\w*|nav\w*|breadcrumbs?|topbar|masthead|header|footer|comments?|commentlist|disqus|reply|replies|respond|responses|related|recommend\w*|share\w*|sharing|social|widget\w*|pagination|pager|toolbar|login|search\w*)(?:$|[\s_-])"
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: within an article only a whole class name hides them.
TEXT = frozenset("p li dt dd blockquote pre figure figcaption table td th span em strong b i a code".split())
#: Beginnings of classes of articles that stand for others: read only where a page has nothing else.
TEASERS = re.compile(r"(?:^|\s)(?:teaser|card|preview|excerpt|related|promo)(?:$|[\s_-])")
#: What end tags of other elements don't reach beyond.
HOLDERS = frozenset(("html", "body", "article", "main"))
#: Elements that end where another block starts, if their own end is missing.
LOOSE = frozenset("p li dt dd tr td th option".split())

#: A comment (an empty one may end at once), a declaration, or a tag, whose quotes are paired if they can be.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<own>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|(?P<odd>[^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][-\w:.@]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def _furniture(tag: str, attributes: str, inside: bool) -> int:
    """Two if the tag, a role or a style hides it, one if only its class or id does, else zero. No class hides an article or its
    headings, and within one no beginning of a class hides running text."""
    if tag in FURNITURE:
        return 2 if tag != "header" or not inside else 0
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return 2
    if found.get("role") in ROLES:
        return 2
    if (tag in HEADINGS and inside) or (tag == "article" and not inside):
        return 0
    own = [found[k] for k in ("class", "id") if k in found]
    if inside and tag in TEXT:
        own = [name for names in own for name in names.split() if "-" not in name and "_" not in name]
    return int(any(NAMES.search(x) for x in own))


def blocks(html: str | None) -> tuple[list[str], bool]:
    """Text blocks in page order without marked furniture; whether they are of a marked article."""
    html = html or ""
    every: list[tuple[str, str]] = []  # scope and text
    stack: list[tuple[str, str, int]] = []  # tag, scope, furniture
    opened = [Counter()]  # how often a tag is open within each holder of the text
    parts: list[str] = []
    scope, hidden = "", 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                every.append((scope, text))

    def close(n: int) -> None:
        nonlocal scope, hidden
        for gone, _, _ in reversed(stack[n:]):
            if gone in HOLDERS:
                opened.pop()
            opened[-1][gone] -= 1
        del stack[n:]
        scope, hidden = (stack[-1][1], stack[-1][2]) if stack else ("", 0)

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        if found is None:
            if not hidden:
                parts.append(html[at:])
            break
        if found.start() > at and not hidden:
            parts.append(html[at : found.start()])
        at = found.end()
        if found["tag"] is None:
            continue
        tag = found["tag"].lower()
        attributes = found["own"] if found["own"] is not None else found["odd"]
        if found["end"]:
            if tag in BLOCKS or tag == "article":
                flush()
            # a stray end tag closes nothing, nor what holds the text
            if any(o[tag] > 0 for o in opened) if tag in HOLDERS else opened[-1][tag] > 0:
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                close(n)
            continue
        if tag == "br":
            if not hidden:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            while stack and stack[-1][0] in LOOSE and (tag not in ("ul", "ol", "dl", "table", "p", "div", "blockquote", "pre") or stack[-1][0] == "p"):
                if stack[-1][0] != "p" and tag not in LOOSE:
                    break
                close(len(stack) - 1)
            if tag == "p" and stack and stack[-1][0] not in BLOCKS and opened[-1]["p"] > 0:  # unclosed inline tags end with their paragraph
                n = len(stack)
                while n and stack[n - 1][0] not in BLOCKS and not stack[n - 1][2]:
                    n -= 1
                if n and stack[n - 1][0] == "p":
                    close(n - 1)
        if tag in RAW:
            own = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = own.end() if own else end
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        inside = scope in ("article", "held")
        gone = max(hidden, _furniture(tag, attributes, inside))
        if gone == 1 and tag == "h1" and inside:  # a title, whatever the class of what holds it
            gone = 0
        elif hidden == 1 and gone == 1 and tag in ("article", "main") and not inside:
            scope, gone = "held", 0  # the text of a page that has no other article
        elif tag == "article" and not gone:
            teaser = not inside and any(k.lower() == "class" and TEASERS.search((v or "").strip("\"'").lower()) for k, v in _ATTRIBUTE.findall(attributes))
            scope = "held" if scope == "held" or teaser else "article"
        elif tag == "main" and not gone and not inside:
            scope = "main"
        hidden = gone
        stack.append((tag, scope, gone))
        opened[-1][tag] += 1
        if tag in HOLDERS:
            opened.append(Counter())
    flush()
    for wanted in ("article", "main", "held"):
        if own := [text for place, text in every if place == wanted]:
            return own, True
    return [text for _, text in every], False


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b. Rows of bits hold the table, so that 10,000 lines a side fit."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    found = set(range(first)) | set(range(len(a) - last, len(a)))
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    places: dict[int, int] = defaultdict(int)
    for j, line in enumerate(y):
        places[line] |= 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for line in x:
        match = row & places[line] if line in places else 0
        row = ((row + match) | (row - match)) & full
        rows.append(row)
    i, j = len(x), len(y)  # a zero at j: one more common line with y's line j than without it
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            found.add(first + i - 1)
            i, j = i - 1, j - 1
    return found


def _beginning(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def unshared(lines: list[int], path: str, others: list[dict], copy: float = 0.8) -> set[int]:
    """Places of the lines to keep: those not shared with the nearest of the other pages that shares some and is no copy."""
    for other in sorted(others, key=lambda o: -_beginning(path, o["path"])):
        shared = common_lines(lines, other["lines"])
        if shared and len(shared) < copy * max(len(lines), len(other["lines"])):
            return set(range(len(lines))) - shared
    return set(range(len(lines)))


def furnished(lines: list[int], path: str, others: list[dict], version: float = 0.5, least: int = 3) -> set[int]:
    """Places of the lines of a marked article that may be the host's furniture: shared with the nearest of the other pages that is
    no version of it, and with all the others that are none, if these are so many."""
    gone, used = set(range(len(lines))), 0
    for other in sorted(others, key=lambda o: -_beginning(path, o["path"])):
        shared = common_lines(lines, other["lines"])
        if len(shared) <= version * max(len(lines), len(other["lines"])):
            gone, used = gone & shared, used + 1
            if not gone:
                return gone
    return gone if used >= least and len(gone) < len(lines) else set()


def _read(pages: DataFrame, id_column: str) -> DataFrame:
    def rows(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts, parts, lines = [], [], []
            for html in batch.column(4):
                own, marked = blocks(html.as_py())
                texts.append("\n\n".join(own) if marked else None)
                parts.append(None if marked else own)
                lines.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in own])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(texts, pa.string()), pa.array(parts, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.int64()))], names=["id", "url", "host", "path", "text", "blocks", "lines"])

    kind = dict(pages.dtypes)[id_column]
    given = pages.select(F.col(f"`{id_column}`").alias("id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    return given.mapInArrow(rows, f"id {kind}, url string, host string, path string, text string, blocks array<string>, lines array<bigint>")


def _furniture_of(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """host and _common: the candidates (host, line) that half of a host's units hold, at most twice the lines of a mean unit."""
    held = units.select("host", F.explode(F.array_distinct("lines")).alias("line")).join(candidates, ["host", "line"])
    held = held.groupBy("host", "line").agg(F.count("*").alias("n")).join(units.groupBy("host").agg(F.count("*").alias("of")), "host")
    return held.filter("2 * n >= of").groupBy("host").agg(F.collect_list("line").alias("_common"))


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """The id, url and text of every page."""
    scratch = Scratch(pages.sparkSession, "pages")
    read = scratch.keep(_read(pages, id_column).withColumn("_print", F.xxhash64("lines")), "read")
    order = ["host", "path", "_print"]  # pages of one host with the same lines are one in the order, at the least of their paths
    kinds = [F.max(F.col("blocks").isNull()).alias("marked"), F.max(F.col("blocks").isNotNull()).alias("open")]
    units = read.groupBy("host", "_print").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), *kinds)
    units = scratch.keep(units.select(*order, "lines", "marked", "open"), "units")
    near = neighbours(ordered(units, order, scratch, "ordered"), order, ["host", "path", "lines"]).withColumnsRenamed({"_before": "_b", "_after": "_a"})
    pairs = neighbours(scratch.keep(near, "near"), order, ["_b", "_a"])
    pairs = pairs.select("host", "_print", "path", "lines", "marked", "open", "_b", "_a", F.col("_before._b").alias("_bb"), F.col("_after._a").alias("_aa"))

    def differ(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for host, kind, path, lines, marked, open_, *others in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                own, every = [o for o in others if o is not None and o["host"] == host], set(range(len(lines)))
                gone = [lines[i] for i in furnished(lines, path, own)] if marked else []
                keep = unshared(lines, path, own) if open_ else every
                if gone or len(keep) < len(every):
                    out.append((host, kind, gone, [i in keep for i in range(len(lines))]))
            types = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["host", "_print", "_gone", "_keep"])

    told = scratch.keep(pairs.mapInArrow(differ, "host string, _print long, _gone array<bigint>, _keep array<boolean>"), "told")
    common = scratch.keep(_furniture_of(units, told.select("host", F.explode("_gone").alias("line")).distinct()), "common")
    opened = read.filter("blocks is not null").join(told.select("host", "_print", "_keep"), ["host", "_print"], "left")
    opened = opened.withColumn("text", F.array_join(F.filter("blocks", lambda x, i: F.coalesce(F.get("_keep", i), F.lit(True))), "\n\n"))
    # blocks hold no line feed, so that a text falls into its blocks again
    marked = read.filter("blocks is null").join(common, "host", "left")
    left = F.filter(F.split("text", "\n\n"), lambda x, i: ~F.array_contains("_common", F.get("lines", i)))
    marked = marked.withColumn("text", F.when(F.col("_common").isNull() | (F.size(left) == 0), F.col("text")).otherwise(F.array_join(left, "\n\n")))
    return marked.select("id", "url", "text").unionAll(opened.select("id", "url", "text")).withColumnRenamed("id", id_column)
