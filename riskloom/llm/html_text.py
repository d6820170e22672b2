"""Main text of web pages by differencing against the nearest page of the same host.

Every folder of a host (its path up to a slash, LEVELS deep at most) that holds differing pages has two reference pages,
those of the least and of the greatest hash of their html. A page is paired with a reference of its nearest folder: its
own, else the folder above, up to the host; of the two, the first that is not a copy of itself. So pairing depends on
the pages alone, neither on partitions nor on their order, and copies are never paired with each other. Their text
lines are aligned by longest common subsequence, and what both hold is template and is deleted. References are
kept as hashes of their lines, so what is joined to the pages is small: two arrays a folder.

Two things guard the deletion. Lines in an article or main element stay, since copies of an article share them and the
whole article is asked for; lines inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are no content anywhere, whether another page has them or not. Of a page with an article or main element nothing
outside of it is content. A page without one all of whose lines the reference holds keeps them.

Null html gives an empty text; a null url, or a host without another page that differs, is paired with nothing; markup
that is not closed runs on to the end of its parent; repeated rows give repeated results; an empty table gives an empty
one; other columns are not read. Pages of any length are read in one pass (a tag's quotes count only if they close
before the last >), the alignment keeps about the square root of its rows. Lines and pages are told apart by 64-bit
hashes: among n of them two share one with chance n^2 / 2^65.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import text_chunks, written
from riskloom.llm.url_filter import host_of, path_of

#: Folders deeper than this count as the one at this depth.
LEVELS = 8

#: Elements by what they do to text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object canvas audio video select xmp noframes".split())
APART = frozenset("head title nav aside footer form menu dialog button label".split())
CONTENT = frozenset(("article", "main"))
_APART_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"comments?|commentlist|respond|disqus|replies|sidebar|side|widgets?|menu|nav|navbar|navigation|breadcrumbs?|masthead|site-header|page-header|topbar|footer|"
    r"shar(?:e|ing)|social|related|recommend\w*|pagination|pager|skip-link|toolbar|search)(?:$|[\s_-])"
)
_APART_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {x: re.compile(f"</{x}(?=[\\s/>])", re.IGNORECASE) for x in RAW}
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


def _is_apart(tag: str, rest: str) -> bool:
    if tag in APART:
        return True
    if rest and tag not in ("html", "body", *CONTENT):
        for m in _NAMES.finditer(rest):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role" and value in _APART_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name in ("class", "id") and _APART_NAME.search(value):
                return True
    return False


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, rest) of each piece of markup; the tag is empty for comments and raw elements.

    One pass: what is not closed takes the rest of the page, and once a tag's quotes run past the last > of the page,
    quotes are no longer heeded.
    """
    last, at, quotes = page.rfind(">"), 0, True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            found = _COMMENT_END.search(page, start + 4)
            at = found.end() if found else len(page)
            yield start, at, "", False, ""
            continue
        m = _TAG.match(page, at)
        if not m and page[at : at + 1] not in ("!", "?", "/"):
            continue
        if start > last:  # never closed
            if m:
                yield start, len(page), "", False, ""
                return
            continue
        inner = m.end() if m else at
        end = inner
        while quotes and (stop := _STOP.search(page, end)) and stop[1]:
            close = page.find(stop[1], stop.end())
            if close < 0 or close > last:
                quotes = False
            end = close + 1
        end = stop.start() if quotes and stop else page.find(">", inner)
        at = end + 1
        if not m:
            yield start, at, "", False, ""
            continue
        tag, closing = m[1].lower(), page[start + 1] == "/"
        if tag in RAW and not closing:
            found = _RAW_END[tag].search(page, at)
            at = page.find(">", found.end()) + 1 if found else 0
            at = at or len(page)
            yield start, at, "", False, ""
            continue
        yield start, at, tag, closing, page[inner:end]


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """(line, apart, inside) of each text block in page order: is it in a part that is no content, in an article or main."""
    lines: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    apart = inside = False

    def flush() -> None:
        line = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        if line:
            lines.append((line, apart, inside))

    at = 0
    for start, end, tag, closing, rest in markup(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                if stack[i][0] == tag:
                    if any(x[1:] != (apart, inside) for x in stack[i:]):
                        flush()
                    apart, inside = stack[i][1:]
                    opened.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            opened["p"] -= 1
        now = apart or _is_apart(tag, rest) or tag == "header" and not inside
        if (now, inside or tag in CONTENT) != (apart, inside):
            flush()
        if not rest.endswith("/"):
            stack.append((tag, apart, inside))
            opened[tag] += 1
            apart, inside = now, inside or tag in CONTENT
    parts.append(page[at:])
    flush()
    return lines


def common_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b, by bit-parallel rows (Hyyro 2004) traced back.

    Rows are kept at every k-th line, k about the square root of their number, and made again between two of them.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    found = {*range(head), *range(len(a) - tail, len(a))}
    both = set(x) & set(y)
    places = [i for i, line in enumerate(x) if line in both]
    x, y = [x[i] for i in places], [line for line in y if line in both]
    where: dict = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full, step = (1 << len(y)) - 1, int(len(x) ** 0.5) + 1

    def rows_from(row: int, lines: list) -> Iterator[int]:
        for line in lines:
            same = row & where[line]
            row = (row + same | row - same) & full
            yield row

    row, kept = full, [full]
    for i, row in enumerate(rows_from(full, x), 1):  # noqa: B007
        if i % step == 0:
            kept.append(row)
    j = len(y) - 1
    for block in range(len(kept) - 1, -1, -1):
        first = block * step
        rows = [kept[block], *rows_from(kept[block], x[first : first + step])]
        i = len(rows) - 1
        while i > 0 and j >= 0:  # rows[i] is the row after line first + i - 1; a clear bit is a step of the length
            if x[first + i - 1] == y[j]:
                found.add(head + places[first + i - 1])
                i, j = i - 1, j - 1
            elif rows[i] >> j & 1:
                j -= 1
            else:
                i -= 1
    return found


def content(lines: list[tuple[str, bool, bool]], other: list[int] | None) -> tuple[list[str], int, int]:
    """Lines of a page that stay when it is differenced against the line hashes of another; numbers of shared and of deleted shared lines."""
    bounded = any(inside and not apart for _, apart, inside in lines)
    shared: set[int] = set()
    if other:
        shared = common_lines([line_hash(x[0]) for x in lines], other)
    template = {i for i in shared if not lines[i][2] or lines[i][1]}
    if not bounded and {i for i, x in enumerate(lines) if not x[1]} <= shared:
        template = {i for i in shared if lines[i][1]}
    kept = [line for i, (line, apart, inside) in enumerate(lines) if i not in template and not apart and (inside or not bounded)]
    return kept, len(shared), len(template)


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def _folders(path: str) -> str:
    """SQL: the folders of a path, '' first (the host's own), then each slash deeper."""
    return f"transform(sequence(1, least({LEVELS}, greatest(size(split({path}, '/', -1)) - 1, 1))), i -> substring_index({path}, '/', i))"


def references(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, folder, low, high, low_lines, high_lines): for every folder with pages of its own the references of the nearest that has two."""
    rows = pages.where(F.col(url).isNotNull()).select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("page"))
    rows = rows.where("host <> ''").selectExpr("host", "page", f"{_folders('path')} as folders")
    levels = rows.selectExpr("host", "page", "posexplode(folders) as (level, folder)", "size(folders) as depth")
    found = written(levels.groupBy("host", "level", "folder").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.bool_or(F.col("level") == F.col("depth") - 1).alias("own")), "folders")
    above = found.where("own").selectExpr("host", "folder as own", "explode(transform(sequence(1, level + 1), i -> substring_index(folder, '/', i))) as folder")
    pairs = found.where("low <> high").select("host", "folder", F.col("level").alias("at"), "low", "high")
    nearest = above.join(pairs, ["host", "folder"]).groupBy("host", "own").agg(F.max_by(F.struct("low", "high"), "at").alias("pair"))
    nearest = written(nearest.select("host", F.col("own").alias("folder"), "pair.low", "pair.high"), "nearest")
    wanted = nearest.select(F.explode(F.array("low", "high")).alias("page")).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, html):
            first: dict[int, str] = {}
            for page, text in zip(part.column("page").to_pylist(), texts, strict=True):
                first.setdefault(page, text.decode())
            lines = [[line_hash(x[0]) for x in page_lines(text)] for text in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array([*first], pa.int64()), pa.array(lines, pa.list_(pa.int64()))], ["page", "lines"])

    known = pages.select(F.col(html), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("page")).join(wanted, "page", "left_semi").mapInArrow(hashed, "page long, lines array<long>")
    known = written(known.groupBy("page").agg(F.first("lines").alias("lines")), "reference-lines")
    out = nearest.join(known.withColumnsRenamed({"page": "low", "lines": "low_lines"}), "low").join(known.withColumnsRenamed({"page": "high", "lines": "high_lines"}), "high")
    return written(out.select("host", "folder", "low", "high", "low_lines", "high_lines"), "references")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_lines, n_shared, n_template) of every page: lines in all, those that the paired page has too, those of them deleted."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    types = [to_arrow_type(pages.schema[c].dataType) for c in (key, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_html"):
            out = []
            for text, other in zip(texts, part.column("_other").to_pylist(), strict=True):
                lines = page_lines(text.decode())
                kept, shared, template = content(lines, other)
                out.append(("\n\n".join(kept), len(lines), shared, template))
            text, *counts = zip(*out, strict=True)
            columns = [part.column(0).cast(types[0]), part.column(1).cast(types[1]), pa.array(text, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, [key, url, "text", "n_lines", "n_shared", "n_template"])

    rows = pages.select(key, url, F.col(html).alias("_html"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("_path"), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("_page"))
    rows = rows.withColumn("folder", F.expr(f"element_at({_folders('_path')}, -1)"))
    joined = rows.join(references(pages, url, html), ["host", "folder"], "left")
    other = F.when(F.col("low") != F.col("_page"), F.col("low_lines")).otherwise(F.col("high_lines"))
    return joined.select(key, url, "_html", other.alias("_other")).mapInArrow(run, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_lines long, n_shared long, n_template long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, its length, and how many of its lines the paired page has."""
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_template")
