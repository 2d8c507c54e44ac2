"""Main text of web pages: nearest-URL page differencing beside the markup.

A page becomes lines, one for each block, and what its markup says of them. Pages of a host are sorted by URL path; each is paired with
the neighbour whose path agrees longest with its own; copies of itself are no neighbours. A longest common subsequence aligns their lines, and lines that both
pages share go, as do those that the markup gives to menus, headers, footers, adverts, forms and the like. A block of an article's
own prose stays, be it shared or not: else copies of an article would delete each other.
"""

from __future__ import annotations

import array
import bisect
import html
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: About so many neighbouring pages are sorted together; keys between groups, at most so many, are broadcast.
GROUP_ROWS, MAX_BORDERS = 256, 50_000
#: Elements that stand deeper than this don't nest any further.
MAX_DEPTH = 512

_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_SIGN = re.compile(r"[\"'<>]")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"[\s\x1c-\x1f]+")

#: Elements whose text is read raw up to their end tag, and shown nowhere.
RAW = frozenset("script style textarea title xmp noscript noembed noframes iframe".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start a block of their own.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text.
ASIDE = frozenset("head nav aside footer button select datalist template svg object audio video map menu search input".split())
#: Blocks of prose.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption caption".split())
#: Words that name menus, headers, footers, sidebars, notices, adverts and forms in class, id and role.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar topbar related recommended share sharing social popup modal overlay widget login search form contentinfo complementary skip toc tags".split())
#: Words that name readers' comments, articles though these may hold.
READERS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
#: Words that say where or how something is shown: they don't change what a name with one of the above means, as any other word does.
PLACES = frozenset("area bar block body bottom box center col column container content entry first global group inner item items last layout left links link list main outer page panel primary right row secondary section site small title top unit wrap wrapper".split())
#: Standings of an element: out for good, out unless an article is in it, in.
DROPPED, FRAMED, SHOWN = range(3)
#: Elements that an end tag or a new block of the same kind closes implicitly.
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDERS = BLOCK - {"head", "body", "html"}


def _names(attributes: str) -> set[str]:
    """Words of those names in class, id and role that say nothing but one of BOILERPLATE or READERS and its place."""
    out: set[str] = set()
    for a, b, c in _NAMES.findall(attributes) if attributes else ():
        for name in (a or b or c).split():
            words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w}
            kinds = words & (BOILERPLATE | READERS)
            if kinds and words - kinds <= PLACES:
                out |= kinds
    return out


class _Reader:
    """Collects lines from tokens: text, if markup keeps it, if an article holds it, if it is prose, and the share of its links."""

    def __init__(self):
        self.lines: list[tuple[str, bool, bool, bool]] = []
        self.stack: list[tuple[str, int, bool, int]] = []  # name, standing, in an article, standing of the block around
        self.open_names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0

    def state(self) -> tuple[int, bool, int]:
        return self.stack[-1][1:] if self.stack else (SHOWN, False, SHOWN)

    def cut(self, k: int) -> None:
        """Closes the elements from place ``k`` of the stack on."""
        self.open_names.subtract(name for name, *_ in self.stack[k:])
        del self.stack[k:]

    def end_line(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            _, article, block = self.state()
            prose = any(name in PROSE for name, *_ in self.stack[-4:]) and 2 * self.linked <= len(text)
            self.lines.append((text, block == SHOWN, article, prose))
        self.parts.clear()
        self.linked = 0

    def text(self, text: str) -> None:
        standing, _, block = self.state()
        if standing != SHOWN and block == SHOWN:
            return  # a button, an advert within a line
        self.parts.append(text)
        if any(name == "a" for name, *_ in self.stack[-3:]):
            self.linked += len(text)

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.end_line()
            closes = CLOSES.get(name, set()) | ({"p"} if name in _P_ENDERS else set())
            if any(self.open_names[c] for c in closes):
                for k in reversed(range(len(self.stack))):
                    if self.stack[k][0] in closes:
                        self.cut(k)
                        break
                    if self.stack[k][0] in BLOCK and self.stack[k][0] not in ("p",):
                        break
        elif name == "br":
            self.parts.append(" ")
        if name in VOID or attributes.rstrip().endswith("/") or len(self.stack) >= MAX_DEPTH:
            return
        standing, article, block = self.state()
        main = name in ("article", "main") or 'role="main"' in attributes
        whole = name in ("html", "body", "main")
        words = set() if whole else _names(attributes)
        closed = name == "dialog" and not re.search(r"\bopen\b", attributes)
        if name == "header" and not article or name in ASIDE or closed or not whole and (words & READERS or _HIDDEN.search(attributes)):
            standing = DROPPED
        elif main and standing == FRAMED:
            standing = SHOWN  # what frames a whole article is its layout
        elif name == "form" or words and not main:
            standing = min(standing, FRAMED)
        self.stack.append((name, standing, article or main, standing if name in BLOCK else block))
        self.open_names[name] += 1

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.end_line()
        if self.open_names[name] <= 0:
            return
        for k in reversed(range(len(self.stack))):
            if self.stack[k][0] == name:
                self.cut(k)
                return
            # A tag of a line doesn't close a block that stands open in between.
            if name not in BLOCK and self.stack[k][0] in BLOCK:
                return


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """Kind (text, open, close), name or text, and attributes. Each place is looked at a few times, however broken the markup is.

    A tag ends at the first ``>`` outside quotes, or at the first one at all if a ``<`` or the end comes before that one.
    A ``<`` that begins nothing is text; what follows an unclosed comment is none.
    """
    at, size, final = 0, len(source), {sign: source.rfind(sign) for sign in "\"'>"}
    # Looking ahead in vain may cost a few times the source in all, whereafter quotes count no more.
    spare = 4 * size

    def tag_end(start: int) -> int:
        nonlocal spare
        k = start
        while spare > 0:
            sign = _SIGN.search(source, k)
            if not sign or sign[0] == "<":
                break
            if sign[0] == ">":
                return sign.start()
            if final[sign[0]] <= sign.start():
                break
            k = source.find(sign[0], sign.end()) + 1
        spare -= k - start
        return source.find(">", start)

    while at < size:
        begin = source.find("<", at)
        if begin != at:
            begin = size if begin < 0 else begin
            yield "text", source[at:begin], ""
            at = begin
            continue
        if source.startswith("<!--", at):
            end = _COMMENT_END.search(source, at + 2)
            at = end.end() if end else size
            continue
        tag = _TAG.match(source, at) if final[">"] > at else None
        if tag or final[">"] > at and source.startswith(("<!", "<?"), at):
            end = tag_end(tag.end()) if tag else source.find(">", at)
            if tag:
                name = tag[1].lower()
                yield "close" if source[at + 1] == "/" else "open", name, source[tag.end() : end]
                if name in RAW and source[at + 1] != "/":
                    closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, end)
                    end = source.find(">", closing.end()) if closing else -1
                    end = size if end < 0 else end
            at = end + 1
        else:
            yield "text", "<", ""
            at += 1


def page_lines(source: str | None) -> list[tuple[str, bool, bool, bool]]:
    """Lines of a page with: shown by the markup, in an article, prose. Character references are decoded."""
    reader = _Reader()
    for kind, value, attributes in tokens(source or ""):
        if kind == "text":
            reader.text(value)
        elif kind == "close":
            reader.close(value)
        elif value not in RAW:
            reader.open(value, attributes)
    reader.end_line()
    return reader.lines


# Longest common subsequence


def _bit_rows(a: list[int], b: list[int]) -> list[int]:
    """The bit-parallel rows of the table of lengths: in row i, bit j is 0 where b[j] lengthens the LCS of a[:i] and b[:j + 1]."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & places.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """LCS lengths of a with each prefix of b."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for bit in bin(v | 1 << len(b))[3:][::-1] if b else "":
        out.append(out[-1] + (bit == "0"))
    return out


def lcs(a: list[int], b: list[int], cells: int = 1 << 26) -> list[int]:
    """Indices in ``a`` of a longest common subsequence; tables over so many bits are halved first (Hirschberg)."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    ends = [*range(first)], [*range(len(a) - last, len(a))]
    common = set(a[first : len(a) - last]) & set(b[first : len(b) - last])
    index = [k for k in range(first, len(a) - last) if a[k] in common]
    x, y = [a[k] for k in index], [v for v in b[first : len(b) - last] if v in common]
    if not x:
        return [*ends[0], *ends[1]]
    if len(x) * len(y) > cells and len(x) > 1:
        half = len(x) // 2
        forward, backward = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
        cut = max(range(len(y) + 1), key=lambda j: forward[j] + backward[len(y) - j])
        chosen = [*lcs(x[:half], y[:cut], cells), *(half + k for k in lcs(x[half:], y[cut:], cells))]
        return [*ends[0], *(index[k] for k in chosen), *ends[1]]
    rows, i, j, chosen = _bit_rows(x, y), len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            chosen.append(i)
        elif _count(rows[i - 1], j) >= _count(rows[i], j - 1):
            i -= 1
        else:
            j -= 1
    return [*ends[0], *(index[k] for k in reversed(chosen)), *ends[1]]


def _count(row: int, upto: int) -> int:
    """Zeros among the first bits: the LCS length there."""
    return upto - (row & ((1 << upto) - 1)).bit_count()


# Spark


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port and www) and path with query; empty for null."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    plain = F.regexp_replace(plain, r"^//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?#]*)", 1)), r"^.*@|:[0-9]*$|^www\.", "")
    return host, F.regexp_extract(plain, r"^[^/?#]*([^#]*)", 1)


def borders(keys: DataFrame, group_rows: int = GROUP_ROWS, most: int = MAX_BORDERS) -> list[tuple[str, str, int]]:
    """Keys (host, path, salt) that cut the pages, in order of their keys, into groups of about ``group_rows`` pages of mean size, fewer of larger ones: a sample by hash.

    ``keys`` has the pages' size, too. The sample is bounded by ``most``, above which groups grow. The salt, a hash of page_id, cuts the pages of one URL, too.
    """
    rows, size = keys.agg(F.count("*"), F.sum("size")).first()
    groups = min(most, rows // group_rows)
    if not groups:
        return []
    share = (F.lit(0.5) + F.lit(0.5) * F.col("size") / F.lit(max(size, 1) / rows)) * F.lit(groups / rows)
    drawn = F.shiftrightunsigned(F.xxhash64("host", "path", "salt", F.lit(1)), 11) < share * F.lit(float(1 << 53))
    sample = keys.where(drawn).select("host", "path", "salt").distinct().limit(3 * most)
    return sorted(tuple(r) for r in sample.select("host", "path", "salt").collect())


def extract(pages: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """page_id, url and text (main text, lines joined by a line feed) for each row of ``pages`` (page_id, url, html; others are left out).

    Null pages and pages without main text have an empty text. A page alone in its host is judged by its markup. Rows that repeat a page are neighbours of each other.
    """
    host, path = url_parts(F.col("url"))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.xxhash64("page_id").alias("salt"))
    cuts = borders(keyed.select("host", "path", "salt", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")), group_rows)
    ids = [pages.schema["page_id"], pages.schema["url"]]
    read = StructType([*ids, *StructType.fromDDL("host string, path string, salt long, lines array<string>, flags array<int>, prints array<long>, hash long, same long, near int, own boolean").fields])
    ends = StructType.fromDDL("host string, path string, salt long, url string, hash long, same long, near int")
    shared = pages.sparkSession.sparkContext.broadcast(cuts)

    def parsed(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Row number, place in the order (host, path, salt, url, hash of the lines, hash of what copies share), group, lines, flags, prints."""
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5, 1)))):
            found = page_lines(row[0])
            flags = [flag(x) for x in found]
            keep = candidates(flags, [len(x[0]) for x in found])
            prints = [xxhash.xxh64_intdigest(x[0].encode("utf-8", "surrogatepass")) - (1 << 63) for x in found]
            place = (*row[1:5], digest(prints), digest(content(flags, keep, prints)))
            # Lines that the markup drops are only compared.
            yield k, place, bisect.bisect_right(shared.value, place[:3]), [x[0] if kept else None for x, kept in zip(found, keep)], flags, prints

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*where, near) for _, where, near, *_ in parsed(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=ends.names)

    lookups = pages.sparkSession.sparkContext.broadcast(_carried(keyed.withColumn("url", F.col("url").cast("string")).mapInArrow(place, ends)) if cuts else {})

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows = []
                for k, where, near, lines, flags, prints in parsed(part):
                    rows.append((k, *where[:3], lines, flags, prints, *where[4:], near, True))
                    rows += [(k, *where[:3], None, None, prints, *where[4:], group, False) for group in lookups.value.get(where, ())]
                took = pa.array([r[0] for r in rows], pa.int64())
                types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).take(took), part.column(1).take(took), *(pa.array([r[c + 1] for r in rows], t) for c, t in enumerate(types))], names=read.names)

    order = ("host", "path", "salt", "url", "hash", "same")
    found = keyed.mapInArrow(parse, read)
    for name, window in (("before", Window.partitionBy("near").orderBy(*order)), ("after", Window.partitionBy("near").orderBy(*(F.desc(c) for c in order)))):
        # Where a run of copies begins, the page ahead of it; within the run, the same page.
        found = found.withColumn(name, F.when(F.lag("same").over(window) != F.col("same"), F.lag(F.struct("host", "path", "prints")).over(window)))
        found = found.withColumn(name, F.last(name, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    moved = [F.col(f"{name}.{c}").alias(f"{name}_{c}") for name in ("before", "after") for c in ("host", "path", "prints")]
    schema = StructType([*ids, *StructType.fromDDL("text string").fields])

    def differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows = zip(*(part.column(k).to_pylist() for k in range(2, 13)))
                texts = ["\n".join(main_lines(*row[2:5], nearest(row[0], row[1], [row[5:8], row[8:11]]))) for row in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=schema.names)

    return found.where("own").select("page_id", "url", "host", "path", "lines", "flags", "prints", *moved).mapInArrow(differ, schema)


def _carried(places: DataFrame) -> dict[tuple, list[int]]:
    """Places of pages that other groups look up, with those groups: the last two ahead of a group and the first two after it that are no copies of each other.

    As many as four for each group; groups are at most one more than borders.
    """
    order = ("host", "path", "salt", "url", "hash", "same")
    at = F.struct(*order)
    runs = places.groupBy("near", "same").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    ranked = runs.select("near", "low", "high", F.row_number().over(Window.partitionBy("near").orderBy("low")).alias("first"), F.row_number().over(Window.partitionBy("near").orderBy(F.desc("high"))).alias("last"))
    edges: dict[int, tuple[dict, dict]] = {}
    for r in ranked.where("first <= 2 OR last <= 2").collect():
        firsts, lasts = edges.setdefault(r["near"], ({}, {}))
        if r["first"] <= 2:
            firsts[r["first"]] = tuple(r["low"])
        if r["last"] <= 2:
            lasts[r["last"]] = tuple(r["high"])
    out: dict[tuple, list[int]] = {}
    for side, groups in ((1, sorted(edges)), (0, sorted(edges, reverse=True))):
        ahead: list[tuple] = []  # the nearest page, and the nearest that is no copy of it
        for group in groups:
            for where in ahead:
                out.setdefault(where, []).append(group)
            near = [edges[group][side][k] for k in sorted(edges[group][side])] + ahead
            ahead = [near[0], *[where for where in near if where[-1] != near[0][-1]][:1]]
    return out


def digest(prints: list[int]) -> int:
    return xxhash.xxh64_intdigest(array.array("q", prints).tobytes()) - (1 << 63)


def content(flags: list[int], keep: list[bool], prints: list[int]) -> list[int]:
    """What copies of a page have in common, whatever their frames: the prose that the markup keeps, or if there is none all that it keeps."""
    kept = [k for k, there in enumerate(keep) if there]
    return [prints[k] for k in kept if flags[k] & 4] or [prints[k] for k in kept]


def nearest(host: str, path: str, others: list[tuple]) -> list[int] | None:
    """Of the neighbours in the host, the one whose path agrees longest with this one's; the first of equals."""
    there = [(len(os.path.commonprefix([path, p])), -k, prints) for k, (h, p, prints) in enumerate(others) if h == host]
    return max(there, key=lambda x: x[:2])[2] if there else None


def flag(line: tuple[str, bool, bool, bool]) -> int:
    """Bits: 1 shown, 2 in an article, 4 prose."""
    return line[1] | line[2] << 1 | line[3] << 2


def candidates(flags: list[int], sizes: list[int]) -> list[bool]:
    """Lines that the markup keeps: shown ones, only those in an article if articles hold most of the prose (of all text if none is prose)."""
    shown = [k for k, f in enumerate(flags) if f & 1]
    judged = [k for k in shown if flags[k] & 4] or shown
    article = 2 * sum(sizes[k] for k in judged if flags[k] & 2) > sum(sizes[k] for k in judged)
    return [bool(f & 1 and (not article or f & 2)) for f in flags]


def main_lines(lines: list[str | None], flags: list[int], prints: list[int], other: list[int] | None) -> list[str]:
    """Lines that stay: those that the markup keeps; of them, ones that the neighbour shares only if they are prose of an article."""
    shared = set(lcs(prints, other)) if other else set()
    return [line for k, line in enumerate(lines) if line is not None and (k not in shared or flags[k] & 6 == 6)]


def op10_html(spark, sf_dir: str) -> DataFrame:
    """The contract's digest."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
