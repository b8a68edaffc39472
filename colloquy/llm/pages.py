"""HTML extraction by nearest-URL page differencing.

A page becomes text lines (one a block element). The URL paths of a host are put in order; the pages at the path before
and at the path after are those most likely made from the same template. Lines are aligned with theirs by longest
common subsequence, and lines shared with either are template: they are deleted. Two guards keep real text and one
rule drops what no neighbour can show: lines inside declared main content (article, main) stay, since copies of an
article and widely quoted passages are shared lines too; a page without such an element whose every line would go
loses only lines that both neighbours share, or else none; and what the markup itself declares not to be content
(navigation, header, footer, aside, form, hidden parts, advert and comment blocks) goes even if no neighbour has it.

Pages are parsed once, into a table in the shared folder. Only hashes of lines travel to the neighbour. Places in the
order are ranks over ranges of (host, path), so a host with a third of all pages is many tasks.

Defined cases: a null or empty page has no text and no lines; a page whose URL is null or without a host has no
neighbour. Neighbours differ in path and in lines: of several pages at one path the one of least hash stands for the
path, of paths of a host with equal lines the first stands for all; so repeated rows and copies under other URLs never
delete each other's text. Each row of the input is a row of the result. A page alone on its host loses only what its
markup declares; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import cut, ranked
from colloquy.llm.url_rules import host_of, path_of
from colloquy.shipping import ship

# What elements and names mean.
RAW = frozenset("script style noscript template iframe object svg math textarea select canvas audio video head title".split())
CHROME = frozenset("nav header footer aside form menu dialog button figcaption".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw elements whose text is never markup; the others of RAW, when not closed, are passed over as a tag alone.
OPAQUE = frozenset("script style textarea title".split())
#: Elements that a new one of the kinds named closes.
CLOSES = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of a class, id or role that declare a block not to be content.
NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer gdpr header masthead menu nav navbar navigation newsletter notice pagination popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo search".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
#: One attribute after the other, each by its whole name.
ATTR = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"\s+")


#: Of those, words that count on a main element too; words beside which those of MILD name a part of the text.
ASIDE = frozenset("ad ads advert advertisement comment comments discussion promo promoted related replies reply sponsored".split())
HEADING = frozenset("article body content entry page post results story text title".split())
MILD = frozenset("banner header".split())
#: Words that name something else on an inline element: marked words, notes, code.
INLINE = frozenset("ad ads banner comment comments discussion header menu notice related reply respond search widget".split())
#: Controls that stand inside a line.
CONTROLS = frozenset("button label".split())
#: Related work, as a part of a text.
STUDIES = re.compile(r"\brelated[^a-z]+(?:works?|research|literature|studies)\b")


def declared(attrs: str, element: str = "div") -> bool:
    """The attributes say that this is not content; names of an article or main element are mostly layout."""
    main, inline = element in MAIN, element not in BLOCKS
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            said = set(re.split(r"[^a-z]+", STUDIES.sub(" ", value)))
            if said & HEADING:
                said -= MILD
            if said & {"result", "results"}:
                said.discard("search")
            if element in ("section", "article"):
                said.discard("discussion")
            if inline:
                said -= INLINE
            if said & (ASIDE if main else NAMES):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of every block in page order; kind 0: unmarked, 1: in declared main content, 2: declared other."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int]] = []  # (element, kind inside, kind of the block around it)
    opened: Counter[str] = Counter()  # how often each element is on the stack
    kind = base = 0
    endless: set[str] = set()  # raw elements that no closing tag follows any more

    def close() -> None:
        joined = SPACES.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if joined:
            out.append((joined, base))

    def add(part: str) -> None:
        if kind == base:  # else inside an inline element that is not content
            text.append(part)

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                close()
            if opened[name]:
                while (gone := stack.pop()[0]) != name:
                    opened[gone] -= 1
                opened[name] -= 1
                kind, base = stack[-1][1:] if stack else (0, 0)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            if name in ("head", "title") or not m[3].endswith("/"):
                close_at = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if close_at is None:
                    endless.add(name)
                if name == "head" and close_at is None and "body" not in endless:
                    close_at = re.compile(r"(?=<body)", re.I).search(page, at)
                    if close_at is None:
                        endless.add("body")
                at = close_at.end() if close_at else (end if name in OPAQUE else at)
            text.append(" ")
            continue
        if name in BLOCKS:
            close()
            while stack and name in CLOSES.get(stack[-1][0], ()):
                opened[stack.pop()[0]] -= 1
            kind, base = stack[-1][1:] if stack else (0, 0)
        if name in VOID or m[3].endswith("/"):
            continue
        if kind != 2:
            # an article may have a header of its own; its heading is content
            inside = kind == 1 and name == "header"
            if (name in CHROME and not inside and name != "figcaption") or name in CONTROLS or name not in ("html", "body") and not inside and declared(m[3], name):
                kind = 2
            elif name in MAIN and kind == 0:
                kind = 1
        if name in BLOCKS:
            base = kind
        stack.append((name, kind, base))
        opened[name] += 1
    close()
    return out


def shared(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of own's lines a longest common subsequence with other pairs up.

    A run of equal lines counts as one. Common ends are paired first and lines that the other page lacks are set
    aside; what is left is aligned exactly.
    """
    if not len(own) or not len(other):
        return np.zeros(len(own), bool)
    new = np.append(True, own[1:] != own[:-1])
    x, y = own[new].tolist(), other[np.append(True, other[1:] != other[:-1])].tolist()
    hit = np.zeros(len(x), bool)
    lo, a, b = 0, len(x), len(y)
    while lo < min(a, b) and x[lo] == y[lo]:
        hit[lo] = True
        lo += 1
    while a > lo and b > lo and x[a - 1] == y[b - 1]:
        a, b = a - 1, b - 1
        hit[a] = True
    mine, theirs = set(x[lo:a]), set(y[lo:b])
    at = [k for k in range(lo, a) if x[k] in theirs]
    _pair([x[k] for k in at], at, [v for v in y[lo:b] if v in mine], hit)
    return hit[np.cumsum(new) - 1]


#: Bits of alignment rows kept at once; longer pairs of pages are halved first, so memory stays at 16 MB.
MOST_BITS = 1 << 27


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """After each item of x: an integer with bit k clear where the longest common subsequence grows at y[k]."""
    places: dict[int, int] = {}
    for k, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << k
    full = row = (1 << len(y)) - 1
    for v in x:
        met = row & places.get(v, 0)
        row = (row + met | row - met) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of y."""
    row = 0
    for row in _rows(x, y):
        pass
    clear = 1 - np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), "u1"), bitorder="little")[: len(y)].astype("i8")
    return np.append(0, np.cumsum(clear))


def _pair(x: list[int], at: list[int], y: list[int], hit: np.ndarray) -> None:
    """Marks in hit the places (at) of those items of x that are paired."""
    if not x or not y:
        return
    if len(x) > 1 and len(x) * len(y) > MOST_BITS:
        mid = len(x) // 2
        cut_at = int(np.argmax(_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]))
        _pair(x[:mid], at[:mid], y[:cut_at], hit)
        _pair(x[mid:], at[mid:], y[cut_at:], hit)
        return
    rows, i, j = list(_rows(x, y)), len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            hit[at[i]] = True
        else:
            i -= 1


def line_hashes(found: list[tuple[str, int]]) -> bytes:
    """48 bits of hash a line; only lines of two neighbouring pages are ever compared."""
    return b"".join(xxhash.xxh64_digest(t)[:6] for t, _ in found)


def numbers(lines: bytes) -> np.ndarray:
    raw = np.frombuffer(lines, "u1").reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).view("<i8").ravel()


def deleted(lines: bytes, others: list[bytes | None], loose: list[int], main: bool) -> list[int]:
    """The (0-based) lines of a page that its neighbours' show to be template.

    loose: lines that stand in no declared main content and are not declared chrome; main: there is main content.
    """
    own = numbers(lines)
    hits = [shared(own, numbers(x)) for x in others if x is not None]
    if not hits:
        return []
    hit = np.any(hits, axis=0)
    if not main and len(loose) and hit[loose].all():
        hit = np.all(hits, axis=0) if len(hits) > 1 else np.zeros(len(own), bool)
        if hit[loose].all():
            return []
    return np.flatnonzero(hit).astype("i4").tolist()


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page once: row, id, url, host, path, and of its lines, as a table in the shared folder.

    lines: the hash of each; at: places of those that are not declared chrome, packed their texts (one a line); loose:
    the places of those that stand in no declared main content either.
    """
    ship(pages.sparkSession)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor().compress
        for texts in batches:
            made = []
            for p in texts:
                found = blocks(p)
                held = [(k, kind, x) for k, (x, kind) in enumerate(found) if kind != 2]
                packed = press("\n".join(x for _, _, x in held).encode()) if held else b""
                made.append((line_hashes(found), [k for k, _, _ in held], [k for k, kind, _ in held if kind == 0], packed))
            yield pd.DataFrame(made, columns=["lines", "at", "loose", "packed"])

    kinds, url = "lines binary, at array<int>, loose array<int>, packed binary", F.col(url_col)
    once = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.pandas_udf(read, kinds, F.PandasUDFType.SCALAR_ITER)(F.col(html_col)).alias("_s"))
    return cut(once.select("row", "id", "url", "host", "path", "_s.*"), "parsed", compression="zstd")


def template_lines(table: DataFrame) -> DataFrame:
    """row and template: the lines of each parsed page that its neighbours by URL show to be template.

    Pages without a loose line have none that could go; they are neighbours like all others, but are not asked about.
    """
    ship(table.sparkSession)
    keys = table.where("host <> ''").select("row", "host", "path", "lines", "loose", (F.size("at") > F.size("loose")).alias("main"), F.xxhash64("lines").alias("content"))
    paths = keys.groupBy("host", "path").agg(F.min(F.struct("content", "lines")).alias("c")).select("host", "path", "c.*")
    classes = paths.groupBy("host", "content").agg(F.min(F.struct("path", "lines")).alias("p")).select("host", "content", "p.*")
    places = ranked(classes, [F.asc("host"), F.asc("path"), F.asc("content")], "rank")
    near = lambda step, name: places.select((F.col("rank") + step).alias("rank"), F.struct("host", "path", "content", "lines").alias(name))
    met = places.select("host", "content", "rank").join(near(1, "before"), "rank", "left").join(near(-1, "after"), "rank", "left").drop("rank")
    asked = keys.where(F.size("loose") > 0).join(paths.select("host", "path", F.col("content").alias("stands")).join(met.withColumnRenamed("content", "stands"), ["host", "stands"]), ["host", "path"])
    other = lambda n: F.when((F.col(n)["host"] == F.col("host")) & (F.col(n)["path"] != F.col("path")) & (F.col(n)["content"] != F.col("content")), F.col(n)["lines"])

    def differ(batches: Iterator[tuple]) -> Iterator[pd.Series]:
        for own, before, after, loose, main in batches:
            yield pd.Series([deleted(a, [b, c], list(e), m) for a, b, c, e, m in zip(own, before, after, loose, main, strict=True)])

    mark = F.pandas_udf(differ, "array<int>", F.PandasUDFType.SCALAR_ITER)
    return asked.select("row", mark("lines", other("before"), other("after"), "loose", "main").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page with text (blocks joined by an empty line), n_chars and n_deleted, the lines deleted as shared."""
    table = parsed(pages, id_col, url_col, html_col)
    held = table.select("row", F.col("id").alias(id_col), F.col("url").alias(url_col), "at", "loose", "packed")
    open_ = F.size("loose") > 0
    both = held.where(open_).join(template_lines(table), "row", "left").unionByName(held.where(~open_).withColumn("template", F.lit(None).cast("array<int>")))

    def kept(batches: Iterator[tuple]) -> Iterator[pd.Series]:
        unpack = zstandard.ZstdDecompressor().decompress
        for some in batches:
            made = []
            for at, loose, packed, template in zip(*some, strict=True):
                gone = set(template) & set(loose) if template is not None else set()
                texts = unpack(packed).decode().split("\n") if packed else []
                made.append("\n\n".join(x for k, x in zip(at, texts, strict=True) if k not in gone))
            yield pd.Series(made)

    text = F.pandas_udf(kept, "string", F.PandasUDFType.SCALAR_ITER)("at", "loose", "packed", "template")
    return both.withColumn("text", text).select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), F.greatest(F.size(F.array_intersect("template", "loose")), F.lit(0)).alias("n_deleted"))


def op1(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import read

    return extract(read(spark, sf_dir, "pages"))
