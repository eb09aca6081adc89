"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by URL path within cells: a host is one cell, and a host with very many pages is cut into cells at pages
that a hash picks, so a host with a third of all pages spreads over many tasks and the cells, and with them the texts, are
the same however the pages are partitioned. Each page is compared with its nearest different neighbours of the same host, those whose paths share the longest
prefixes: text lines are aligned by their longest common subsequence, and shared lines are deleted as template. Blocks
inside menus, footers, forms, scripts and the like are never lines. If an article or main element is declared, the text
is its lines, without those that three neighbours or more share, all compared; neighbours that hold a copy of the article
don't count, so copies of an article on one host don't delete each other.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import staged, table

# Names of HTML elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
SKIPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas dialog menu audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starting one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class, id and role that mark what isn't the article.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promotion promoted related respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
MAIN_WORDS = frozenset({"article-body", "article-content", "articlebody", "content", "entry-content", "main", "main-content", "maincontent", "post-body", "post-content"})
#: Pages of a host beyond which it is cut into cells of about as many pages, and the most cells of a host.
CELL_PAGES, MOST_CELLS = 1_000, 4096
#: Up to so many hosts that are cut (checked) are broadcast; beyond, the join shuffles.
BROADCAST_HOSTS = 2_000
#: Pages to each side that may be neighbours, and as many of them are compared.
REACH = 4
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass(frozen=True)
class Line:
    text: str
    level: int  # 2 in an article, 1 in a main part, 0 elsewhere
    heading: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\n\r\f") else {}


def _is_aside(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in SKIPPED or name == "header" and not in_article or "hidden" in attrs:
        return True
    if name in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in ASIDE_ROLES:
        return True
    words = {w for a in ("class", "id") for token in attrs.get(a, "").lower().split() for w in (token, *re.split(r"[-_]+", token))}
    if name == "article":
        words &= {"comment", "comments"}
    return bool(words & ASIDE_WORDS)


def _level(name: str, attrs: dict[str, str]) -> int:
    if name == "article":
        return 2
    if name == "main" or attrs.get("role", "").lower() == "main":
        return 1
    return int(any(t in MAIN_WORDS for a in ("class", "id") for t in attrs.get(a, "").lower().split()))


def text_lines(page: str) -> list[Line]:
    """The page's text blocks in order, without those that markup sets aside; character references decoded."""
    lines: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # name, set aside, level

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append(Line(text, stack[-1][2], stack[-1][0] in HEADINGS))

    def pop_to(depth: int) -> None:
        if any(s[0] in BLOCKS or s[1] != stack[depth - 1][1] for s in stack[depth:]):
            flush()
        del stack[depth:]

    at = 0
    while True:
        m = TAG.search(page, at)
        if not stack[-1][1]:
            held.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                pop_to(depth)
            elif name in BLOCKS and not stack[-1][1]:
                flush()
            continue
        if name == "br" or name in ("td", "th"):
            if not stack[-1][1]:
                held.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in ENDS_PARAGRAPH:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0)
            if depth and stack[depth][0] == "p":
                pop_to(depth)
        if name in SIBLINGS:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in SIBLINGS[name] or stack[i][0] in ("ul", "ol", "dl", "table", "select")), 0)
            if depth and stack[depth][0] in SIBLINGS[name]:
                pop_to(depth)
        if name in BLOCKS:
            flush()
        _, aside, level = stack[-1]
        attrs = _attributes(m[3])
        aside_now = aside or _is_aside(name, attrs, level == 2)
        if aside_now and not aside and name not in BLOCKS and name not in SKIPPED:
            flush()
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, aside_now, max(level, _level(name, attrs))))
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of one longest common subsequence of ``a`` and ``b`` (Hunt-Szymanski after equal ends)."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(start), *range(len(a) - end, len(a))}
    where: dict[str, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    chains: list[tuple | None] = []
    for i in range(start, len(a) - end):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(chain)
            else:
                tails[k], chains[k] = j, chain
    chain = chains[-1] if chains else None
    while chain:
        out.add(chain[0])
        chain = chain[1]
    return out


def _mostly(lines: list[Line], part: Iterable[int], shared: set[int]) -> bool:
    """Whether ``shared`` holds over four fifths of the part's text."""
    sizes = {i: len(lines[i].text) for i in part}
    return 5 * sum(n for i, n in sizes.items() if i in shared) > 4 * sum(sizes.values())


def _most_share(shares: list[set[int]]) -> set[int]:
    """Lines that over half of three neighbours or more share."""
    counts = Counter(i for shared in shares for i in shared)
    return {i for i, n in counts.items() if 2 * n > len(shares)} if len(shares) >= 3 else set()


def main_text(lines: list[Line], neighbours: list[list[Line]]) -> str:
    """The page's article: lines of the innermost declared part, or all lines, without template.

    neighbours: different pages, the nearest first. In a declared part, template is what all neighbours share, three or
    more that don't share over four fifths of the part (copies of the article do), at the part's ends or if the page says
    it outside of the part as well; section headings and what stands between own lines are the article's. If a page declares no part, template
    is what most of three neighbours or more share, and what the nearest shares, unless the latter is over four fifths of
    the rest (two copies). If nothing would be left, nothing is template.
    """
    level = max((x.level for x in lines), default=0)
    part = [i for i, x in enumerate(lines) if x.level == level]
    texts = [x.text for x in lines]
    shares = [shared_lines(texts, [x.text for x in n]) for n in neighbours]
    if level:
        others = [s for s in shares if not _mostly(lines, part, s)]
        shared = set.intersection(*others) if len(others) >= 3 else set()
        ends = {*takewhile(shared.__contains__, part), *takewhile(shared.__contains__, reversed(part))}
        outside = {x.text for x in lines if x.level != level}
        template = {i for i in shared if not lines[i].heading and (i in ends or texts[i] in outside)}
    else:
        template = _most_share(shares)
        if template.issuperset(part):
            template = set()
        rest = [i for i in part if i not in template]
        if shares and not _mostly(lines, rest, shares[0]):
            template = template | shares[0]
    if template.issuperset(part):
        template = set()
    return "\n\n".join(texts[i] for i in part if i not in template)


def _common(a: str, b: str) -> int:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return n


def _in_cells(rows: DataFrame) -> DataFrame:
    """The rows with ``cell`` (0 if the host isn't cut), dealt by host and cell and sorted in them."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > CELL_PAGES)
    every = F.greatest(F.lit(CELL_PAGES), F.ceil(F.col("pages") / F.lit(MOST_CELLS))).alias("every")
    large = staged(hosts.select(F.col("host").alias("cut_host"), every), "large-hosts")
    small = large.count() <= BROADCAST_HOSTS
    here = F.col("host") == F.col("cut_host")
    marks = rows.select("host", "path", "k").join(F.broadcast(large) if small else large, here).where(F.pmod(F.xxhash64("path", "k"), "every") == 0)
    cuts = marks.groupBy("cut_host").agg(F.collect_set(F.struct("path", "k")).alias("cuts"))
    cell = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.struct("path", "k"))), F.lit(0))
    placed = rows.join(F.broadcast(cuts) if small else cuts, here, "left").select(*rows.columns, F.when(F.col("cuts").isNull(), 0).otherwise(cell).alias("cell"))
    return placed.repartition("host", "cell").sortWithinPartitions("host", "cell", "path", "k", F.xxhash64("page"))


def extract_main_text(df: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) for each page.

    A null or empty page gives an empty text; a null url is a host of its own kind, "", whose pages pair up by key.
    Repeated rows are pages of their own. Pages at the edge of a cell look inwards; a page without a neighbour is judged
    by its markup. Runs of pages with equal lines count as one page. Very long pages are parsed in one pass. An empty table gives no rows; other columns are not read.
    """
    where = F.coalesce(F.col("u"), F.lit(""))
    rows = df.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(page), F.lit("")).alias("page"))
    rows = rows.select("k", "u", F.lower(F.regexp_extract(where, r"^[^/?#]*//([^/?#]*)", 1)).alias("host"), F.regexp_extract(where, r"^(?:[^/?#]*//[^/?#]*)?([^?#]*)", 1).alias("path"), "page")
    dealt = _in_cells(rows)

    def pages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                k, u, host, path, body, cell = (c[i].as_py() for c in batch.columns)
                yield k, u, (host, cell), path, text_lines(body)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def batches_seen() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for b in batches:
                kinds = b.schema.field(0).type
                yield b

        out: list[tuple] = []
        held: list[tuple[list[tuple], tuple, str, list[Line]]] = []  # keys and urls, cell, path, lines
        at = 0

        def settle(at: int) -> list[tuple]:
            rows, cell, path, lines = held[at]
            around = [held[i] for d in range(1, REACH + 1) for i in (at - d, at + d) if 0 <= i < len(held) and held[i][1] == cell]
            near: list[list[Line]] = []
            for x in sorted(around, key=lambda x: -_common(x[2], path)):
                if len(near) < REACH and x[3] != lines and x[3] not in near:
                    near.append(x[3])
            text = main_text(lines, near)
            return [(k, u, text, len(text)) for k, u in rows]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            k, u, text, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, kinds), pa.array(u, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64())], names=[key, url, "text", "n_chars"])

        for k, u, cell, path, lines in pages(batches_seen()):
            if held and held[-1][1] == cell and held[-1][3] == lines:
                held[-1][0].append((k, u))
                continue
            held.append(([(k, u)], cell, path, lines))
            # the newest page may still gain copies, so it is settled only once others follow
            if len(held) - at > REACH + 1:
                out += settle(at)
                at += 1
                del held[: max(0, at - REACH)]
                at = min(at, REACH)
            while len(out) >= 1000:
                yield batch(out[:1000])
                del out[:1000]
        for i in range(at, len(held)):
            out += settle(i)
        for a in range(0, len(out), 1000):
            yield batch(out[a : a + 1000])

    return dealt.mapInArrow(work, f"`{key}` {rows.schema['k'].dataType.simpleString()}, `{url}` string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
