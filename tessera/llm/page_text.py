"""Main text of web pages by nearest-URL differencing (operator 2).

Pages of a host lie in the order of their URL paths; a page's template is what
it shares with the nearest page of another text. The text lines of both are
aligned by a longest common subsequence, and shared lines are to go, the others
to stay. As two pages may also share what is not template, an exact check by
place overrules that: lines inside an article (``article`` or ``main``) stay and
those in furniture (navigation, adverts, forms, comments and the like, known by
element, role, class or id) go. Lines of unmarked places, on any page, stand or
fall by the difference.

Defined results
* null or empty html, or none but furniture: empty text; such a page is no neighbour
* a page alone on its host, or with copies only: no difference, structure alone
  decides: lines of unmarked places stay if no article is marked
* copies (repeated rows, one article under several URLs) have the same lines but
  for furniture; they are not held against each other
* a page of which the difference would leave nothing is held against the page on
  its other side; if that too leaves nothing, structure alone decides
* ties in URL go by page id; equal URLs are neighbours; repeated rows are pages
* null url: such pages have no neighbours
* very long pages: three pages are held at a time, and ids and URLs of copies
* empty table: no rows; extra columns are ignored
* broken markup: an element ends with its container; the end of the page ends all

Ranges of keys are dealt out, so a hot host is spread over many tasks. Each range
is sent the nearest rows on both sides of it as guests, ``GUESTS`` of other html,
from as many ranges away as that takes; so where ranges end decides nothing,
unless more than ``GUESTS`` copies that differ in html, or empty pages, lie there. The driver sees
sampled keys and the edges of ranges, of which there are ``RANGES`` about at any
size: larger corpora have longer ranges, which are sorted on disk and streamed.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the HTML standard and of common page furniture.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|select"
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_FURNITURE = frozenset("nav footer aside form menu dialog button input fieldset head search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_MARKS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe subscription signup login form search pagination pager widget toolbar skip".split())
#: Words beside these that leave a name what it is.
_NEUTRAL = frozenset("main site page global local left right top bottom upper lower primary secondary inner outer list area section box block container wrapper wrap holder content body item items link links button buttons bar panel group row col column zone slot unit area text title form field icon icons count post posts story stories article articles entry small large mini fixed sticky floating mobile desktop js id".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[_-]+")
_SPACE = re.compile(r"\s+")
#: A tag that the end of the page cuts off.
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")

#: Rows of other html that a range is sent from each side, sampled keys for each range, and the number of ranges at most, about.
GUESTS = 3
SAMPLED = 8
RANGES = 8192
#: Ranges in a task, about.
TASK_RANGES = 4

#: Where a line stands.
ARTICLE, OPEN, FURNITURE = 0, 1, 2


def _marks(name: str) -> bool:
    """Whether a class or id names furniture: by one word at least, and by no word that tells of something else."""
    words = [w for w in _SPLIT.split(name) if w]
    return not _MARKS.isdisjoint(words) and all(w in _MARKS or w in _NEUTRAL or w.isdigit() for w in words)


def _is_furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in _FURNITURE or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value in _ROLES:
                return True
        elif any(_marks(one) for one in value.split()):
            return not (inside_article and tag[0] == "h" and tag[1:].isdigit())
    return bool(_HIDDEN.search(attributes))


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text lines of a page, one per block, each with where it stands."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, place outside it, whether an article is around it
    place, article, at = OPEN, False, 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, place))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("br", "hr"):
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if place != stack[i][1]:
                        flush()
                    place, article = stack[i][1], stack[i][2]
                    del stack[i:]
                    break
                if not block and stack[i][0] in _BLOCK:
                    break  # an inline end tag doesn't end blocks
            continue
        if tag in _VOID or m[4].endswith("/"):
            continue
        if block:
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "li" or stack[-1][0] not in _BLOCK and any(s[0] == "p" for s in stack)):
                _, place, article = stack.pop()
        inner, within = place, article
        if tag in ("article", "main") and place != FURNITURE:
            inner, within = ARTICLE, True
        elif place != FURNITURE and _is_furniture(tag, m[4], article):
            inner = FURNITURE
        if inner != place and not block:
            flush()
        stack.append((tag, place, article))
        place, article = inner, within
    if at < len(page):
        parts.append(_CUT_OFF.sub("", page[at:]))
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Matches in order of ``a`` (and from the end in ``b``) whose places in ``b``
    rise: a longest rising sequence, in time by the number of matches.
    """
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect.bisect_left(tails, j)
            node = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(node)
            else:
                tails[k], ends[k] = j, node
    out, node = set(), ends[-1] if ends else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def main_text(lines: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """Lines that are not shared with the neighbour, after the exact check by place."""
    if neighbour is None:
        marked = any(p == ARTICLE for _, p in lines)
        gone = {i for i, (_, p) in enumerate(lines) if p == OPEN and marked}
    else:
        gone = shared_lines([t for t, _ in lines], [t for t, _ in neighbour])
    kept = [t for i, (t, p) in enumerate(lines) if p == ARTICLE or (p == OPEN and i not in gone)]
    return "\n".join(kept)


def _nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Run:
    """Adjacent copies: the lines of the first, and the path and row of each."""

    def __init__(self, group: tuple, lines: list[tuple[str, int]]):
        self.group, self.lines, self.members = group, lines, []
        self.text = [x for x in lines if x[1] != FURNITURE]

    def texts(self, before: _Run | None, after: _Run | None) -> Iterator[tuple]:
        """``page_id, url, text`` of each copy that is no guest; the nearer of the runs beside it is its neighbour."""
        beside = [x for x in (before, after) if x and x.group == self.group and x.group[1] is not None]
        held: dict[int, str] = {}
        for path, page_id, url, guest in self.members:
            if guest:
                continue
            # of the run before, the last copy is nearest
            order = sorted(beside, key=lambda x: -_nearness(x.members[-1 if x is before else 0][0], path))
            text = ""
            for x in [*order, None]:
                if id(x) not in held:
                    held[id(x)] = main_text(self.lines, x.lines if x else None)
                if text := held[id(x)]:
                    break
            yield page_id, url, text


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (range, host, path, id); each run of copies is held against the runs beside it."""
    before = now = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=["page_id", "url", "text"])

    for batch in batches:
        for to, host, path, page_id, url, html, guest in zip(*(batch.column(i).to_pylist() for i in range(7))):
            after = _Run((to, host), lines_of(html or ""))
            after.members.append((path, page_id, url, guest))
            if not after.text:
                done += [] if guest else [(page_id, url, "")]  # nothing to hold another page against
            elif now is None or after.group != now.group or after.text != now.text:
                if now:
                    done += now.texts(before, after)
                before, now = now, after
            else:
                now.members += after.members
            if len(done) >= 500:
                yield out()
                done = []
    if now:
        done += now.texts(before, None)
    yield out()


def _placed(pages: DataFrame, rows: int) -> DataFrame:
    """The keyed pages with their ``range``, about ``rows`` pages each: only sampled keys, a few for each range, are gathered."""
    url = F.lower("url")
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.|m\.)?([^/:?#]*)", 1)
    path = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    page_id = F.col("page_id").cast("long")
    keyed = pages.select(
        host.alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(page_id, F.lit(-(1 << 63))).alias("id"),
        page_id.alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    )
    share = min(1.0, SAMPLED / rows)
    keys = keyed.select("host", "path", "id").sample(share, seed=2).collect()
    keys = sorted((r.host is not None, r.host or "", r.path, r.id) for r in keys)
    step = max(1, round(rows * share))
    bounds = sorted(set(keys[step::step]))

    @F.pandas_udf("int")
    def range_of(has, host, path, id_):
        import pandas as pd

        return pd.Series([bisect.bisect_right(bounds, k) for k in zip(has.tolist(), host.tolist(), path.tolist(), id_.tolist())], dtype="int32")

    return keyed.withColumn("range", range_of(F.col("host").isNotNull(), F.coalesce("host", F.lit("")), "path", "id"))


def _edges(placed: DataFrame) -> list:
    """Keys and hashes of the outermost ``GUESTS`` rows of other html at both ends of each range."""
    order = Window.partitionBy("range").orderBy("host", "path", "id", "h")
    keys = placed.select("range", "host", "path", "id", F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"))
    flagged = keys.select(
        "*", (~F.lag("h").over(order).eqNullSafe(F.col("h"))).alias("opens"), (~F.lead("h").over(order).eqNullSafe(F.col("h"))).alias("closes")
    )
    numbered = flagged.withColumn("run", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.withColumn("runs", F.max("run").over(Window.partitionBy("range")))
    head, tail = F.col("opens") & (F.col("run") <= GUESTS), F.col("closes") & (F.col("run") > F.col("runs") - GUESTS)
    return runs.select("range", "run", "host", "path", "id", "h", head.alias("head"), tail.alias("tail")).where("head or tail").collect()


def _guests(edges: list) -> list[tuple]:
    """``to, range, host, path, id, h``: for each range the nearest rows of other html on both sides."""
    by_range: dict[int, list] = {}
    for e in sorted(edges, key=lambda e: (e.range, e.run, e.tail)):
        by_range.setdefault(e.range, []).append(e)
    out = set()
    for side, ranges in (("tail", sorted(by_range)), ("head", sorted(by_range, reverse=True))):
        near: deque = deque(maxlen=GUESTS)
        for k in ranges:
            out |= {(k, e.range, e.host, e.path, e.id, e.h) for e in near}
            own = [e for e in by_range[k] if e[side]]
            for e in own if side == "tail" else reversed(own):
                if near and near[-1].h == e.h:
                    near.pop()
                near.append(e)
    return list(out)


def main_texts(pages: DataFrame, rows: int = 1000) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; ``rows`` is about the pages of a range, of no more than ``RANGES``."""
    n = pages.count()
    rows = max(rows, n // RANGES)
    placed = _placed(pages, rows)
    columns = ["to", "host", "path", "page_id", "url", "html", "guest", "id"]
    dealt = placed.withColumn("to", F.col("range")).withColumn("guest", F.lit(False)).select(*columns)
    if guests := _guests(_edges(placed)):
        g = pages.sparkSession.createDataFrame(guests, "to int, range int, host string, path string, id long, h long")
        h = F.xxhash64(F.coalesce("p.html", F.lit("")))
        on = [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("range", "host", "path", "id")]
        sent = placed.alias("p").join(F.broadcast(g).alias("g"), [*on, h == F.col("g.h")])  # a few rows for each range
        sent = sent.select("g.to", *[f"p.{c}" for c in columns[1:6]], F.lit(True).alias("guest"), "p.id")
        dealt = dealt.union(sent.dropDuplicates(["to", "host", "path", "id", "html"]))
    # as many tasks as the pages need, whatever the session's number of partitions
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, n // (rows * TASK_RANGES))
    dealt = dealt.repartition(tasks, "to").sortWithinPartitions("to", "host", "path", "id", F.xxhash64(F.coalesce("html", F.lit(""))))
    texts = dealt.mapInArrow(_extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
