"""Main text of web pages by nearest-URL differencing.

1. A page is cut into all its visible blocks, menus, adverts and footers among them.
2. Pages are ordered by URL path within the host, and each is aligned with its nearest neighbours by a longest common subsequence of blocks.
3. Blocks shared with a neighbour are deleted. A neighbour that shares half of the page's own text or more may be a copy of the same article
   rather than another page of the site: its shared blocks go only if three neighbours have them. A block within an element that marks an
   article (`main`, `article` and their roles, holding half of the text or more), unless mostly links, needs more, as articles quote and
   repeat: the whole host must agree, nine in ten blocks of its element or place (counted from the start or the end) being shared, on half
   of the pages, four pages at least. An element whose name has a word for boilerplate beside others (`related-work`) goes if a neighbour
   shares its text or, on pages that mark no article and for words that name nothing else (`ad`, `footer`), has the same element; the latter also
   go where no neighbour can be asked.
4. A check by markup follows for what differs from page to page: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
   and reader comments that their markup names, and what stands beside a marked article, go wherever differencing left them.

Neighbours stand in a range-partitioned order, read as a stream that holds a few pages, so a host of any size is spread over all tasks; the few
pages at both ends of each partition are met afterwards. Equal pages of a host act as one.

Defined results: null html or a page without text gives empty text; null URLs share an empty host; repeated rows stay and are treated
alike; character references are decoded once; a tag that is not closed ends with the page; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalframe.sources.scratch import written

_name = re.compile(r"[A-Za-z][^\s/>]*+")
_mark = re.compile(r"[\"'>]")
_attribute = re.compile(r"([A-Za-z_:][-\w:.]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_space = re.compile(r"\s+")
_digits = re.compile(r"\d+")
_not_word = re.compile(r"[^a-z0-9]+")
_raw_end = {x: re.compile(rf"</{x}\b[^>]*+>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("nav footer aside form button select menu dialog head svg canvas object audio video map label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that mark what is not the article, wherever they stand.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus respond reply "
    "replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager banner".split()
)
#: The same, unless the name also has a word for the article.
LAYOUT = frozenset("sidebar side menu nav navbar navigation footer foot header masthead topbar toolbar widget widgets search".split())
ARTICLE = frozenset("article content main post entry story text body".split())
#: Words that say nothing of what an element holds.
NEUTRAL = ARTICLE | frozenset(
    "area articles block bottom box button buttons center col column container count feed first form global group heading icon icons id inline inner item "
    "items js last left link links list middle outer page panel posts primary right row secondary section site slot space stories the thread title top unit "
    "wrap wrapper zone bar".split()
)
#: Words that name boilerplate in any company.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo disqus cookie cookies gdpr newsletter breadcrumb breadcrumbs pagination "
    "pager nav navbar navigation footer masthead topbar toolbar sidebar commentlist signup login".split()
)

PLAIN, WEAK, STRONG, CERTAIN = range(4)  # how far an element's markup names boilerplate
#: What decides a block: the check by markup; a neighbour's text; the host; for names a neighbour's text, its element too, or that no neighbour stands by.
GONE, OPEN, PROSE, NAMED, SITED, ALONE = range(6)
LINE = np.dtype([("h", "<i8"), ("path", "<u4"), ("n", "<u4"), ("kind", "u1")])
ENDS = 8  # places counted from either end of an article


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag, in time linear in the page; comments and declarations have no name."""
    at, size, no_more = page.find("<"), len(page), set()
    while at >= 0:
        closing = page.startswith("/", at + 1)
        m = _name.match(page, at + 1 + closing)
        if m:
            place = m.end()
            while True:
                k = _mark.search(page, place)
                if not k:
                    end = size
                    break
                end = k.end()
                if k.group() == ">":
                    break
                close = -1 if k.group() in no_more else page.find(k.group(), end)
                if close < 0:  # no such quote any more: it quotes nothing
                    no_more.add(k.group())
                place = end if close < 0 else close + 1
            yield at, end, closing, m.group().lower(), page[m.end() : end - 1]
        elif page.startswith(("!", "?", "/"), at + 1):
            close = page.find("-->", at + 4) + 2 if page.startswith("!--", at + 1) else page.find(">", at + 1)
            end = close + 1 if close > 1 else size
            yield at, end, False, "", ""
        else:
            end = at + 1  # a sign, not a tag
        at = page.find("<", end)


def blocks_of(page: str) -> list[tuple[str, int, bool, int, int]]:
    """(text, how far its markup names boilerplate, whether in an element that marks an article, link characters, element) of each visible block."""
    found, buffer, other, links = [], [], [], 0
    stack: list[tuple[str, int, bool, int]] = []  # name, boilerplate, article, element; each inherits
    at = anchors = 0
    end = len(page)

    def flush():
        nonlocal links
        _, level, article, path = stack[-1] if stack else ("", PLAIN, False, 0)
        for parts, known in ((buffer, level if level < CERTAIN else PLAIN), (other, CERTAIN)):
            if parts:
                text = _space.sub(" ", html.unescape("".join(parts))).strip()
                if text:
                    found.append((text, known, article, links if parts is buffer else 0, path))
                parts.clear()
        links = 0

    def take(text):
        nonlocal links
        if not text:
            return
        if stack and stack[-1][1] == CERTAIN:
            other.append(text)
        else:
            buffer.append(text)
            if anchors:
                links += len(text)

    for start, stop, closing, name, attributes in tags(page):
        if start < at:  # inside a script or the like
            continue
        take(page[at:start])
        at = stop
        if not name:
            continue
        if closing:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    anchors -= sum(x[0] == "a" for x in stack[i:])
                    del stack[i:]
                    break
            continue
        if name in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
        if name in _raw_end:
            close = _raw_end[name].search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            continue
        _, level, article, path = stack[-1] if stack else ("", PLAIN, False, 0)
        values = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(attributes)} if attributes else {}
        if level < CERTAIN:
            own, article = judged(name, values, article)
            level = max(level, own)
        if name in BLOCK:
            label = f"{name} {values.get('class', '')} {values.get('id', '')}" if values else name
            path = crc32(_digits.sub("", label).encode("utf-8", "replace"), path)
        stack.append((name, level, article, path))
        anchors += name == "a"
    take(page[at:])
    flush()
    return found


def judged(name: str, attributes: dict[str, str], article: bool) -> tuple[int, bool]:
    """How far an element's own markup names boilerplate, and whether it or one around it marks an article."""
    if name in OUT or name == "header":
        return CERTAIN, article
    article = article or name in ("article", "main")
    if not attributes:
        return PLAIN, article
    role = attributes.get("role", "").lower()
    if role in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return CERTAIN, article
    article = article or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    if name in ("body", "html", "main"):
        return PLAIN, article
    names = [[w for w in _not_word.split(x) if w and not w.isdigit()] for k in ("class", "id") for x in attributes.get(k, "").lower().split()]
    for_article = any(w in ARTICLE for x in names for w in x)
    if name == "article" and for_article:
        return PLAIN, article
    words = NEVER if for_article or name == "article" else NEVER | LAYOUT
    level = max((_named(x, words) for x in names), default=PLAIN)
    if name not in BLOCK and level < CERTAIN:  # part of a block: differencing cannot judge it alone
        level = CERTAIN if level == STRONG else PLAIN
    return level, article


def _named(name: list[str], words: frozenset[str]) -> int:
    """How far a name of one or more words is one of boilerplate: for certain if no other word says what it is."""
    hits = [w in words for w in name]
    if not any(hits):
        return PLAIN
    if all(hit or w in NEVER or w in LAYOUT or w in NEUTRAL for hit, w in zip(hits, name, strict=True)):
        return CERTAIN
    return STRONG if any(w in SURE for w in name) else WEAK


def placed(page: str) -> list[tuple[str, int, int]]:
    """(text, what decides it, element) of each visible block."""
    blocks = blocks_of(page)
    size = sum(len(t) for t, level, _, _, _ in blocks if level == PLAIN)
    marked = size and 2 * sum(len(t) for t, level, a, _, _ in blocks if a and level == PLAIN) >= size
    found = []
    for text, level, article, links, path in blocks:
        if level == CERTAIN or marked and not article:
            kind = GONE
        elif level == PLAIN or not size:
            kind = PROSE if marked and 2 * links <= len(text) else OPEN
        else:
            kind = ALONE if level == STRONG else NAMED if marked else SITED
        found.append((text, kind, path))
    return found


def sorted_out(page: str) -> tuple[list[str], list[bool]]:
    """Blocks that the check by markup leaves, and which of them one neighbour can delete."""
    blocks = [(t, kind != PROSE) for t, kind, _ in placed(page) if kind != GONE]
    return [t for t, _ in blocks], [x for _, x in blocks]


def matched(a: list[int], b: list[int], bound: int = 1 << 18) -> list[tuple[int, int]]:
    """Places (in `a`, in `b`) of a longest common subsequence; more than `bound` matches are halved first, so memory stays small."""
    head, tail = 0, 0
    short = min(len(a), len(b))
    while head < short and a[head] == b[head]:
        head += 1
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = Counter(a), Counter(b)
    if len(a) > 1 and sum(x * m[k] for k, x in n.items()) > bound:  # Hirschberg's halves, whose lengths come in bits
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[:half - 1 : -1], b[::-1])[::-1]))
        inner = matched(a[:half], b[:cut], bound) + [(half + i, cut + j) for i, j in matched(a[half:], b[cut:], bound)]
    else:
        inner = _by_matches(a, b)
    return ends[0] + [(head + i, head + j) for i, j in inner] + ends[1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of a longest common subsequence of `a` with each beginning of `b`, a bit for each place of `b`."""
    places: dict[int, list[int]] = {}
    wanted, width = set(a), len(b) // 8 + 1
    for j, x in enumerate(b):
        if x in wanted:
            places.setdefault(x, []).append(j)

    def mask(spots):
        found = bytearray(width)
        for j in spots:
            found[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(found, "little")

    often = {x: mask(spots) for x, spots in places.items() if len(spots) > 64}  # few, so that their masks are small together
    row = full = (1 << len(b)) - 1
    for x in a:
        if x in places and (y := row & (often[x] if x in often else mask(places[x]))):
            row = ((row + y) | (row - y)) & full
    steps = np.unpackbits(np.frombuffer(row.to_bytes(width, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - steps.astype(np.int64))])


def _by_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The same, over all matches in order (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends, tails, nodes = [], [], []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            nodes.append((i, j, tails[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                tails.append(len(nodes) - 1)
            else:
                ends[k], tails[k] = j, len(nodes) - 1
    out, n = [], tails[-1] if tails else -1
    while n >= 0:
        i, j, n = nodes[n]
        out.append((i, j))
    return out[::-1]


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`."""
    return [i for i, _ in matched(a, b)]


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """url, id, the blocks that the check by markup leaves, and a record (LINE) of each visible block, without its text."""

    def rows(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                some = b.iloc[i : i + 256]
                texts, lines, sigs = [], [], []
                for x in some["html"]:
                    blocks = placed(x)
                    kept = [t for t, kind, _ in blocks if kind != GONE]
                    texts.append(kept)
                    lines.append(None)
                    sigs.append(None)
                    if kept:
                        line = np.array([(_hash(t), path, len(t) if kind != GONE else 0, kind) for t, kind, path in blocks], LINE)
                        own = line[line["n"] > 0]
                        lines[-1], sigs[-1] = line.tobytes(), _hash(own["h"].tobytes() + own["kind"].tobytes())
                yield pd.DataFrame({
                    "url": some["url"].array, "id": some["id"].astype("Int64").array, "blocks": texts, "lines": lines, "sig": pd.array(sigs, "Int64"),
                })

    page, number = F.coalesce(F.col(html_col), F.lit("")), F.col(id_col).cast("long")
    given = pages.select(F.col(url_col).alias("url"), number.alias("id"), page.alias("html"))
    return given.mapInPandas(rows, "url string, id long, blocks array<string>, lines binary, sig long")


def _hash(x: str | bytes) -> int:
    x = x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x
    return int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True)


class _Page:
    """A page and what its neighbours met of it."""

    def __init__(self, host, sig, lines, decide):
        self.host, self.sig, self.decide = host, sig, decide
        line = np.frombuffer(lines, LINE)
        self.h, self.path, self.n, self.kind = (line[x].tolist() for x in LINE.names)
        self.size = sum(self.n)
        self.elements = {p for p, k in zip(self.path, self.kind, strict=True) if k != PROSE and k != OPEN}
        self.met: list[tuple[bool, set[int], set[int]]] = []

    def meet(self, other: _Page, copy_share: float) -> None:
        pairs = matched(self.h, other.h)
        for k, (one, two) in enumerate(((self, other), (other, self))):
            hits = {p[k] for p in pairs if one.n[p[k]]}
            one.met.append((sum(one.n[i] for i in hits) >= copy_share * one.size, hits, two.elements))

    def judge(self, agree: int, counts: dict[int, list[int]]) -> tuple[list[int], list[int], list[int]]:
        """Places among the kept blocks that go; places that go if the host agrees, with a key each. Adds to the host's counts."""
        seen = Counter(i for _, hits, _ in self.met for i in hits)
        others = [(hits, elements) for copy, hits, elements in self.met if not copy]
        shared = {i for hits, _ in others for i in hits}
        gone, places, keys, mine = [], [], [], {}
        prose = [i for i, k in enumerate(self.kind) if k == PROSE]
        rank = {i: s for s, i in enumerate(prose)}
        spot = -1
        for i, kind in enumerate(self.kind):
            if kind == GONE:
                continue
            spot += 1
            if kind == PROSE:
                base, s = self.path[i] << 16, rank[i]
                e = len(prose) - 1 - s
                own = [base, *([base + 1 + s] if s < ENDS else []), *([base + 1 + ENDS + e] if e < ENDS else [])]
                if seen[i]:
                    places += [spot] * len(own)
                    keys += own
                if others:
                    for k in own:
                        c = mine.setdefault(k, [0, 0, 0])
                        c[1] += 1
                        c[2] += i in shared
            elif i in shared or seen[i] >= agree or kind == ALONE and not others or kind >= SITED and any(self.path[i] in x for _, x in others):
                gone.append(spot)
        if mine:
            mine[-1] = [0, 1, 1]
        for k, (_, n, hit) in mine.items():
            c = counts.setdefault(k, [0, 0, 0])
            c[0] += hit > 0
            c[1] += n
            c[2] += hit
        return gone, places, keys


MET = pa.schema([
    ("kind", pa.int32()), ("host", pa.string()), ("sig", pa.int64()), ("gone", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())),
    ("key", pa.int64()), ("pages", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("lines", pa.binary()), ("part", pa.int64()), ("at", pa.int64()), ("decide", pa.bool_()),
])
MET_DDL = "kind int, host string, sig long, gone array<int>, places array<int>, keys array<long>, key long, pages long, n long, shared long, lines binary, part long, at long, decide boolean"


def _meetings(rows, reach: int, copy_share: float, agree: int, whole: bool):
    """Rows of MET over pages in order: 0, what goes of a page; 1, counts of a host. Pages near the end wait for more, unless `whole`."""
    window: deque[_Page] = deque()
    counts: dict[int, list[int]] = {}
    host = None

    def told():
        for key, (n_pages, n, shared) in counts.items():
            yield {"kind": 1, "host": host, "key": key, "pages": n_pages, "n": n, "shared": shared}
        counts.clear()

    def decided(page):
        nonlocal host
        if not page.decide:
            return
        if page.host != host or len(counts) > 50_000:  # Spark adds them up
            yield from told()
        host = page.host
        gone, places, keys = page.judge(agree, counts)
        if gone or places:
            yield {"kind": 0, "host": host, "sig": page.sig, "gone": gone, "places": places, "keys": keys}

    for row in rows:
        page = _Page(*row)
        for other in window:
            if other.host == page.host:
                other.meet(page, copy_share)
        window.append(page)
        if len(window) > reach:
            yield from decided(window.popleft())
    while whole and window:
        yield from decided(window.popleft())
    yield from told()


def _batched(rows):
    some = []
    for row in rows:
        some.append(row)
        if len(some) == 1000:
            yield pa.RecordBatch.from_pylist(some, MET)
            some = []
    yield pa.RecordBatch.from_pylist(some, MET)


def _rows(batches, *names):
    for b in batches:
        yield from zip(*(b.column(x).to_pylist() for x in names), strict=True)


def _met(distinct: DataFrame, reach: int, copy_share: float, agree: int) -> DataFrame:
    """Meetings of pages up to `reach` places apart in the order of paths within a host."""

    def inner(batches):
        part, first, last, total = TaskContext.get().partitionId(), [], deque(maxlen=2 * reach), 0

        def numbered():
            nonlocal total
            for host, sig, lines in _rows(batches, "host", "sig", "lines"):
                row = {"kind": 2, "host": host, "sig": sig, "lines": lines, "part": part, "at": total}
                (first if total < 2 * reach else last).append(row)
                total += 1
                yield host, sig, lines, total > reach

        def all_rows():
            yield from _meetings(numbered(), reach, copy_share, agree, False)
            for row in (*first, *last):
                yield row | {"decide": row["at"] < reach or row["at"] >= total - reach}

        yield from _batched(all_rows())

    def between(batches):
        yield from _batched(_meetings(_rows(batches, "host", "sig", "lines", "decide"), reach, copy_share, agree, True))

    ordered = distinct.repartitionByRange("host", "path", "sig").sortWithinPartitions("host", "path", "sig")
    met = written(ordered.select("host", "sig", "lines").mapInArrow(inner, MET_DDL), "page-meetings")
    # Of each partition the first and last pages, so few; in order, so that a page near a border meets all its neighbours.
    edges = met.where("kind = 2").repartition(1).sortWithinPartitions("part", "at")
    return met.where("kind < 2").unionByName(written(edges.mapInArrow(between, MET_DDL), "page-borders"))


def main_text(pages: DataFrame, reach: int = 2, copy_share: float = 0.5, agree: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars for each row of `pages`."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    parsed = written(_parsed(pages, id_col, url_col, html_col), "page-blocks").withColumn("host", host)
    distinct = parsed.where("lines is not null").groupBy("host", "sig").agg(F.min(F.struct(path.alias("path"), "lines")).alias("x"))
    met = _met(distinct.select("host", "sig", "x.path", "x.lines"), reach, copy_share, agree)

    counts = met.where("kind = 1").groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("shared").alias("shared"))
    size = counts.where("key = -1").select("host", F.col("pages").alias("of"))
    # Written, so that its size is known: a few keys a host, which go to all tasks unless there are very many hosts.
    agreed = written(counts.where("key >= 0 and 10 * shared >= 9 * n and pages >= 4").join(size, "host").where("2 * pages >= of").select("host", "key"), "page-agreements")
    found = met.where("kind = 0")
    asked = found.select("host", "sig", F.explode(F.arrays_zip("places", "keys")).alias("x")).select("host", "sig", F.col("x.places").alias("place"), F.col("x.keys").alias("key"))
    by_host = asked.join(agreed, ["host", "key"], "left_semi").groupBy("host", "sig").agg(F.collect_set("place").alias("gone"))
    both = found.where("size(gone) > 0").select("host", "sig", "gone").unionByName(by_host)
    gone = written(both.groupBy("host", "sig").agg(F.flatten(F.collect_list("gone")).alias("gone")), "page-deletions")

    # Few places that go are sent to all tasks, and no text is shuffled; many meet their pages in a shuffle.
    few = gone.agg(F.sum(F.size("gone") + 8)).first()[0] or 0
    gone = F.broadcast(gone) if few < 4_000_000 else gone.hint("merge")
    left = F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), "gone")
    stay = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.transform(left, lambda i: F.get("blocks", i)))
    mended = parsed.select("id", "url", "host", "sig", "blocks").join(gone, ["host", "sig"], "left").select("id", "url", F.array_join(stay, " ").alias("text"))
    return mended.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
