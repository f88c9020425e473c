"""Main text of pages: containers are scored per page, voted on per host, and read by the winners.

A page is parsed into elements. A block of text counts for the container it stands in, and half for
the one around that; text in links counts against it, and text in what is never an article (menus,
forms, scripts ...) does not count. Class names are only a hint: an element named like a notice, a
sidebar or an advert goes unless its text speaks for it (``_dropped``), names that tell a state
(``has-sidebar``, ``comment-open``) say nothing, and only reader comments go by name alone. Each page gives
its containers' generalised paths (tags and classes, digits as ``#``) shares of one vote. Votes are
summed per host; a page is then read from the best-voted path of its host that it has, or from its own
best container if it has none of them. A winner stands for the article around it; without one, the
headings and paragraphs that stand directly around it, below a heading, belong to it.

Inside the winning containers, what is never an article is left out. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed, empty ones dropped, and
the rest joined by line feeds in page order. A line break element is white space; scripts, styles,
buttons, pictures and the like inside a paragraph do not end it. Nothing else is dropped or cut. NULL,
empty and textless pages have an empty text. Pages without a host vote for the empty host. Repeated
rows vote and are answered one by one. Markup that is cut off or nested wrongly is read as far as it
goes. Time and memory of a page grow with its length, however deep it is nested: paths of more than
``_LONGEST_PATH`` characters go on from a digest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import column, kept_columns
from .url_filter import host_of

#: Paths of a host that are handed to its pages, best first. Others are looked up by the pages that need them.
PATHS_PER_HOST = 16

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr br".split()
)
_NEVER = frozenset("head title nav footer aside form dialog menu".split())
#: Never text, and no end of the block they stand in.
_SILENT = frozenset("script style noscript template button select textarea option iframe object svg canvas audio video".split())
_UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot promo promotion sponsor sponsored "
    "banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related "
    "recommended recommendations share sharing social footer masthead comment comments reply replies "
    "respond disqus discussion toolbar pagination pager search form hidden skip".split()
)
_TALK = frozenset("comment comments reply replies respond disqus discussion".split())
#: Words that only say where or how an element is laid out.
_LAYOUT = frozenset(
    "site page top bottom left right main inner outer list box bar block area section wrapper wrap container "
    "content item items link links button buttons slot unit panel text body title head header post posts user "
    "column col row widget widgets group media icon icons js the".split()
)
#: Words that tell of a state: what stands beside them is not what the element is.
_STATES = frozenset(
    "has have with without no not is can supports enable enabled disable disabled open opened closed on off "
    "allowed available count".split()
)
_LONGEST_PATH = 400
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"),
}
_LISTS = frozenset("ul ol dl table".split())
_BREAKS = frozenset("div td li article section blockquote".split())
#: Elements whose text belongs to the container around them.
_PARTS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt ul ol dl table thead tbody tfoot tr caption figure figcaption hgroup".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "path", "never", "article", "hint", "zone", "chars", "linked", "score")

    def __init__(self, tag: str, parent: Node | None, path: str, never: bool = False, article: bool = False, hint: int = 0):
        self.tag, self.parent, self.path, self.never = tag, parent, path, never
        #: The innermost article around, itself included; and the innermost element named like no article.
        self.article: Node | None = self if article else parent and parent.article
        self.zone: Node | None = self if hint else parent and parent.zone
        self.hint, self.chars, self.linked, self.score = hint, 0, 0, 0.0


def _hint(names: list[str]) -> int:
    """What classes and id say: 0 nothing, 1 maybe no article, 2 named like none, 3 reader comments."""
    found = 0
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        if _UNWANTED.isdisjoint(words) or not _STATES.isdisjoint(words):
            continue
        if any(w not in _UNWANTED and w not in _LAYOUT for w in words):
            found = max(found, 1)
        else:
            found = max(found, 2 if _TALK.isdisjoint(words) else 3)
    return found


@lru_cache(1 << 14)
def _named(tag: str, classes: str, name: str) -> tuple[str, int]:
    """An element's step in a path, and what its names say."""
    each = sorted(classes.split())
    return re.sub(r"\d+", "#", ".".join([tag, *each])), _hint([*each, name])


def _dropped(zone: Node, total: int) -> bool:
    """Whether an element named like no article is none, by its text and that of its page."""
    if zone.hint == 3:
        return True
    if 2 * zone.linked > zone.chars:
        return True
    if zone.hint == 2:  # all the page has, nearly: a shell around it
        return 10 * zone.chars < 9 * total
    return zone.chars < 200 and 2 * zone.chars < total


class _Page(HTMLParser):
    """Elements in page order and blocks ``(container, text, characters in links)``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", None, "")
        self.stack = [self.root]
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[Node, str, int]] = []
        self.zones: list[Node] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        #: Size of the stack when an element without text was opened; 0 outside of them.
        self.silent = 0

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                holder = next(n for n in reversed(self.stack) if n.tag not in _INLINE)
                self.blocks.append((holder, text, self.linked))
            self.parts, self.linked = [], 0

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop().tag] -= 1
        if len(self.stack) <= self.silent:
            self.silent = 0

    def _close_to(self, tags: tuple[str, ...], within: frozenset[str]) -> None:
        if not any(self.open[tag] for tag in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._cut(i)
                return
            if self.stack[i].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            if self.silent:
                return
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self._flush()
            return
        above = self.stack[-1]
        if self.silent or tag in _SILENT:
            self.silent = self.silent or len(self.stack)
            self._push(Node(tag, above, above.path, True))
            return
        if tag in _INLINE:
            if tag == "a":
                self.links += 1
        else:
            self._flush()
            if tag in ("html", "body"):
                return
            if tag in _CLOSES:
                self._close_to(_CLOSES[tag], _LISTS)
            else:
                self._close_to(("p",), _BREAKS)
            above = self.stack[-1]
        never = above.never or tag in _NEVER or (tag == "header" and above.article is None)
        step, hint, article = tag, 0, tag in ("article", "main")
        if attrs:
            values = dict(attrs)
            role = (values.get("role") or "").lower()
            never = never or role in _ROLES or "hidden" in values
            article = article or role in ("article", "main")
            step, hint = _named(tag, values.get("class") or "", values.get("id") or "")
        path = f"{above.path}/{step}"
        if len(path) > _LONGEST_PATH:
            path = "#" + blake2b(path.encode("utf-8", "replace"), digest_size=12).hexdigest()
        if never or (article and above.article is None):  # an article in no other one is not judged by its names
            hint = 0
        node = Node(tag, above, path, never, article, hint)
        if node.hint:
            self.zones.append(node)
        self._push(node)

    def _push(self, node: Node) -> None:
        self.stack.append(node)
        self.open[node.tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _SILENT or self.silent:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            if not self.silent and tag not in _INLINE and tag not in _SILENT and tag not in _VOID:
                self._flush()
            return
        at = len(self.stack) - 1
        if tag in _INLINE:
            while self.stack[at].tag in _INLINE and self.stack[at].tag != tag:
                at -= 1
            if tag == "a" and self.links and not self.silent:
                self.links -= 1
            if self.stack[at].tag == tag:
                self._cut(at)
            return
        while self.stack[at].tag != tag:
            at -= 1
        if tag not in _SILENT and not (self.silent and at >= self.silent):
            self._flush()
        self._cut(at)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def _judge(page: _Page) -> None:
    """Decides which of the elements named like no article are none, and marks their blocks' holders."""
    total = 0
    for holder, text, linked in page.blocks:
        if not holder.never:
            total += len(text)
            if holder.zone is not None:
                holder.zone.chars += len(text)
                holder.zone.linked += linked
    for zone in reversed(page.zones):  # inner ones were opened later
        around = zone.parent.zone
        if around is not None:
            around.chars += zone.chars
            around.linked += zone.linked
    for zone in page.zones:
        around = zone.parent.zone
        zone.never = (around is not None and around.never) or _dropped(zone, total)
    for holder, _, _ in page.blocks:
        holder.never = holder.never or (holder.zone is not None and holder.zone.never)


def _container(holder: Node) -> Node:
    while holder.tag in _PARTS and holder.parent is not None:
        holder = holder.parent
    return holder


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.finish()
    _judge(page)
    for holder, text, linked in page.blocks:
        if holder.never:
            continue
        weight = max(0, len(text) - 2 * linked)
        container = _container(holder)
        container.score += weight
        if container.parent is not None:
            container.parent.score += weight / 2
    return page


def _scores(page: _Page) -> dict[str, float]:
    """Score by path; nodes are reached through the blocks that gave them one."""
    seen: dict[int, Node] = {}
    for holder, _, _ in page.blocks:
        node: Node | None = holder
        while node is not None and id(node) not in seen:
            seen[id(node)] = node
            node = node.parent
    found: dict[str, float] = {}
    for node in seen.values():
        if node.score > 0 and not node.never and not (node.zone is not None and node.zone.never):
            found[node.path] = found.get(node.path, 0) + node.score
    return found


def _up(holder: Node, known: dict[int, Node | None], wanted: Callable[[Node], bool]) -> Node | None:
    """The innermost wanted element around ``holder``, itself included. Each element is asked once."""
    node: Node | None = holder
    passed = []
    while node is not None and id(node) not in known and not wanted(node):
        passed.append(node)
        node = node.parent
    found = known.get(id(node), node) if node is not None else None
    for one in [*passed, node]:
        if one is not None:
            known[id(one)] = found
    return found


def _around(page: _Page, winners: dict[int, Node]) -> set[int]:
    """Elements whose own blocks belong to winners inside them: below a heading of their own."""
    headed: set[int] = set()
    found: set[int] = set()
    inner = {id(w.parent): w.parent for w in winners.values() if w.parent is not None and w.parent.parent is not None}
    for holder, _, _ in page.blocks:
        if holder.never:
            continue
        container = _container(holder)
        if id(container) in inner and holder.tag in ("h1", "h2", "h3", "hgroup"):
            headed.add(id(container))
        elif id(container) in winners and container.parent is not None and id(container.parent) in headed:
            found.add(id(container.parent))
    return found


def main_text(html: str | None, paths: list[str], more: bool | None = False) -> str | None:
    """Text of the containers at the first of ``paths`` that has text here, else of the page's best.

    None if the page has none of ``paths`` and there are ``more``.
    """
    page = parse(html)
    own = _scores(page)
    ranked = [path for path in paths if path in own]
    if more and own and not ranked:
        return None
    ranked += sorted(own, key=lambda p: (-own[p], p))[:1]
    blocks = [(holder, text) for holder, text, _ in page.blocks if not holder.never]
    for path in ranked:
        whole: dict[int, Node] = {}  # the winners, or the articles they stand for
        known: dict[int, Node | None] = {}
        tops: dict[int, Node | None] = {}
        for holder, _ in blocks:
            node = _up(holder, known, lambda n: n.path == path)
            if node is not None and node.article is not None:
                node = node.article
            if node is not None:
                whole[id(node)] = node
        beside = _around(page, whole)
        texts = [
            text for holder, text in blocks
            if _up(holder, tops, lambda n: id(n) in whole) is not None or id(_container(holder)) in beside
        ]
        if texts:
            return "\n".join(texts)
    return ""


def path_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, votes``, as whole numbers."""
    source = pages.select(host_of(column(url)).alias("host"), column(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                scores = _scores(parse(one.as_py()))
                total = sum(scores.values())
                for path, score in scores.items():
                    key = (host, path)
                    votes[key] = votes.get(key, 0) + score / total
            rows = [(h, p, round(v * (1 << 20))) for (h, p), v in votes.items()]  # whole numbers: sums in any order
            columns = list(zip(*rows)) if rows else [[]] * 3
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "votes"])

    votes = source.mapInArrow(run, "host string, path string, votes long")
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def host_paths(votes: DataFrame, most: int) -> DataFrame:
    """``host, paths, more``: the ``most`` best-voted paths of each host, best first, ties by the path itself.

    ``more`` says whether the host has others.
    """
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    best = votes.withColumn("place", place).where(F.col("place") <= most + 1)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"])
    return best.groupBy("host").agg(F.slice(paths, 1, most).alias("paths"), (F.count("*") > most).alias("more"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", most: int = PATHS_PER_HOST) -> DataFrame:
    """``pages`` without the markup, with ``text`` and ``n_chars``, its number of characters."""
    votes = stored(path_votes(pages, url, html), "votes")
    winners = stored(host_paths(votes, most), "paths")
    kept = kept_columns(pages, ["text", "n_chars", html])
    source = pages.select(*map(column, kept), column(html).alias("_html"), host_of(column(url)).alias("_host"))
    names = winners.select(F.col("host").alias("_host"), F.col("paths").alias("_paths"), F.col("more").alias("_more"))
    source = source.join(names, "_host", "left").select(*map(column, kept), "_html", "_paths", "_more", "_host")
    n = len(kept)
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts, which = [], []
                given = zip(part.column(n), part.column(n + 1).to_pylist(), part.column(n + 2).to_pylist())
                for i, (h, p, more) in enumerate(given):
                    text = main_text(h.as_py(), p or [], more)
                    if text is not None:
                        texts.append(text)
                        which.append(i)
                columns = [c.take(pa.array(which, pa.int64())) for c in part.columns[:n]]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + new, names=[*kept, "text", "n_chars"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, which = [], []
                for i, (h, p) in enumerate(zip(part.column(n), part.column(n + 1).to_pylist())):
                    own = _scores(parse(h.as_py()))
                    if own and own.keys().isdisjoint(p or []):
                        found.append(sorted(own))
                        which.append(i)
                take = pa.array(which, pa.int64())
                columns = [part.column(i).take(take) for i in (*range(n + 1), n + 3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.string()))], names=[*kept, "_html", "_host", "_own"])

    schema = T.StructType(source.schema.fields[:n] + fields)
    decided = source.mapInArrow(run, schema)
    # pages without any of the paths handed out: few, and only on hosts that have more paths than these
    rest_schema = T.StructType([*source.schema.fields[: n + 1], source.schema["_host"], T.StructField("_own", T.ArrayType(T.StringType()))])
    rest = stored(source.where("_more").mapInArrow(others, rest_schema), "other-pages")
    rest = stored(rest.withColumn("_row", F.monotonically_increasing_id()), "other-rows")
    own = rest.select("_row", F.col("_host").alias("host"), F.explode("_own").alias("path"))
    best = own.join(votes, ["host", "path"]).groupBy("_row").agg(F.min(F.struct(-F.col("votes"), "path")).getField("path").alias("path"))
    looked = rest.join(best, "_row", "left").select(
        *map(column, kept), "_html", F.array("path").alias("_paths"), F.lit(False).alias("_more"), "_host"
    )
    return decided.unionByName(looked.mapInArrow(run, schema))
