"""Operator 5, HTML extraction by consensus paths of a host.

Every block element of a page has a generalised path: its tags from the root down, each with its classes, digits in them replaced. Text
blocks give points to their parent and half to its parent, less for text in links; a page votes for the path of
its best element with a point and the score. Votes are summed for each host in Spark, and the host's paths, most votes first, are tried on each of
its pages: the first whose elements (digits are replaced, so a page may have several of one path) have text gives it, that of all of them in order. A page on which none does, or that has no host, keeps its own best element.

Votes are (host, path, votes, score); a host's PATHS most voted paths are tried first, on a page where none of them has text the host's further paths in their order,
which are joined by the page's own paths, so none is left out. The paths of the MOST_BROADCAST hosts with most votes are broadcast; pages of other hosts,
none of which is large then, are joined by host.

Defined results: null or empty html, or a page without text blocks, gives a null path and an empty text; a null or odd url has the host '';
null page_ids stay; rows that repeat vote and are extracted as often as they occur; ties go to the higher score, then the smaller
path; a slash in a class name counts as a bar; very long pages are read whole and deep ones in time that grows with their length; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, settle

TRACKED = frozenset("html body div article main section nav aside header footer table tbody thead tr td th ul ol li dl dd dt p form blockquote pre figure h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav aside footer form".split())
PATHS = 5  #: paths of a host that go with each of its pages
MOST_BROADCAST = 100_000  #: hosts
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[ \t\r\n\f]+")


def mark(parent: int, part: str) -> int:
    return int.from_bytes(blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8, key=(parent % 2**64).to_bytes(8)).digest(), signed=True)


class Paths:
    """The paths of a page as numbers; each is its parent's and one part more, so nesting costs no more than length."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.parts: list[tuple[int, str]] = [(-1, "")]

    def below(self, parent: int, part: str) -> int:
        k = self.numbers.setdefault((parent, part), len(self.parts))
        if k == len(self.parts):
            self.parts.append((parent, part))
        return k

    def text(self, k: int) -> str:
        out = []
        while k > 0:
            k, part = self.parts[k]
            out.append(part)
        return "/".join(reversed(out))

    def marks(self) -> list[int]:
        """A hash of each path, by its number; equal for equal paths of any page."""
        out = [0]
        for parent, part in self.parts[1:]:
            out.append(mark(out[parent], part))
        return out

    def find(self, text: str) -> int | None:
        k: int | None = 0
        for part in text.split("/"):
            k = self.numbers.get((k, part))
            if k is None:
                return None
        return k


class Element:
    """A block element: path, parent, points, and where its content lies among the page's text runs."""

    __slots__ = ("tag", "path", "parent", "points", "first", "last", "text", "linked")

    def __init__(self, tag: str, path: int, parent: "Element | None", first: int) -> None:
        self.tag, self.path, self.parent, self.first, self.last = tag, path, parent, first, first
        self.points = 0.0
        self.text = self.linked = 0


def parse(page: str | None) -> tuple[list[Element], list[tuple[str, bool]], Paths]:
    """Block elements in order, runs of (text, inside something left out), of which an empty one ends a line, and the paths."""
    elements: list[Element] = []
    paths = Paths()
    runs: list[tuple[str, bool]] = []
    if not page:
        return elements, runs, paths
    open_: list[Element] = []
    links = hidden = at = 0
    in_head = False

    def close(n: int) -> None:
        nonlocal hidden
        while len(open_) > n:
            e = open_.pop()
            e.last = len(runs)
            hidden -= e.tag in LEFT_OUT
            runs.append(("", False))

    def text(s: str) -> None:
        if s and not in_head:
            runs.append((s, hidden > 0))
            if open_:
                n = len(s.strip())
                open_[-1].text += n
                if links:
                    open_[-1].linked += n

    for m in TAG.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "head":
                in_head = False
            elif tag in TRACKED:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k].tag == tag:
                        close(k)
                        break
            continue
        if tag == "a":
            links += 1
        elif tag == "head":
            in_head = True
        elif tag == "br":
            runs.append(("", False))
        elif tag in TRACKED:
            in_head = in_head and tag != "body"
            if open_ and open_[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):  # these hold no block
                close(len(open_) - 1)
            elif open_ and tag in ("li", "tr", "td", "dd") and open_[-1].tag == tag:
                close(len(open_) - 1)
            runs.append(("", False))
            c = CLASS.search(m[4]) if m[4] else None
            names = sorted(set(re.sub(r"\d+", "#", (c[1] or c[2] or c[3] or "").lower().replace("/", "|")).split())) if c else []
            own = ".".join([tag, *names])
            parent = open_[-1] if open_ else None
            e = Element(tag, paths.below(parent.path if parent else 0, own), parent, len(runs))
            elements.append(e)
            open_.append(e)
            hidden += tag in LEFT_OUT
            if m[4].endswith("/"):
                close(len(open_) - 1)
    text(page[at:])
    close(0)
    return elements, runs, paths


def best(elements: list[Element], paths: Paths) -> tuple[Element | None, float]:
    """The element with the most points; of equal ones the smaller path, then the first."""
    for e in elements:
        if e.tag in TEXT_BLOCKS and e.text > 0 and e.parent:
            gained = e.text - 2.0 * e.linked
            e.parent.points += gained
            if e.parent.parent:
                e.parent.parent.points += gained / 2
    found = [e for e in elements if e.points > 0 and e.tag not in LEFT_OUT]
    if not found:
        return None, 0.0
    most = max(e.points for e in found)
    found = [e for e in found if e.points == most]
    return found[0] if len(found) == 1 else min(found, key=lambda e: paths.text(e.path)), round(most, 1)


def content(e: Element, runs: list[tuple[str, bool]]) -> str:
    """The element's text: a line for each block, white space collapsed, entities decoded."""
    lines: list[str] = []
    part: list[str] = []
    for s, hidden in [*runs[e.first : e.last], ("", False)]:
        if s:
            if not hidden:
                part.append(s)
        elif part:
            line = SPACE.sub(" ", entities.unescape("".join(part))).strip()
            if line:
                lines.append(line)
            part = []
    return "\n".join(lines)


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        votes: dict[tuple[str, str], list[float]] = {}
        for host, page in zip(pdf["host"], pdf["html"]):
            elements, _, paths = parse(page)
            e, score = best(elements, paths)
            if e:
                v = votes.setdefault((host, paths.text(e.path)), [0, 0.0])
                v[0] += 1
                v[1] += score
        yield pd.DataFrame([(h, p, reduce(mark, p.split("/"), 0), n, s) for (h, p), (n, s) in votes.items()], columns=["host", "path", "mark", "votes", "score"])


def extracted(page: str | None, wanted: Iterable[str], rest: bool = False) -> tuple[str | None, bool, str, list[int] | None]:
    """(path, is it one of wanted, text, and with rest, where none of wanted has text, the marks of all paths of the page that have some)."""
    elements, runs, paths = parse(page)
    own, _ = best(elements, paths)
    by_path: dict[int, list[Element]] = {}
    for e in elements:
        by_path.setdefault(e.path, []).append(e)
    for p in wanted:
        text = "\n".join(filter(None, (content(e, runs) for e in by_path.get(paths.find(p), ()))))
        if text:
            return p, True, text, None
    if own is None:
        return None, False, "", []
    if not rest:
        return paths.text(own.path), False, content(own, runs), None
    marks, seen = paths.marks(), list(accumulate((bool(not hidden and entities.unescape(s).strip()) for s, hidden in runs), initial=0))
    return paths.text(own.path), False, content(own, runs), [marks[k] for k, es in by_path.items() if any(seen[e.last] > seen[e.first] for e in es)]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [extracted(page, wanted if wanted is not None else ())[:3] for page, wanted in zip(pdf["html"], pdf["paths"])]
        yield pd.concat([pdf[["page_id", "host"]].reset_index(drop=True), pd.DataFrame(out, columns=["path", "by_host", "text"])], axis=1)


def _unsettled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [extracted(page, wanted, True)[3] for page, wanted in zip(pdf["html"], pdf["paths"])]
        yield pdf.assign(own=found)[[bool(x) for x in found]][["page_id", "host", "html", "own"]]


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def voted_paths(pages: DataFrame) -> DataFrame:
    """(host, path, mark, votes, score) over all pages with a host."""
    votes = pages.where("host <> ''").mapInPandas(_vote, "host string, path string, mark long, votes long, score double")
    return votes.groupBy("host", "path", "mark").agg(F.sum("votes").alias("votes"), F.round(F.sum("score"), 1).alias("score"))


def winning_paths(voted: DataFrame) -> DataFrame:
    """(host, paths, further, size): for each host its PATHS paths of most votes, whether there are more, and all its votes."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    top = voted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PATHS)
    top = top.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"]).alias("paths"))
    whole = voted.groupBy("host").agg((F.count("*") > PATHS).alias("further"), F.sum("votes").alias("size"))
    return top.join(whole, "host")


def _with_paths(own: DataFrame, winners: DataFrame) -> DataFrame:
    """own with the paths and further of its hosts: by broadcast for the largest hosts, by a join on the host for others."""
    if winners.count() <= MOST_BROADCAST:
        return own.join(F.broadcast(winners), "host", "left")
    large = settle(winners.orderBy(F.desc("size"), "host").limit(MOST_BROADCAST))  # the rest is not left out but joined below
    first = own.join(F.broadcast(large), "host", "left")
    other = winners.join(F.broadcast(large.select("host")), "host", "left_anti")
    here, rest = first.where("paths IS NOT NULL OR host = ''"), first.where("paths IS NULL AND host <> ''")
    return here.unionByName(rest.select(own.columns).join(other, "host", "left"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, by_host, text) for every row."""
    importable(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), _host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    voted = settle(voted_paths(own))
    winners = settle(winning_paths(voted))
    joined = _with_paths(own, winners)
    schema = "page_id string, host string, path string, by_host boolean, text string"
    out = ["page_id", "host", "html", "paths"]
    found = joined.select(*out).mapInPandas(_extract, schema)
    if not winners.where("further").isEmpty():
        left = joined.where("further").select(*out).mapInPandas(_unsettled, "page_id string, host string, html string, own array<long>")
        left = settle(left.withColumn("row", F.monotonically_increasing_id()))
        if not left.isEmpty():
            order = F.struct(-F.col("votes"), -F.col("score"), F.col("path"))
            chosen = left.select("row", "host", F.explode("own").alias("mark")).join(voted, ["host", "mark"]).groupBy("row").agg(F.min(order)["path"].alias("path"))
            again = left.join(chosen, "row", "left").select("page_id", "host", "html", F.array("path").alias("paths")).mapInPandas(_extract, schema)
            settled = joined.where("further").select(*out).mapInPandas(_resolved, schema)
            found = joined.where("NOT coalesce(further, false)").select(*out).mapInPandas(_extract, schema).unionByName(settled).unionByName(again)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "by_host", "text")


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(i, h, *found[:3]) for i, h, page, wanted in zip(pdf["page_id"], pdf["host"], pdf["html"], pdf["paths"]) if not (found := extracted(page, wanted, True))[3]]
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "by_host", "text"])
