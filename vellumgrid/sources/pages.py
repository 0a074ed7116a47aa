"""Links of fetched pages, and the offline crawl over a table of them."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain, islice
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions.urls import canonical_url, in_scope, publication_base, relevant_link
from vellumgrid.runtime import materialise, written_rows

#: Links taken from one page.
PAGE_LINKS = 256
# Elements whose content is no text of the page, and marks that end a sentence rather than an address.
SKIPPED_ELEMENTS = ("script", "style", "template")
TRAILING_MARKS = ".,;:!?]"


class _Page(HTMLParser):
    """Collects a page's anchors, its visible text and its source without the skipped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.anchors: list[str] = []
        self.visible: list[str] = []
        self.source: list[str] = []
        self._inside: str | None = None
        self._depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._inside:
            self._depth += tag == self._inside
            return
        if tag in SKIPPED_ELEMENTS:
            self._inside, self._depth = tag, 1
            return
        if tag == "a":
            self.anchors += [value for name, value in attrs if name == "href" and value][:1]
        self.visible.append(" ")
        self.source.append(self.get_starttag_text() or "")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SKIPPED_ELEMENTS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._inside:
            self._depth -= tag == self._inside
            if not self._depth:
                self._inside = None
        else:
            self.visible.append(" ")

    def handle_data(self, data: str) -> None:
        if not self._inside:
            self.visible.append(data)
            self.source.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def _bare_addresses(text: str) -> Iterator[str]:
    """Addresses written out in a text: from the scheme to the next blank, quote or angle bracket."""
    for word in text.translate(_WORD_ENDS).split():
        starts = [at for at in (word.find("http://"), word.find("https://")) if at >= 0]
        if starts:
            yield word[min(starts) :]


def _destination(text: str, at: int) -> str:
    """The link destination that begins at or after ``at``, in angle brackets or not."""
    rest = text[at : at + MAX_DESTINATION].lstrip()
    rest = rest.removeprefix("<")
    for i, c in enumerate(rest):
        if c.isspace() or c in ")>":
            return rest[:i]
    return rest


def _markdown_destinations(source: str) -> Iterator[str]:
    """Destinations of inline links, then those of link definitions."""
    at = source.find("](")
    while at >= 0:
        yield _destination(source, at + 2)
        at = source.find("](", at + 2)
    for line in source.splitlines():
        label, colon, rest = line.strip().partition("]:")
        if colon and label.startswith("[") and len(label) > 1 and "]" not in label and rest.strip():
            yield rest.split()[0].strip("<>")


#: Addresses longer than this are no links.
MAX_DESTINATION = 1 << 16
_WORD_ENDS = str.maketrans({c: " " for c in "\"'<>"})


def _absolute(reference: str, base: str) -> str | None:
    """The canonical https address a reference means on a page, or NULL."""
    reference = html.unescape(reference.strip("<>\"'").strip()).rstrip(TRAILING_MARKS)
    if not reference or reference[0] == "#":
        return None
    try:
        parts = urlsplit(urljoin(base, reference))
    except ValueError:
        return None
    if parts.scheme != "https" or not parts.netloc:
        return None
    return urlunsplit(("https", parts.netloc.lower(), parts.path or "/", parts.query, ""))


def page_links(body: str, base: str, limit: int | None = PAGE_LINKS) -> list[str]:
    """The https links of a page, absolute and canonical, each once: anchors, written-out addresses, Markdown links, definitions."""
    page = _Page()
    page.feed(body)
    page.close()
    written = chain(page.anchors, _bare_addresses("".join(page.visible)), _markdown_destinations("".join(page.source)))
    found = dict.fromkeys(x for r in written if (x := _absolute(r, base)))
    return list(islice(found, limit))


def extract_links(pages: DataFrame, url: str = "url", body: str = "body", limit: int | None = PAGE_LINKS) -> DataFrame:
    """``(url, pos, link)`` of every page; NULL bodies have no links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(u, i, x) for u, t in zip(b["url"], b["body"]) for i, x in enumerate(page_links(t, u, limit), 1)], columns=["url", "pos", "link"])

    rows = pages.select(F.col(url).alias("url"), F.col(body).alias("body")).where(F.col("url").isNotNull() & F.col("body").isNotNull())
    return rows.mapInPandas(run, "url string, pos int, link string")


def crawl(seeds: DataFrame, pages: DataFrame, depth: int = 3, fetches: int | None = None) -> DataFrame:
    """``(url, seed, depth)`` of the pages reached from ``seeds(url)`` within their publications.

    ``pages(url, body)`` holds what was fetched; links are extracted once. A link
    is followed if it is relevant and below its seed's base. Breadth first, a
    written table per round. With ``fetches`` the crawl stops after so many pages,
    which the seeds take in turn; :func:`not_fetched` tells what was left.
    """
    links = materialise(extract_links(pages, limit=None).where(relevant_link("link")).select("url", "link"), "links")
    known = pages.select(canonical_url("url").alias("url")).distinct()
    start = seeds.select(canonical_url("url").alias("url")).where(F.col("url").isNotNull()).distinct()
    left = fetches

    def round_of(queue: DataFrame, d: int) -> DataFrame:
        nonlocal left
        if left is not None:
            queue = round_robin(queue, order="url", fetches=left).drop("turn")
        done = materialise(queue.withColumn("depth", F.lit(d)), "frontier", measure=True)
        left = None if left is None else left - written_rows(done)
        return done

    frontier = round_of(start.join(known, "url", "left_semi").select("url", F.col("url").alias("seed")), 0)
    seen = frontier
    for d in range(1, depth + 1):
        if left == 0 or not written_rows(frontier):
            break
        step = frontier.join(links.withColumn("url", canonical_url("url")), "url").where(in_scope("link", publication_base("seed")))
        new = step.select(F.col("link").alias("url"), "seed").distinct().join(known, "url", "left_semi").join(seen, ["url", "seed"], "left_anti")
        frontier = round_of(new, d)
        seen = seen.unionByName(frontier)
    return seen


def not_fetched(reached: DataFrame, pages: DataFrame) -> DataFrame:
    """``(seed, url, reason)``: links of the reached pages that were not: ``outside``, ``unknown`` or ``budget`` (depth or fetches)."""
    links = extract_links(pages, limit=None).where(relevant_link("link")).select(canonical_url("url").alias("url"), "link").distinct()
    asked = reached.join(links, "url").select("seed", F.col("link").alias("url")).distinct().join(reached.select("seed", "url"), ["seed", "url"], "left_anti")
    known = pages.select(canonical_url("url").alias("url"), F.lit(True).alias("_known")).distinct()
    reason = F.when(~in_scope("url", publication_base("seed")), "outside").when(F.col("_known").isNull(), "unknown").otherwise("budget")
    return asked.join(known, "url", "left").select("seed", "url", reason.alias("reason"))


def round_robin(queue: DataFrame, seed: str = "seed", order: str = "pos", fetches: int | None = 64) -> DataFrame:
    """``queue`` with ``turn`` from 1: one candidate of every seed after the other, each seed's in order; ``fetches`` of them.

    Turns are ``(number within the seed, seed)``, so seeds take turns until they run out.
    """
    n = F.row_number().over(Window.partitionBy(seed).orderBy(order))
    ranked = queue.withColumn("_n", n).orderBy("_n", seed)
    chosen = ranked if fetches is None else ranked.limit(fetches)
    return chosen.withColumn("turn", F.row_number().over(Window.orderBy("_n", seed))).drop("_n")


_HASH = re.compile(r"[0-9a-f]{64}\Z")


def decode_manifest(text: str) -> tuple[dict[str, str], list[dict]]:
    """``(digests by path, external references)`` of a graph manifest; ``ValueError`` if it is malformed."""
    data = json.loads(text)
    digests: dict[str, str] = {}
    for group in ("files", "artifacts"):
        for path, f in (data.get(group) or {}).items():
            if path in digests or path.startswith("..") or not _HASH.match(f.get("sha256", "")):
                raise ValueError(f"bad manifest entry: {path}")
            digests[path] = f["sha256"]
    external = data.get("external") or []
    for x in external:
        if not _HASH.match(x.get("sha256", "")) or not str(x.get("url", "")).startswith("https://"):
            raise ValueError("bad external reference")
    if [(x.get("from", ""), x.get("line", 0), x["url"]) for x in external] != sorted((x.get("from", ""), x.get("line", 0), x["url"]) for x in external):
        raise ValueError("external references are not in order")
    return digests, external


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
