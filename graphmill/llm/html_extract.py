"""Main text of web pages: page structure, and a suffix array per host.

A page is cut into blocks in page order. Blocks in elements that are never
article text (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, by element, role, class or id) are frame. If the page declares its
article (article, main, role main, articleBody), the blocks in it are its text
and all others are frame. A declared article lifts what only a class or id around
it says, and its own header is its title; what is frame inside it stays frame.

The host decides the rest, by suffix arrays over all its pages. The blocks outside
articles are concatenated as streams of tokens, and the array finds substrings of RUN or
more tokens that occur in distinct streams. On pages that declare no article the tokens
that such substrings cover are removed, and the runs that are unique to the page
remain. The blocks of declared articles have arrays of their own, which find the substrings
of RUN or more tokens that stand in the articles of nearly all of the host's pages (SHARE
of at least LEAST distinct articles): a block that these cover from end to end goes, all
others stay whole. Only articles count for that, never menus or adverts that say
the same. Passages that some articles share are content.

A host may hold any share of the pages: its distinct streams are dealt into shards of
about SHARD tokens, each with a suffix array of its own, whose classes of equal
substrings (one row per distinct substring of RUN tokens, not per place) are
merged across shards by a map-side combined aggregation. A substring of RUN tokens
or more is repeated across pages exactly if the RUN-token substrings in it are, so
the merge loses none. What SHARE of a host's articles have, SHARE of the articles of at
least one shard have: of articles' classes only these move, and are counted over all
of the host's articles. A page is parsed once, into a table of its blocks; articles are kept
and moved deflated, at most one of equal ones from each task. Parsing is linear in the
page, however deep its elements.

Defined results: null or empty html has the empty text; a null url is a host of
its own; rows of equal content are one page to the host, and each gets its text; a null page_id comes back null; a tag that the page ends in is dropped
with what follows; an empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.shared import small_batches, text_of, written

#: Tokens of the shortest substring that counts as long; a power of two.
RUN = 8
#: Tokens of a host in one shard, about.
SHARD = 32_768
#: A substring goes from a host's articles if this share of them has it, where there are so many distinct ones.
SHARE, LEAST = 0.9, 10
#: Articles a task remembers to pass on only one of equal ones.
SEEN = 100_000
MAIN, OPEN, FRAME, MUTE = "main", "open", "frame", "mute"

# Quotes count after = only; possessive, so that no position is tried twice.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements and names by their part in a page.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "xmp"}
MUTE_TAGS = {"head", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button"}
FRAME_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
MAIN_TAGS = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
FRAME_NAMES = {"ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "widget"}
#: Of these, what makes an article element frame all the same, and what an article may call parts of its own.
NO_ARTICLE = {"advert", "advertisement", "comment", "comments", "disqus", "promoted", "recommended", "related", "respond", "sponsored", "teaser"}
OWN_PARTS = {"header", "banner", "masthead"}
#: What inside an article may stand beside such a name in a class or id without changing what it says.
NEUTRAL = {"area", "articles", "bar", "block", "box", "bottom", "button", "buttons", "container", "content", "form", "icons", "inner", "left", "link", "links", "list", "outer", "panel", "posts", "right", "section", "slot", "top", "wrap", "wrapper", "unit"}


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


@cache
def name_parts(names: str) -> frozenset[str]:
    return frozenset(part.lower() for part in NAME_PART.findall(names))


@cache
def frame_names(names: str, inside: bool) -> frozenset[str]:
    """The frame's names in a class or id. Inside an article a name only counts if the
    whole token says no more: 'related-posts' does, 'related-work' doesn't."""
    if not inside:
        return name_parts(names) & FRAME_NAMES
    found = (name_parts(token) for token in names.split())
    return frozenset().union(*[parts & FRAME_NAMES for parts in found if parts <= FRAME_NAMES | NEUTRAL])


WEAK = "weak"  # frame by class or id only


def part_of(tag: str, source: str, inside: bool) -> str | None:
    """What an element makes of the blocks in it, if it says so; inside: whether it
    stands in a declared article."""
    if tag in MUTE_TAGS:
        return MUTE
    if tag in FRAME_TAGS and not (inside and tag == "header"):
        return FRAME
    main = tag in MAIN_TAGS
    if "=" in source or "hidden" in source:
        found = attributes(source)
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return FRAME
        if found.get("role") in FRAME_ROLES:
            return FRAME
        main = main or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        if tag not in ("html", "body", "main"):
            names = frame_names(f"{found.get('class', '')} {found.get('id', '')}", inside)
            if names & NO_ARTICLE if main else names - OWN_PARTS if inside else names:
                return FRAME if main else WEAK
    return MAIN if main else None


class Page:
    """The blocks of a page as its tags are read."""

    def __init__(self):
        self.out: list[tuple[str, str]] = []
        self.text: list[str] = []
        #: name, part and, of a main part, the weak frames around it, which it lifts.
        self.stack: list[tuple[str, str | None, int]] = []
        #: Where in the stack elements of a name stand.
        self.places: dict[str, list[int]] = {}
        self.count = dict.fromkeys((MAIN, FRAME, WEAK, MUTE), 0)
        self.lifted = 0

    def add(self, text: str) -> None:
        if not self.count[MUTE]:
            self.text.append(text)

    def flush(self) -> None:
        if self.text:
            joined = "".join(self.text)
            joined = " ".join((unescape(joined) if "&" in joined else joined).split())
            if joined:
                frame = self.count[FRAME] or self.count[WEAK] > self.lifted
                self.out.append((FRAME if frame else MAIN if self.count[MAIN] else OPEN, joined))
            self.text.clear()

    def enter(self, name: str, part: str | None) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, part, self.lifted))
        if part:
            self.count[part] += 1
        if part == MAIN:
            self.lifted = self.count[WEAK]

    def leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, part, lifted = self.stack.pop()
            self.places[name].pop()
            if part:
                self.count[part] -= 1
            if part == MAIN:
                self.lifted = lifted

    def opened(self, name: str, source: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
            if self.stack and self.stack[-1][0] in ("p", "head"):  # a block ends an open paragraph, and the head
                self.leave(len(self.stack) - 1)
        if name in VOID:
            return
        part = part_of(name, source, self.count[MAIN] > 0)
        if part in (FRAME, WEAK) and not block:  # within a line: its words go, the block stays one
            part = MUTE
        if block or part:
            self.enter(name, part)

    def closed(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if places := self.places.get(name):
            depth = places[-1]
            if any(x[0] in BLOCKS for x in self.stack[depth:]):
                self.flush()
            self.leave(depth)


def blocks_of(html: str) -> list[tuple[str, str]]:
    """(part, text) of the blocks of a page, in order."""
    page, at, unclosed = Page(), 0, set()
    while (start := html.find("<", at)) >= 0:
        if start > at:
            page.add(html[at:start])
        after = html[start + 1 : start + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:].isalpha():
            mark = "-->" if html.startswith("!--", start + 1) else ">"
            end = html.find(mark, start + 1 + (mark == "-->") * 3)
            at = len(html) if end < 0 else end + len(mark)
            continue
        if not after.lstrip("/")[:1].isascii() or not after.lstrip("/")[:1].isalpha():
            page.add("<")
            at = start + 1
            continue
        tag = TAG.match(html, start)
        if not tag:  # the page ends in a tag
            at = len(html)
            break
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            page.closed(name)
        elif name in RAW:
            end = None if name in unclosed else raw_end(name).search(html, at)
            if end is None:
                unclosed.add(name)
            at = end.end() if end else len(html) if name in ("script", "style") else at
        elif name == "br":
            page.add(" ")
        else:
            page.opened(name, tag[3])
    page.add(html[at:])
    page.flush()
    return page.out


@cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE)


def declared(blocks: list[tuple[str, str]]) -> bool:
    return any(part == MAIN for part, _ in blocks)


def covered_tokens(n: int, repeated: list[int] | None) -> np.ndarray:
    """Which of a stream's n tokens lie in substrings of RUN tokens that begin at repeated."""
    change = np.zeros(n + RUN + 1, np.int64)
    np.add.at(change, np.array(repeated or [], np.int64), 1)
    np.add.at(change, np.array(repeated or [], np.int64) + RUN, -1)
    return np.cumsum(change)[:n] > 0


def main_text(blocks: list[tuple[str, str]]) -> str:
    """The article of a page by itself; without a declared one, what isn't frame."""
    part = MAIN if declared(blocks) else OPEN
    return "\n".join(text for own, text in blocks if own == part)


def unique_text(blocks: list[list[str]], loose: list[bool], repeated: list[int] | None) -> str:
    """The unique runs of a page without an article. blocks: all blocks' words; loose:
    which aren't frame; repeated: places in the page's stream where a repeated substring begins."""
    covered, out, at = covered_tokens(sum(map(len, blocks)), repeated), [], 0
    for words, own in zip(blocks, loose, strict=True):
        if own:
            kept = " ".join(w for w, gone in zip(words, covered[at : at + len(words)], strict=True) if not gone)
            if kept:
                out.append(kept)
        at += len(words)
    return "\n".join(out)


def suffix_classes(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the streams one after another, sorted by RUN tokens:
    places in suffix order, the class of equal substrings of RUN tokens each is
    in (-1: it reaches past its stream), and each place's stream."""
    names: dict[str, int] = {}
    stream = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    ids, end = [], -1
    for s in streams:
        ids += [names.setdefault(w, len(names)) for w in s]
        ids.append(end)  # a mark of its own after each stream
        end -= 1
    rank = np.unique(np.array(ids, np.int64), return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < RUN:
        after = np.concatenate((rank[depth:], np.full(min(depth, len(rank)), -1)))
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    left = np.concatenate([np.arange(len(s), -1, -1) for s in streams])
    order = np.argsort(rank, kind="stable")
    return order, np.where(left[order] >= RUN, rank[order], -1), stream


def shard_classes(pdf):
    """For applyInPandas: one row per distinct substring of RUN tokens in a
    shard: its hash, its smallest and largest page."""
    import pandas as pd

    streams = [list(x) for x in pdf["tokens"]]
    order, classes, stream = suffix_classes(streams)
    order, classes = order[classes >= 0], classes[classes >= 0]
    if not len(order):
        return pd.DataFrame({"host": [], "gram": [], "low": [], "high": []}).astype({"host": "object", "gram": "int64", "low": "int64", "high": "int64"})
    cuts = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    page = pdf["page_key"].to_numpy()[stream[order]]
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in streams])))
    firsts = order[cuts]
    grams = [words_hash(streams[i][p - starts[i] : p - starts[i] + RUN]) for i, p in zip(stream[firsts], firsts, strict=True)]
    return pd.DataFrame({"host": pdf["host"].iloc[0], "gram": np.array(grams, np.int64), "low": np.minimum.reduceat(page, cuts), "high": np.maximum.reduceat(page, cuts)})


def deflated(text: str) -> bytes:
    return zlib.compress(text.encode(), 6)


def inflated(data: bytes) -> str:
    return zlib.decompress(data).decode()


def article_classes(pdf):
    """For applyInPandas: of the distinct articles of a shard one row with their number
    (whole), and one per substring of RUN tokens that SHARE of them have in their
    blocks: its hash, and how many have it."""
    import pandas as pd

    streams, owner = [], []
    for i, data in enumerate(pdf["article"]):
        for words in (block.split(" ") for block in inflated(data).split("\n")):
            if len(words) >= RUN:
                streams.append(words)
                owner.append(i)
    grams, counts = [], []
    if streams:
        order, classes, stream = suffix_classes(streams)
        order, classes = order[classes >= 0], classes[classes >= 0]
        page = np.array(owner)[stream[order]]  # ascends within a class
        new = np.concatenate(([True], classes[1:] != classes[:-1]))
        cuts = np.flatnonzero(new)
        held = np.add.reduceat((new | np.concatenate(([True], page[1:] != page[:-1]))).astype(np.int64), cuts)
        starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in streams])))
        most = held >= SHARE * len(pdf)
        counts = held[most].tolist()
        for p in order[cuts[most]]:
            i = stream[p]
            grams.append(words_hash(streams[i][p - starts[i] : p - starts[i] + RUN]))
    return pd.DataFrame({"host": pdf["host"].iloc[0], "gram": np.array([0, *grams], np.int64), "n": np.array([len(pdf), *counts], np.int64), "whole": [True] + [False] * len(grams)})


def words_hash(words: list[str]) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest("\x00".join(words).encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARSED = "article binary, body long, size int, first boolean, blocks array<array<string>>, loose array<boolean>"
KINDS = [("article", pa.binary()), ("body", pa.int64()), ("size", pa.int32()), ("first", pa.bool_()), ("blocks", pa.list_(pa.list_(pa.string()))), ("loose", pa.list_(pa.bool_()))]


def parsed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of each page: its article's blocks (null: it declares none), deflated, their hash and
    number of words, whether the task meets it first on this host; the words of the other
    blocks, and which of these aren't frame."""
    seen: set[tuple[str, int]] = set()
    for pages, hosts in batches:
        rows = []
        for blocks, host in zip(map(blocks_of, pages.to_pylist()), hosts.to_pylist(), strict=True):
            other = [(part, text.split(" ")) for part, text in blocks if part != MAIN]
            row = {"article": None, "body": None, "size": 0, "first": False, "blocks": [w for _, w in other], "loose": [part == OPEN for part, _ in other]}
            if declared(blocks):
                text = main_text(blocks)
                body = words_hash([text])
                row |= {"article": deflated(text), "body": body, "size": len(text.split()), "first": (host, body) not in seen}
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((host, body))
            rows.append(row)
        yield pa.array(rows, pa.struct(KINDS))


def article_texts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Articles without the blocks that substrings of RUN tokens with the given hashes (null: none) cover."""
    for articles, gone in batches:
        out = []
        for data, hashes in zip(articles.to_pylist(), gone.to_pylist(), strict=True):
            text = inflated(data)
            if hashes:
                hashes = set(hashes)
                text = "\n".join(block for block in text.split("\n") if not covered(block.split(" "), hashes))
            out.append(text)
        yield pa.array(out, pa.string())


def covered(words: list[str], hashes: set[int]) -> bool:
    places = [i for i in range(len(words) - RUN + 1) if words_hash(words[i : i + RUN]) in hashes]
    return bool(places) and bool(covered_tokens(len(words), places).all())


def article_grams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The hashes of the substrings of RUN tokens in an article's blocks, each once."""
    for articles in batches:
        rows = []
        for data in articles.to_pylist():
            blocks = [block.split(" ") for block in inflated(data).split("\n")]
            rows.append(list({words_hash(w[i : i + RUN]) for w in blocks for i in range(len(w) - RUN + 1)}))
        yield pa.array(rows, pa.list_(pa.int64()))


def unique_texts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for blocks, loose, places in batches:
        yield pa.array([unique_text(*page) for page in zip(blocks.to_pylist(), loose.to_pylist(), places.to_pylist(), strict=True)], pa.string())


def places_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The hash of the substring of RUN tokens at each place of a stream."""
    for streams in batches:
        yield pa.array([[words_hash(s[i : i + RUN]) for i in range(len(s) - RUN + 1)] for s in streams.to_pylist()], pa.list_(pa.int64()))


def repeated_places(streams: DataFrame, shard: int) -> DataFrame:
    """(page_key, places) of the streams (host, page_key, blocks) that have any: where
    substrings of RUN tokens begin that other streams of their host have too."""
    streams = written(streams.dropDuplicates(["page_key"]), "html-streams")
    words = F.flatten("blocks").alias("tokens")
    # Hosts over one shard: no more of them than the table holds shards.
    large = streams.groupBy("host").agg(F.sum(F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(b))).alias("n")).where(F.col("n") > shard)
    large = written(large.select("host", F.ceil(F.col("n") / shard).cast("int").alias("shards")), "html-hosts")
    dealt = streams.select("host", "page_key", words).join(F.broadcast(large), "host", "left")
    dealt = dealt.withColumn("shard", F.pmod("page_key", F.coalesce("shards", F.lit(1)))).drop("shards")
    classes = dealt.groupBy("host", "shard").applyInPandas(shard_classes, "host string, gram long, low long, high long")
    merged = classes.groupBy("host", "gram").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    repeated = written(merged.where("low <> high").select("host", "gram"), "html-repeated")
    places = streams.select("page_key", "host", words).select("page_key", "host", F.posexplode(F.arrow_udf(places_of, "array<long>")("tokens")).alias("place", "gram"))
    found = places.join(repeated, ["host", "gram"], "left_semi")
    return found.groupBy("page_key").agg(F.collect_list("place").alias("places"))


def shared_grams(articles: DataFrame, shard: int) -> DataFrame:
    """(host, gram): hashes of the substrings of RUN tokens that nearly all articles of a
    host have. articles: host, body, size, article. Equal articles count once."""
    # No shard of fewer than LEAST articles on average: of few, all would have nearly everything.
    large = articles.groupBy("host").agg(F.sum("size").alias("n"), F.count("*").alias("of")).where((F.col("n") > shard) & (F.col("of") > LEAST))
    large = written(large.select("host", F.least(F.ceil(F.col("n") / shard), F.ceil(F.col("of") / LEAST)).cast("int").alias("shards")), "html-article-hosts")
    dealt = articles.join(F.broadcast(large), "host", "left").select("host", F.pmod("body", F.coalesce("shards", F.lit(1))).alias("shard"), "body", "article")
    # One shuffle for both: equal articles are in one shard.
    distinct = dealt.repartition("host", "shard").groupBy("host", "shard", "body").agg(F.first("article").alias("article"))
    classes = written(distinct.groupBy("host", "shard").applyInPandas(article_classes, "host string, gram long, n long, whole boolean"), "html-article-classes")
    sizes = classes.where("whole").groupBy("host").agg(F.sum("n").alias("of")).where(F.col("of") >= LEAST)
    candidates = written(classes.where("NOT whole").select("host", "gram").distinct().join(sizes, "host"), "html-article-candidates")
    if candidates.isEmpty():
        return candidates.select("host", "gram")
    held = articles.select("host", "body", F.explode(F.arrow_udf(article_grams, "array<long>")("article")).alias("gram"))
    counts = held.join(candidates, ["host", "gram"]).select("host", "gram", "of", "body").distinct().groupBy("host", "gram", "of").count()
    return written(counts.where(F.col("count") >= F.col("of") * SHARE).select("host", "gram"), "html-shared")


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard: int = SHARD) -> DataFrame:
    """page_id, url, text of every row of pages."""
    small_batches(pages.sparkSession)
    host = host_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.arrow_udf(parsed, PARSED)(text_of(html_col), host).alias("p"))
    rows = rows.select("page_id", "url", "host", "p.*").withColumn("page_key", F.xxhash64("host", "blocks"))
    rows = written(rows, "html-parsed")
    articles, loose = rows.where("article IS NOT NULL"), rows.where("article IS NULL")

    # A row per host: no more substrings than SHARE of its articles have, so about an article's.
    shared = shared_grams(articles.where("first").select("host", "body", "size", "article"), shard)
    if shared.isEmpty():
        joined = articles.withColumn("gone", F.lit(None).cast("array<long>"))
    else:
        joined = articles.join(shared.groupBy("host").agg(F.collect_set("gram").alias("gone")), "host", "left")
    whole = joined.select("page_id", "url", F.arrow_udf(article_texts, "string")("article", "gone").alias("text"))

    places = written(repeated_places(rows.select("page_key", "host", "blocks"), shard), "html-places")
    cut = loose.join(places, "page_key", "left").select("page_id", "url", F.arrow_udf(unique_texts, "string")("blocks", "loose", "places").alias("text"))
    return whole.unionByName(cut)
