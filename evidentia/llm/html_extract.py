"""HTML extraction: blocks that structure does not tell to be furniture and that no run of words repeated in the host's suffix array covers."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches, map_arrow, stored, worker_cache

#: Tags whose whole content is dropped, and those of them whose content is no markup.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg canvas object button select textarea menu dialog head title audio video math datalist".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: Tags that hold the article, and tags that end a block of text.
ARTICLE = frozenset(("article", "main"))
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that tell parts which are no article text, and those that tell reader comments.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead footer sidebar aside ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login paywall share sharing social related teaser teasers recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar search complementary contentinfo form disclaimer copyright skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond responses discussion".split())
#: Words of a run that must repeat on distinct pages, the share of a block's words under repeated runs from which on
#: it is boilerplate, and the rows of an Arrow batch of suffixes.
RUN, COVERED, SLICE = 8, 0.9, 10_000
#: In a marked article, where passages repeat as well, a run is furniture if at least LEAST distinct pages of the host and
#: a share of SHARED of them have it; where such blocks hold more than the share MOST of an article's words, pages are
#: near copies and keep theirs.  Words of an anchor, and pages of a host that are counted at once.
LEAST, SHARED, MOST, GRAM, PART = 5, 0.5, 0.5, 4, 1_000

#: A quote opens a value only after an equals sign; elsewhere in a tag it is a character like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_COMMENT = re.compile(r"(?:comment|repl|respon|discussion|disqus)")  # an article that is a comment, not one that has some
_WORD = re.compile(r"[a-z]+")
_MARKED = r"(?i)<(?:article|main)[\s>/]|role\s*=\s*[\"']?main\b"


def _kind(tag: str, attributes: str) -> str:
    """article, comments, dropped (by its tag), aside (by words of its class, id or role) or nothing."""
    found = {}
    if attributes and "=" in attributes or "hidden" in attributes:
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    words = set(_WORD.findall(" ".join(found.get(k, "") for k in ("class", "id", "role"))))
    if tag in ("body", "html"):
        return ""
    if words & COMMENT_WORDS and (tag not in ARTICLE or any(_COMMENT.match(c) for k in ("class", "id", "role") for c in found.get(k, "").split())):
        return "comments"
    if tag in DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "dropped"
    if tag == "article" and {"teaser", "teasers"} & set(found.get("class", "").split()):
        return "aside"
    if tag in ARTICLE or found.get("role") == "main":
        return "article"
    if words & ASIDE_WORDS:
        return "aside"
    return ""


def blocks(source: str) -> list[tuple[bool, str]]:
    """(in an article, text) of each block of text that belongs to no dropped part, in page order.

    An article inside a dropped part is a teaser and goes with it.  Two exceptions keep what broken or odd markup
    holds: a dropped part whose own end tag never comes drops no article inside it, and an article inside parts that
    only words of their class tell to be dropped counts if the page has no other block.
    """
    out: list[tuple[bool, str, tuple | None]] = []  # in an article, text, chain of the parts around the article
    held: list[str] = []
    stack: list[tuple[str, str, int, tuple]] = []
    where: dict[str, list[int]] = {}  # places of a tag in the stack, and of all articles under ""
    closed: dict[int, str] = {}  # dropped parts that have met their end tags
    parts = 0
    # in an article, in comments, chain of open dropped parts in it, chain of those around it; chains are (number, rest)
    state: tuple = (False, False, None, None)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((state[0], text, state[3]))

    def push(tag: str, kind: str) -> None:
        nonlocal state, parts
        parts += 1
        where.setdefault(tag, []).append(len(stack))
        if kind == "article":
            where.setdefault("", []).append(len(stack))
        inside, silent, open_, around = state
        if not silent:
            if kind == "comments":
                silent = True
            elif kind == "article" and not inside:
                inside, open_, around = True, None, open_
            elif kind in ("dropped", "aside"):
                open_ = (parts, open_)
        stack.append((tag, kind, parts, state))
        state = (inside, silent, open_, around)

    def pop() -> None:
        nonlocal state
        tag, kind, _, state = stack.pop()
        where[tag].pop()
        if kind == "article":
            where[""].pop()

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        silent = state[1] or state[2] is not None
        if text and not silent:
            held.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA[") and not silent:
            held.append(m[0][9:].removesuffix("]]>"))
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            last = where[tag][-1] if where.get(tag) else -1
            if last >= 0 and (tag in ("body", "html") or last >= (where[""][-1] if where.get("") else 0)):
                if any(k for _, k, _, _ in stack[last:]):
                    flush()
                    closed[stack[last][2]] = stack[last][1]
                while len(stack) > last:
                    pop()
            continue
        kind = _kind(tag, m[3])
        if tag in BLOCK or kind:
            flush()
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "iframe", "canvas"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "p" or tag == "li" or tag in ("td", "th", "tr", "option", "dt", "dd"):
            if stack and stack[-1][0] == tag:
                pop()
        push(tag, kind)
    flush()
    met: dict[int, tuple[bool, bool]] = {0: (False, True)}  # by the chain's first part: whether one has closed, whether all closed ones are asides

    def verdict(chain: tuple | None) -> tuple[bool, bool]:
        todo = []
        while chain and chain[0] not in met:
            todo.append(chain)
            chain = chain[1]
        got = met[chain[0] if chain else 0]
        for number, _ in reversed(todo):
            got = met[number] = (got[0] or number in closed, got[1] and closed.get(number, "aside") == "aside")
        return got

    kept = [(own, text) for own, text, over in out if not verdict(over)[0]]
    return kept or [(True, text) for _, text, over in out if verdict(over)[1]]


def article_text(source: str | None) -> str | None:
    """The text of the page's marked articles; null if it marks none."""
    if not source or not re.search(_MARKED, source):
        return None
    return "\n".join(text for inside, text in blocks(source) if inside)


class Numbers(dict):
    """A number of 32 bits for each word; what is held stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


def words_of(text_blocks: list[str]) -> list[str]:
    """A page's stream: its blocks' words, with a mark after each block."""
    return [w for t in text_blocks for w in (*t.split(), "\n")]


def run_anchors(stream: list[str], numbers: dict[str, int]) -> np.ndarray:
    """For each place from which RUN words follow, the least hash of GRAM words among them: the same wherever the run stands."""
    n = np.fromiter(map(numbers.__getitem__, stream), np.uint64, len(stream))
    size = max(0, len(n) - GRAM + 1)
    grams = np.zeros(size, np.uint64)
    for i in range(GRAM):
        grams = (grams + n[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    hashes, count = (grams >> np.uint64(32)).astype(np.uint32).view(np.int32), max(0, len(n) - RUN + 1)
    least = hashes[:count].copy()
    for i in range(1, RUN - GRAM + 1):
        np.minimum(least, hashes[i : i + count], out=least)
    return least


def suffixes(pages: DataFrame) -> DataFrame:
    """(host, head, content, at) for each place of each page from which RUN words follow: the suffix that starts there.

    ``head`` is the suffix's first RUN words.  Of a page with ``anchors``, suffixes whose first run has one of them.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        numbers = worker_cache("html numbers").setdefault("all", Numbers())
        for host, content, own, some in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "blocks", "anchors")), strict=True):
            stream = words_of(own)
            places = range(len(stream) - RUN + 1) if some is None else np.flatnonzero(np.isin(run_anchors(stream, numbers), some)).tolist()
            for first in range(0, len(places), SLICE):
                at = places[first : first + SLICE]
                heads = ["\0".join(stream[i : i + RUN]) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(at), pa.string()), pa.array(heads, pa.string()), pa.array([content] * len(at), pa.binary()), pa.array(at, pa.int32())], ["host", "head", "content", "at"])

    return map_arrow(pages.select("host", "content", "blocks", "anchors"), run, "host string, head string, content binary, at int")


def shared_prefixes(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of suffixes in order, (host, head, content, at) of those whose first RUN words start a suffix of another page too.

    What is settled comes without a head.  The first and the last head of the rows may go on in the rows before or
    after; of these, places on a lone page come with their head, and a head that several pages share comes once more
    without a place, so that the neighbours learn of it.  At most the places of one page are held.
    """

    def edge() -> Iterator[tuple]:
        for content, at in [(held[0][0], None)] if several else held:
            yield *key, content, at

    key, held, several, edges = None, [], False, 0
    for host, head, content, at in rows:
        if (host, head) != key:
            if not edges and key:
                yield from edge()
                edges = 1
            key, held, several = (host, head), [(content, at)], False
        elif several:
            yield host, None, content, at
        elif content == held[0][0]:
            held.append((content, at))
        else:
            yield from ((host, None, c, i) for c, i in [*held, (content, at)])
            several = True
    if key:
        yield from edge()


def suffix_array(found: DataFrame) -> DataFrame:
    """Suffixes of all hosts in order, as deep as RUN words, which settles every repeat of that length.

    A range sort lays all suffixes in the order of their first words, whatever host they are of, so that a hot host, and
    a head that very many pages share, are cut over partitions.  A page's suffixes of one head stay together.
    """
    bounded_batches(found.sparkSession)
    order = ["host", "head", "content"]
    return found.repartitionByRange(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "at")


def repeated_places(pages: DataFrame) -> DataFrame:
    """(host, content, places): where, on each page, runs of RUN words or more begin that another page of the host has.

    Neighbours of the same head in the suffix array share RUN words.  Heads at the edges of partitions meet once more,
    at most two of each.  ``pages`` holds each content of a host once.
    """
    array = suffix_array(stored(suffixes(pages), "suffixes"))
    shape = pa.schema([("host", pa.string()), ("head", pa.string()), ("content", pa.binary()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in shape.names), strict=True))
        found = shared_prefixes(rows)
        while some := list(islice(found, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), shape, strict=True)], schema=shape)

    found = stored(array.mapInArrow(run, "host string, head string, content binary, at int"), "prefixes")
    edges = found.where(F.col("head").isNotNull())
    over = edges.groupBy("host", "head").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b")
    late = edges.where(F.col("at").isNotNull()).join(over, ["host", "head"], "left_semi")
    hits = found.where(F.col("head").isNull()).unionByName(late.select(*found.columns))
    return hits.groupBy("host", "content").agg(F.collect_list("at").alias("places"))


def likely_anchors(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, anchors): the anchors of all runs that a share of SHARED of a host's pages have, and a few more.

    A host's pages are dealt over groups.  What that share of all its pages have, the same share of some group's pages
    have at least, so nothing is missed, and a group names few; which runs are meant is for the suffix array to settle.
    """

    def anchored(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = worker_cache("html numbers").setdefault("all", Numbers())
        found = [np.unique(run_anchors(words_of(text.split("\n")), numbers)) for text in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("content"), lists], ["host", "content", "anchors"])

    def frequent(group: pa.Table) -> pa.Table:
        values, counts = np.unique(group.column("anchors").combine_chunks().flatten().to_numpy(), return_counts=True)
        least = group.num_rows * SHARED if group.column("dealt")[0].as_py() > 1 else max(LEAST, group.num_rows * SHARED)
        some = values[counts >= least]
        return pa.table({"host": pa.array([group.column("host")[0].as_py()] * len(some), pa.string()), "anchor": pa.array(some, pa.int32())})

    each = map_arrow(pages.select("host", "content", "text"), anchored, "host string, content binary, anchors array<int>").dropDuplicates(["host", "content"])
    dealt = each.join(sizes, "host").withColumn("dealt", F.ceil(F.col("n") / PART).cast("int"))
    groups = dealt.select("host", "dealt", "anchors", F.pmod(F.xxhash64("content"), F.col("dealt")).alias("part")).groupBy("host", "part")
    return groups.applyInArrow(frequent, "host string, anchor int").groupBy("host").agg(F.collect_set("anchor").alias("anchors"))


def common_places(pages: DataFrame) -> DataFrame | None:
    """(host, content, places): where, on each page, runs of RUN words begin that SHARED of the host's distinct pages, and LEAST at least, have.

    By the suffix array of each host, in which the pages of a head are neighbours; partitions' counts add up, as a page's
    suffixes of one head stay together.  None if no host has such runs.
    """
    one = stored(pages.groupBy("host", "content").agg(F.min("_row").alias("_row")), "article-pages")
    sizes = stored(one.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "article-hosts")
    if sizes.isEmpty():
        return None
    likely = stored(likely_anchors(pages, sizes), "likely-anchors")
    if likely.isEmpty():
        return None
    those = pages.join(likely, "host").join(one.select("_row"), "_row", "left_semi")
    found = stored(suffixes(those.withColumn("blocks", F.split("text", "\n"))), "article-suffixes")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, n, out = None, None, 0, []
        for batch in batches:
            for host, head, content in zip(*(batch.column(c).to_pylist() for c in ("host", "head", "content")), strict=True):
                if (host, head) != key:
                    if key:
                        out.append((*key, n))
                    key, last, n = (host, head), content, 1
                elif content != last:
                    last, n = content, n + 1
            if len(out) >= SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["host", "head", "n"])
                out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, (*key, n), strict=True)], ["host", "head", "n"])

    heads = suffix_array(found).mapInArrow(counted, "host string, head string, n bigint").groupBy("host", "head").agg(F.sum("n").alias("have"))
    common = heads.join(sizes, "host").where((F.col("have") >= LEAST) & (F.col("have") >= F.col("n") * SHARED))
    return found.join(common, ["host", "head"], "left_semi").groupBy("host", "content").agg(F.collect_list("at").alias("places"))


def kept_blocks(text_blocks: list[str], places: list[int], most: float = 1.0) -> list[str]:
    """A page's blocks, without those of whose words the runs that begin at these places cover COVERED or more.

    All stay if those have more than the share ``most`` of the page's words.
    """
    if not places:
        return text_blocks
    sizes = [len(t.split()) for t in text_blocks]
    covered = bytearray(sum(sizes) + len(sizes))
    for i in places:
        covered[i : i + RUN] = b"\1" * RUN
    at, out, gone = 0, [], 0
    for t, n in zip(text_blocks, sizes, strict=True):
        if sum(covered[at : at + n]) < COVERED * n:
            out.append(t)
        else:
            gone += n
        at += n + 1
    return out if gone <= most * sum(sizes) else text_blocks


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, and of each page either its article's text or, if it has no article block, all its blocks.

    A stored table with a number for each row, _row; ``content`` is a digest of the text or the blocks, null where there
    are none.  Neither is a result yet: both go to the suffix array.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1)), F.lit(""))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rest = [], []
        for source in batch.column("html").to_pylist():
            found = blocks(source) if source else []
            article = "\n".join(text for inside, text in found if inside)
            texts.append(article if article or not found else None)
            rest.append([text for _, text in found] if texts[-1] is None else None)
        columns = [batch.column(c) for c in ("page_id", "url", "host")]
        held = [text if own is None else "\n".join(own) for text, own in zip(texts, rest, strict=True)]
        content = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() if x else None for x in held]
        columns += [pa.array(texts, pa.string()), pa.array(rest, pa.list_(pa.string())), pa.array(content, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "text", "blocks", "content"])

    found = map_arrow(rows.select("page_id", "url", host.alias("host"), "html"), run, "page_id bigint, url string, host string, text string, blocks array<string>, content binary")
    return stored(found.withColumn("_row", F.monotonically_increasing_id()), "parsed")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    A page that marks its article (article, main) offers the blocks in it, without parts that tags, classes or roles
    tell to be menus, headers, footers, sidebars, notices, adverts, forms or comments.  Pages without an article
    block (a reader comment is none) offer all blocks outside such parts.  Of either, blocks under runs of words that
    the host repeats go, by the host's suffix array: without an article, runs that distinct pages share
    (``repeated_places``); in articles, which quote each other, runs that at least half of the host's distinct articles
    share (``common_places``).  A null or empty html gives an empty text; null urls are one host; repeated rows stay, and
    pages of the same blocks count as one, so repeated rows keep their text.
    """
    rows = parsed(pages)
    marked = rows.where(F.col("blocks").isNull())
    rest = rows.where(F.col("blocks").isNotNull())
    common = common_places(marked.where(F.col("content").isNotNull()))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = zip(*(batch.column(c).to_pylist() for c in ("blocks", "places", "most")), strict=True)
        texts = ["\n".join(kept_blocks(own, places or [], most)) for own, places, most in held]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    def without(some: DataFrame, places: DataFrame, most: float) -> DataFrame:
        found = some.join(places, ["host", "content"], "left").select("page_id", "url", "blocks", "places", F.lit(most).alias("most"))
        return map_arrow(found, cut, "page_id bigint, url string, text string")

    if common is None:
        left = marked.select("page_id", "url", "text")
    else:
        left = without(marked.withColumn("blocks", F.split("text", "\n")), common, MOST)
    if not rest.isEmpty():
        one = rest.groupBy("host", "content").agg(F.min("_row").alias("_row")).select("_row")
        places = repeated_places(rest.join(one, "_row", "left_semi").withColumn("anchors", F.lit(None).cast("array<int>")))
        left = left.unionByName(without(rest, places, 1.0))
    return left.withColumn("n_chars", F.length("text").cast("bigint"))
