"""Main text of web pages.

A page becomes blocks. The tokens of the blocks outside its article (of all
blocks, where a page marks no article) form a stream. The streams of a host are
concatenated and their suffixes sorted by doubling the compared length;
neighbours in that order that share WINDOW tokens or more, in PAGES different
pages, are repeated strings. A host too large for a task is dealt out by pages;
what is repeated in none of its parts is counted over all of them. What a host
repeats is boilerplate and goes, also from pages whose markup says nothing;
unique runs stay.

Repetition alone can't tell an article from what surrounds it: copies of an
article and passages that articles share are repeated, and adverts or menus can
be unique. So blocks inside an article are not judged by it, and blocks inside
elements that are menus, footers, adverts and so on by name, class or role are
left out whether repeated or not. A class, an id or a form says so only as long
as the element doesn't hold the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, per_batch, table, texts

WINDOW = 8  # tokens that have to be repeated in a row
PAGES = 3  # different pages of a host that have to repeat them
HOST_TOKENS = 1 << 20  # tokens whose suffixes are sorted in a task
#: Repeated windows up to which their hashes are sent to all tasks (8 bytes each); beyond it they are joined.
BROADCAST_WINDOWS = 500_000

# Fixed values of HTML: elements whose content is no text, that start a block, and that surround an article.
RAW = set("script style noscript template textarea select svg iframe title object math canvas button datalist".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AROUND = set("aside dialog footer form head header menu nav search".split())
HINTS = set(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist
    consent cookie cookies copyright disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices
    pagination popup promo promoted recommended related replies respond share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription toolbar topbar widget""".split()
)
ROLES = set("banner navigation contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*|[^>]*)>|<[!?/][^>]*>", re.S)
#: One attribute after the other: name, and value in quotes (to the end, where the closing one lacks) or without.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
#: A slash at the end that belongs to a value without quotes.
VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
RAW_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])([^>]*)>", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    around: bool  # inside a menu, footer, advert or the like
    article: bool
    main: bool


@dataclass(eq=False)
class Wrapper:
    """An element that holds what surrounds an article, by its class, id or role of a form, unless the article is in it."""

    article: bool = False
    main: bool = False


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by name, both in small letters; of equal names the first one counts."""
    out: dict[str, str] = {}
    for key, *values in ATTRIBUTE.findall(text):
        out.setdefault(key.lower(), "".join(values).lower())
    return out


def self_closed(text: str) -> bool:
    return text.endswith("/") and not VALUE_SLASH.search(text)


def hinted(value: str) -> set[str]:
    """Names of a class or id that are hints, or made of nothing but hints as nav-menu is."""
    return {n for n in value.split() if n in HINTS or (words := re.split("[-_]+", n.strip("-_")))[0] and HINTS.issuperset(words)}


def surrounds(name: str, attributes: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element holds what surrounds an article: for sure, and as long as no article is in it.

    A header inside an article is its heading.
    """
    sure = name in AROUND and name != "form" and not (name == "header" and inside)
    maybe = name == "form"
    if attributes:
        role = attributes.get("role", "")
        sure = sure or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""))) or (role in ROLES and role != "form")
        maybe = maybe or role == "form"
        if not (sure or maybe) and name not in ("html", "body", "article", "main"):
            for key in ("class", "id"):
                names = hinted(attributes.get(key, ""))
                if names and not (inside and names & {"header", "form"} and name in ("header", "h1", "h2", "h3")):
                    maybe = True
    return sure, maybe


def raw_ends(page: str, name: str) -> dict[int, int]:
    """Where the content of elements ``name`` ends, end tag included, by where it starts; those that are never closed have none."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in RAW_TAGS[name].finditer(page):
        if not m.group(1):
            if not self_closed(m.group(2)):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
            if name in ("script", "style", "textarea", "title", "iframe"):  # hold no elements: the first end tag ends them
                out.update(dict.fromkeys(opened, m.end()))
                opened.clear()
    if name in ("script", "style"):  # code of a page that was cut off
        out.update(dict.fromkeys(opened, len(page)))
    return out


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, character references decoded and white space made single."""
    out: list[tuple[str, bool, tuple[Wrapper, ...], bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, tuple[Wrapper, ...], bool, bool]] = []  # name, around, wrappers, article, main
    outside: tuple[bool, tuple[Wrapper, ...], bool, bool] = (False, (), False, False)
    around, wrappers, article, main = outside
    ends: dict[str, dict[int, int]] = {}
    at = 0

    def close() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((text, around, wrappers, article, main))
            parts.clear()

    while m := TAG.search(page, at):
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(html.unescape(raw) if "&" in raw else raw)
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not m.group(1) and not self_closed(m.group(3)):
                if name not in ends:
                    ends[name] = raw_ends(page, name)
                at = ends[name].get(at, at)
        elif m.group(1):
            if name in BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close()
                    del stack[i:]
                    around, wrappers, article, main = stack[-1][1:] if stack else outside
                    break
        elif name in ("br", "td", "th"):
            parts.append(" ")
        elif name not in VOID or name == "hr":
            block = name in BLOCK
            if block:
                close()
                if stack and stack[-1][0] in ("p", "li", "dt", "dd") and stack[-1][0] == name:
                    stack.pop()
                    around, wrappers, article, main = stack[-1][1:] if stack else outside
            attributes = attributes_of(m.group(3)) if m.group(3) else {}
            sure, maybe = surrounds(name, attributes, article or main)
            if sure or maybe or (block and name not in ("p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr")):
                if sure or maybe:
                    close()
                if not self_closed(m.group(3)) and name not in VOID:
                    around = around or sure
                    is_main = name == "main" or attributes.get("role") == "main"
                    if not around:
                        for w in wrappers:
                            w.main = w.main or is_main
                            w.article = w.article or (name == "article" and not article)
                    if maybe and not sure:
                        wrappers = (*wrappers, Wrapper())
                    article = article or name == "article"
                    main = main or is_main
                    stack.append((name, around, wrappers, article, main))
    if at < len(page):
        raw = page[at:]
        parts.append(html.unescape(raw) if "&" in raw else raw)
    close()
    # a wrapper of the main part is none; one of articles is, where another article stands outside (comments, related pages)
    seen = [(a, m) for _, x, ws, a, m in out if not x and all(w.main for w in ws)]
    plain, rest = any(a for a, _ in seen), any(m for _, m in seen)
    # where text of the main part stands beside articles in wrappers, the main part is the text and holds them
    return [Block(t, x or any(not (w.main or (w.article and not plain)) for w in ws), a and (plain or not rest), m) for t, x, ws, a, m in out]


def zone(blocks: list[Block]) -> str | None:
    """Where a page says that its main text is."""
    return "article" if any(b.article and not b.around for b in blocks) else "main" if any(b.main and not b.around for b in blocks) else None


def stream(blocks: list[Block]) -> tuple[list[int], list[list[str]]]:
    """Numbers and words of the blocks that repetition may judge: those outside the marked article."""
    where = zone(blocks)
    rows = [i for i, b in enumerate(blocks) if not (where and getattr(b, where) and not b.around)]
    return rows, [blocks[i].text.split(" ") for i in rows]


def token_codes(words: list[list[str]]) -> np.ndarray:
    """Hashes of a page's stream of tokens; blocks are joined by a mark."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for w in words for t in [*w, "\n"]], np.uint64)


def string_hashes(host: str, code: np.ndarray) -> np.ndarray:
    """Hash of the host and the first WINDOW tokens of every suffix that has them."""
    import xxhash

    if len(code) < WINDOW:
        return np.zeros(0, np.int64)
    out = np.full(len(code) - WINDOW + 1, xxhash.xxh64_intdigest(host, 1), np.uint64)
    for i in range(WINDOW):
        out = (out ^ code[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def window_hashes(host: str, words: list[list[str]]) -> np.ndarray:
    return string_hashes(host, token_codes(words))


def suffix_ranks(host: np.ndarray, page: np.ndarray, code: np.ndarray, depth: int) -> np.ndarray:
    """Place of every suffix in the order by host and first ``depth`` tokens, equal ones in one place; -1 where its page has fewer.

    The compared length doubles: the order by 2n tokens is that of the pairs of
    places by n tokens, of a suffix and of that n tokens later.
    """
    n = len(code)
    rank, span = np.unique(code, return_inverse=True)[1].astype(np.int64), 1
    while span < depth:
        step = min(span, depth - span)
        later = np.r_[rank[step:], np.zeros(min(step, n), np.int64)][:n]
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        span += step
    whole = np.zeros(n, bool)
    whole[: n - depth + 1] = page[depth - 1 :] == page[: n - depth + 1]
    place = np.unique(host * (n + 1) + rank, return_inverse=True)[1].astype(np.int64)
    return np.where(whole, place, -1)


def repeated_strings(hosts: list[str], prints: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the streams of some hosts: (hash, stream of its first page, number of different pages) of every string of WINDOW tokens.

    The suffixes are sorted; strings are runs of neighbours that share WINDOW tokens.
    """
    sizes = np.array([len(c) for c in codes])
    page, code = np.repeat(np.arange(len(codes)), sizes), np.concatenate(codes)
    if len(code) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.unique(np.array(hosts, object), return_inverse=True)[1]
    rank = suffix_ranks(number[page], page, code, WINDOW)
    order = np.flatnonzero(rank >= 0)
    order = order[np.lexsort((prints[page[order]], rank[order]))]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, rank[order][1:] != rank[order][:-1]]
    other = new | np.r_[True, prints[page[order]][1:] != prints[page[order]][:-1]]
    first = np.flatnonzero(new)
    hashes = np.concatenate([string_hashes(h, c) for h, c in zip(hosts, codes, strict=True)])
    at = np.cumsum(np.r_[0, np.maximum(sizes - WINDOW + 1, 0)])[:-1][page[order[first]]] + order[first] - np.cumsum(np.r_[0, sizes])[:-1][page[order[first]]]
    return hashes[at], page[order[first]], np.add.reduceat(other.astype(np.int64), first)


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def long_runs(covered: np.ndarray) -> list[bool]:
    """What goes of a block: all of it if all is covered, else its covered runs of WINDOW tokens or more.

    A shorter run is the start or end of a window that lies in a neighbour.
    """
    if covered.all():
        return covered.tolist()
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    out = np.zeros(len(covered), bool)
    for a, b in edges.reshape(-1, 2):
        out[a:b] = b - a >= WINDOW
    return out.tolist()


def main_text(page: str, repeated: set[int] | None, host: str) -> str:
    """The text of a page, given the hashes of the windows that its host repeats."""
    blocks = blocks_of(page)
    where = zone(blocks)
    rows, words = stream(blocks)
    gone: dict[int, list[bool]] = {}
    if repeated and rows:
        hits = [i for i, h in enumerate(window_hashes(host, words).tolist()) if h in repeated]
        covered = np.zeros(sum(len(w) + 1 for w in words) + WINDOW, bool)
        for i in hits:
            covered[i : i + WINDOW] = True
        at = 0
        for row, w in zip(rows, words, strict=True):
            gone[row] = long_runs(covered[at : at + len(w)])
            at += len(w) + 1
    out = []
    for i, b in enumerate(blocks):
        if b.around or (where and not getattr(b, where)):
            continue
        marks = gone.get(i)
        text = b.text if not marks or not any(marks) else " ".join(t for t, g in zip(b.text.split(" "), marks, strict=True) if not g)
        if text:
            out.append(text)
    return "\n\n".join(out)


def repeated_windows(pages: DataFrame) -> DataFrame:
    """Hashes (h) of strings of WINDOW tokens that PAGES different pages of a host have; pages with one stream are the same page."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        hosts, prints, tokens = [], [], []
        for url, page in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
            raw = token_codes(stream(blocks_of(page))[1]).tobytes()
            hosts.append(host_of(url))
            prints.append(xxhash.xxh64_intdigest(raw) >> 1)
            tokens.append(raw)
        return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(prints, pa.int64()), pa.array(tokens, pa.binary())], ["host", "print", "tokens"])

    streams = pages.select("url", "html").mapInArrow(per_batch(read), "host string, print long, tokens binary").where(F.length("tokens") >= 8 * WINDOW)
    streams = cut(streams.groupBy("host", "print").agg(F.min("tokens").alias("tokens")))
    size = F.sum(F.length("tokens")) / 8
    tasks = max(1, -(-(streams.agg(size).first()[0] or 0) // HOST_TOKENS))
    # there are no more of these than tasks
    large = streams.groupBy("host").agg(F.ceil(size / HOST_TOKENS).alias("parts")).where("parts > 1")
    dealt = streams.join(F.broadcast(large), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    bucket = F.pmod(F.xxhash64("host", F.pmod(F.xxhash64("print"), F.col("parts"))), F.lit(int(tasks) * 2))

    def sort(part: pa.Table) -> pa.Table:
        parts, prints = part["parts"].to_numpy(), part["print"].to_numpy()
        hashes, page, pages_ = repeated_strings(part["host"].to_pylist(), prints, [np.frombuffer(x, np.uint64) for x in part["tokens"].to_pylist()])
        told = (pages_ >= PAGES) | (parts[page] > 1) if len(page) else np.zeros(0, bool)
        return pa.table([pa.array(hashes[told]), pa.array(pages_[told])], names=["h", "n"])

    counted = dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(sort, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("h")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url and text, blocks joined by an empty line.

    A null page is empty and has an empty text; a null or broken url is host
    "". Repeated rows stay; pages with the same stream of boilerplate count
    once; an empty table gives an empty result; only the three columns are read.
    """
    found = cut(repeated_windows(pages))
    few = found.count() <= BROADCAST_WINDOWS
    shared = pages.sparkSession.sparkContext.broadcast({r.h for r in found.collect()} if few else None)

    def text(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        extra = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        for url, page, windows in zip(texts(batch.column(1)), texts(batch.column(2)), extra, strict=True):
            out.append(main_text(page, set(windows or []) if shared.value is None else shared.value, host_of(url)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    source = pages.select("page_id", "url", "html")
    if not few:  # the windows of a page that are repeated come with it by a join

        def own(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(window_hashes(host_of(u), stream(blocks_of(p))[1])) for u, p in zip(texts(batch.column(1)), texts(batch.column(2)), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(sets, pa.list_(pa.int64()))], ["page_id", "_hash", "windows"])

        keyed = source.withColumn("_hash", F.xxhash64("url", "html"))
        rows = keyed.mapInArrow(per_batch(own), f"page_id {pages.schema['page_id'].dataType.simpleString()}, _hash long, windows array<long>")
        per_page = rows.dropDuplicates(["page_id", "_hash"]).select("page_id", "_hash", F.explode("windows").alias("h")).join(found, "h", "left_semi").groupBy("page_id", "_hash").agg(F.collect_list("h").alias("_windows"))
        source = keyed.alias("k").join(per_page.alias("w"), F.col("k.page_id").eqNullSafe(F.col("w.page_id")) & (F.col("k._hash") == F.col("w._hash")), "left").select("k.page_id", "k.url", "k.html", "w._windows")
    kind = pages.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(per_batch(text), f"page_id {kind}, url string, text string")


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
