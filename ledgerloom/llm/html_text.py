"""Main text of web pages: structure first, then a suffix array over the pages of a host.

A page is cut into blocks of text. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts and styles are boilerplate by their mark-up; blocks inside an article are its text. What the
mark-up leaves open, on pages without an article, is judged by the host: runs of tokens that stand on distinct
pages go. Hashes of all runs, grouped by host, find those of the whole host; a suffix array over the concatenated
token streams of a bucket of its pages finds them there, and what either covers is taken out. Unique runs stay.
Text inside an article is never taken out, however often it is repeated; what stands outside it, marked or not,
is evidence for the other pages of the host."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ledgerloom.llm.common import slices, stored, without

#: Tokens of a repeated run, and pages of a host that are searched together.
RUN, BUCKET_PAGES = 8, 256
#: Odd base of the rolling hash of a run.
BASE = 0x9E3779B97F4A7C15
#: Largest number of hosts whose page counts are broadcast.
BROADCAST_HOSTS = 100_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
SKIP = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "label", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|replies|disqus|respond|breadcrumbs?|menu|navigation|navbar|nav|"
    r"footer|header|masthead|skip|pagination|pager|toolbar|login)(?:$|[\s_-]|\d)",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by its tag, class, id, role or because it is hidden."""
    if tag in SKIP or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main") and not re.search("comment|repl", attributes, re.I):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").strip()
        if name in ("class", "id") and MARKED.search(value) or name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; the zone is article, main, open or marked (boilerplate).

    The reader keeps the stack of open elements. A closing tag closes the nearest open element of its name and
    what that holds; a closing tag without partner and elements never closed are let pass, so broken mark-up
    still reads. An article or main element ends a boilerplate element that was never closed before it."""
    found, text, stack, at = [], [], [], 0
    marked = article = main = 0

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            found.append(("marked" if marked else "article" if article else "main" if main else "open", joined))
        text.clear()

    def close(index: int) -> None:
        nonlocal marked, article, main
        for tag, was_marked in stack[index:]:
            marked -= was_marked
            article -= tag == "article" and not was_marked
            main -= tag == "main"
        del stack[index:]

    end = len(page)
    lowered = None
    while at < end:
        match = TOKEN.search(page, at)
        if not match:
            break
        if match.start() > at:
            text.append(html.unescape(page[at : match.start()]))
        at, tag = match.end(), (match[2] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag in ("img", "input", "wbr"):
            text.append(" " if tag != "wbr" else "")
            continue
        if match[1]:
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCK or index is not None and stack[index][1]:
                flush()
            if index is not None:
                close(index)
            continue
        attributes = match[3]
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            stop = -1 if attributes.endswith("/") else lowered.find(f"</{tag}", at)
            if stop >= 0:
                at = page.find(">", stop) + 1 or end
            elif tag in ("script", "style") and not attributes.endswith("/"):
                at = end
            continue
        boilerplate = is_boilerplate(tag, attributes, article > 0)
        if tag in BLOCK or boilerplate:
            flush()
        if tag in ("article", "main") and not boilerplate and marked and f"</{stack[next(i for i, s in enumerate(stack) if s[1])][0]}" not in page[at:].lower():
            close(next(i for i, s in enumerate(stack) if s[1]))
        if tag == "p" and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.append((tag, boilerplate))
        marked += boilerplate
        article += tag == "article" and not boilerplate
        main += tag == "main"
    if at < end:
        text.append(html.unescape(page[at:]))
    flush()
    return found


def suffix_order(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` tokens or more: prefix doubling, equal prefixes equal ranks."""
    ranks, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while width < length:
        step = min(width, length - width)
        later = np.full(len(ranks), -1, np.int64)
        later[:-step] = ranks[step:]
        order = np.lexsort((later, ranks))
        changed = np.concatenate([[False], (np.diff(ranks[order]) != 0) | (np.diff(later[order]) != 0)])
        fresh = np.empty_like(ranks)
        fresh[order] = np.cumsum(changed)
        ranks, width = fresh, width + step
    return ranks


def repeated(streams: list[list[str]], run: int = RUN, pages: list[int] | None = None) -> list[np.ndarray]:
    """For each stream's tokens, which of them lie in a run of ``run`` tokens that stands on another page too.

    ``pages`` numbers the page of each stream, where several are versions of one."""
    pages = list(range(len(streams))) if pages is None else pages
    sizes = [len(s) for s in streams]
    names: dict[str, int] = {}
    flat, owner = [], []
    for page, stream in enumerate(streams):
        flat.extend(names.setdefault(t, len(names)) for t in stream)
        flat.append(-page - 1)  # no run goes on behind the end of its page
        owner.extend([page] * (len(stream) + 1))
    tokens, owners, numbers = np.array(flat, np.int64), np.array(owner), np.array(pages, np.int64)
    covered = np.zeros(len(tokens) + run, np.int64)
    if len(tokens) > run:
        ranks = suffix_order(tokens, run)
        whole = np.flatnonzero(owners[: len(owners) - run + 1] == owners[run - 1 :])
        whole = whole[tokens[whole + run - 1] >= 0]
        if len(whole):
            low, high = np.full(ranks.max() + 1, len(streams)), np.full(ranks.max() + 1, -1)
            np.minimum.at(low, ranks[whole], numbers[owners[whole]])
            np.maximum.at(high, ranks[whole], numbers[owners[whole]])
            twice = whole[low[ranks[whole]] != high[ranks[whole]]]
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + run, -1)
    inside, start, out = np.cumsum(covered) > 0, 0, []
    for size in sizes:
        out.append(inside[start : start + size])
        start += size + 1
    return out


def stream_of(zones: list[str], texts: list[str]) -> tuple[list[str], list[int]]:
    """Tokens of the open and marked blocks of a page, and where each block begins (-1 for other blocks).

    A token with a blank, which no other has, stands where the zone changes: no run leads from boilerplate into text."""
    stream, starts, last = [], [], None
    for zone, body in zip(zones, texts, strict=True):
        if zone in ("open", "marked"):
            if zone != last:
                stream.append(f"\0 {len(stream)}")
            starts.append(len(stream))
            stream.extend(body.split(" "))
        else:
            starts.append(-1)
        last = zone
    return stream, starts


def run_hashes(stream: list[str], names: dict[str, int], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each run of ``run`` tokens that no change of zone parts; ``names`` remembers token hashes."""
    for token in stream:
        if token not in names:
            names[token] = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    count = len(stream) - run + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens, parted = np.array([names[t] for t in stream], np.uint64), np.cumsum([0] + [" " in t for t in stream])
    with np.errstate(over="ignore"):
        hashes = np.zeros(count, np.uint64)
        for k in range(run):
            hashes = hashes * np.uint64(BASE) + tokens[k : k + count]
            hashes ^= hashes >> np.uint64(32)
    places = np.flatnonzero(parted[run:] == parted[:count])
    return places, hashes.view(np.int64)[places]


def parse(pages: DataFrame) -> DataFrame:
    """``pages`` without its html, plus ``own__``, ``zones`` and ``texts`` of the blocks.

    A page with an article keeps the article's blocks as its own; else one with a main element keeps those; else
    all that is not marked is open. Open and marked blocks of every page stay beside them as evidence of what the
    host repeats."""
    kept = without(pages, "html", "own__", "zones", "texts").columns
    ready = pages.select(*kept, F.col("html").cast("string").alias("html"))
    names = [*kept, "own__", "zones", "texts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            owns, zones, texts = [], [], []
            for page in batch.column(len(kept)).to_pylist():
                found = blocks(page or "")
                have = {z for z, _ in found}
                owns.append(next((z for z in ("article", "main", "open") if z in have), "none"))
                # blocks of a main element around an article are neither text nor evidence, but part the streams
                zones.append([z for z, _ in found])
                texts.append(["" if z == "main" and owns[-1] == "article" else t for z, t in found])
            added = [pa.array(owns, pa.string()), pa.array(zones, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names=names)

    added = [StructField("own__", StringType()), StructField("zones", ArrayType(StringType())), StructField("texts", ArrayType(StringType()))]
    return ready.mapInArrow(run, StructType([*ready.schema.fields[: len(kept)], *added]))


def runs_of(parsed: DataFrame) -> DataFrame:
    """``host__``, ``key__``, ``open__`` and ``run__``: hashes of the runs of each page, once a page."""
    ready = parsed.select("host__", "key__", (F.col("own__") == "open").alias("open__"), "zones", "texts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            names: dict[str, int] = {}
            found = [np.unique(run_hashes(stream_of(z, t)[0], names)[1]) for z, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(3)], pa.array(np.concatenate(found))], names=["host__", "key__", "open__", "run__"])

    return ready.mapInArrow(run, "host__ string, key__ long, open__ boolean, run__ long")


def repeated_runs(parsed: DataFrame, hosts: DataFrame) -> DataFrame:
    """``key__`` and ``runs__``: of each page with open blocks, its runs that stand on another page of its host.

    Only pages of ``hosts`` are read. A run of all pages of a host is one row per task before it is shuffled."""
    runs = runs_of(parsed.join(hosts, "host__", "left_semi"))
    spread = runs.groupBy("host__", "run__").agg(F.min("key__").alias("low"), F.max("key__").alias("high"), F.max("open__").alias("open"))
    twice = spread.where((F.col("low") != F.col("high")) & F.col("open")).select("host__", "run__")
    return runs.where("open__").join(twice, ["host__", "run__"]).groupBy("key__").agg(F.collect_set("run__").alias("runs__"))


def clean_host(table: pa.Table) -> pa.Table:
    """Pages of one host and bucket: what runs cover that the host (``runs__``) or the bucket repeats goes from open blocks."""
    texts, names = [], {}
    zones, bodies = table.column("zones").to_pylist(), table.column("texts").to_pylist()
    parted = [stream_of(z, b) for z, b in zip(zones, bodies, strict=True)]
    # the marks of zone changes differ by page
    streams = [[f"{t} {page}" if " " in t else t for t in stream] for page, (stream, _) in enumerate(parted)]
    numbers: dict[int, int] = {}
    pages = [numbers.setdefault(k, len(numbers)) for k in table.column("key__").to_pylist()]
    known = table.column("runs__").to_pylist()
    for zs, bs, (_, starts), stream, gone, runs in zip(zones, bodies, parted, streams, repeated(streams, pages=pages), known, strict=True):
        if runs:
            places, hashes = run_hashes(stream, names)
            for place in places[np.isin(hashes, np.array(runs, np.int64))].tolist():
                gone[place : place + RUN] = True
        parts = []
        for zone, body, start in zip(zs, bs, starts, strict=True):
            if zone == "open":
                n = body.count(" ") + 1
                parts.append(" ".join(t for t, g in zip(stream[start : start + n], gone[start : start + n].tolist(), strict=True) if not g))
        texts.append("\n".join(p for p in parts if p))
    place = table.schema.get_field_index("key__")
    kept = [c for i, c in enumerate(table.column_names) if i < place]
    return table.select(kept).append_column("text", pa.array(texts, pa.string()))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without its html, plus ``text``: blocks of the main text, joined by line ends.

    Null and empty pages give an empty text; a null url is a host of its own; repeated rows stay; an input
    column ``text`` is replaced. A page is known by ``page_id`` and ``url`` (by its html where both are null);
    rows that share them are versions of one page and no evidence against each other. A run on two pages of a host
    is found however many pages it has. A host is dealt into buckets of about ``BUCKET_PAGES`` open pages by a hash
    of the page, so one host with a third of all pages is many tasks."""
    pages = without(pages, "text", "host__", "bucket__", "n__", "key__", "own__", "zones", "texts", "runs__")
    names = [c for c in pages.columns if c.lower() != "html"]
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    unnamed = F.when(F.col("page_id").isNull() & F.col("url").isNull(), F.col("html").cast("string"))
    keyed = pages.select(*names, F.xxhash64("page_id", F.lit("\0"), "url", F.lit("\0"), unnamed).alias("key__"), host.alias("host__"), "html")
    parsed = stored(parse(keyed), "pages")
    own = F.filter("texts", lambda text, i: F.get("zones", i) == F.col("own__"))
    settled = parsed.where("own__ != 'open'").select(*names, F.array_join(own, "\n").alias("text"))
    left = parsed.where("own__ = 'open'")
    hosts = stored(left.groupBy("host__").agg(F.ceil(F.count(F.lit(1)) / BUCKET_PAGES).alias("n__")), "hosts")
    # one small row per host: broadcast where they are few by count, else joined by a shuffle
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    runs = repeated_runs(parsed, hosts)
    dealt = left.join(hosts, "host__").withColumn("bucket__", F.pmod("key__", "n__")).join(runs, "key__", "left")
    dealt = dealt.select(*names, "key__", "host__", "bucket__", "zones", "texts", "runs__")
    schema = StructType([*dealt.select(*names).schema.fields, StructField("text", StringType())])
    return settled.unionByName(dealt.groupBy("host__", "bucket__").applyInArrow(clean_host, schema))
