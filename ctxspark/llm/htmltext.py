"""Main text of web pages, with a host suffix array against boilerplate.

A page's mark-up is read as a stream of tags and texts; block tags end a block. Each block is text of the marked article
(article, main or role="main"), open (the page marks none), or the rest: what lies in elements that never hold main text
(menus, headers, footers, sidebars, forms), in elements one of whose class, id or role words says advert, notice, comments and
the like, and what lies beside a marked article. Scripts, styles and titles (which repeat the article's headline) are nothing at all.

The rest of all pages, and the open blocks, are what the host decides by. Their token streams are concatenated, by host, in
every task; a suffix array (prefix doubling to RUN tokens) brings equal substrings together, and each run of RUN tokens (or
whole shorter block) is passed on with at most REPEATS of its pages. A run that REPEATS different pages of the host hold,
wherever they lie, is boilerplate. Repeats within articles aren't evidence: articles quote and copy each other.

Open blocks then lose the tokens that such runs cover; what is left of a block, its unique runs, stays. The marked article of a
page stays whole: a site's notices and adverts may quote what an article says. Beside it nothing stays, repeated or not.

Runs are known by 64-bit hashes of host and tokens. Up to BROADCAST_RUNS of them (counted first) are broadcast, and pages are
decided where they lie. Beyond that, a filter of fixed size is broadcast, runs that pass it are joined with the table, and only
their hashes and the pages are shuffled. So a host of any size is never in one task, and both ways find the same.

Edge cases: null or empty html has an empty text; unclosed elements end with the page or with the element around them; a tag
without an end is text; copies of a page count once as evidence; page_id and url may be null (an unknown host is a host);
other columns are carried in a struct, so that no name clashes; no rows give no rows; reading is linear in a page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, texts, written

RUN, REPEATS = 8, 3
#: Runs up to which they are broadcast (8 bytes each), and 64-bit words of the filter beyond that.
BROADCAST_RUNS, FILTER_WORDS = 4_000_000, 1 << 20
#: Tokens that a task holds before it builds its suffix arrays; tokens whose hashes it remembers.
FLUSH, REMEMBER = 2_000_000, 400_000
NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
PLAIN = re.compile(r"[^<>\"']*")
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Elements whose content isn't text, elements of the rest, elements that don't hold anything, inline elements.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "title", "noscript", "template", "svg", "textarea", "select", "iframe", "object", "canvas", "math")}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "button", "dialog", "menu", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: A whole word of a class, id or role that means boilerplate: alone, or with more behind it, or behind a part of the page.
NOISE = re.compile(
    r"(?:nav|navbar|navigation|menu|sidebar|side|aside|footer|header|masthead|topbar|toolbar|notices?|alert|overlay|related|recommended|recommendations|repl(?:y|ies)|discussion|widget|copyright|legal|disclaimer|contentinfo|complementary|skip|hidden|tags|banner)"
    r"|(?:ads?|advert\w*|adsense|sponsor\w*|promo|cookies?|consent|gdpr|newsletter|subscribe|subscription|breadcrumbs?|comments?|disqus|respond|share|sharing|social|pagination|pager|login|signup|search|popup|modal)(?:[-_][\w-]*)?"
    r"|(?:site|page|main|global|top|bottom|left|right)[-_](?:header|footer|nav|navigation|menu|sidebar|banner|ads?)",
    re.I,
)
#: Inside an article, and on one, only these: a noise word alone, or with words of a part of a page behind it (`comment-list`, not
#: `comments-open`, `ad-free`, `share-price` or `social-science`).
PART = r"(?:box|block|banner|bar|list|section|container|wrapper|wrap|widget|area|form|links?|buttons?|btns?|icons?|slots?|units?|panel|thread|consent|signup|inner|body|content|items?|title|header|footer|top|bottom|left|right|popup|modal|overlay|message|notices?|policy|settings|dialog|law|info|google|native|respond|reply|posts|articles|stories|feed|\d\w*)"
STRICT = re.compile(
    r"(?:nav|navbar|navigation|menu|sidebar|aside|toolbar|notices?|alert|overlay|related|recommended|recommendations|repl(?:y|ies)|widget|copyright|disclaimer|complementary|skip|hidden|banner"
    r"|ads?|advert\w*|adsense|sponsor\w*|promo|cookies?|consent|gdpr|newsletter|subscribe|subscription|breadcrumbs?|comments?|disqus|respond|share|sharing|social|pagination|pager|login|signup|search|popup|modal)"
    rf"(?:[-_]{PART})*",
    re.I,
)
#: Words that say that an article element is the article, whatever else is said of it; and ids of forms around whole pages.
POSITIVE = re.compile(r"(?:h-?entry|post|article|entry|story|content|main|single|page|news)(?:[-_]\w+)*", re.I)
PAGE_FORM = re.compile(r"aspnet\w*|form1|mainform|pageform", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that an opening tag of the first kind ends when it is open.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where a block lies: marked nowhere, in an article, in an article within noise, in noise, and where nothing is an article.
#: A form is like the last, but an article that is marked in it counts.
OPEN, MAIN, INNER, SOFT, HARD, FORM = range(6)


def _tag_end(html: str, at: int) -> int:
    """The place of the > that ends a tag whose name ends at `at`; -1 if the tag doesn't end before the next <."""
    while True:
        at = PLAIN.match(html, at).end()
        if at == len(html) or html[at] == "<":
            return -1
        if html[at] == ">":
            return at
        quoted = html[:at].endswith("=") if at < 2 else html[at - 1] == "=" or (html[at - 1].isspace() and html[max(0, at - 8) : at].rstrip().endswith("="))
        close = html.find(html[at], at + 1) if quoted else at
        if close < 0:  # the last quote of its kind, so this happens at most twice
            return html.find(">", at)
        at = close + 1


def _zone(name: str, attrs: str, around: int) -> int:
    """Where the content of an element lies."""
    noise = strict = positive = article = hidden = whole = False
    for key, value in NAMED.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'")
        hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and bool(HIDDEN.search(value)))
        if key in ("class", "id", "role"):
            words = value.split()
            noise |= any(map(NOISE.fullmatch, words))
            strict |= any(map(STRICT.fullmatch, words))
            positive |= any(map(POSITIVE.fullmatch, words))
            whole |= any(map(PAGE_FORM.fullmatch, words))
            article |= key == "role" and value.lower() == "main"
    if around == HARD or hidden:
        return HARD
    if name == "form":
        return around if whole else HARD if around in (MAIN, INNER, SOFT) else FORM
    if name in DROPPED and not (name == "header" and around in (MAIN, INNER)):
        return HARD
    if name in ("article", "main") or article:
        # An article outranks what else its class says, unless that is nothing but noise.
        if name == "main" or positive or not strict:
            return {OPEN: MAIN, FORM: MAIN, SOFT: INNER}.get(around, around)
    if around in (MAIN, INNER):
        return HARD if strict else around
    if noise and name not in ("html", "body", "main"):
        return SOFT if around in (OPEN, SOFT) else HARD
    return around


def blocks(html: str) -> tuple[bool, list[str], list[str]]:
    """Whether the page marks its article; the blocks of the article, or else the open ones; and those of the rest."""
    stack: list[tuple[str, int]] = []
    names: Counter = Counter()
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    zone, at, last = OPEN, 0, html.rfind(">")

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((zone, text))

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            parts.append(html[at:])
            break
        if lt > at:
            parts.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = len(html) if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            at = html.find(">", lt) + 1
            continue
        m = NAME.match(html, lt + 1)
        end = _tag_end(html, m.end()) if m else -1
        if end < 0:
            parts.append("<")
            at = lt + 1
            continue
        name, attrs, at = m.group(2).lower(), html[m.end() : end], end + 1
        closed = attrs.rstrip().endswith("/")
        if name in RAW and not m.group(1):
            flush()
            stop = None if closed else RAW[name].search(html, at)
            at = at if closed else stop.end() if stop else len(html)
            continue
        if name not in INLINE:
            flush()
        if m.group(1):
            while names[name]:
                top = stack.pop()[0]
                names[top] -= 1
                if top == name:
                    break
        elif name in VOID or closed:
            continue
        else:
            while stack and name in ENDS and stack[-1][0] in ENDS[name]:
                names[stack.pop()[0]] -= 1
            stack.append((name, _zone(name, attrs, stack[-1][1] if stack else OPEN)))
            names[name] += 1
        now = stack[-1][1] if stack else OPEN
        if now != zone:
            flush()
            zone = now
    flush()
    there = {z for z, _ in found}
    want = MAIN if MAIN in there else INNER if INNER in there else OPEN
    return want != OPEN, [t for z, t in found if z == want], [t for z, t in found if z != want]


class Runs:
    """Hashes of tokens (remembered) and of runs of tokens on a host."""

    def __init__(self, run: int = RUN):
        self.run, self.known = run, {}

    def tokens(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            known.update((w, xxhash.xxh64_intdigest(w)) for w in words if w not in known)
            return np.array([known[w] for w in words], np.uint64)

    def hashes(self, tokens: np.ndarray, host: str) -> np.ndarray:
        """Of every run, in order; of fewer tokens than a run, of all."""
        n = min(self.run, len(tokens))
        h = np.full(len(tokens) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : len(tokens) - n + 1 + j]
        h = (h ^ np.uint64(xxhash.xxh64_intdigest(host))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def suffix_ranks(tokens: np.ndarray, lengths: list[int], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated blocks' suffixes that have `run` tokens within their block: where they start, and their rank by
    those tokens (equal substrings have equal ranks), by prefix doubling."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < run:
        step = min(length, run - length)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1]
        length += step
    starts = np.flatnonzero(np.arange(len(tokens)) + run <= ends)
    return starts, rank[starts]


def _few(key: np.ndarray, page: np.ndarray, repeats: int) -> np.ndarray:
    """Places of at most `repeats` different pages of each key."""
    order = np.lexsort((page, key))
    k, p = key[order], page[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    order, k = order[new], k[new]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    nth = np.arange(len(k)) - np.repeat(first, np.diff(np.concatenate([first, [len(k)]])))
    return order[nth < repeats]


def host_runs(runs: Runs, host: str, pages: list[tuple[int, list[str]]], repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of a host's pages (page hash, blocks) and of pages that hold them, at most `repeats` for each."""
    streams = [(p, runs.tokens(t)) for p, blocks_ in pages for t in blocks_]
    long, short = [s for s in streams if len(s[1]) >= runs.run], [s for s in streams if len(s[1]) < runs.run]
    keys = [np.concatenate([runs.hashes(t, host) for _, t in short])] if short else [np.zeros(0, np.int64)]
    at = [np.array([p for p, _ in short], np.int64)]
    some = _few(keys[0], at[0], repeats)
    keys[0], at[0] = keys[0][some], at[0][some]
    if long:
        lengths = [len(t) for _, t in long]
        tokens = np.concatenate([t for _, t in long])
        starts, rank = suffix_ranks(tokens, lengths, runs.run)
        page = np.repeat(np.array([p for p, _ in long], np.int64), lengths)[starts]
        some = _few(rank, page, repeats)
        keys.append(runs.hashes(tokens, host)[starts[some]])
        at.append(page[some])
    return np.concatenate(keys), np.concatenate(at)


def without(runs: Runs, host: str, texts_: list[str], repeated: Callable[[np.ndarray], np.ndarray]) -> tuple[list[str], int]:
    """A page's open blocks without the tokens that repeated runs cover, and how many blocks lost any."""
    out, cut = [], 0
    for text in texts_:
        s = runs.tokens(text)
        hit = np.flatnonzero(repeated(runs.hashes(s, host)))
        if len(hit):
            depth = np.zeros(len(s) + 1, np.int64)
            np.add.at(depth, hit, 1)
            np.add.at(depth, np.minimum(hit + runs.run, len(s)), -1)
            text = " ".join(w for w, d in zip(text.split(), np.cumsum(depth[:-1])) if not d)
            cut += 1
        if text:
            out.append(text)
    return out, cut


def _within(values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Membership in a sorted array."""
    return lambda x: values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x if len(values) else np.zeros(len(x), bool)


def boilerplate(rows: DataFrame) -> DataFrame:
    """run: hashes of the runs that REPEATS different pages of their host hold. rows: host, html."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held, size = Runs(), {}, 0
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                html = html.as_py() or ""
                marked, text, rest = blocks(html)
                held.setdefault(host, {})[xxhash.xxh64_intdigest(html) - (1 << 63)] = rest if marked else rest + text
                size += sum(map(len, rest)) // 4 + (0 if marked else sum(map(len, text)) // 4)
            if size > FLUSH:
                yield from flush(runs, held)
                held, size = {}, 0
        yield from flush(runs, held)

    def flush(runs: Runs, held: dict) -> Iterator[pa.RecordBatch]:
        for host, pages in held.items():
            keys, page = host_runs(runs, host, sorted(pages.items()))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(page)], names=["run", "page"])

    return rows.mapInArrow(work, "run long, page long").distinct().groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS).select("run")


def extract(pages: DataFrame, html: str = "html", url: str = "url", broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """Every row of pages as the struct `row`, with text and boilerplate_blocks (how many blocks of the text the suffix array cut)."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    source = F.col(f"`{html}`").cast("string")
    rows = pages.select(host.alias("host"), source.alias("html"), F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html or c == url]).alias("row"))
    table = written(boilerplate(rows.select("host", "html")), "host-runs")
    few = table.limit(broadcast_runs + 1).count() <= broadcast_runs
    schema = arrow_schema(rows, ["row"], "text string, boilerplate_blocks long")

    def decided(part: DataFrame, member: Callable) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = Runs()
            for batch in batches:
                out = []
                for i, (h, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                    marked, text, _ = blocks(x.as_py() or "")
                    out.append((text, 0) if marked else without(runs, h, text, member(batch, i)))
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([" ".join(t) for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["row", "text", "boilerplate_blocks"])

        return part.mapInArrow(work, schema)

    if few:
        every = spark.sparkContext.broadcast(np.sort(table.toArrow().column("run").to_numpy()))
        return decided(rows, lambda batch, i: _within(every.value))

    # At most FILTER_WORDS words come to the driver; what passes them is looked up in the table.
    slot, bit = F.shiftrightunsigned("run", 6).bitwiseAND(FILTER_WORDS - 1), F.expr("shiftleft(1L, CAST(run & 63 AS INT))")
    got = table.groupBy(slot.cast("int").alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    words = spark.sparkContext.broadcast(words)
    k1, k2 = F.xxhash64("host", "html"), F.xxhash64(F.lit(1), "host", "html")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, bits = Runs(), words.value
        for batch in batches:
            for i, (h, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                marked, text, _ = blocks(x.as_py() or "")
                r = np.unique(np.concatenate([np.zeros(0, np.int64), *[runs.hashes(runs.tokens(t), h) for t in text if not marked]]))
                r = r[(bits[(r >> 6) & (FILTER_WORDS - 1)] >> (r & 63)) & 1 == 1]
                if len(r):
                    at = pa.array([i] * len(r), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(r), batch.column(2).take(at), batch.column(3).take(at)], names=["run", "k1", "k2"])

    keyed = rows.withColumns({"k1": k1, "k2": k2})
    found = keyed.select("host", "html", "k1", "k2").mapInArrow(seek, "run long, k1 long, k2 long").distinct()
    own = found.join(table, "run", "left_semi").groupBy("k1", "k2").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    joined = keyed.join(own, ["k1", "k2"], "left").select("host", "html", "row", "runs")
    return decided(joined, lambda batch, i: _within(np.array(batch.column(3)[i].as_py() or [], np.int64)))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages", "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return extract(pages).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"), "boilerplate_blocks")
