"""Main text of web pages: markup structure, and a suffix array of each host's token streams.

Parsing turns a page into blocks of text with a zone: ``main`` inside an article or main element, ``chrome`` inside
elements that state another purpose (navigation, footers, adverts, forms, comments ...), ``open`` otherwise. The blocks of
a page are two token streams, that of its main blocks (the article) and that of all others (the frame). Each kind of a host's
streams forms one suffix array, sorted to ``RUN`` tokens and, for pages without a main zone, further to ``LONG`` tokens by
doubling. Spark ranks the heads by host, so a host may hold any share of the pages.

Pages that share a long run are copies of one text and form a group, unless the run is the host's template: on at least
``TEMPLATE`` pages and on more than half of the host's. A run is boilerplate where it stands in two groups or is template;
what only the copies of one text share is not. A block is removed when most of its tokens are boilerplate.

A page with an article or main element states its own main text. The suffixes that start one of its blocks are sorted to the
end of the block as well. What stands on at least ``NOTICE`` pages and on more than half of the host's is a notice: a block, or
a run of ``RUN`` tokens at any place. Blocks that are notices or wholly made of such runs are not part of the article. Copies
of an article and shared passages belong to it: pages that share a block of ``LONG`` tokens or more with another page do not
vote, and where notices would be over half of an article they stay. On any other page the open blocks that the suffix array
leaves are the text.

A run on more than half of a host's pages is on more than half of some group of them, however they are dealt. So the places
inside articles go through the order in two steps: short names of a page's runs, packed into one row, are counted in groups of
pages, and only places whose short name is that frequent somewhere are ranked by whole names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected_components, stored
from barloom.llm.url_filter import host_of

RUN = 6
LONG = 4 * RUN
TEMPLATE = 3
NOTICE = 5
COVERED = 0.5
#: Pages of a host whose article runs are counted together, and the bits of their short names (a whole name decides later).
TOGETHER = 64
SHORT_BITS = 16
ZSTD = pa.Codec("zstd")
#: Places in the table of covered places that may be broadcast (rows of other tables likewise); a larger one is joined by shuffle.
BROADCAST_PLACES = 1_000_000

#: Fixed values of HTML: elements without content, elements that start a block, elements that hold no page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
SILENT = frozenset("applet audio canvas datalist embed head iframe math noembed noframes noscript object rp script style svg template title video".split())
CHROME = frozenset("aside button dialog fieldset footer form input label menu nav optgroup option output select textarea".split())
CLOSES_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead title tr".split())
CHROME_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup "
    "promo promoted recommended related reply respond share sharing sidebar sidenav social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
OUTSIDE_WORDS = frozenset("header masthead topbar".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
NOT_NAME = re.compile(r"[^a-z0-9]+")


class _Blocks(HTMLParser):
    """Collects (text, zone) blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, silent, chrome, main (each inherited)
        self.blocks: list[tuple[str, str]] = []
        self.text: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections hold no text; one that the parser does not know ends at the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted."""
        return j

    def _flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text:
                _, _, chrome, main = self.stack[-1] if self.stack else ("", False, False, False)
                self.blocks.append((text, "chrome" if chrome else "main" if main else "open"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in CLOSES_P:
            self._close_p()
        elif tag in ("td", "th", "tr", "option"):
            self._close_until({tag} | ({"td", "th"} if tag != "option" else set()), {"table", "select"})
        if tag == "li":
            self._close_until({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close_until({"dt", "dd"}, {"dl"})
        if tag in ("article", "main"):
            self._leave_menus()
        if tag in VOID:
            return
        _, silent, chrome, main = self.stack[-1] if self.stack else ("", False, False, False)
        if not attrs:
            main = main or tag in ("article", "main")
            self.stack.append((tag, silent or tag in SILENT, chrome or tag in CHROME or not main and tag == "header", main))
            return
        a = {k: (v or "").lower() for k, v in attrs}
        main = main or tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articlebody"
        words = set(NOT_NAME.split(f"{a.get('class', '')} {a.get('id', '')}")) if "class" in a or "id" in a else set()
        named = bool(words & CHROME_WORDS) and tag not in ("html", "body", "article", "main")
        outside = not main and (tag == "header" or bool(words & OUTSIDE_WORDS) and tag not in ("html", "body"))
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", "")))
        chrome = chrome or tag in CHROME or named or outside or a.get("role") in ROLES or hidden
        self.stack.append((tag, silent or tag in SILENT, chrome, main))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in ("article", "main") and tag not in ("body", "html"):
                return  # a stray end tag does not reach out of an article

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.text.append(data)

    def _close_p(self) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag == "p":
                del self.stack[k:]
                return
            if tag in BLOCK:
                return

    def _close_until(self, tags: set[str], stop: set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in stop:
                return
            if self.stack[k][0] in tags:
                del self.stack[k:]
                return

    def _leave_menus(self) -> None:
        """An article does not stand inside a menu or form: such an element was not closed."""
        for k, (tag, _, _, _) in enumerate(self.stack):
            if tag in ("nav", "form", "head", "menu", "header"):
                del self.stack[k:]
                return


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """Blocks of a page in order: (text, zone)."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.blocks


def _stream(blocks: list[tuple[str, str]], article: bool = False) -> tuple[list[str], list[int]]:
    """Tokens of the frame or of the article, and the number of them in each block (0 for blocks of the other stream)."""
    tokens, sizes = [], []
    for text, zone in blocks:
        own = text.split() if (zone == "main") == article else []
        tokens += own
        sizes.append(len(own))
    return tokens, sizes


def _heads(tokens: list[str], run: int) -> np.ndarray:
    """A 64-bit name of the ``run`` tokens at each place of a stream, mixed from names of the tokens."""
    n = max(len(tokens) - run + 1, 0)
    names = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens] if n else [], np.uint64)
    out = names[:n].copy()
    for k in range(1, run):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + names[k : k + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _long_heads(heads: np.ndarray, run: int, long: int) -> np.ndarray:
    """Names of the ``long`` tokens at each place, doubled from names of ``run`` tokens; long / run is a power of two."""
    names, size = heads.view(np.uint64), run
    with np.errstate(over="ignore"):
        while size < long:
            names = names[: max(len(names) - size, 0)] * np.uint64(0x9E3779B97F4A7C15) ^ (names[size:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(size))
            names ^= names >> np.uint64(31)
            size *= 2
    return names.view(np.int64)


def _short(heads: np.ndarray) -> np.ndarray:
    return (heads.view(np.uint64) >> np.uint64(64 - SHORT_BITS)).astype(np.uint16)


def _packed(heads: np.ndarray) -> tuple[int, bytes]:
    """The different short names among ``heads``: how many, and their steps in order, all low bytes before all high ones, compressed."""
    marked = np.zeros(1 << SHORT_BITS, bool)
    marked[_short(heads)] = True
    steps = np.diff(np.flatnonzero(marked), prepend=0).astype("<u2")
    return len(steps), ZSTD.compress(steps.view(np.uint8).reshape(-1, 2).T.tobytes(), asbytes=True)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(ZSTD.decompress(packed, 2 * size, asbytes=True), np.uint8).reshape(2, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u2").ravel(), dtype=np.int64)


def _page_key(html: str | None) -> int:
    return xxhash.xxh3_64_intdigest(html or "") - (1 << 63)


def _article(blocks: list[tuple[str, str]], long: int) -> tuple[list[int], list[int], list[int | None]]:
    """Main blocks: their numbers, the 64-bit names of all their tokens, and the names again where they have ``long`` tokens."""
    main = [(k, text.split()) for k, (text, zone) in enumerate(blocks) if zone == "main"]
    names = [xxhash.xxh3_64_intdigest("\0".join(tokens)) - (1 << 63) for _, tokens in main]
    return [k for k, _ in main], names, [n if len(tokens) >= long else None for n, (_, tokens) in zip(names, main, strict=True)]


def suffixes(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Every suffix of every stream (url, html, page_key): host, head, page (the html's name), page_key, at, open, long, article, runs.

    ``open`` marks pages without a main zone, whose blocks depend on runs; they also have ``long``, the name of four times
    as many tokens, null where fewer follow. ``article`` marks the suffixes that start a main block: ``at`` is the number of
    the block, ``head`` names all its tokens, ``long`` too if they are as many. All suffixes of an article are one more row
    (``article`` null): ``runs`` holds the short names of their heads, ``at`` how many different ones there are.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hosts, names, free, counts, found, longs = [], [], [], [], [], [np.empty(0, np.int64)], [pa.nulls(0, pa.int64())]
            places, marks, runs = [np.empty(0, np.int64)], [], []
            for key, host, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks = blocks_of(html)
                h = _heads(_stream(blocks)[0], run)
                found.append(h)
                counts.append(len(h))
                keys.append(key), hosts.append(host), names.append(_page_key(html))
                free.append(all(zone != "main" for _, zone in blocks))
                far = _long_heads(h, run, LONG // RUN * run) if free[-1] else h[:0]
                longs += [pa.array(far, pa.int64()), pa.nulls(len(h) - len(far), pa.int64())]
                places.append(np.arange(len(h)))
                marks += [False] * len(h)
                runs += [None] * len(h)
                numbers, whole, long = _article(blocks, LONG // RUN * run)
                found.append(np.array(whole, np.int64))
                counts[-1] += len(whole)
                longs.append(pa.array(long, pa.int64()))
                places.append(np.array(numbers, np.int64))
                marks += [True] * len(whole)
                runs += [None] * len(whole)
                inside = _heads(_stream(blocks, True)[0], run)
                if len(inside):
                    found.append(np.zeros(1, np.int64))
                    counts[-1] += 1
                    longs.append(pa.nulls(1, pa.int64()))
                    many, packed = _packed(inside)
                    places.append(np.array([many]))
                    marks.append(None)
                    runs.append(packed)
            index = pa.array(np.repeat(np.arange(len(counts)), counts))
            at = np.concatenate(places).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hosts, pa.string()).take(index), pa.array(np.concatenate(found), pa.int64()), pa.array(names, pa.int64()).take(index),
                    pa.array(keys, pa.binary()).take(index), pa.array(at), pa.array(free, pa.bool_()).take(index),
                    pa.concat_arrays(longs), pa.array(marks, pa.bool_()), pa.array(runs, pa.binary()),
                ],
                names=["host", "head", "page", "page_key", "at", "open", "long", "article", "runs"],
            )

    rows = pages.select("page_key", host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(heads, "host string, head long, page long, page_key binary, at int, open boolean, long long, article boolean, runs binary")


def _template(n: str) -> Column:
    return (F.col(n) >= TEMPLATE) & (2 * F.col(n) > F.col("pages"))


def copy_groups(suffix: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pages of a host that share long runs, template aside, over any number of steps: host, page, root."""
    runs = suffix.where("long is not null").select("host", "long", "page").distinct()
    ranked = runs.groupBy("host", "long").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("hub")).where("n > 1")
    ranked = ranked.join(sizes, "host").where(~_template("n")).select("host", "long", "hub")
    links = stored(runs.join(ranked, ["host", "long"]).where("page != hub").select("host", "page", "hub").distinct(), "copies")
    name = lambda c: F.xxhash64("host", c)
    ends = links.select("host", "page").union(links.select("host", F.col("hub").alias("page"))).distinct()
    if not links.limit(1).count():
        return ends.withColumn("root", F.col("page"))
    roots = connected_components(links.select(name("page").alias("a"), name("hub").alias("b")))
    return ends.withColumn("vertex", name("page")).join(roots, "vertex").select("host", "page", "root")


def repeated_runs(suffix: DataFrame) -> DataFrame:
    """Heads of open pages that are boilerplate of their host: host, head. Equal pages count once, copies as one group."""
    suffix = suffix.where("not article")
    sizes = stored(suffix.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    groups = copy_groups(suffix, sizes)
    wanted = suffix.where("open").select("host", "head").distinct()
    rows = suffix.join(wanted, ["host", "head"], "left_semi").select("host", "head", "page").distinct()
    rows = rows.join(groups, ["host", "page"], "left").withColumn("root", F.coalesce("root", F.xxhash64("host", "page")))
    ranked = rows.groupBy("host", "head").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return ranked.where("n > 1").join(sizes, "host").where((F.col("low") != F.col("high")) | _template("n")).select("host", "head")


def voters(suffix: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Main blocks of the pages that vote (host, head, page), the pages that do not (host, page) and the voters (host, pages).

    Equal pages count once; copies and sharers of a passage do not vote.
    """
    blocks = stored(suffix.where("article").select("host", "head", "long", "page").distinct(), "blocks")
    shared = blocks.where("long is not null").groupBy("host", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stored(blocks.where("long is not null").join(shared, ["host", "head"], "left_semi").select("host", "page").distinct(), "sharers")
    votes = blocks.join(copies, ["host", "page"], "left_anti").select("host", "head", "page")
    sizes = votes.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return votes, copies, stored(sizes.where(F.col("pages") >= NOTICE), "voters")


def _frequent(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of distinct ``rows`` (host, head, page) of voters the heads that are notices: host, head."""
    ranked = rows.groupBy("host", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= NOTICE)
    return ranked.join(sizes, "host").where("2 * n > pages").select("host", "head")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a table that was written, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_PLACES else df


def frequent_names(suffix: DataFrame, copies: DataFrame, sizes: DataFrame) -> DataFrame:
    """Short names of article runs on more than half of some group of a host's voters: host, names."""
    group = F.pmod(F.xxhash64("page"), F.ceil(F.col("pages") / TOGETHER)).alias("deal")
    rows = suffix.where("runs is not null").join(_small(sizes), "host").join(_small(copies), ["host", "page"], "left_anti")
    rows = rows.select("host", group, "page", "at", "runs", "pages").repartition("host", "deal").sortWithinPartitions("host", "deal")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, total, least = None, set(), np.zeros(1 << SHORT_BITS, np.int32), 0

        def names() -> list[int]:
            return np.flatnonzero(total >= max(len(seen) // 2 + 1, least)).tolist() if key else []

        for b in batches:
            out: list[tuple[str, list[int]]] = []
            for host, deal, page, size, runs, pages in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (host, deal) != key:
                    out.append((key and key[0], names()))
                    key, seen, total = (host, deal), set(), np.zeros(1 << SHORT_BITS, np.int32)
                    least = NOTICE if pages <= TOGETHER else 1  # the only group of its host
                if page not in seen:
                    seen.add(page)
                    total[_unpacked(runs, size)] += 1
            yield from _named(out)
        yield from _named([(key and key[0], names())])

    found = rows.mapInArrow(count, "host string, name int").distinct()
    return stored(found.groupBy("host").agg(F.collect_list("name").alias("names")), "names")


def _named(found: list[tuple[str | None, list[int]]]) -> Iterator[pa.RecordBatch]:
    hosts, names = [h for h, own in found for _ in own], [n for _, own in found for n in own]
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.int32())], names=["host", "name"])


def article_runs(pages: DataFrame, suffix: DataFrame, copies: DataFrame, sizes: DataFrame, run: int = RUN) -> DataFrame | None:
    """Places of articles where a run starts that is a notice of the host: page_key, at. None where no run is frequent."""
    names = frequent_names(suffix, copies, sizes)
    if not names.limit(1).count():
        return None

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for key, host, html, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                heads = _heads(_stream(blocks_of(html), True)[0], run)
                at = np.flatnonzero(np.isin(_short(heads), np.array(wanted, np.uint16)))
                for column, values in zip(out, ([host] * len(at), heads[at].tolist(), [_page_key(html)] * len(at), [key] * len(at), at.tolist()), strict=True):
                    column += values
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["host", "head", "page", "page_key", "at"])

    rows = pages.select("page_key", host_of(F.col("url")).alias("host"), "html").join(_small(names), "host").select("page_key", "host", "html", "names")
    rows = stored(rows.mapInArrow(places, "host string, head long, page long, page_key binary, at int"), "places")
    votes = rows.select("host", "head", "page").distinct().join(copies, ["host", "page"], "left_anti")
    return rows.join(_frequent(votes, sizes), ["host", "head"]).select("page_key", "at")


def article_text(blocks: list[tuple[str, str]], repeated: list[int] | None, runs_at: list[int] | None = None, run: int = RUN) -> str:
    """The main blocks without the notices among them, which are over half of the text or go.

    Notices are the blocks of the given numbers and those wholly made of runs that start at the given places of the article.
    """
    sizes = {k: len(text.split()) for k, (text, zone) in enumerate(blocks) if zone == "main"}
    drop = set(repeated or [])
    if runs_at:
        covered = np.zeros(sum(sizes.values()), bool)
        for at in runs_at:
            covered[at : at + run] = True
        ends = np.cumsum(list(sizes.values()))
        drop |= {k for (k, n), end in zip(sizes.items(), ends, strict=True) if n and covered[end - n : end].all()}
    if sum(sizes[k] for k in drop) > COVERED * sum(sizes.values()):
        drop = set()
    return "\n\n".join(blocks[k][0] for k in sizes if k not in drop)


def text_of(blocks: list[tuple[str, str]], covered_at: list[int] | None, run: int = RUN, runs_at: list[int] | None = None) -> str:
    """The main text, given the places of the frame where a repeated run starts, or an article's notices: blocks, places of runs."""
    if any(zone == "main" for _, zone in blocks):
        return article_text(blocks, covered_at, runs_at, run)
    tokens, sizes = _stream(blocks)
    covered = np.zeros(len(tokens), bool)
    for at in covered_at or []:
        covered[at : at + run] = True
    ends = np.cumsum(sizes)
    kept = [
        text for (text, zone), n, end in zip(blocks, sizes, ends, strict=True)
        if zone == "open" and covered[end - n : end].sum() <= COVERED * n
    ]
    return "\n\n".join(kept)


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html has empty text. A null or malformed url belongs to the empty host. Repeated rows give equal rows
    and do not make their own text a repeat; an empty table gives no rows; other columns are not read.
    """
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))))
    pages = pages.select("page_id", "url", "html", key.alias("page_key"))
    suffix = stored(suffixes(pages, run), "suffixes")
    votes, copies, sizes = voters(suffix)
    hits = suffix.where("article").join(_frequent(votes, sizes), ["host", "head"])
    if suffix.where("open").limit(1).count():
        runs = suffix.where("open and not article").join(repeated_runs(suffix), ["host", "head"])
        hits = hits.unionByName(runs.select(hits.columns))
    hits = hits.select("page_key", "at", F.lit(False).alias("inside"))
    inside = article_runs(pages, suffix, copies, sizes, run)
    if inside is not None:
        hits = hits.unionByName(inside.withColumn("inside", F.lit(True)))
    of = lambda kind: F.collect_set(F.when(F.col("inside") == kind, F.col("at")))
    covered = stored(hits.groupBy("page_key").agg(of(False).alias("covered"), of(True).alias("runs")), "covered")
    size = covered.agg(F.sum(F.size("covered") + F.size("runs"))).first()[0] or 0
    covered = F.broadcast(covered) if size <= BROADCAST_PLACES else covered

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [text_of(blocks_of(h), c, run, r) for h, c, r in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.join(covered, "page_key", "left").select("page_id", "url", "html", "covered", "runs")
    return rows.mapInArrow(texts, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
