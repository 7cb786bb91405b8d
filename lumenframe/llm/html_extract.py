"""Main text of web pages: page structure, and a suffix array over the pages of a host.

1. Each page is cut into blocks of text, each with the zone it stands in: main (an article or main element),
   aside (menus, headers, footers, forms, adverts, notices, comments and the like, by element or class) or open.
2. The token streams of a host's pages are concatenated and sorted as a suffix array. Token runs that
   occur on distinct pages and are REPEAT_TOKENS or longer (or fill their block) are covered.
3. Main blocks are kept, aside blocks dropped. Of open blocks, covered runs are removed as boilerplate and the
   runs unique to the page are kept, whether the page has main blocks or not.

A main block of REPEAT_TOKENS or more is dropped only if all of it also stands in an aside zone of another page. Hosts are
cut into groups of GROUP_PAGES pages by a hash, so no task holds a whole large host. What two groups of a host share
is found by a shuffle of hashes: of the runs that could be covered, the same runs on all pages, and of whole blocks.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import bounded_batches, checkpointed
from lumenframe.llm.text import mix64, range_hashes

REPEAT_TOKENS = 8
GROUP_PAGES = 256
#: Up to so many hosts their page counts are broadcast; beyond, pages and counts are merge-joined.
BROADCAST_HOSTS = 50_000
#: Pages of a task, on average, where the session's shuffle partitions would hold more.
TASK_PAGES = 2048
#: Of hashed runs that could be covered so many leading bits are known when all runs are sent; a full map costs time, not runs.
MAP_BITS = 21

# Fixed values of HTML: elements without content, with raw content, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav header footer aside form menu dialog fieldset head".split())
#: Class, id and role words of asides.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|"
    r"header|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|comments?|replies|reply|discussion|disqus|pagination|pager|toolbar|skip|copyright|legal)(?=$|[\s_-])",
    re.I,
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article(?:[_-]?body)?|main|post(?:[_-]?(?:body|content))?|entry(?:[_-]?content)?|story|content)(?=$|[\s_-])", re.I)
# An open p ends where a block begins; an open li, dd, dt, option, tr, td or th where another begins.
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_NAME = re.compile(r"/?([A-Za-z][^\s/>\"'<]*)")
_SPECIAL = re.compile(r"[>\"']")
#: A whole tag: its name, and its attributes up to the first > outside quotes. Longer ones than TAG_WINDOW are left to _Tags.
_TAG = re.compile(r"/?([A-Za-z][^\s/>\"'<]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
TAG_WINDOW = 512
# Inline elements whose end tag reaches no further than into these.
INLINE = frozenset(("p", "b", "i", "span", "a", "em", "strong"))
BARRIERS = frozenset(("article", "main", "td", "body"))
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@functools.lru_cache(maxsize=1 << 12)  # of short tags: at most TAG_WINDOW characters each
def _short_zone(tag: str, attributes: str, above: str) -> str:
    return _zone(tag, attributes, above)


def _zone(tag: str, attributes: str, above: str) -> str:
    if above == "aside":
        return above
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    named = f"{found.get('class', '')} {found.get('id', '')}"
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ASIDE_ROLES:
        return "aside"
    if tag == "header" and above == "main":  # the head of an article holds its title
        return "aside" if ASIDE_WORDS.search(named.replace("header", "")) else above
    if tag in ASIDE or (tag not in ("html", "body", "article", "main") and ASIDE_WORDS.search(named)):
        return "aside"
    if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or (tag in ("div", "section") and MAIN_WORDS.search(named)):
        return "main"
    return above


class _Tags:
    """Where the tags of a page end, in time that grows with the page whatever it holds: what was found is kept for the
    positions that follow."""

    def __init__(self, page: str):
        self.page, self.ends = page, {}  # of quotes outside quotes: the end of the tag they stand in
        self.next: dict[str, tuple[int, int]] = {}

    def find(self, what: str, at: int) -> int:
        """page.find(what, at); positions asked for must not fall."""
        asked, found = self.next.get(what, (-1, -2))
        if found == -2 or (found >= 0 and found < at):
            asked, found = at, self.page.find(what, at)
            self.next[what] = (asked, found)
        return found

    def special(self, at: int) -> int:
        """The next > or quote; positions asked for must not fall."""
        asked, found = self.next.get("", (-1, -2))
        if found == -2 or (found >= 0 and found < at):
            m = _SPECIAL.search(self.page, at)
            found = m.start() if m else -1
            self.next[""] = (at, found)
        return found

    def end(self, at: int) -> int:
        """Where the first > outside quotes is from `at` on, or -1."""
        page, passed, k = self.page, [], self.special(at)
        while k >= 0 and page[k] != ">" and k not in self.ends:
            passed.append(k)
            close = page.find(page[k], k + 1)
            m = _SPECIAL.search(page, close + 1) if close >= 0 else None
            k = m.start() if m else -1
        k = self.ends.get(k, k)
        self.ends.update(dict.fromkeys(passed, k))
        return k


class _Open:
    """The open elements and their zones, with the places of each name, of blocks and of barriers, so that no tag walks
    through elements that it doesn't end."""

    def __init__(self):
        self.tags: list[str] = []
        self.zones: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.barriers: list[int] = []

    def zone(self) -> str:
        return self.zones[-1] if self.zones else "open"

    def push(self, tag: str, zone: str) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.zones.append(zone)
        self.places.setdefault(tag, []).append(k)
        if tag in BLOCKS:
            self.blocks.append(k)
        if tag in BARRIERS:
            self.barriers.append(k)

    def cut(self, k: int) -> None:
        """Ends the elements from place k on."""
        while len(self.tags) > k:
            self.places[self.tags.pop()].pop()
            self.zones.pop()
        for places in (self.blocks, self.barriers):
            while places and places[-1] >= k:
                places.pop()


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page in order: references decoded, white space one space, trimmed, not empty.

    A < that begins no tag (nothing ends it outside quotes) is text.
    """
    out: list[tuple[str, str]] = []
    stack, tags = _Open(), _Tags(page)
    parts: list[str] = []
    ends: dict[str, tuple[int, int]] = {}  # of elements with raw content: the next end tag
    at = seen = 0

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append((stack.zone(), text))

    while True:
        k = page.find("<", seen)
        if k < 0:
            break
        if page.startswith(("<!", "<?"), k):
            comment = page.startswith("<!--", k)
            end = tags.find("-->", k + 4) if comment else tags.find(">", k + 2)
            if end < 0 and not comment:
                seen = k + 1
                continue
            parts.append(page[at:k])
            at = seen = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        m = _TAG.match(page, k + 1, k + 1 + TAG_WINDOW)
        if m:
            end, attributes, zone_of = m.end() - 1, m[2], _short_zone
        else:
            m = _NAME.match(page, k + 1)
            end = tags.end(m.end()) if m else -1
            if end < 0:
                seen = k + 1
                continue
            attributes, zone_of = page[m.end() : end], _zone
        if at < k:
            parts.append(page[at:k])
        at = seen = end + 1
        tag = m[1].lower()
        if page[k + 1] == "/":
            place = stack.places.get(tag)
            if place and not (tag in INLINE and stack.barriers and stack.barriers[-1] > place[-1]):
                if stack.blocks and stack.blocks[-1] >= place[-1]:
                    close_block()
                stack.cut(place[-1])
            continue
        if tag in RAW:  # its content isn't text of the page
            found = ends.get(tag)
            if found is None or 0 <= found[0] < at:
                e = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                found = ends[tag] = e.span() if e else (-1, -1)
            if found[0] >= 0:
                at = seen = found[1]
            elif tag in ("script", "style", "title", "textarea"):
                at = seen = len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        if tag in BLOCKS:
            close_block()
            while stack.blocks:  # elements that a block ends without saying so
                place = stack.blocks[-1]
                t = stack.tags[place]
                if t != "p" and t not in SAME_ENDS.get(tag, ()):
                    break
                stack.cut(place)
                if t == "p" or tag != "tr":
                    break
        if not attributes.rstrip().endswith("/"):
            stack.push(tag, zone_of(tag, attributes, stack.zone()))
    parts.append(page[at:])
    close_block()
    return out


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first `depth` tokens at least, by doubling."""
    rank, n, k = np.unique(tokens, return_inverse=True)[1].astype(np.int64), len(tokens), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - k, 0)] = rank[k:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        new = np.zeros(n, np.int64)
        new[1:] = both[order[1:]] != both[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        k *= 2
        if k >= depth or rank[order[-1]] == n - 1:
            return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of what each suffix in order shares with the one before it (0 for the first)."""
    n = len(tokens)
    out, live = np.zeros(n, np.int64), np.arange(1, n)
    for k in range(most):
        a, b = order[live] + k, order[live - 1] + k
        inside = (a < n) & (b < n)
        live = live[inside]
        live = live[tokens[a[inside]] == tokens[b[inside]]]
        if not len(live):
            break
        out[live] += 1
    return out


def covered(streams: list[np.ndarray], owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens of the concatenated block streams lie in a run that other pages (owner) have too.

    A run counts if it has REPEAT_TOKENS or fills its block. Streams end in tokens of their own, so no run crosses
    two blocks.
    """
    tokens = np.concatenate(streams)
    order = suffix_array(tokens, REPEAT_TOKENS)
    need = np.minimum(REPEAT_TOKENS, ends - np.arange(len(tokens)))  # to the end of the block, for shorter ones
    whole = np.concatenate([[True], np.diff(ends) > 0])  # where a block begins
    shared = common_prefixes(tokens, order, REPEAT_TOKENS)
    # Suffixes that agree in REPEAT_TOKENS tokens stand together: a group repeats if it has two owners.
    least = np.where(whole[order], need[order], REPEAT_TOKENS)
    mark = np.zeros(len(tokens), bool)
    for limit in range(1, REPEAT_TOKENS + 1):
        group = np.cumsum(np.concatenate([[True], shared[1:] < limit]))
        low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        high = np.full(group[-1] + 1, -1)
        np.minimum.at(low, group, owner[order])
        np.maximum.at(high, group, owner[order])
        mark[order[(low != high)[group] & (least == limit)]] = True
    length = np.where(whole, need, REPEAT_TOKENS)
    reach = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(mark)
    np.add.at(reach, at, 1)
    np.add.at(reach, np.minimum(at + length[at], len(tokens)), -1)
    return np.cumsum(reach[:-1]) > 0


def run_hashes(texts: list[str], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First word and number of words of each text, these laid end to end; and for each length up to REPEAT_TOKENS
    the salted hash of the run of so many words from each word on (within a text, else of no meaning)."""
    n = np.array([t.count(" ") + 1 for t in texts], np.int64)
    raw = np.frombuffer(" ".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    gap = np.flatnonzero(raw == 32)
    h = range_hashes(raw, np.append(0, gap + 1), np.append(gap, len(raw)))
    salt, out, v = np.repeat(salt, n), [], np.zeros(len(h), np.uint64)
    for k in range(REPEAT_TOKENS):
        v = v * np.uint64(0x9E3779B97F4A7C15)
        v[: max(len(h) - k, 0)] += h[k:]
        out.append(mix64(v ^ salt ^ np.uint64(k + 1)))
    return np.cumsum(n) - n, n, out


def coverable(first: np.ndarray, n: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and hash of the runs of these texts that count: of REPEAT_TOKENS words, or a whole shorter text."""
    at, length = [first[n < REPEAT_TOKENS]], [n[n < REPEAT_TOKENS]]
    for a, m in zip(first[n >= REPEAT_TOKENS].tolist(), n[n >= REPEAT_TOKENS].tolist(), strict=True):
        at.append(np.arange(a, a + m - REPEAT_TOKENS + 1))
    length.append(np.full(sum(map(len, at[1:])), REPEAT_TOKENS))
    start, length = np.concatenate(at), np.concatenate(length)
    return start, length, np.array(hashes)[length - 1, start]


def block_hashes(texts: list[str], salt: np.ndarray) -> np.ndarray:
    """Salted hashes of whole blocks, apart from those of runs."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(x) for x in data])
    return mix64(range_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends) ^ salt)


def decided(zones: list[str]) -> list[bool]:
    """The blocks of a page on whose runs the suffix array decides."""
    return [z == "open" for z in zones]


def choose(pages: list[tuple[list[str], list[str]]], salt: int = 0, shared: np.ndarray | None = None) -> list[str]:
    """The text of each page of a group of one host, from its (zones, texts of blocks); shared has the (salted) hashes
    of runs, and of main blocks that are asides, that other groups of the host have."""
    every = [t for _, texts in pages for t in texts]
    if not every:
        return ["" for _ in pages]
    size = np.array([t.count(" ") + 1 for t in every], np.int64)
    words = " ".join(every).split(" ")  # of all blocks, laid end to end
    ids, names = pd.factorize(np.array(words, object))
    last = np.cumsum(size + 1) - 1  # a block's tokens are those of its words, and one of its own
    tokens = np.empty(last[-1] + 1, np.int64)
    tokens[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
    tokens[last] = len(names) + np.arange(len(size))
    owner = np.repeat(np.repeat(np.arange(len(pages)), [len(texts) for _, texts in pages]), size + 1)
    hit = covered([tokens], owner, np.repeat(last, size + 1))
    aside_there: set[str] = set()
    if shared is not None and len(shared):
        flat = [(z, t, d) for zones, texts in pages for z, t, d in zip(zones, texts, decided(zones), strict=True)]
        salts = np.full(len(flat), salt, np.int64).view(np.uint64)
        first, n, hashes = run_hashes([t for _, t, _ in flat], salts)
        open_ = np.array([d for _, _, d in flat])
        start, length, h = coverable(first[open_], n[open_], hashes)
        found = np.isin(h, shared)
        reach = np.zeros(n.sum() + 1, np.int64)
        np.add.at(reach, start[found], 1)
        np.add.at(reach, start[found] + length[found], -1)
        word = np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)  # hit has one more for the end of each block
        hit[word] |= np.cumsum(reach[:-1]) > 0
        aside_there = {t for (z, t, _), x in zip(flat, np.isin(block_hashes([t for _, t, _ in flat], salts), shared), strict=True) if x and z == "main"}
    elsewhere: dict[str, set[int]] = {}
    for p, (zones, texts) in enumerate(pages):
        for z, t in zip(zones, texts, strict=True):
            if z == "aside":
                elsewhere.setdefault(t, set()).add(p)
    sums = np.append(0, np.cumsum(hit))
    hits = (sums[last] - sums[last - size]).tolist()  # covered words of each block
    sizes, starts, out, k = size.tolist(), (last - size).tolist(), [], 0
    for p, (zones, texts) in enumerate(pages):
        kept = []
        for z, t, by_array in zip(zones, texts, decided(zones), strict=True):
            n, gone = sizes[k], hits[k]
            if z == "main":
                if not (n >= REPEAT_TOKENS and (t in aside_there or (gone == n and elsewhere.get(t, set()) - {p}))):
                    kept.append(t)
            elif by_array and gone < n:
                kept.append(" ".join(words[starts[k] - k + i] for i in np.flatnonzero(~hit[starts[k] : starts[k] + n]).tolist()) if gone else t)
            k += 1
        out.append("\n\n".join(kept))
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null and empty pages, and pages without main text, give an empty text. A null or odd url counts as a host of its
    own. Rows that repeat a key get a row each (copies of a page don't make its main blocks boilerplate). Other
    columns are not read. An empty table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                made = [blocks(x or "") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([[z for z, _ in m] for m in made], pa.list_(pa.string())), pa.array([[t for _, t in m] for m in made], pa.list_(pa.string()))], names=["page_id", "url", "zones", "texts"])

    def group(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        text = choose(list(zip(pdf["zones"].map(list), pdf["texts"].map(list), strict=True)), int(pdf["salt"].iloc[0]) if len(pdf) else 0, found["hash"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    def blocks_of(b: pa.RecordBatch) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Zone, text, whether the array decides, salt and group of the blocks of pages on hosts of several groups."""
        zones, texts, decides, salt, gid = [], [], [], [], []
        for r in b.select(["zones", "texts", "salt", "gid", "parts"]).to_pylist():
            if r["parts"] > 1:
                zones += r["zones"]
                texts += r["texts"]
                decides += decided(r["zones"])
                salt += [r["salt"]] * len(r["zones"])
                gid += [r["gid"]] * len(r["zones"])
        return zones, texts, np.array(decides, bool), np.array(salt, np.int64).view(np.uint64), np.array(gid, np.int64)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, texts, decides, salt, _ = blocks_of(b)
            if decides.any():
                h = coverable(*run_hashes([t for t, d in zip(texts, decides, strict=True) if d], salt[decides]))[2]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h >> np.uint64(64 - MAP_BITS)).astype(np.int64))], names=["place"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << MAP_BITS, bool)
        known[shared.value] = True
        for b in batches:
            zones, texts, decides, salt, gid = blocks_of(b)
            if not texts:
                continue
            whole = block_hashes(texts, salt)
            aside = np.array([z == "aside" for z in zones])
            main = np.array([z == "main" and t.count(" ") >= REPEAT_TOKENS - 1 for z, t in zip(zones, texts, strict=True)])
            parts = [(whole[main], gid[main], True, False), (whole[aside], gid[aside], False, True)]
            if len(shared.value):
                first, n, hashes = run_hashes(texts, salt)
                owner = np.repeat(gid, n)
                start, _, h = coverable(first[decides], n[decides], hashes)
                parts.append((h, owner[start], True, True))
                left = np.repeat(first + n, n) - np.arange(n.sum())
                for k, h in enumerate(hashes):
                    some = (left > k) & known[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)]
                    parts.append((h[some], owner[some], False, True))
            for h, g, want, offer in parts:
                if len(h):
                    order = np.lexsort((g, h))
                    h, g = h[order], g[order]
                    once = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
                    m = int(once.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(g[once]), pa.array(np.full(m, want)), pa.array(np.full(m, offer))], names=["hash", "gid", "want", "offer"])

    bounded_batches(pages)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")), F.lit(""))
    counts = checkpointed(rows.groupBy(host.alias("host")).agg(F.ceil(F.count("*") / GROUP_PAGES).alias("parts"), F.count("*").alias("n")))
    hosts, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = counts.drop("n")
    counts = F.broadcast(counts) if hosts <= BROADCAST_HOSTS else counts.hint("merge")
    made = rows.mapInArrow(cut, "page_id long, url string, zones array<string>, texts array<string>").withColumn("host", host)
    dealt = made.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")))
    dealt = dealt.select("page_id", "url", "zones", "texts", "parts", F.xxhash64("host").alias("salt"), F.xxhash64("host", "part").alias("gid"))
    several = dealt.where("parts > 1").mapInArrow(places, "place long").distinct().toArrow()
    shared = pages.sparkSession.sparkContext.broadcast(several["place"].to_numpy())
    # By group, else the parts of a host would stay in the task of the join by host; tasks grow in number with the pages.
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_PAGES)
    dealt = dealt.repartition(tasks, "gid")
    sent = dealt.mapInArrow(send, "hash long, gid long, want boolean, offer boolean").repartition("hash")
    offers = sent.where("offer").groupBy("hash").agg(F.min("gid").alias("least"), F.max("gid").alias("most"))
    found = sent.where("want").select("hash", "gid").distinct().join(offers.hint("merge"), "hash").where("least <> gid OR most <> gid").select("gid", "hash")
    out = dealt.groupBy("gid").cogroup(found.groupBy("gid")).applyInPandas(group, "page_id long, url string, text string, n_chars long")
    return out.withColumnRenamed("page_id", key).withColumnRenamed("url", url)
