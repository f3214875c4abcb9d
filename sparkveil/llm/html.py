"""Main text of web pages, with a suffix array per host.

A page is read as a stream of blocks. The token streams of a host's pages are
concatenated, block ends among them, and strings of at least ``TOKENS`` symbols
that distinct pages repeat are found with a suffix array. What they cover is
boilerplate by how many pages have it, and the other runs stay. Elements give the
prior:

- in an article or main element, a block goes if half of the host's pages repeat
  it (``MOST``, ``MOST_SHARE``);
- beside such elements, or on a page without, a block goes if a few pages repeat
  it (``PAGES``, ``SHARE``), and from other blocks go the tokens that strings of
  half the pages cover (with ``REAL`` tokens at least, beside ends of blocks);
- what elements, class names or roles mark as menu, footer, advert, form,
  comments and the like goes in any case.

Pages are distinct if their longest blocks are: copies of an article under many
addresses are one page, so an article isn't taken for boilerplate because it was
copied.

Distinct pages of one host are dealt to groups of about ``GROUP`` pages by a hash
of that block, so a host of any size is worked on in parallel and a group fits
in memory. What reaches a share of a host's pages reaches it in one of its
groups at least, so the groups' suffix arrays together find all there is; these
blocks and strings are then counted over all pages of the host, and that count
decides. Beyond its group each goes by 64 bits. As each takes its share of the
pages, a host has no more of them than a mean page has blocks by ``1 / SHARE``,
and tokens by ``1 / MOST_SHARE``.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .features import word_hashes
from .suffixes import common_prefixes, suffix_array

GROUP = 256
#: Tokens of a repeated string, and for how many of them the end of a block counts, so that a block of one word between two others is a string too.
TOKENS, END = 6, 3
#: Tokens, not ends of blocks, that a string has which cuts a part of a block.
REAL = 4
#: The distinct pages of a host that must have a string: this many, and this share; and so many for what goes from articles too.
PAGES, SHARE = 3, 0.01
MOST, MOST_SHARE = 5, 0.5
ARTICLE, OPEN, MARKED = 0, 1, 2

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is read as raw text up to their end tag, and is never shown.
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "audio", "video", "canvas", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "label", "datalist"}
#: Elements that start and end a block; all others run on in the line.
_BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
#: Words of a class, id or role that mark boilerplate.
_WORDS = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus replies respond form search skip pagination pager toolbar widget".split())
#: Of these, words that a page's frame may have too ("with-sidebar"): an article inside is read all the same.
_LAYOUT = set("nav navbar navigation menu menubar header masthead footer sidebar ad ads cookie cookies modal overlay search".split())
#: In an article, words that a heading's element may have.
_HEADING = {"header", "masthead", "banner"}
#: Start tags that end an open element of the same kind.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_MARK = np.uint64(0x9D3F00A1C55E7B21)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _boilerplate(name: str, attributes: str, in_article: bool) -> int:
    """0: no boilerplate; 1: boilerplate; 2: boilerplate, unless an article is inside."""
    if name in _DROP or (name == "header" and not in_article):
        return 1
    if not attributes or name in ("body", "html", "main"):
        return 0
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return 1
        if kind == "style":
            if "display:none" in re.sub(r"\s", "", value.lower()):
                return 1
        elif kind in ("class", "id", "role"):
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            found |= _WORDS.intersection(words)
    if in_article or name == "article":
        found -= _HEADING
    return 0 if not found else 2 if found <= _LAYOUT else 1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block of a page that has text, in order; kinds: ARTICLE, OPEN, MARKED. Character references are decoded, white space runs are one space."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, int, int, bool]] = []  # name; hard and soft boilerplate around it; whether it starts an article
    hard = soft = articles = 0
    held: list[str] = []

    def close_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((MARKED if hard or soft else ARTICLE if articles else OPEN, text))

    def pop() -> None:
        nonlocal hard, soft, articles
        _, hard, soft, a = stack.pop()
        articles -= a

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _BLOCK:
            close_block()
        if closing:
            if any(x[0] == name for x in stack):
                # an end tag inside dropped or article content doesn't close elements outside of it
                while stack and stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _RAW:
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                found = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
                at = found.end() if found else end
            continue
        if name in _VOID or m[3].endswith("/") and name in ("svg", "math"):
            continue
        while stack and stack[-1][0] in _CLOSES.get(name, ()):
            pop()
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        d = _boilerplate(name, m[3], articles > 0)
        a = not d and not hard and (name in ("article", "main") or 'role="main"' in m[3])
        stack.append((name, hard, soft, a))
        hard, soft, articles = hard + (d == 1), 0 if a else soft + (d == 2), articles + a
    close_block()
    return out


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def stream_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a page's blocks, 64 bits for each token and ``END`` marks before, between and after blocks; and for each symbol the block it is a token of, -1 for a mark."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.concatenate(list(word_hashes(" ".join(texts).encode("utf-8", "surrogatepass"))))
    sizes = np.array([t.count(" ") + 1 for t in texts])
    at = np.repeat(np.cumsum(sizes) - sizes, END)  # marks stand before a block's first token
    block = np.insert(np.repeat(np.arange(len(texts)), sizes), at, -1)
    return np.r_[np.insert(hashes, at, _MARK), np.full(END, _MARK)], np.r_[block, np.full(END, -1)]


def repeated_strings(streams: list[np.ndarray], owners: list[int], tokens: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the concatenated streams, each with one place more for its end, how many owners have the string of ``tokens`` symbols that starts there, or 0 where fewer than ``least`` (over 1) have it; and the place where each stream begins.

    Symbols that only strings of too few places cover are left out before the
    suffix array sorts the rest, a mark of its own in place of each such run.
    Strings are told apart by a hash there, so what is left out is certain.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    if not len(streams):
        return np.zeros(0, np.int64), begins
    _, ids = np.unique(np.concatenate(streams), return_inverse=True)
    flat = np.insert(ids.astype(np.int64), np.cumsum(sizes), -1 - np.arange(len(streams)))  # ends a page; each once
    owner = np.repeat(np.array(owners, np.int64), sizes + 1)
    having = np.zeros(len(flat), np.int64)
    if len(flat) < tokens:
        return having, begins
    _, back, counts = np.unique(window_keys(flat.view(np.uint64), tokens), return_inverse=True, return_counts=True)
    left = np.flatnonzero(_covered(np.flatnonzero(counts[back] >= least), len(flat), tokens))
    if not len(left):
        return having, begins
    gap = np.flatnonzero(np.diff(left) > 1) + 1
    symbols = np.insert(flat[left], gap, -1 - len(streams) - np.arange(len(gap)))
    symbols = np.append(symbols, -1 - len(streams) - len(gap)).tolist()
    at = np.append(np.insert(left, gap, -1), -1)
    order = suffix_array(symbols)
    string = np.cumsum(np.r_[True, common_prefixes(symbols, order)[1:] < tokens]) - 1  # suffixes that share a string stand together
    ends = np.r_[0, np.cumsum(flat < 0)]
    whole = np.r_[ends[tokens:] == ends[: len(flat) - tokens + 1], np.zeros(tokens - 1, bool)]
    own = at[np.array(order)]
    real = (own >= 0) & whole[own]
    own, string = own[real], string[real]
    pairs = np.unique(string * (len(streams) + 1) + owner[own])
    n = np.bincount(pairs // (len(streams) + 1), minlength=len(order))[string]
    having[own] = np.where(n >= least, n, 0)
    return having, begins


def window_keys(tokens: np.ndarray, width: int) -> np.ndarray:
    """64 bits for each string of ``width`` of the 64-bit ``tokens``, by the place where it starts."""
    n = max(len(tokens) - width + 1, 0)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    return key


def _covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` places a string of ``width`` that starts at one of ``starts`` covers."""
    edges = np.zeros(n + width + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges)[:n] > 0


def main_of(texts: list[str]) -> int:
    """64 bits of a page's longest block, the first of equally long ones."""
    return block_key(max(texts, key=len, default=""))


def block_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def boilerplate_of(pages: list[tuple[int, list[str], list[bool]]], least: float, most: float) -> tuple[dict[int, int], dict[int, int]]:
    """Of some of a host's pages (longest block, blocks, which of them aren't marked): for blocks that repeated strings cover whole and that aren't marked on some page, and for strings, their keys and how many distinct pages have them; blocks on ``least`` pages and strings on ``most``."""
    owner_of = {m: k for k, m in enumerate(dict.fromkeys(m for m, *_ in pages))}
    read = [stream_of(texts) for _, texts, _ in pages]
    having, begins = repeated_strings([s for s, _ in read], [owner_of[m] for m, *_ in pages], TOKENS, least)
    places = np.flatnonzero(having)
    covered = _covered(places, len(having), TOKENS)
    found: dict[int, set[int]] = {}
    asked: set[int] = set()
    for (m, texts, unmarked), (stream, block), begin in zip(pages, read, begins.tolist()):
        if texts:
            token = block >= 0
            bare = np.bincount(block[token], ~covered[begin : begin + len(stream)][token], len(texts))
            for k in np.flatnonzero(bare == 0).tolist():
                key = block_key(texts[k])
                found.setdefault(key, set()).add(m)
                if unmarked[k]:
                    asked.add(key)
    strings: dict[int, int] = {}
    for (stream, block), begin in zip(read, begins.tolist()):
        own = having[begin : begin + len(stream)]
        tokens = np.r_[0, np.cumsum(block >= 0)]
        real = tokens[np.minimum(np.arange(len(stream)) + TOKENS, len(stream))] - tokens[:-1]
        at = np.flatnonzero((own >= most) & (real >= REAL))
        if len(at):
            strings.update(zip(window_keys(stream, TOKENS).view(np.int64)[at].tolist(), own[at].tolist()))
    return {k: len(own) for k, own in found.items() if k in asked and len(own) >= least}, strings


def keep_runs(found: list[tuple[int, str]], often: set[int], most: set[int], strings: np.ndarray) -> tuple[str, int]:
    """The text that stays of a page's blocks (kind, text), and how many unmarked tokens went, by the keys of blocks that enough and that most pages have, and of strings that most have (ascending)."""
    kept, repeated, cut = [], 0, None
    if len(strings) and found:
        stream, block = stream_of([t for _, t in found])
        own = window_keys(stream, TOKENS).view(np.int64)
        hit = strings[np.minimum(np.searchsorted(strings, own), len(strings) - 1)] == own
        cut = _covered(np.flatnonzero(hit), len(stream), TOKENS)[block >= 0].tolist()
    at = 0
    for kind, text in found:
        n = text.count(" ") + 1
        key, own = block_key(text) if often else 0, cut[at : at + n] if cut else ()
        at += n
        gone = key in (most if kind == ARTICLE else often)
        if kind == MARKED:
            continue
        if gone:
            repeated += n
            continue
        if kind == OPEN and any(own):
            repeated += sum(own)
            text = " ".join(w for w, c in zip(text.split(" "), own) if not c)
        if text:
            kept.append(text)
    return " ".join(kept), repeated


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) for every row of ``pages``: the main text, its code points, and how many tokens went because the host repeats them.

    Null or empty html has empty text. Pages of a host with the same longest
    block count as one page. Pages whose url is null or has no host are one
    host. Repeated rows stay repeated; an empty table gives no rows; other
    columns are ignored.
    """
    url = F.col(url_col)
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    groups = rows.select("host", F.xxhash64("html").alias("content")).distinct().groupBy("host").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    groups = stage(groups, "host-groups")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        many: Counter = Counter()
        for b in batches:
            new = []
            for h, page, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts = blocks(page)
                texts = [t for _, t in parts]
                main = main_of(texts)
                content = xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63)
                if (h, content) not in seen:  # equal pages of a task go on once
                    seen.add((h, content))
                    many[h, main] += 1
                    # pages with one longest block meet, but a mass of them is spread
                    new.append((h, (main if many[h, main] <= group else content) % n, n, main, content, texts, [k != MARKED for k, _ in parts]))
            if new:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*new), kinds)], ["host", "share", "groups", "main", "content", "texts", "unmarked"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(host: str, share: int, n_groups: int, held: list[tuple[int, list[str], list[bool]]]) -> pa.RecordBatch:
            mains = {m for m, *_ in held}
            n, whole = sum(m % n_groups == share for m in mains), n_groups == 1
            # what enough of a host's pages have, enough of the pages of one of its groups have
            sure = (max(PAGES, SHARE * n), max(MOST, MOST_SHARE * n)) if whole else (max(2, SHARE * n - 1e-9), max(2, MOST_SHARE * n - 1e-9))
            found, strings = boilerplate_of(held, *sure)
            rows = [(host, whole, "size", None, None, n, None, None)]
            rows += [(host, whole, kind, k, c, n, None, None) for kind, x in (("block", found), ("string", strings)) for k, c in x.items()]
            if not whole:  # what other groups find is counted here too
                rows += [(host, whole, "page", None, None, None, m, list({block_key(t) for t in texts})) for m, texts, _ in held]
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "whole", "kind", "key", "c", "n", "main", "keys"])

        key, n_groups, last, held = None, 0, None, []
        for b in batches:
            for h, s, n, m, content, texts, unmarked in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (h, s) != key:
                    if held:
                        yield done(*key, n_groups, held)
                    key, n_groups, last, held = (h, s), n, None, []
                if content != last:
                    held.append((m, texts, unmarked))
                last = content
        if held:
            yield done(*key, n_groups, held)

    def kept_sets() -> Callable[..., tuple]:
        """A function from a host and its key arrays to sets, made once for a host and task at a time."""
        known: dict[str, tuple] = {}

        def of(host: str, *keys: pa.Scalar) -> tuple:
            if host not in known:
                if len(known) >= 64:
                    known.clear()
                known[host] = tuple(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in keys[-1:])
                known[host] = (*(frozenset(x.as_py() or ()) for x in keys[:-1]), *known[host])
            return known[host]

        return of

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = kept_sets()
        for b in batches:
            mains, found = [], []
            for k, (host, page) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                texts = [t for _, t in blocks(page)]
                mains.append(main_of(texts))
                found.append(np.intersect1d(window_keys(stream_of(texts)[0], TOKENS).view(np.int64), *sets(host, b.column(2)[k])))
            yield pa.record_batch([b.column(0), pa.array(mains, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "main", "keys"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = kept_sets()
        for b in batches:
            made = [keep_runs(blocks(page), *sets(host, *(b.column(c)[k] for c in (4, 5, 6)))) for k, (host, page) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))]
            texts = [t for t, _ in made]
            yield pa.record_batch([*b.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in made], pa.int64())], ["page_id", "url", "text", "n_chars", "n_repeated"])

    def keys_where(condition) -> F.Column:
        return F.sort_array(F.collect_set(F.when(condition, F.col("key"))))

    dealt = rows.join(groups, "host").select("host", "html", "groups").mapInArrow(read, "host string, share int, groups int, main bigint, content bigint, texts array<string>, unmarked array<boolean>")
    grouped = dealt.repartition("host", "share").sortWithinPartitions("host", "share", "content")
    local = stage(grouped.mapInArrow(find, "host string, whole boolean, kind string, key bigint, c bigint, n bigint, main bigint, keys array<bigint>"), "repeats")
    sizes = stage(local.where("kind = 'size'").groupBy("host").agg(F.sum("n").alias("n")), "host-sizes")
    asked = stage(local.where("not whole and kind in ('block', 'string')").select("host", "kind", "key").distinct(), "repeats-asked")
    having = local.where("kind = 'page'").select("host", "main", F.lit("block").alias("kind"), F.explode("keys").alias("key")).join(asked, ["host", "kind", "key"], "left_semi")
    if not (strings := asked.where("kind = 'string'")).isEmpty():  # pages are read again only on hosts that may have such strings
        strings = stage(strings.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys")), "strings-asked")
        told = rows.join(strings, "host").select("host", "html", "keys").mapInArrow(count, "host string, main bigint, keys array<bigint>")
        having = having.unionByName(told.select("host", "main", F.lit("string").alias("kind"), F.explode("keys").alias("key")))
    counts = having.distinct().groupBy("host", "kind", "key").agg(F.count("*").alias("c")).join(sizes, "host")
    known = local.where("whole and kind in ('block', 'string')").select("host", "kind", "key", "c", "n").unionByName(counts.select("host", "kind", "key", "c", "n"))
    enough = (F.col("c") >= PAGES) & (F.col("c") >= F.col("n") * F.lit(SHARE))
    most = (F.col("c") >= MOST) & (F.col("c") >= F.col("n") * F.lit(MOST_SHARE))
    block = F.col("kind") == "block"
    keys = [keys_where(block).alias("often"), keys_where(block & most).alias("most"), keys_where(~block & most).alias("strings")]
    found = stage(known.where(enough).groupBy("host").agg(*keys), "repeats-found")
    return rows.join(found, "host", "left").select("page_id", "url", "host", "html", "often", "most", "strings").mapInArrow(decide, "page_id bigint, url string, text string, n_chars bigint, n_repeated bigint")
