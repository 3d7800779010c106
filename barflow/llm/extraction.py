"""Main text of feed entries by wrappers: union-free patterns inferred from the token streams of a host's pages."""

from __future__ import annotations

import html
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Wrappers of at most so many hosts and characters are broadcast; beyond, they are joined by a shuffle on the host.
BROADCAST_HOSTS, BROADCAST_CHARACTERS = 50_000, 32 << 20
#: Partial wrappers of a host first meet in so many groups.
SALTS = 64
_LONGEST_GROUP = 4
#: Cells of a table of all pairs of labels, beyond which the alignment works on bits; and the levels that merging two patterns may go down.
MOST_CELLS, DEEPEST = 250_000, 1_000_000
#: Least part of a weaker region's text that a page's one region, its several regions (teasers of a listing), or any against unmarked text must have.
SHARES = {"one": 0.25, "several": 0.5, "unmarked": 0.1}
# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table div section p".split())
_SCOPE = frozenset("ul ol dl table article section div body nav aside main form header footer".split())
_DROP_TAGS = frozenset("nav footer aside form button select head dialog menu fieldset".split())
_DROP_WORDS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navbar navigation menu sidebar side rail footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus replies respond breadcrumb breadcrumbs widget toolbar login search pagination pager tags skip alert".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar alertdialog".split())
_MAIN_WORDS = frozenset("article content entry post story main body maincontent articlebody postbody".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
TEXT = "#"


def _label(tag: str, attributes: str) -> str:
    """A tag with what its class, id and role say: ``div`` or ``div.ad`` or ``div!search`` (role)."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    said: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() in ("class", "id"):
            said.update("." + w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w and (w in _DROP_WORDS or w in _MAIN_WORDS))
        elif name.lower() == "role":
            said.add("!" + value.lower().strip())
        elif name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true" or name.lower() == "style" and "display:none" in value.replace(" ", "").lower():
            said.add("!hidden")
    return tag + "".join(sorted(said))


def events(page: str) -> Iterator[tuple[str, str]]:
    """('(', label), (')', label), ('#', text) and ('|', '') for a line break, well nested whatever the page leaves open."""
    stack: list[tuple[str, str]] = []
    raw = None
    at, n = 0, len(page)
    low = None
    while at < n:
        if raw is not None:  # to the end tag, whatever stands between
            low = page.lower() if low is None else low
            end = low.find(f"</{raw}", at)
            at, raw = (n if end < 0 else end), None
            continue
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            close = page.find(">", at)
            at = n if close < 0 else close + 1
            continue
        at = m.end()
        if m[4] is not None:
            yield TEXT, m[4]
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                if any(t == tag for t, _ in stack):
                    while True:
                        t, label = stack.pop()
                        yield ")", label
                        if t == tag:
                            break
            elif tag in _VOID:
                if tag in ("br", "hr"):
                    yield "|", ""
            else:
                closes = {"p"} if tag in _CLOSES_P else _SAME_CLOSES.get(tag, ())
                if closes:
                    depth = len(stack) - 1
                    while depth >= 0 and stack[depth][0] not in closes and stack[depth][0] not in _SCOPE:
                        depth -= 1
                    if depth >= 0 and stack[depth][0] in closes:
                        while len(stack) > depth:
                            yield ")", stack.pop()[1]
                label = _label(tag, m[3])
                if tag in _RAW:
                    raw = tag if not m[3].rstrip().endswith("/") else None
                if not (m[3].endswith("/") and tag not in _RAW and tag in ("svg", "path")):
                    stack.append((tag, label))
                    yield "(", label
    while stack:
        yield ")", stack.pop()[1]


def pattern(page: str) -> list:
    """The page as a pattern: a node is [label, flags, children, characters of text, characters of them in links]; a text slot has the label #.

    Flags: 1 optional, 2 repeated. Equal neighbours, and equal groups of up to four, are one repeated group.
    """
    root = ["", 0, [], 0, 0]
    path, links = [root], 0
    for kind, value in events(page):
        if kind == "(":
            node = [value, 0, [], 0, 0]
            path[-1][2].append(node)
            path.append(node)
            links += value == "a"
        elif kind == ")":
            node = path.pop()
            links -= value == "a"
            node[2] = fold(node[2])
        elif kind == TEXT and not value.isspace():
            size = len(value)
            if path[-1][2] and path[-1][2][-1][0] == TEXT:
                path[-1][2][-1][3] += size
                path[-1][2][-1][4] += size * bool(links)
            else:
                path[-1][2].append([TEXT, 0, [], size, size * bool(links)])
    root[2] = fold(root[2])
    return root


def fold(items: list) -> list:
    """Repeated runs of the same labels as one repeated group each: the shortest groups first."""
    for size in range(1, _LONGEST_GROUP + 1):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * size and all(out[-i][0] == out[-i - size][0] for i in range(1, size + 1)):
                tail = out[-size:]
                del out[-size:]
                for i in range(1, size + 1):
                    out[-i] = merge(out[-i], tail[-i])
                    out[-i][1] |= 2
        items = out
    return items


def merge(a: list, b: list) -> list:
    """One pattern for two nodes with the same label: their children are aligned, mismatches become optional, and repetition is folded again."""
    return [a[0], a[1] | b[1], align(a[2], b[2]), a[3] + b[3], a[4] + b[4]]


def align(a: list, b: list) -> list:
    """Children of two nodes in one sequence along a longest common subsequence of labels; what only one has becomes optional."""
    x, y = [n[0] for n in a], [n[0] for n in b]
    if x == y:
        return [merge(p, q) for p, q in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*(_pairs if len(x) * len(y) <= MOST_CELLS else _pairs_by_bits)(x, y), (len(a), len(b))]:
        out += [[n[0], n[1] | 1, *n[2:]] for n in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def _pairs(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by a table of all cells."""
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _pairs_by_bits(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The same for long lists: a row of the table is one number, in which a bit is 0 where the subsequence grows."""
    at: dict[str, int] = {}
    for j, label in enumerate(y):
        at[label] = at.get(label, 0) | 1 << j
    whole = (1 << len(y)) - 1
    row, rows = whole, []
    for label in x:
        hit = row & at.get(label, 0)
        row = (row + hit | row - hit) & whole
        rows.append(row)
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def stored(node: list) -> str:
    """A pattern as JSON: its nodes in order with their depth, so that no depth is too much."""
    out, open_ = [], [(0, node)]
    while open_:
        depth, n = open_.pop()
        out.append([depth, n[0], n[1], n[3], n[4]])
        open_ += [(depth + 1, c) for c in reversed(n[2])]
    return json.dumps(out, separators=(",", ":"))


def restored(text: str) -> list:
    path: list[list] = []
    for depth, label, flags, size, links in json.loads(text):
        node = [label, flags, [], size, links]
        del path[depth:]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


def expression(node: list) -> str:
    """The pattern as a regular expression over tags and text slots."""
    body = TEXT if node[0] == TEXT else f"<{node[0]}>{''.join(map(expression, node[2]))}</>" if node[0] else "".join(map(expression, node[2]))
    return {0: body, 1: f"({body})?", 2: f"({body})+", 3: f"({body})*"}[node[1]]


def _dropped(label: str) -> bool:
    tag, words = _tag(label), re.findall(r"[.!][^.!]*", label)
    if tag in _RAW or tag in _DROP_TAGS or any(w[0] == "!" and (w[1:] in _DROP_ROLES or w == "!hidden") for w in words):
        return True
    if tag in ("article", "main", "body", "html"):
        return False
    return any(w[0] == "." and w[1:] in _DROP_WORDS for w in words)


def _main(label: str) -> int:
    tag, words = _tag(label), re.findall(r"[.!][^.!]*", label)
    return 3 if tag == "article" else 2 if tag == "main" or "!main" in words or "!article" in words else 1 if tag in ("div", "section", "td") and any(w[1:] in _MAIN_WORDS for w in words) else 0


def kept_paths(wrapper: list) -> dict[str, int]:
    """Paths of the wrapper's nodes whose text may be main text, and bit by bit for which kinds of region (see ``_main``).

    Slots below menus, notices, adverts and the like go. Bit k has the slots within a region of the kind k; bit 0, for
    pages without marked regions, the text slots of headings, paragraphs and other blocks that are not mostly links.
    """
    out: dict[str, int] = {}

    # inside: kinds of the regions around; block: whether the block of the node's text is kept without a region; listed: whether it lies in a list of links or a header
    open_ = [(wrapper, "", 0, True, False)]
    while open_:
        node, path, inside, block, listed = open_.pop()
        if _tag(node[0]) not in _INLINE:
            size, links = _sizes(node, True)
            block = links * 2 <= size
        bits = inside | (block and not listed)
        if bits and any(c[0] == TEXT for c in node[2]):
            out[path] = out.get(path, 0) | bits
        for c in node[2]:
            header = _tag(c[0]) == "header"
            if c[0] != TEXT and not _dropped(c[0]) and (inside or not header):
                kind, many = _main(c[0]), False
                if _tag(c[0]) in _LISTS:
                    size, links = _sizes(c)
                    many = links * 2 > size
                open_.append((c, f"{path}/{c[0]}", inside | (1 << kind if kind else 0), block, listed or header or many))
    return out


def _tag(label: str) -> str:
    return re.match(r"[^.!]*", label)[0]


def _sizes(node: list, inline: bool = False) -> tuple[int, int]:
    """Characters below a node, and those in links; ``inline``: of its own block only."""
    size = links = 0
    open_ = [node]
    while open_:
        n = open_.pop()
        if n[0] == TEXT:
            size, links = size + n[3], links + n[4]
        else:
            open_ += [c for c in n[2] if not inline or c[0] == TEXT or _tag(c[0]) in _INLINE]
    return size, links


def main_text(page: str, kept: dict[str, int]) -> str:
    """Text at the paths kept for the page's own region: white space within a block is one space, blocks are joined by one space.

    That is the strongest kind whose characters outside links are a large enough part (SHARES) of those of every weaker kind.
    """
    out: list[str] = []
    bits_at: dict[int, int] = {}
    size, regions = [0] * 4, [0] * 4
    path, entered, links = [""], [(0, 0)], 0
    for kind, value in events(page):
        if kind == "(":
            path.append(f"{path[-1]}/{value}")
            own = _main(value)
            entered.append((own, size[own]))
            links += _tag(value) == "a"
            if _tag(value) not in _INLINE:
                out.append(" ")
        elif kind == ")":
            path.pop()
            own, before = entered.pop()
            regions[own] += size[own] > before
            links -= _tag(value) == "a"
            if _tag(value) not in _INLINE:
                out.append(" ")
        elif kind == "|":
            out.append(" ")
        elif bits := kept.get(path[-1], 0):
            bits_at[len(out)] = bits
            out.append(html.unescape(value))
            n = 0 if links else len("".join(value.split()))
            for k in range(4):
                size[k] += n * (bits >> k & 1)
    some = [k for k in (3, 2, 1, 0) if any(b >> k & 1 and out[i].strip() for i, b in bits_at.items())]
    enough = lambda k, w: size[k] >= size[w] * SHARES["unmarked" if not w else "several" if regions[k] > 1 else "one"]
    chosen = next((k for k in some if size[k] and all(enough(k, w) for w in range(k))), some[0] if some else 0)
    return " ".join("".join(x for i, x in enumerate(out) if bits_at.get(i, 1 << chosen) >> chosen & 1).split())


def host_of(link: Column) -> Column:
    """The host of a link in lower case; without one, empty."""
    return F.lower(F.coalesce(F.regexp_extract(link, r"^[A-Za-z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial wrapper of each host from the pages of a partition."""
    known: dict[str, list] = {}
    sys.setrecursionlimit(DEEPEST)
    for batch in (x for b in batches for x in slices(b, "summary")):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("summary").to_pylist(), strict=True):
            own = pattern(page or "")
            known[host] = merge(known[host], own) if host in known else own
            if len(known) >= 5_000:
                yield _wrapper_batch(known)
                known = {}
    yield _wrapper_batch(known)


def _wrapper_batch(known: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([stored(w) for w in known.values()], pa.string())], ["host", "wrapper"])


def _merge_groups(frame):
    import pandas as pd

    whole = None
    sys.setrecursionlimit(DEEPEST)
    for text in frame["wrapper"].sort_values():
        one = restored(text)
        whole = one if whole is None else merge(whole, one)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [stored(whole)]})


def wrappers(entries: DataFrame) -> DataFrame:
    """host, wrapper (JSON of the pattern) of every host, from all its pages.

    Each task merges the pages it has; a host's partial wrappers then meet in SALTS groups and at last in one, so no
    task sees more of a host than one small pattern a task.
    """
    pages = entries.select(host_of(F.col("link")).alias("host"), "summary")
    partial = pages.mapInArrow(_infer, "host string, wrapper string")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInPandas(_merge_groups, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(_merge_groups, "host string, wrapper string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths: dict[str, dict[str, int]] = {}
    for batch in (x for b in batches for x in slices(b, "summary")):
        out = []
        for page, wrapper in zip(batch.column("summary").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if wrapper not in paths:
                if len(paths) > 20_000:
                    paths.clear()
                paths[wrapper] = kept_paths(restored(wrapper))
            out.append(main_text(page or "", paths[wrapper]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("link"), pa.array(out, pa.string())], ["id", "link", "text"])


def extract(entries: DataFrame, id_col: str = "id") -> DataFrame:
    """Main text of every feed entry's html: the article without menus, notices, adverts, forms, comments and markup.

    entries: ``id``, ``link``, ``summary`` (html); more columns are ignored. Returns one row per input row: ``id``,
    ``link``, ``text`` (empty if none), ``n_chars`` (code points).

    All pages of a host are aligned into one wrapper, a union-free regular expression over tags and text slots: runs and
    groups of like neighbours become repeated, what some pages lack becomes optional. Which slots may hold main text is
    decided once for the wrapper, for each kind of region (article, main, class words) and, without marked regions, by
    the share of links over all pages. Each page then gives the text of its kept slots in order, for the strongest kind
    of region that it has itself with enough text, so templates of one host do not switch each other's text off.

    Wrappers are broadcast if they are few and small (BROADCAST_HOSTS, BROADCAST_CHARACTERS), else joined on the host,
    where Spark splits hot hosts. Null html is an empty page, links without a host share one wrapper. Null and repeated
    ids are handled like others. No rows give no rows.
    """
    from .common import written

    found = written(wrappers(entries))
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("c")).first()
    few = size["n"] <= BROADCAST_HOSTS and size["c"] <= BROADCAST_CHARACTERS
    pages = entries.select(F.col(id_col).alias("id"), "link", "summary", host_of(F.col("link")).alias("host"))
    kind = pages.schema["id"].dataType.simpleString()
    joined = pages.join(F.broadcast(found) if few else found, "host").select("id", "link", "summary", "wrapper")
    return joined.mapInArrow(_apply, f"id {kind}, link string, text string").withColumn("n_chars", F.length("text").cast("long"))
