"""Main text of web pages by wrapper induction.

Pages with the same headings are copies of one page, and of those one is evidence. Blocks are counted over all different pages of a
host; the trees of some of them are aligned by simple tree matching. Aligned nodes of one
text that nearly all pages have are template, whatever their tags, but for headings that
lead to what varies. What varies is content, but for regions whose labels say that they are comments, adverts, menus or the like. Both
make the host's wrapper, and every page is read through its host's wrapper alone: of a
page's tags only those that never hold text (head, script, form controls, hidden nodes)
are left out beforehand.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut, join_skewed

#: Different pages of a host whose trees are aligned; what they propose is counted over all pages.
SAMPLE = 8
#: Share of a host's different pages that have a template text, two pages at least.
AGREE = 0.9
#: How far from the diagonal children that are not equal are aligned, and how many at once.
BAND, PIECE = 8, 512
#: Bytes of all wrappers up to which every task gets them all; beyond that pages are shuffled to their host's wrapper.
EVERYWHERE = 32 << 20
#: Levels that label paths and the alignment tell apart; deeper text keeps the path of this level.
DEEP = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption dd dt li tbody td tfoot th thead tr html body".split()) | {"p"}
#: A start tag closes open elements of these, up to one of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text no reader of a page sees as text.
NEVER = frozenset("head title script style noscript template button select textarea input iframe object svg canvas".split())
#: Elements that mark a region: what varies between pages there is no article.
REGIONS = frozenset("nav footer aside form dialog menu search".split())
#: Words of a class, id or role that mark such regions: menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored sidebar aside menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social related"
    " recommended recommendations comment comments commentlist reply replies respond disqus discussion pagination pager toolbar widget contentinfo complementary search form copyright".split()
)
_WORDS = re.compile(r"[^A-Za-z0-9]+")


class Node:
    __slots__ = ("tag", "label", "dropped", "region", "children")

    def __init__(self, tag: str, names: str = "", hidden: bool = False):
        words = [w.lower() for w in _WORDS.split(names) if w]
        self.tag, self.children = tag, []
        marks = sorted({w for w in words if w in MARKED}) if tag not in ("html", "body", "main", "article") else []
        self.label = ".".join((tag, *(words[:1] if words and words[0] not in marks else ()), *marks))
        self.dropped = tag in NEVER or hidden
        self.region = bool(marks) or tag in REGIONS


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.open = [self.root]
        self.opened: Counter = Counter()  # open elements by tag, so that a deep page is not searched in vain

    def _close(self, tags, stop=()) -> None:
        if not any(self.opened[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                for n in self.open[i:]:
                    self.opened[n.tag] -= 1
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        a = {k: v or "" for k, v in attrs}
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        node = Node(tag, f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}", hidden)
        if tag == "header" and not self.opened["article"] and not self.opened["main"]:
            node.region = True
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "circle", "rect", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag})

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; whatever is not closed ends with the page."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def blocks(root: Node) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(label path, region, text) of every block that is not dropped, in page order.

    The region is the label of the outermost marked element around the block, empty
    without one. A region's text is a block of its own, also inside a line.
    """
    parts: list[str] = []
    at: list[tuple] = [((), "")]

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            yield *at[0], text

    # a stack and no recursion, for pages may be nested deeply
    stack: list = [(root, (), "", iter(root.children))]
    while stack:
        node, where, region, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if stack and (node.tag in BLOCK or region != stack[-1][2]):
                yield from flush()
                at[0] = stack[-1][1:3]
            continue
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append(" ")
        elif not child.dropped:
            below = (*where, child.label) if len(where) < DEEP else where
            inside = region or (child.label if child.region else "")
            if child.tag in BLOCK or inside != region:
                yield from flush()
                at[0] = (below, inside)
            stack.append((child, below, inside, iter(child.children)))
        elif child.tag in BLOCK:
            yield from flush()
            at[0] = (where, region)
    yield from flush()


def _digests(root: Node) -> dict[int, int]:
    """A hash of every element's labels and texts, by its id."""
    out: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            out[id(node)] = hash((node.label, node.dropped, tuple(" ".join(c.split()) if isinstance(c, str) else out[id(c)] for c in node.children)))
        else:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if not isinstance(c, str)]
    return out


def _anchors(xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
    """Positions of equal hashes in both lists, rising on both sides; only what is once in either list counts."""
    nx, ny = Counter(xs), Counter(ys)
    at = {h: j for j, h in enumerate(ys) if ny[h] == 1}
    found = [(i, at[h]) for i, h in enumerate(xs) if nx[h] == 1 and h in at]
    tails: list[int] = []  # the longest rising run, by patience
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(found):
        k = bisect_left(tails, j)
        before.append(last[k - 1] if k else -1)
        tails[k : k + 1], last[k : k + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(found[n])
        n = before[n]
    return out[::-1]


def match(a: Node, b: Node, depth: int = 0, digests: dict[int, int] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of an order-preserving matching, and its pairs.

    Whole lists of children are aligned: equal heads and tails first, then equal children
    that are in either list once, then what lies between these, near the diagonal.
    """
    if a.label != b.label:
        return 0, []
    if depth == DEEP:
        return 1, [(a, b)]
    if digests is None:
        digests = _digests(a) | _digests(b)
    xs, ys = ([c for c in n.children if not isinstance(c, str)] for n in (a, b))
    hx, hy = ([digests[id(c)] for c in cs] for cs in (xs, ys))
    head = 0
    while head < min(len(xs), len(ys)) and hx[head] == hy[head]:
        head += 1
    tail = 0
    while tail < min(len(xs), len(ys)) - head and hx[-1 - tail] == hy[-1 - tail]:
        tail += 1
    fixed = [(i, i) for i in range(head)]
    fixed += [(head + i, head + j) for i, j in _anchors(hx[head : len(xs) - tail], hy[head : len(ys) - tail])]
    fixed += [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]
    total, pairs, i, j = 1, [(a, b)], 0, 0
    for p, q in [*fixed, (len(xs), len(ys))]:
        n, found = _between(xs[i:p], ys[j:q], depth, digests)
        total, i, j = total + n, p + 1, q + 1
        pairs += found
        if p < len(xs):
            n, found = match(xs[p], ys[q], depth + 1, digests)
            total += n
            pairs += found
    return total, pairs


def _between(xs: list[Node], ys: list[Node], depth: int, digests: dict[int, int]) -> tuple[int, list[tuple[Node, Node]]]:
    """The matching of two lists of children near their diagonal, long ones piece by piece."""
    if not xs or not ys:
        return 0, []
    if (parts := -(-max(len(xs), len(ys)) // PIECE)) > 1:
        cuts = lambda cs: [cs[len(cs) * k // parts : len(cs) * (k + 1) // parts] for k in range(parts)]
        found = [_between(x, y, depth, digests) for x, y in zip(cuts(xs), cuts(ys))]
        return sum(n for n, _ in found), [p for _, pairs in found for p in pairs]
    slope = len(ys) / len(xs)
    width = BAND + int(slope)
    size, sub = [[0] * (len(ys) + 1)], {}
    for i, x in enumerate(xs):
        row = size[-1].copy()
        for j in range(max(0, int(i * slope) - width), min(len(ys), int(i * slope) + width + 1)):
            if x.label == ys[j].label:
                sub[i, j] = match(x, ys[j], depth + 1, digests)
            row[j + 1] = max(row[j + 1], row[j], size[-1][j] + sub.get((i, j), (0,))[0])
        size.append(list(accumulate(row, max)))
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if (i - 1, j - 1) in sub and size[i][j] == size[i - 1][j - 1] + sub[i - 1, j - 1][0]:
            pairs += sub[i - 1, j - 1][1]
            i, j = i - 1, j - 1
        elif size[i][j] == size[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return size[-1][-1], pairs


def _own_texts(node: Node) -> set[str]:
    """The texts of a node that its block children part, as ``blocks`` gives them."""
    found: set[str] = set()
    out: list[str] = []
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(" ")
        elif c.tag in BLOCK or c.region:
            found.add(" ".join("".join(out).split()))
            out.clear()
        elif not c.dropped:
            todo += reversed(c.children)
    found.add(" ".join("".join(out).split()))
    return found - {""}


def _paths(root: Node) -> dict[int, tuple[str, ...]]:
    found, stack = {}, [(root, ())]
    while stack:
        node, path = stack.pop()
        found[id(node)] = path
        stack += [(c, (*path, c.label) if len(path) < DEEP else path) for c in node.children if not isinstance(c, str)]
    return found


def induce(pages: list[str]) -> dict:
    """What different pages of one host propose: ``template`` lists (path, text) of aligned nodes with one text."""
    trees = [parse(p) for p in pages]
    agreed: set[tuple[tuple[str, ...], str]] = set()
    for a, b in zip(trees, trees[1:]):
        where = _paths(a), _paths(b)
        for x, y in match(a, b)[1]:
            if (path := where[0][id(x)]) == where[1][id(y)]:
                agreed.update((path, t) for t in _own_texts(x) & _own_texts(y))
    return {"template": sorted([list(p), t] for p, t in agreed)}


def slot(path: tuple[str, ...], text: str) -> int:
    """A block's place and text as 64 bits, alike in every process."""
    return int.from_bytes(hashlib.blake2b("\0".join((*path, "", text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _hash(slots: list[int]) -> int:
    return int.from_bytes(hashlib.blake2b(repr(slots).encode(), digest_size=8).digest(), "big", signed=True)


def _tag(path: tuple[str, ...]) -> str:
    return path[-1].split(".", 1)[0] if path else ""


#: A heading that always stays, and a block that leads to no other.
ALWAYS, NONE = -1, 0


def _leads(found: list[tuple[tuple[str, ...], str, str]]) -> list[int]:
    """For every heading the number (from 1) of the block that it leads to: the next one in its container that is none itself.

    Headings of an element article or main stay as they are.
    """
    out, after = [NONE] * len(found), len(found)
    for i in range(len(found) - 1, -1, -1):
        path, region, _ = found[i]
        if _tag(path) not in HEADINGS:
            after = i
        elif not region and any(x.split(".", 1)[0] in ("article", "main") for x in path[:-1]):
            out[i] = ALWAYS
        elif after < len(found) and found[after][0][: len(path) - 1] == path[:-1]:
            out[i] = after + 1
    return out


def content(html: str | None) -> tuple[int, int, int, list[dict]]:
    """Hashes of a page's headings, of its blocks outside regions and of all its blocks, and the blocks: slot, region, text, what it leads to.

    A page without headings outside regions has its blocks there in their place.
    """
    read = list(blocks(parse(html)))
    found = [{"slot": slot(p, t), "region": r, "text": t, "leads": n} for (p, r, t), n in zip(read, _leads(read))]
    page = _hash([x["slot"] for x in found if not x["region"]])
    heads = [t for p, r, t in read if not r and _tag(p) in HEADINGS]
    return _hash([slot((), t) for t in heads]) if heads else page, page, _hash([x["slot"] for x in found]), found


def extract(html: str | None, wrapper: dict) -> str:
    """The blocks of a page that are neither the wrapper's template nor in one of its regions, one to a line."""
    template, regions = {(tuple(p), t) for p, t in wrapper["template"]}, set(wrapper["regions"])
    read = list(blocks(parse(html)))
    content_ = [r not in regions and (p, t) not in template for p, r, t in read]
    stays = [r not in regions and (n == ALWAYS or n > NONE and content_[n - 1]) for (_, r, _), n in zip(read, _leads(read))]
    return "\n".join(t for (_, _, t), a, b in zip(read, content_, stays) if a or b)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE, everywhere: int = EVERYWHERE) -> DataFrame:
    """``key, url, text, n_chars``: one row for each row of ``pages``.

    Pages without a host share one wrapper. Null, empty or text-free pages have an empty
    text. A text is template where ``AGREE`` of all different pages of its host have it in
    one place, and two at least; pages with the same headings are copies of one page, near
    ones too, and count once, as do pages with the same blocks; so a page and its copies alone have no
    template. A heading stays if it is in an element article or main, or if the next block
    in its container that is no heading is content. A marked region with text that is not template goes whole; so it does on hosts of one
    different page, which nothing can be aligned with. Only the alignment, which proposes
    texts, reads ``sample`` pages. A rerun reads alike. An empty table gives an empty
    table; other columns are left out.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", host_of(F.col("url"))).withColumn("at", F.xxhash64("html"))
    kind = dict(rows.dtypes)["key"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [content(h if isinstance(h, str) else None) for h in pdf["html"]]
            yield pdf.drop(columns="html").assign(unit=[u for u, _, _, _ in found], page=[p for _, p, _, _ in found], full=[f for _, _, f, _ in found], blocks=[x for _, _, _, x in found])

    # the key travels as text, as pandas turns longs with nulls into doubles
    sent = rows.withColumn("key", F.col("key").cast("string"))
    parsed = cut(sent.mapInPandas(read, "key string, url string, host string, at long, unit long, page long, full long, blocks array<struct<slot:long,region:string,text:string,leads:int>>"), "blocks")

    slots = F.array_distinct(F.transform("blocks", lambda x: F.struct(x["slot"].alias("slot"), x["region"].alias("region"))))
    # pages with the same blocks are one page; of pages with the same headings the least speaks for all
    whole = cut(parsed.where(F.size("blocks") > 0).groupBy("host", "full").agg(F.min(F.struct("unit", "page", "at")).alias("x"), F.first(slots).alias("slots")).select("host", "x.*", "slots"), "whole_pages")
    free = F.filter("slots", lambda x: x["region"] == "")
    different = cut(whole.groupBy("host", "unit").agg(F.min_by(F.struct("page", "at", free.alias("slots")), F.struct("page", "at")).alias("x")).select("host", "x.*"), "different_pages")

    def counted(pages_: DataFrame, of: Column) -> DataFrame:
        n = pages_.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        return pages_.select("host", F.explode(of).alias("x")).groupBy("host", "x.slot", "x.region").agg(F.count(F.lit(1)).alias("c")).join(n, "host")

    each = counted(different, F.col("slots")).unionByName(counted(whole, F.filter("slots", lambda x: x["region"] != "")))
    agrees = (F.col("c") > 1) & (F.col("c") >= AGREE * F.col("n"))
    told = each.groupBy("host").agg(F.collect_set(F.when(agrees, F.struct("slot", "region"))).alias("common"), F.collect_set(F.when(~agrees & (F.col("region") != ""), F.col("region"))).alias("regions"))
    told = cut(told, "common_texts")
    order = Window.partitionBy("host").orderBy("page")
    chosen = different.select("host", "page", "at").join(told.where(F.size("common") > 0).select("host"), "host", "left_semi").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    chosen = cut(chosen, "chosen_pages")  # the planner sees its size before it shuffles the pages
    some = rows.select("host", "at", "html").join(chosen, ["host", "at"]).groupBy("host", "nth").agg(F.min("html").alias("html")).join(told, "host")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        agreed = {x["slot"] for x in pdf["common"].iloc[0]}
        template = [x for p, t in induce(list(pdf["html"]))["template"] if (x := slot(tuple(p), t)) in agreed]
        return pd.DataFrame({"host": pdf["host"].iloc[:1].to_numpy(), "template": [template]})

    templates = some.groupBy("host").applyInPandas(learn, "host string, template array<long>")
    # a region with a text that no alignment proposes goes whole, too
    wrappers = told.join(templates, "host", "left").withColumn("template", F.coalesce("template", F.array().cast("array<long>")))
    alone = F.transform(F.filter("common", lambda x: (x["region"] != "") & ~F.array_contains("template", x["slot"])), lambda x: x["region"])
    wrappers = cut(wrappers.select("host", "template", F.array_distinct(F.concat("regions", alone)).alias("regions")), "wrappers")
    size = wrappers.agg(F.sum(8 * F.size("template") + F.length(F.array_join("regions", ",")) + F.length("host") + 64).alias("bytes")).first()["bytes"] or 0
    out = parsed.join(F.broadcast(wrappers), "host", "left") if size <= everywhere else join_skewed(parsed, wrappers, "host", "left")
    inside = lambda x: F.coalesce(F.array_contains("regions", x["region"]), F.lit(False))
    constant = lambda x: F.coalesce(F.array_contains("template", x["slot"]), F.lit(False))
    to = lambda x: F.get("blocks", x["leads"] - 1)
    leads = lambda x: (x["leads"] == ALWAYS) | ((x["leads"] > NONE) & ~inside(to(x)) & ~constant(to(x)))
    kept = F.filter("blocks", lambda x: ~inside(x) & (~constant(x) | leads(x)))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return out.select(F.col("key").cast(kind).alias(key), F.col("url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def digest(pages: DataFrame) -> DataFrame:
    """The rows of query op6."""
    return main_text(pages)
