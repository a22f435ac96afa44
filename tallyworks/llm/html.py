"""Operator 10: main text of pages by wrappers inferred from each host's pages.

A page is a tree of block elements. A host's wrapper is a union-free regular expression
over such trees: a sequence of elements, each once, optional (``n`` below the number of
its parents) or repeated (``rep``), and text slots, which are constant or vary. Aligning a
wrapper with a page collapses repeats, matches children in order, turns mismatched text
into slots and mismatched elements into optional groups; aligning two wrappers is the same
operation, so tasks fold their own pages and the partial wrappers are merged in two
rounds, the first dealt over salts: no task sees all pages of a large host. The wrapper
then tells where the article is, and every page is read there.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches, table

# Element names by role, and the words of classes and ids that mark what is no article.
BLOCKS = frozenset("html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form fieldset blockquote pre figure figcaption address hr details summary center menu dialog hgroup search".split())
RAW = frozenset("script style noscript template iframe svg math canvas object select textarea button title video audio head map".split())
#: Of these, the ones whose text is no markup: without an end tag they run to the end of the page.
RAW_TEXT = frozenset("script style title iframe textarea".split())
DROPPED = frozenset("nav footer aside form menu dialog fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body"}
NOISE = frozenset("nav navbar navigation menu sidebar sidenav header masthead footer ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored cookie cookies notice consent gdpr popup modal overlay newsletter subscribe subscription signup comment comments commentlist respond reply replies disqus breadcrumb breadcrumbs share sharing social related recommended widget login search pagination pager toolbar skip hidden".split())
REMARKS = frozenset("comment comments commentlist reply replies respond response responses".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: White space of a block, as HTML and Unicode have it.
BLANK = re.compile(r"\s+")
#: Share of a wrapper element's varying text that one child must hold to be entered.
DENSE = 0.6
#: Elements on a block's path at most; of those further inside only the first that is no article is kept.
DEPTH = 64
#: Places of a table of two sequences of children at most; longer ones are aligned greedily.
CELLS = 40_000
#: Salts of the first merge.
SALTS = 64


def _label(tag: str, attributes: str) -> str:
    """The element's name in wrappers; with ! if its class, id or role marks it as no article."""
    if tag in HEADINGS or tag in ("html", "body") or not attributes.strip():
        return tag
    a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)}
    words = re.findall(r"[a-z]+", f"{a.get('class', '')} {a.get('id', '')}".lower())
    if tag in ("article", "main"):
        # a reader's comment may be an article of its own
        return tag + "!" if REMARKS.intersection(words) or a.get("itemprop", "").lower() == "comment" else tag
    if NOISE.intersection(words) or a.get("role", "").lower() in ROLES or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "").lower()):
        return tag + "!"
    if a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody":
        return "main"
    return f"{tag}.{words[0]}" if words and tag in ("div", "section") else tag


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of block elements, text, characters in links) of each block with text, in page order.

    A block ends where a block element begins or ends; references are decoded, white space
    is single, comments and elements without text of their own are left out. Markup need
    not be well formed.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    path: list[tuple[str, str]] = []
    parts: list[str] = []
    within: Counter[str] = Counter()
    endless: set[str] = set()
    links = inlink = 0

    def flush() -> None:
        nonlocal links
        text = BLANK.sub(" ", "".join(parts)).strip()
        if text:
            shown = [x for _, x in path[:DEPTH]]
            out.append(((*shown, *next(([x] for _, x in path[DEPTH:] if not _clean(x)), [])), text, links))
        parts.clear()
        links = 0

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                text = entities.unescape(m[0])
                parts.append(text)
                links += len(text) * bool(inlink)
            elif m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3])
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if not end:
                    endless.add(tag)
                if tag == "head" and not end:
                    end = re.compile(r"<body\b", re.I).search(page, at)
                    at = end.start() if end else at
                else:
                    at = end.end() if end else size if tag in RAW_TEXT else at
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
        elif tag == "a":
            inlink = max(0, inlink - 1) if closing else 1
        if tag not in BLOCKS:
            continue
        flush()
        inlink = 0
        if tag == "hr":
            continue
        if closing:
            while within[tag]:
                last = path.pop()[0]
                within[last] -= 1
                if last == tag:
                    break
            continue
        if tag in CLOSES_P and path and path[-1][0] == "p":
            within[path.pop()[0]] -= 1
        for same, stop in (({"li"}, {"ul", "ol", "menu"}), ({"td", "th"}, {"tr", "table"}), ({"tr"}, {"table", "tbody", "thead", "tfoot"}), ({"dt", "dd"}, {"dl"})):
            if tag in same and any(within[t] for t in same):
                for i in range(len(path) - 1, -1, -1):
                    if path[i][0] in stop:
                        break
                    if path[i][0] in same:
                        within.subtract(t for t, _ in path[i:])
                        del path[i:]
                        break
        if tag in ("html", "body") and within[tag]:
            continue
        path.append((tag, _label(tag, m[3])))
        within[tag] += 1
    flush()
    return out


@dataclass
class Node:
    """An element of a wrapper: how often, repeated or not, its text slot and its children in order."""

    label: str
    n: int = 1
    rep: bool = False
    chars: int = 0
    links: int = 0
    text: int | None = None
    slot: bool = False
    kids: list[Node] = field(default_factory=list)

    def state(self) -> list:
        return [self.label, self.n, int(self.rep), self.chars, self.links, self.text, int(self.slot), [k.state() for k in self.kids]]


def load(s: list) -> Node:
    return Node(s[0], s[1], bool(s[2]), s[3], s[4], s[5], bool(s[6]), [load(k) for k in s[7]])


def _absorb(a: Node, b: Node, same_page: bool) -> Node:
    """a with b aligned into it; on one page the two are repeats of each other."""
    if same_page:
        a.rep, a.n = True, max(a.n, b.n)
    else:
        a.rep, a.n = a.rep or b.rep, a.n + b.n
    a.chars += b.chars
    a.links += b.links
    if a.text != b.text:
        a.slot = True
    a.slot = a.slot or b.slot
    a.kids = align(a.kids, b.kids, same_page)
    return a


def collapse(kids: list[Node]) -> list[Node]:
    """Repeats of one element, or of a run of up to six, become one."""
    for period in range(1, 7):
        out: list[Node] = []
        for k in kids:
            out.append(k)
            while len(out) >= 2 * period and all(out[-i].label == out[-i - period].label for i in range(1, period + 1)):
                for i in range(period, 0, -1):
                    _absorb(out[-i - period], out[-i], True)
                del out[-period:]
        kids = out
    return kids


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of labels: equal ends, then the longest one by a table, or a greedy one where that would be too large."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head : n - tail], b[head : m - tail]
    if len(x) * len(y) <= CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for j, label in enumerate(y):
            places.setdefault(label, []).append(j)
        at = 0
        for i, label in enumerate(x):
            found = places.get(label, [])
            k = bisect_left(found, at)
            # no jump that leaves much less of one sequence than of the other
            if k < len(found) and found[k] - at <= 8 + max(0, len(y) - at - (len(x) - i)):
                out.append((head + i, head + found[k]))
                at = found[k] + 1
    return out + [(n - tail + i, m - tail + i) for i in range(tail)]


def align(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    """Two sequences as one: a common subsequence of labels is matched, the rest is optional."""
    if [x.label for x in a] == [x.label for x in b]:
        return [_absorb(x, y, same_page) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in _matches([x.label for x in a], [x.label for x in b]):
        out += [*a[i:p], *b[j:q], _absorb(a[p], b[q], same_page)]
        i, j = p + 1, q + 1
    return collapse(out + a[i:] + b[j:])


def tree(found: list[tuple[tuple[str, ...], str, int]]) -> Node:
    """A page's blocks as the wrapper of that page."""
    root = Node("")
    for path, text, links in found:
        at = root
        for label in path:
            # neighbours of one label join at once, so a long page makes no long list
            if not at.kids or at.kids[-1].label != label:
                at.kids.append(Node(label))
            at = at.kids[-1]
        if at.chars:
            at.rep = at.slot = True
        at.chars += len(text)
        at.links += links
        at.text = zlib.crc32(text.encode()) if at.text is None else at.text

    def settle(x: Node) -> None:
        for k in x.kids:
            settle(k)
        x.kids = collapse(x.kids)

    settle(root)
    return root


def infer(partials: Iterator[Node]) -> Node | None:
    wrapper = None
    for p in partials:
        wrapper = p if wrapper is None else _absorb(wrapper, p, False)
    return wrapper


def _clean(label: str) -> bool:
    return not label.endswith("!") and label not in DROPPED


def volume(x: Node, inside: bool = False) -> int:
    """Characters outside links of what varies, or of all text inside an article, below an element that is no noise."""
    if not _clean(x.label) or x.label == "header" and not inside:
        return 0
    own = x.chars - x.links if x.slot or x.n == 1 or inside else 0
    return max(own, 0) + sum(volume(k, inside) for k in x.kids)


def places(wrapper: Node) -> list[list[str]]:
    """Paths at which the article is looked for, in order: article elements, main elements, the densest element, the page."""
    found: dict[str, list[list[str]]] = {"article": [], "main": []}

    def walk(x: Node, path: list[str]) -> None:
        for k in x.kids:
            if not _clean(k.label):
                continue
            here = [*path, k.label]
            if k.label in found and volume(k, True):
                if here not in found[k.label]:
                    found[k.label].append(here)
            else:
                walk(k, here)

    walk(wrapper, [])
    dense, at = [], wrapper
    while True:
        sizes = [volume(k) for k in at.kids]
        whole = sum(sizes) + (max(at.chars - at.links, 0) if at.slot else 0)
        if not sizes or not whole or max(sizes) < DENSE * whole or at.kids[sizes.index(max(sizes))].rep:
            break
        at = at.kids[sizes.index(max(sizes))]
        dense.append(at.label)
    return [*found["article"], *found["main"], dense, []]


def read(page: str | None, where: list[list[str]]) -> str:
    """A page's text at the first kind of place where it has some."""
    found = blocks(page or "")
    done: set[str] = set()
    for place in where:
        kind = place[-1] if place and place[-1] in ("article", "main") else str(place)
        if kind in done:
            continue
        done.add(kind)
        roots = [p for p in where if p and p[-1] == kind] if kind in ("article", "main") else [place]
        texts = []
        for path, text, _ in found:
            for r in roots:
                if list(path[: len(r)]) == r:
                    rest = path[len(r) :]
                    if all(map(_clean, rest)) and (r and r[-1] in ("article", "main") or "header" not in rest):
                        texts.append(text)
                    break
        if texts:
            return "\n".join(texts)
    return ""


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial wrappers of a task's pages, by host; the task holds wrappers, not pages."""
    own: dict[str, Node] = {}
    salt = TaskContext.get().partitionId() % SALTS
    for pdf in batches:
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            one = tree(blocks(page or ""))
            own[host] = _absorb(own[host], one, False) if host in own else one
        if len(own) > 5000:
            yield _rows(own, salt)
            own = {}
    if own:
        yield _rows(own, salt)


def _rows(own: dict[str, Node], salt: int) -> pd.DataFrame:
    # plain objects: strings that pandas keeps in Arrow chunks are not taken back
    strings = lambda x: pd.Series(list(x), dtype=object)
    return pd.DataFrame({"host": strings(own), "salt": salt, "wrapper": strings(json.dumps(w.state()) for w in own.values())})


def _merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    w = infer(load(json.loads(s)) for pdf in batches for s in pdf["wrapper"])
    if w:
        yield _rows({key[0]: w}, 0)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host of pages(url, html); wrapper is the expression as JSON."""
    schema = "host string, salt int, wrapper string"
    parts = pages.select(host_of(pages["url"]).alias("host"), F.coalesce(pages["html"], F.lit("")).alias("html")).mapInPandas(_fold, schema)
    once = parts.groupBy("host", "salt").applyInPandas(_merge, schema)
    return once.groupBy("host").applyInPandas(_merge, schema).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    Null html is an empty page, whose text is empty; a null url, or one without a host,
    belongs to the host without name; repeated rows give equal rows; extra columns are
    ignored; an empty table gives an empty table. Elements may be nested to any depth, of
    which wrappers see DEPTH levels, and have any number of children.
    """
    small_batches(pages.sparkSession, 128)

    @F.pandas_udf("string")
    def place(ws: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(places(load(json.loads(w)))) for w in ws], dtype=object)

    where = keep(wrappers(pages).select("host", place("wrapper").alias("places")), "wrappers")
    cache: dict[str, list[list[str]]] = {}

    @F.pandas_udf("string")
    def text(htmls: pd.Series, ps: pd.Series) -> pd.Series:
        if len(cache) > 10_000:
            cache.clear()
        return pd.Series([read(h, cache.setdefault(p, json.loads(p)) if p not in cache else cache[p]) for h, p in zip(htmls, ps, strict=True)], dtype=object)

    joined = pages.select("page_id", "url", "html", host_of(pages["url"]).alias("host")).join(where, "host")
    return joined.select("page_id", "url", text("html", "places").alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
