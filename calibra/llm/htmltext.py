"""Main text of web pages by inferred wrappers.

*Stream.*  A page is read as a stream of block elements and text; comments,
scripts and inline tags are not part of it, an unclosed paragraph or list item
ends where the next block begins, and a tag cut off by the end of the page is
dropped.  Elements nested more than ``DEPTH`` deep still part their text into
blocks, but do not deepen the structure.  An element is known by its tag and, if its class, id or role has a
word of ``BOILERPLATE`` or ``MAIN``, by that word.

*Wrapper.*  A union-free expression over elements and text slots.  Two
streams are aligned level by level (longest common subsequence of the
elements); an element that both have is aligned within, one that only one of
them has becomes optional, and neighbours of the same kind become one repeated
group.  Pages of a host that have the same containers around most of their
text, and alike have or lack a main element, are of one template; a
template's wrapper is the alignment of all its pages: equal wrappers are
counted once, the others are aligned in up to ``PARTS`` parallel groups, and
the groups' wrappers with each other.

*Slots.*  Each page is matched against its template's wrapper, which gives
every text the place of its slot.  A slot that reads the same on
``CONSTANT_PAGES`` or more distinct pages (copies count once) is constant,
others vary.  The text is that of the smallest container that holds most of
the varying characters, without its constant slots that all pages have.  Word
lists break ties: slots of ``BOILERPLATE`` count only where no other slot
varies; around or below that container a main element is preferred, and so it
is in templates of too few pages to tell what is constant.

*Text.*  A page's blocks at its template's text slots, in page order: character
references decoded, white space turned to single spaces, trimmed, joined by
blank lines.

Wrappers join pages by host and template; they are broadcast only after a
count shows that they are at most ``broadcast_rows``.

Nulls and odd cases: a null or empty page has the text ''; a null URL belongs
to the empty host; rows that repeat an id are extracted each; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from calibra.llm.common import in_arrow, small_enough, written
from calibra.llm.urlfilter import host_of

PARTS = 64
DEPTH = 100
CONSTANT_PAGES = 3
BROADCAST_ROWS = 20_000

# fixed values: HTML elements by their part in a page, and words of class, id and role that mark one
BLOCKS = frozenset("""
html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr title
""".split())
SKIPPED = frozenset("script style noscript template iframe svg canvas object select option button textarea input label math video audio".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head nav footer aside form fieldset title dialog menu".split())
CENTRES = frozenset("article main".split())
CONTAINERS = frozenset("html body main article section div".split())
BOILERPLATE = frozenset("""
ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menus nav navbar navigation
breadcrumb breadcrumbs masthead topbar footer contentinfo complementary cookie cookies consent gdpr notice notices alert popup modal dialog newsletter
subscribe subscription signup login search share sharing social related recommended widget comment comments reply replies respond disqus
pagination pager copyright disclaimer form hidden
""".split())
MAIN = frozenset("article articlebody main content post entry story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+")
_WHOLE = re.compile(r"[\s]+")
# words that may stand beside a word of BOILERPLATE in a compound, as in share-buttons
_COMPOUND = frozenset("""
area bar block blocks box button buttons container form frame group holder icons inner item items label link links list outer panel
policy posts articles section slot text top bottom left right unit wrap wrapper
""".split())


def _tokens(value: str) -> set[str]:
    """The words that whole class tokens stand for; a compound counts if all of its words speak of boilerplate."""
    out = set()
    for token in _WHOLE.split(value.lower()):
        parts = [w for w in _SPLIT.split(token) if w]
        if len(parts) < 2:
            out.update(parts)
        elif "hidden" not in parts and all(w in BOILERPLATE | _COMPOUND for w in parts):
            out.update(w for w in parts if w in BOILERPLATE)
    return out


@lru_cache(4096)
def _mark(tag: str, attributes: str) -> tuple[str, bool]:
    """(name of the element, whether it is boilerplate)."""
    words: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            words |= _tokens(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.add("hidden")
    bad = sorted(words & BOILERPLATE)
    if tag not in ("body", "html") and (bad and tag not in CENTRES or "comment" in words or "hidden" in words):
        return f"{tag}.{(bad or ['hidden'])[0]}", True
    good = sorted(words & MAIN)
    return (f"{tag}.{good[0]}" if good else tag), tag in LEFT_OUT


_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def blocks(page: str | None) -> list[tuple[str, str, bool]]:
    """(path, text, boilerplate) of each block of text, in page order; elements without text have ''."""
    page = page or ""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, boilerplate
    buffer: list[str] = []
    inline: list[str] = []  # open inline elements that are left out
    at, raw = 0, ""

    def here() -> tuple[str, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else ("", False)

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((here()[0], text, here()[1]))

    def close(k: int) -> None:
        flush()
        del stack[k:]

    while at < len(page):
        if raw:  # up to its own end tag
            m = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at, raw = (m.end() if m else len(page)), ""
            continue
        m = _TAG.search(page, at)
        if not inline:
            buffer.append(html.unescape(page[at:m.start() if m else len(page)]))
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        if m[7] == "":  # cut off by the end of the page
            break
        tag = tag.lower()
        if end:
            if inline:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag):]
                    continue
                if tag not in BLOCKS:
                    continue
            if tag in BLOCKS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        inline.clear()
                        close(k)
                        break
                else:
                    flush()
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            buffer.append(" ")
            continue
        if tag in RAW and tag != "title" or tag == "title" and not stack:
            raw = tag
            continue
        if tag in SKIPPED:
            if not attributes.endswith("/"):
                inline.append(tag)
            continue
        if tag not in BLOCKS:
            if inline:
                if tag in inline:
                    inline.append(tag)
            elif _mark(tag, attributes)[1]:
                inline.append(tag)
            continue
        flush()
        inline.clear()
        if tag == "hr":
            continue
        if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()  # these hold no blocks
        shut = _CLOSES.get(tag, ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in shut:
                del stack[k:]
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                break
        path, bad = here()
        name, own = _mark(tag, attributes)
        if tag == "header" and not any(s[0] in CENTRES for s in stack):
            own = True
        if len(stack) < DEPTH:
            path = f"{path}/{name}"
            out.append((path, "", bad or own))
        stack.append((tag, path, bad or own))
        if tag == "title":
            raw = "title"
    flush()
    return out


# ---- wrappers: [name, optional, repeated, children]; a text slot is ["#", ...] ----

def _fold(kids: list) -> list:
    """Neighbours of the same kind as one repeated group."""
    out: list = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            last = out[-1]
            out[-1] = [k[0], last[1] and k[1], k[0] != "#", _align(last[3], k[3])]
        else:
            out.append(k)
    return out


class _Common:
    """Lengths of the longest common subsequences of all suffix pairs of two name lists.

    A row of lengths is one integer whose zero bits are its steps, so a row
    costs a few operations on whole integers.  Only every ``step``-th row is
    kept; the rows between two kept ones are made again when asked for.
    """

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.m = a, len(b)
        self.full = (1 << self.m) - 1
        self.where: dict[str, int] = {}
        for j, name in enumerate(reversed(b)):
            self.where[name] = self.where.get(name, 0) | 1 << j
        self.step = math.isqrt(len(a)) + 1
        row, self.kept, self.near = self.full, {len(a): self.full}, {}
        for i in range(len(a) - 1, -1, -1):
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def _above(self, i: int, row: int) -> int:
        hit = row & self.where.get(self.a[i], 0)
        return (row + hit | row - hit) & self.full

    def __call__(self, i: int, j: int) -> int:
        """Of the suffixes that start at i and j."""
        row = self.kept.get(i)
        if row is None:
            row = self.near.get(i)
        if row is None:
            last = min(len(self.a), (i // self.step + 1) * self.step)
            row, self.near = self.kept[last], {}
            for k in range(last - 1, i // self.step * self.step, -1):
                row = self.near[k] = self._above(k, row)
            row = self.near[i]
        n = self.m - j
        return n - (row & (1 << n) - 1).bit_count()


def _align(a: list, b: list) -> list:
    """One expression for what both match."""
    if a == b:
        return a
    n, m = len(a), len(b)
    common = _Common([x[0] for x in a], [x[0] for x in b])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append([a[i][0], a[i][1] or b[j][1], a[i][2] or b[j][2], _align(a[i][3], b[j][3])])
            i, j = i + 1, j + 1
        elif j == m or i < n and common(i + 1, j) >= common(i, j + 1):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return _fold(out)


def wrapper_of(stream: list[tuple[str, str, bool]]) -> list:
    """The expression of one page."""
    root: list = ["", False, False, []]
    open_: list[list] = [root]
    paths = [""]
    for path, text, _ in stream:
        if text:
            while paths[-1] != path and len(paths) > 1:
                paths.pop()
                open_.pop()
            if not open_[-1][3] or open_[-1][3][-1][0] != "#":
                open_[-1][3].append(["#", False, False, []])
            continue
        parent, _, name = path.rpartition("/")
        while paths[-1] != parent and len(paths) > 1:
            paths.pop()
            open_.pop()
        node = [name, False, False, []]
        open_[-1][3].append(node)
        open_.append(node)
        paths.append(path)

    def folded(node: list) -> list:
        return [node[0], node[1], node[2], _fold([folded(k) for k in node[3]])]

    return folded(root)[3]


def show(wrapper: list) -> str:
    """The wrapper as an expression, # being a text slot."""
    return " ".join(("#" if n == "#" else f"<{n}>({show(k)})") + "?" * opt + "+" * rep for n, opt, rep, k in wrapper)


def align_all(wrappers: list[str]) -> str:
    out: list | None = None
    for w in sorted(wrappers):
        out = json.loads(w) if out is None else _align(out, json.loads(w))
    return json.dumps(out or [])


def _named(kids: list, base: str) -> list[str]:
    """Paths of the children, the second and further ones of a name being numbered."""
    met: Counter = Counter()
    out = []
    for k in kids:
        met[k[0]] += 1
        out.append(f"{base}/{k[0]}" + (f"[{met[k[0]]}]" if met[k[0]] > 1 else ""))
    return out


def slots(wrapper: list, base: str = "", required: bool = False) -> list[str]:
    """Paths of the text slots, or of those that every page of the wrapper has."""
    out = []
    for k, path in zip(wrapper, _named(wrapper, base)):
        if not (required and k[1]):
            out += [base] if k[0] == "#" else slots(k[3], path, required)
    return list(dict.fromkeys(out))


# ---- matching a page against its wrapper ----

def _places(names: list[str], kids: list) -> list[int] | None:
    """Which of the expression's children each name is, in order; what every page has is passed over only if nothing else fits."""
    after, last = [0] * (len(kids) + 1), len(kids)  # the next required one behind each
    for j in range(len(kids) - 1, -2, -1):
        after[j + 1] = last
        if j >= 0 and not kids[j][1]:
            last = j
    where: dict[str, list[int]] = {}
    for j, k in enumerate(kids):
        where.setdefault(k[0], []).append(j)
    ends, rows = [-1], []
    for name in names:
        back, loose = {}, {}
        for k in where.get(name, ()):
            i = bisect_left(ends, k) - 1
            if i >= 0:
                loose[k] = ends[i]
                if k <= after[ends[i] + 1]:
                    back[k] = ends[i]
        rows.append(back or loose)
        ends = sorted(rows[-1])
        if not ends:
            return None
    at, out = ends[-1], []
    for back in reversed(rows):
        out.append(at)
        at = back[at]
    return out[::-1]


def matched(stream: list[tuple[str, str, bool]], wrapper: list) -> list[str]:
    """The wrapper's slot of each text of the stream, in order."""
    root: list = ["", []]
    open_, paths, n = [root], [""], 0
    for path, text, _ in stream:
        to = path if text else path.rpartition("/")[0]
        while paths[-1] != to and len(paths) > 1:
            paths.pop()
            open_.pop()
        if text:
            open_[-1][1].append(["#", n])
            n += 1
        else:
            node = [path.rpartition("/")[2], []]
            open_[-1][1].append(node)
            open_.append(node)
            paths.append(path)
    out = [""] * n

    def walk(nodes: list, kids: list, base: str) -> None:
        runs: list[tuple[str, list]] = []
        for node in nodes:
            if not runs or runs[-1][0] != node[0]:
                runs.append((node[0], []))
            runs[-1][1].append(node)
        found = _places([name for name, _ in runs], kids)
        named = _named(kids, base)
        for k, (name, same) in enumerate(runs):
            for node in same:
                if name == "#":
                    out[node[1]] = base
                elif found is None:
                    walk(node[1], [], f"{base}/{name}")
                else:
                    walk(node[1], kids[found[k]][3], named[found[k]])

    walk(root[1], wrapper, "")
    return out


def _central(element: str) -> bool:
    name = element.partition("[")[0]
    return name.split(".")[0] in CENTRES or name.partition(".")[2] in MAIN


def _tag_of(element: str) -> str:
    return element.partition("[")[0].split(".")[0]


def shape_of(stream: list[tuple[str, str, bool]]) -> str:
    """Template of a page: whether it has a main element, and the containers around most of its text down to a main element."""
    texts = [(p, len(t)) for p, t, bad in stream if t and not bad] or [(p, len(t)) for p, t, _ in stream if t]
    if not texts:
        return ""
    centre = any(not bad and not t and _central(p.rpartition("/")[2]) for p, t, bad in stream)
    whole = sum(n for _, n in texts)
    sums: Counter = Counter()
    for p, n in texts:
        sums[p] += n
    spine = ""
    while not _central(spine.rpartition("/")[2]):
        below: Counter = Counter()
        for p, n in sums.items():
            if p.startswith(spine + "/"):
                below[p[len(spine) + 1:].partition("/")[0]] += n
        most = max(below, key=lambda x: (below[x], x), default="")
        if 2 * below[most] <= whole or _tag_of(most) not in CONTAINERS:
            break
        spine += f"/{most}"
    return f"{'main' if centre else ''}:{spine}"


def text_slots(wrapper: list, seen: dict[str, tuple[int, bool, int]]) -> list[str]:
    """Slots whose text is the page's; seen: distinct pages (up to CONSTANT_PAGES), marked as boilerplate, and characters (0 if constant) by slot."""
    known = [p for p in slots(wrapper) if p in seen]
    vary = {p: seen[p][2] for p in known}
    good = [p for p in known if not seen[p][1]]
    words = [p for p in known if seen[p][1] and vary[p] and not any(
        _tag_of(x) in LEFT_OUT or _tag_of(x) == "header" or x.partition("[")[0].endswith(".hidden") for x in p.split("/"))]
    told = [p for p in good if vary[p] and seen[p][0] >= CONSTANT_PAGES]
    differ = sum(vary[p] for p in words if seen[p][0] >= CONSTANT_PAGES)
    if words and not any(vary[p] for p in good) or not told and differ > sum(vary[p] for p in good):
        return [p for p in known if p in good or p in words]  # marked by words, and yet most of what the template varies
    whole = sum(vary[p] for p in good)
    central = [p for p in good if any(map(_central, p.split("/")))]
    if not whole:
        return central or good
    evident = max(seen[p][0] for p in known) >= CONSTANT_PAGES
    if central and not evident:
        return central
    sums: Counter = Counter()
    for p in good:
        parts = p.split("/")
        for k in range(1, len(parts) + 1):
            sums["/".join(parts[:k])] += vary[p]
    holder = max((e for e, n in sums.items() if 2 * n > whole), key=lambda e: (e.count("/"), e))  # the deepest that holds most of it
    parts = holder.split("/")
    while len(parts) > 1 and _tag_of(parts[-1]) not in CONTAINERS:
        parts.pop()

    def within(p: str, e: str) -> bool:
        return p == e or p.startswith(e + "/")

    holder = inner = "/".join(parts)
    around = [k for k, x in enumerate(parts) if _central(x)]
    if around:
        holder, inner = "/".join(parts[:around[0] + 1]), "/".join(parts[:around[-1] + 1])
        return [p for p in good if within(p, inner) or within(p, holder) and vary[p]]
    below = [p for p in central if within(p, holder)]
    if any(vary[p] for p in below):
        return below
    needed = set(slots(wrapper, required=True))
    return [p for p in good if within(p, holder) and (vary[p] or p not in needed)]


_KEY = ["host", "shape"]


def parsed(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but html, with shape, own (the page's own expression) and stream, as JSON."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    new = ["shape", "own", "stream"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                streams = [blocks(h) for h in some["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[some[f.name] for f in kept], pa.array([shape_of(x) for x in streams], pa.string()),
                     pa.array([json.dumps(wrapper_of(x)) for x in streams], pa.string()),
                     pa.array([json.dumps(x, ensure_ascii=False) for x in streams], pa.string())], [*[f.name for f in kept], *new])

    return pages.transform(in_arrow, run, StructType([*kept, *[StructField(c, StringType()) for c in new]]))


def _beside(rows: DataFrame, table: DataFrame, broadcast_rows: int) -> DataFrame:
    return rows.join(F.broadcast(table) if small_enough(table, broadcast_rows) else table, _KEY, "left")


@lru_cache(512)
def _loaded(wrapper: str | None) -> list:
    return json.loads(wrapper or "[]")


def infer(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """host, shape, wrapper (as JSON), text_paths of every template of host, html."""
    return _infer(written(parsed(pages.select("host", "html")), "streams"), broadcast_rows)


def _infer(streams: DataFrame, broadcast_rows: int) -> DataFrame:
    shapes = written(streams.select("host", "shape", F.col("own").alias("wrapper")).distinct(), "shapes") \
        .withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))

    def aligned(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "shape": [rows["shape"].iloc[0]], "wrapper": [align_all(rows["wrapper"].tolist())]})

    kinds = "host string, shape string, wrapper string"
    parts = shapes.groupBy(*_KEY, "part").applyInPandas(aligned, kinds)
    whole = written(parts.groupBy(*_KEY).applyInPandas(aligned, kinds), "aligned")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes: dict = {}
            for host, shape, wrapper, page in zip(*(b[c].to_pylist() for c in ("host", "shape", "wrapper", "stream"))):
                stream = json.loads(page)
                texts: dict[str, list] = {}
                bad = {}
                for (_, text, boiler), slot in zip((x for x in stream if x[1]), matched(stream, _loaded(wrapper))):
                    texts.setdefault(slot, []).append(text)
                    bad[slot] = boiler
                # copies differ in boilerplate at most, and boilerplate is told by whole pages
                page_ = [xxhash.xxh64_intdigest("\n".join(t for _, t, boiler in stream if t and (every or not boiler))) >> 1 for every in (False, True)]
                for slot, t in texts.items():
                    h = xxhash.xxh64_intdigest("\n".join(t)) >> 1
                    lo, hi, chars, _, met = sizes.get((host, shape, slot), (h, h, 0, False, ()))
                    own = page_[bad[slot]]
                    if own not in met and len(met) < CONSTANT_PAGES:
                        met = (*met, own)
                    sizes[(host, shape, slot)] = (min(lo, h), max(hi, h), chars + sum(map(len, t)), bad[slot], met)
            rows = [(*key, lo, hi, 0 if k else chars, boiler, own) for key, (lo, hi, chars, boiler, met) in sizes.items() for k, own in enumerate(met)]
            kinds = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             ["host", "shape", "path", "lo", "hi", "chars", "bad", "page"])

    sizes = _beside(streams.select(*_KEY, "stream"), whole, broadcast_rows).select(*_KEY, "wrapper", "stream").transform(
        in_arrow, measure, "host string, shape string, path string, lo long, hi long, chars long, bad boolean, page long")
    # as many rows as the wrappers have slots; copies of a page count once
    by_slot = sizes.groupBy(*_KEY, "path").agg(
        F.count_distinct("page").alias("pages"), F.max("bad").alias("bad"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"))
    constant = (F.col("lo") == F.col("hi")) & (F.col("pages") >= CONSTANT_PAGES)
    seen = by_slot.groupBy(*_KEY).agg(F.collect_list(F.struct("path", "pages", "bad", F.when(constant, 0).otherwise(F.col("chars")).alias("chars"))).alias("seen"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for w, s in zip(b["wrapper"].to_pylist(), b["seen"].to_pylist()):
                known = {x["path"]: (x["pages"], x["bad"], x["chars"]) for x in s or ()}
                got.append(text_slots(json.loads(w), known) if known else [])
            yield pa.RecordBatch.from_arrays([b["host"], b["shape"], b["wrapper"], pa.array(got, pa.list_(pa.string()))],
                                             ["host", "shape", "wrapper", "text_paths"])

    return whole.join(seen, _KEY, "left").select(*_KEY, "wrapper", "seen").transform(in_arrow, chosen, f"{kinds}, text_paths array<string>")


def main_text(page: str | None, text_paths: list[str] | None, wrapper: list | None = None) -> str:
    """The page's texts at the slots of its wrapper; without one the page is its own."""
    stream = blocks(page)
    return _text(stream, text_paths, wrapper_of(stream) if wrapper is None else wrapper)


def _text(stream: list, text_paths: list[str] | None, wrapper: list) -> str:
    keep = set(text_paths or ())
    return "\n\n".join(text for text, slot in zip((t for _, t, _ in stream if t), matched(stream, wrapper)) if slot in keep)


def extract(pages: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, host, text of every row."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    streams = written(parsed(rows), "streams")  # a page is parsed once
    wrappers = written(_infer(streams, broadcast_rows), "wrappers")
    joined = _beside(streams.drop("own"), wrappers, broadcast_rows).select("page_id", "url", "host", "stream", "wrapper", "text_paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_text(json.loads(x), p, _loaded(w)) for x, p, w in zip(*(b[c].to_pylist() for c in ("stream", "text_paths", "wrapper")))]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], b["host"], pa.array(got, pa.string())], ["page_id", "url", "host", "text"])

    return joined.transform(in_arrow, run, StructType([joined.schema["page_id"], joined.schema["url"], StructField("host", StringType()),
                                              StructField("text", StringType())]))
