"""Main text of web pages by wrapper induction: pages of one site are aligned, what is constant is template.

A page is parsed to a tree of its block elements; text that stands in a block (with all inline markup) is a leaf. Pages
of one host whose trees have the same kinds of nodes around the main text are a site. A site's reference is its page
with the fewest nodes. Every page of the site is aligned with it by simple tree matching: the largest matching of two
trees that keeps order and ancestors, from a dynamic program over the children of matched nodes. A reference node whose
text is in the matched place in nearly all pages of at least LEAST_PAGES is template; the other text nodes are slots. Pages that
share most of their text with the reference are copies and no evidence.

Of a page, the slots of its content element are the main text. That element is `article`, `main` or their roles; where
a page has none, it is the lowest element that holds nearly all slot text which is not link text. What a page itself
marks as menu, header, footer, sidebar, notice, advert, form, script, style or reader comment (by element, role, class
or id) is left out in any case, varying or not: such parts vary within a site as content does.

Two passes read the pages. The first sends on node kinds and text hashes only (a few bytes a node); counts by reference
node are summed in tasks before they are shuffled. What is known of a site is put beside its pages by a broadcast join
if its measured size is under BROADCAST_BYTES, else by a shuffle in which pages of hot sites are dealt to several keys
(a site with over a HOT-th of all pages is hot, so there are fewer than HOT of these).

Defined results: a null or empty html has the empty text; pages without a host are sites by their node kinds alone. A
site with few pages has no template, and its pages are judged by their own marks. Very long pages are handled like
others: matching a page costs its children times the reference's, level by level, and elements nested over DEEPEST
levels deep count as children of the last level. Repeated rows and null ids give one row each. Ties between pages for
the reference go to the smaller hash. An empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairloom.llm.common import release
from fairloom.operators.storage import written

LEAST_PAGES, SHARE, COPY_SHARE = 5, 0.9, 0.8
#: The content element of a page without article or main holds at least this share of its text that isn't links.
HELD = 0.7
DEEPEST = 200
BROADCAST_BYTES = 16_000_000
HOT = 1000
#: Pages a hot site's key may have.
DEALT = 20_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAMED = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")

# Kinds of elements, as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
SKIPPED = frozenset("select datalist svg math canvas audio video object template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label map mark meter nobr "
    "output picture progress q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
ENDS_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("nav footer aside form button select datalist dialog menu template head svg math canvas audio video object iframe applet noscript script style textarea".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
#: Words of class names and ids that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars aside menu menus nav navi navbar navigation breadcrumb breadcrumbs pager pagination masthead topbar toolbar footer "
    "comment comments commentlist respond reply replies disqus related recommended recommendations share sharing social widget widgets skip login search".split())
PAGE_MARKS = MARKS | {"header", "head"}
NEGATIONS = frozenset("no not has with without".split())
CONTENT = frozenset(["article", "main"])


class Node:
    __slots__ = ("tag", "kind", "children", "parent", "depth", "text", "links", "out", "content", "marked")

    def __init__(self, tag: str, kind: str, parent: Node | None):
        self.tag, self.kind, self.parent = tag, kind, parent
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text: str = ""
        self.links = 0
        self.out = self.content = self.marked = False


@lru_cache(maxsize=20_000)
def described(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's kind; if it is left out anywhere; if it is left out around the main text; if it is the main text."""
    said = {}
    for m in ATTRIBUTE.finditer(attributes):
        said.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    names = f"{said.get('class', '')} {said.get('id', '')}".split()
    kind = ".".join([tag, *sorted({DIGITS.sub("0", n) for n in names})]).replace("(", "").replace(")", "").replace(",", "")
    role = said.get("role", "").lower()
    content = tag in CONTENT or role in CONTENT or "articlebody" in said.get("itemprop", "").lower()
    words = set()
    for n in names:
        split = [w.lower() for w in WORD.findall(n)]
        words |= {w for i, w in enumerate(split) if not (i and split[i - 1] in NEGATIONS)}
    style = said.get("style", "").lower().replace(" ", "")
    hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    out = tag in LEFT_OUT or role in LEFT_OUT_ROLES or hidden or bool(words & MARKS)
    return kind, out, out or tag == "header" or bool(words & PAGE_MARKS), content and not (words & MARKS or hidden)


def parsed(html: str) -> Node:
    """The tree of block elements, with the text of each stretch of inline content as a leaf of kind '#'."""
    root = node = Node("html", "html", None)
    opened: list[str] = []  # inline elements open in this block that matter: links, and what is left out
    held: list[str] = []
    linked = dropped = over = 0

    def flush() -> None:
        nonlocal linked
        words = "".join(held).split()
        if words:
            leaf = Node("#", "#", node)
            leaf.text, leaf.links = " ".join(words), linked
            node.children.append(leaf)
        held.clear()
        linked = 0

    at = 0
    while True:
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece and not dropped:
            piece = entities.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if "a" in opened:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in ("html", "body"):
            if node.tag == "head":
                flush()
                node = root
            continue
        if closing:
            if tag in INLINE:
                if tag in opened:
                    opened.remove(tag)
                if tag + "!" in opened:
                    opened.remove(tag + "!")
                    dropped -= 1
                continue
            if over:
                over -= 1
                continue
            found = node
            while found is not None and found.tag != tag:
                found = found.parent
            if found is not None and found.parent is not None:
                flush()
                node = found.parent
                dropped, opened = 0, []
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img", "input") and not dropped:
                held.append("" if tag == "wbr" else " ")
            if tag == "hr":
                flush()
            continue
        if tag in RAW or tag in SKIPPED:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else at if tag in SKIPPED else len(html)
            continue
        if tag in INLINE and not NAMED.search(attributes):
            opened.append(tag + "!" * (tag == "button"))
            dropped += tag == "button"
            continue
        kind, out, around, content = described(tag, attributes.strip().rstrip("/"))
        if tag in INLINE:
            if out:
                opened.append(tag + "!")
                dropped += 1
            else:
                opened.append(tag)
            continue
        flush()
        dropped, opened = 0, []
        if node.tag == "head":
            node = root
        if tag in CLOSED_BY:
            up = node
            while up is not root and up.tag not in ENDS_AT[tag] and up.tag not in CLOSED_BY[tag]:
                up = up.parent
            while up is not root and up.tag in CLOSED_BY[tag]:
                node = up = up.parent
        if tag in HEADINGS and node.tag in HEADINGS:
            node = node.parent
        while node.tag == "p":  # any block ends a paragraph
            node = node.parent
        if node.depth == DEEPEST:
            over += 1
            continue
        made = Node(tag, kind, node)
        made.out, made.marked, made.content = out, around, content
        node.children.append(made)
        node = made
    flush()
    return root


def in_order(node: Node) -> Iterator[Node]:
    """A node and all below it, in page order."""
    held = [node]
    while held:
        node = held.pop()
        yield node
        held.extend(reversed(node.children))


def sizes(nodes: list[Node]) -> dict[int, int]:
    """Characters of text that isn't links below each node."""
    total = {id(n): max(0, len(n.text) - n.links) for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None:
            total[id(n.parent)] += total[id(n)]
    return total


class Page:
    """What is needed of a page: kinds of its nodes as a skeleton, and texts of the leaves that may be main text."""

    def __init__(self, html: str | None):
        root = parsed(html or "")
        nodes = list(in_order(root))
        around: set[int] = set()  # what holds the main text is never left out
        for n in nodes:
            up = n if n.content else None
            while up is not None and id(up) not in around:
                around.add(id(up))
                up = up.parent
        has_content = bool(around)
        total = {} if has_content else sizes(nodes)
        state: dict[int, tuple[bool, bool]] = {}  # left out, inside the main text
        self.leaves: list[int] = []
        self.texts: list[str] = []
        self.prose: list[int] = []
        self.kinds: set[str] = set()
        for i, n in enumerate(nodes):
            out, inside = state[id(n.parent)] if n.parent is not None else (False, False)
            if not out and (n.out or n.marked) and id(n) not in around:
                # where nothing is marked as main text, a form or a badly named element may hold it
                whole = not has_content and total[id(n)] > HELD * total[id(root)] and (n.tag == "form" or n.tag not in LEFT_OUT)
                out = not whole and (n.out or not inside)
            inside = inside or n.content
            if n.kind == "#" and inside and in_header(n):
                out = True
            state[id(n)] = out, inside
            if not inside and n.kind != "#" and n.depth <= 3:
                self.kinds.add(n.kind)
            if n.kind == "#" and not out and (inside or not has_content):
                self.leaves.append(i)
                self.texts.append(n.text)
                self.prose.append(max(0, len(n.text) - n.links))
        self.skeleton = skeleton(root)
        # where nothing says what the main text is, each leaf's ancestors help to find it
        place = {} if has_content else {id(n): i for i, n in enumerate(nodes)}
        self.ups = [] if has_content else [ancestors(nodes[i], place) for i in self.leaves]


def in_header(n: Node) -> bool:
    """If a leaf lies in the header element of the main text, but in none of its headings."""
    up, heading = n.parent, False
    while up is not None and not up.content:
        heading = heading or up.tag in HEADINGS
        if up.tag == "header":
            return not heading
        up = up.parent
    return False


def ancestors(n: Node, place: dict[int, int]) -> list[int]:
    """What a leaf's block stands in, and all around that."""
    out, up = [], n.parent.parent or n.parent
    while up is not None:
        out.append(place[id(up)])
        up = up.parent
    return out


def skeleton(root: Node) -> str:
    """Kinds in page order, children in brackets."""
    out: list[str] = []
    held: list[Node | str] = [root]
    while held:
        n = held.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        out.append(n.kind)
        if n.children:
            out.append("(")
            held.append(")")
            held.extend(reversed(n.children))
        else:
            out.append(",")
    return "".join(out)


STEP = re.compile(r"([^(),]+)([(,])|(\))")


def tree(spelled: str) -> tuple[list[str], list[list[int]]]:
    """Kinds and children of a skeleton's nodes, numbered in page order."""
    kinds: list[str] = []
    children: list[list[int]] = []
    path: list[int] = []
    for m in STEP.finditer(spelled):
        if m[3]:
            path.pop()
            continue
        if path:
            children[path[-1]].append(len(kinds))
        kinds.append(m[1])
        children.append([])
        if m[2] == "(":
            path.append(len(kinds) - 1)
    return kinds, children


@lru_cache(maxsize=2000)
def matched(reference: str, page: str) -> tuple[int, ...]:
    """Simple tree matching: for each node of page, the node of reference it is matched with, or -1."""
    kinds_a, below_a = tree(reference)
    kinds_b, below_b = tree(page)
    known: dict[tuple[int, int], tuple[int, list[list[int]] | None]] = {}

    def weight(a: int, b: int) -> int:
        if kinds_a[a] != kinds_b[b]:
            return 0
        if not below_a[a] or not below_b[b]:
            return 1
        if (a, b) not in known:
            rows = [[0] * (len(below_b[b]) + 1)]
            for x in below_a[a]:
                last, row = rows[-1], [0]
                for j, y in enumerate(below_b[b]):
                    row.append(max(row[j], last[j + 1], last[j] + weight(x, y)))
                rows.append(row)
            known[a, b] = rows[-1][-1] + 1, rows
        return known[a, b][0]

    out = [-1] * len(kinds_b)
    held = [(0, 0)] if weight(0, 0) else []
    while held:
        a, b = held.pop()
        out[b] = a
        rows = known.get((a, b), (0, None))[1]
        i, j = len(below_a[a]), len(below_b[b])
        while rows and i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                held.append((below_a[a][i], below_b[b][j]))
    return tuple(out)


@lru_cache(maxsize=4000)
def holders(spelled: str) -> tuple[int, ...]:
    """For each node of a skeleton the element its block stands in: the parent's parent."""
    kinds, below = tree(spelled)
    up = [0] * len(kinds)
    for i, held in enumerate(below):
        for j in held:
            up[j] = i
    return tuple(up[i] for i in up)


def slots(reference: str, page: str, leaves: list[int]) -> list[int]:
    """For each leaf of page the reference node that is matched with the element its block stands in. Blocks of one
    kind in one element can be matched in many ways; the text then tells which are the same."""
    match, up = matched(reference, page), holders(page)
    return [match[up[i]] for i in leaves]


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def site_of(host: str | None, page: Page) -> int:
    return hashed(f"{host or ''} {' '.join(sorted(page.kinds))}")


FIRST = T.StructType([
    T.StructField("site", T.LongType()), T.StructField("skeleton", T.StringType()), T.StructField("leaves", T.ArrayType(T.IntegerType())),
    T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("nodes", T.IntegerType()), T.StructField("whole", T.LongType()),
])
SECOND = T.StructType([
    T.StructField("site", T.LongType()), T.StructField("skeleton", T.StringType()), T.StructField("leaves", T.ArrayType(T.IntegerType())),
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("prose", T.ArrayType(T.IntegerType())), T.StructField("ups", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


def host_of(url: Column) -> Column:
    """The host, without a port or the name www, in lower case."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)


def kinds_and_hashes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """First pass: of every page its site, skeleton and the hashes of its leaves' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                page = Page(as_text(body.as_py()))
                hashes = [hashed(t) for t in page.texts]
                rows.append((site_of(host, page), page.skeleton, page.leaves, hashes, [len(t) for t in page.texts], page.skeleton.count("(") + page.skeleton.count(","), hashed(page.skeleton + repr(hashes))))
            yield batch_of(FIRST, rows)
        matched.cache_clear()
        release()

    return pages.select(host_of(F.col(url)).alias("host"), html).mapInArrow(run, FIRST)


def as_text(body: bytes | None) -> str | None:
    return None if body is None else body.decode("utf-8", "replace")


ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()), "array<array<int>>": pa.list_(pa.list_(pa.int32())),
}


def batch_of(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[f.dataType.simpleString()]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def beside(pages: DataFrame, known: DataFrame, size: Column, hot: DataFrame, how: str) -> DataFrame:
    """pages with what is known of their site. known has one row a site."""
    measured = known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if measured <= BROADCAST_BYTES:
        return pages.join(F.broadcast(known), "site", how)
    hot = F.broadcast(hot)
    dealt = pages.join(hot, "site", "left").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))).drop("parts")
    copies = known.join(hot, "site", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    return dealt.join(copies, ["site", "part"], how).drop("part")


def hot_sites(first: DataFrame, pages: int) -> DataFrame:
    """site, parts of sites that have over a HOT-th of all pages, and more than one part takes: fewer than HOT rows."""
    counts = first.groupBy("site").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") * HOT > pages) & (F.col("n") > DEALT)).select("site", F.ceil(F.col("n") / DEALT).cast("long").alias("parts"))


SEEN = T.StructType([T.StructField("site", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("same", T.LongType()), T.StructField("pages", T.LongType())])


def same_texts(pages: DataFrame) -> DataFrame:
    """By site and reference node: pages whose matched node has the same text, and pages that count as evidence (at
    node -1). Summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                up = holders(row["r_skeleton"])
                reference = {(up[i], h): i for i, h in zip(row["r_leaves"], row["r_hashes"], strict=True)}
                at = slots(row["r_skeleton"], row["skeleton"], row["leaves"])
                same = [(reference.get((a, h), -1), n) for a, h, n in zip(at, row["hashes"], row["lengths"], strict=True)]
                if row["whole"] == row["r_whole"] or sum(n for i, n in same if i >= 0) > COPY_SHARE * sum(row["lengths"]):
                    continue
                for node in {-1, *(i for i, _ in same)}:
                    seen[row["site"], node] = seen.get((row["site"], node), 0) + 1
            if len(seen) > 100_000:
                yield batch_of(SEEN, [(s, i, 0 if i < 0 else n, n if i < 0 else 0) for (s, i), n in seen.items()])
                seen.clear()
        yield batch_of(SEEN, [(s, i, 0 if i < 0 else n, n if i < 0 else 0) for (s, i), n in seen.items()])
        matched.cache_clear()
        release()

    return pages.mapInArrow(run, SEEN)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """One row for each site that has template text: site, r_skeleton, template (reference nodes), t_hashes (their
    texts' hashes). And the hot sites."""
    first = written(kinds_and_hashes(pages, url, html))
    hot = hot_sites(first, first.count())
    best = F.min(F.struct("nodes", "whole", "skeleton", "leaves", "hashes")).alias("r")
    reference = first.groupBy("site").agg(best, F.count("*").alias("n")).where(F.col("n") > LEAST_PAGES).select("site", *(F.col(f"r.{c}").alias(f"r_{c}") for c in ("whole", "skeleton", "leaves", "hashes")))
    size = F.length("r_skeleton") + 12 * F.size("r_leaves") + 100
    seen = same_texts(beside(first, written(reference), size, hot, "inner")).groupBy("site", "node").agg(F.sum("same").alias("same"), F.sum("pages").alias("pages"))
    counts = seen.where(F.col("node") < 0).select("site", F.col("pages").alias("all_pages"))
    constant = seen.where(F.col("node") >= 0).join(counts, "site").where((F.col("all_pages") >= LEAST_PAGES) & (F.col("same") >= SHARE * F.col("all_pages")))
    template = constant.groupBy("site").agg(F.sort_array(F.collect_list("node")).alias("template"))
    found = template.join(reference, "site").select("site", "r_skeleton", "template", F.transform("template", lambda i: F.col("r_hashes")[(F.array_position("r_leaves", i) - 1).cast("int")]).alias("t_hashes"))
    return written(found), hot


def main_text(texts: list[str], prose: list[int], ups: list[list[int]], keep: list[bool]) -> str:
    """The kept texts of the content element; where none is marked, of the lowest element with most of their prose."""
    if ups and any(keep):
        below: dict[int, int] = {}
        for up, n, k in zip(ups, prose, keep, strict=True):
            for j in up if k else ():
                below[j] = below.get(j, 0) + n
        whole = sum(n for n, k in zip(prose, keep, strict=True) if k)
        # nodes are numbered in page order, so of two that hold nearly all the one with the higher number is the lower
        element = max((j for j, n in below.items() if n >= HELD * whole), default=0)
        keep = [k and element in up and 2 * n >= len(t) for up, t, n, k in zip(ups, texts, prose, keep, strict=True)]
    return "\n\n".join([t for t, k in zip(texts, keep, strict=True) if k])


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    found, hot = wrappers(pages, url, html)
    key_type = pages.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(url, T.StringType()), *SECOND.fields])
    result = T.StructType([T.StructField(key, key_type), T.StructField(url, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for host, body in zip(part.column(2).to_pylist(), part.column(3).cast(pa.binary()), strict=True):
                    page = Page(as_text(body.as_py()))
                    rows.append((site_of(host, page), page.skeleton, page.leaves, page.texts, page.prose, page.ups))
                made = batch_of(SECOND, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made.columns], names=schema.names)
        release()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.drop_columns([key, url]).to_pylist():
                keep = [True] * len(row["texts"])
                if row["r_skeleton"] is not None:
                    up = holders(row["r_skeleton"])
                    constant = {(up[i], h) for i, h in zip(row["template"], row["t_hashes"], strict=True)}
                    keep = [(i, hashed(t)) not in constant for i, t in zip(slots(row["r_skeleton"], row["skeleton"], row["leaves"]), row["texts"], strict=True)]
                texts.append(main_text(row["texts"], row["prose"], row["ups"], keep))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=result.names)
        matched.cache_clear()
        release()

    second = pages.select(key, F.col(url).cast("string").alias(url), host_of(F.col(url)).alias("host"), html).mapInArrow(parse, schema)
    size = F.length("r_skeleton") + 12 * F.size("template") + 100
    return beside(second, found, size, hot, "left").select(key, url, "skeleton", "leaves", "texts", "prose", "ups", "r_skeleton", "template", "t_hashes").mapInArrow(choose, result)
