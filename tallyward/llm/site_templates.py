"""Main text of web pages, with site templates found by counting element subtrees per host.

Method: every page is read into a tree; each element's subtree gets a hash of its tags, attributes and text. Spark
counts, per host, on how many different pages a subtree stands; subtrees that stand on ``LEAST_PAGES`` of them are the
site's template and go, whatever the size of the host. What stands for menus, headers, footers, sidebars, notices,
adverts, forms and reader comments by its tag, role or name goes too, as does what lies beside an article.

A page counts once per host however often it is copied: pages are told apart by their main text, so near copies that
differ in their menus only are one. The paragraphs and headings of an article are never taken for template, only boxes
around or beside them: a passage that many articles quote is still theirs.

Reading takes time in proportion to the page: a tag that never ends is looked for once, and where a quote swallows the
end of the page, quotes are no longer trusted from there on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import written

LEAST_PAGES = 3

# Element names of the HTML standard by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select input textarea iframe object embed svg canvas audio "
    "video dialog menu".split()
)
BOXES = frozenset("div section ul ol dl table figure details center fieldset header blockquote".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "login comment comments disqus respond replies share sharing social related recommended widget toolbar pagination pager".split()
)
HEADINGS = frozenset(("h1", "h2"))
CONTENT = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body", "article", "main"))

# A quote matters behind an equals sign only.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*(?:>|\Z)", re.DOTALL
)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TAG_START = re.compile(r"<[a-zA-Z/!?]")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def host(url: str | None) -> str:
    """The host a page belongs to: lower case, without user, port and a leading www. or m."""
    rest = _SCHEME.sub("", (url or "").strip())
    name = re.split(r"[/?#\\]", rest.lstrip("/"), maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower().rstrip(".")
    for prefix in ("www.", "m."):
        if name.startswith(prefix) and name.count(".") > 1:
            name = name[len(prefix) :]
    return name


class Node:
    """An element: its tag, attribute text and children, which are nodes and decoded texts."""

    __slots__ = ("attributes", "children", "digest", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], 0


def _tags(html: str) -> Iterator[tuple[int, int, re.Match]]:
    last, pattern = html.rfind(">"), _TAG
    at = html.find("<")
    while at >= 0:
        if at > last and html[at + 1 : at + 2] not in ("!", "?", "/"):
            return  # nothing ends a tag from here on
        match = pattern.match(html, at)
        if match is None and pattern is _TAG and _TAG_START.match(html, at):
            pattern = _LOOSE
            match = pattern.match(html, at)
        if match:
            yield at, match.end(), match
        at = html.find("<", match.end() if match else at + 1)


def parse(html: str) -> Node:
    """A page's tree; faulty markup is closed where a browser would close it, and a tag cut off at the end is left out."""
    root = Node("#page")
    stack = [root]
    opened: dict[str, int] = {}
    done = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    def close_within(tags: set[str] | frozenset[str], limits: set[str]) -> None:
        if any(opened.get(t) for t in tags):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in tags:
                    pop_to(depth)
                elif stack[depth].tag in limits:
                    return

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(unescape(piece))

    skip = 0
    for start, end, match in _tags(html):
        if start < skip:
            continue
        text(html[done:start])
        done = end
        tag = (match.group(2) or "").lower()
        if not tag:
            continue
        if match.group(1):
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                pop_to(depth)
            continue
        if tag in CLOSES_P:
            close_within({"p"}, {"td", "th", "button", "table"})
        if tag in CLOSED_BY_LIKE:
            close_within(*CLOSED_BY_LIKE[tag])
        node = Node(tag, " ".join(match.group(3).rstrip("/").split()))
        stack[-1].children.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, end)
            stop = closing.start() if closing else len(html)
            node.children.append(html[end:stop])
            done = skip = stop
        elif tag not in VOID and not (match.group(3).endswith("/") and tag in ("svg", "path", "use")):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    rest = html[done:]
    cut = _TAG_START.search(rest, rest.rfind(">") + 1)
    text(rest[: cut.start()] if cut else rest)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element on the way down and again on the way up."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, up = stack.pop()
        yield node, up
        if not up:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children) if isinstance(c, Node)]


def hash_subtrees(root: Node) -> None:
    """Give every element the hash of its tag, attributes, text and the hashes below it."""
    for node, up in _walk(root):
        if up:
            digest = blake2b(f"{node.tag} {node.attributes}".encode("utf-8", "replace"), digest_size=8)
            for child in node.children:
                digest.update(b"<%d>" % child.digest if isinstance(child, Node) else " ".join(child.split()).encode("utf-8", "replace"))
            node.digest = int.from_bytes(digest.digest(), "little", signed=True)


def _given(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)} if node.attributes else {}


def unwanted(node: Node) -> bool:
    """Whether an element's tag, role, name or hiding says that it is not the article."""
    if node.tag in DROPPED:
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    given = _given(node)
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    if given.get("role", "").lower() in DROPPED_ROLES:
        return True
    if node.tag in INLINE and node.tag != "span":
        return False
    names = re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{given.get('class', '')} {given.get('id', '')}").lower())
    return not DROPPED_NAMES.isdisjoint(names)


def _articles(root: Node) -> list[Node]:
    """The outermost articles outside unwanted parts, else the main parts, else the whole page."""
    for wanted in CONTENT:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node is not root and unwanted(node):
                continue
            if node.tag == wanted:
                found.append(node)
                continue
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


Piece = tuple[str, int]  # a block of text, the number of the innermost box around it or -1
Box = tuple[int, int]  # the number of the box around it or -1, the hash of its subtree


def pieces(root: Node) -> tuple[list[Piece], list[Box]]:
    """The blocks of the main text in page order, and the boxes around them that may turn out to be template.

    Headers go, but for headings in the header of an article. Outside articles every block is a box of its own.
    """
    out: list[Piece] = []
    found: list[Box] = []
    for top in _articles(root):
        inside = top.tag in CONTENT
        line: list[str] = []
        around = [-1]

        def flush() -> None:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                out.append((text, around[-1]))

        stack: list[tuple[Node | str, bool, bool]] = [(top, False, False)]  # item, closing, silent
        while stack:
            item, closing, silent = stack.pop()
            if isinstance(item, str):
                if not silent:
                    line.append(item)
                continue
            block = item.tag not in INLINE
            boxed = item.tag not in ROOTS and (item.tag in BOXES or (block and not inside))
            if closing:
                if block:
                    flush()
                if boxed:
                    around.pop()
                continue
            if item.tag == "br":
                line.append(" ")
                continue
            if block:
                flush()
            if item is not top and unwanted(item):
                continue
            if item.tag == "header":
                silent = True
            elif inside and item.tag in HEADINGS:
                silent = False
            if boxed:
                found.append((around[-1], item.digest))
                around.append(len(found) - 1)
            stack.append((item, True, silent))
            stack += [(c, False, silent) for c in reversed(item.children)]
        flush()
    return out, found


def without_boxes(blocks: list[Piece], boxes: list[Box], gone: set[int]) -> list[str]:
    """The blocks that stand in no box of ``gone``, at any depth; a box comes after the one around it."""
    away: list[bool] = []
    for outer, digest in boxes:
        away.append(digest in gone or (outer >= 0 and away[outer]))
    return [text for text, box in blocks if box < 0 or not away[box]]


def subtrees(root: Node) -> set[int]:
    """Hashes of the subtrees of a whole page that count towards its host's template."""
    return {n.digest for n, up in _walk(root) if up and n is not root and n.tag not in ROOTS and n.tag not in INLINE}


def set_aside(root: Node) -> list[int]:
    """Hashes of the outermost elements of a page's body that lists of tags and names take out, or that lie beside its article."""
    tops = {id(n) for n in _articles(root)}
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in RAW or node.tag in ("head", "noscript", "template"):
            continue
        if node is not root and (unwanted(node) or node.tag == "header"):
            out.append(node.digest)
        elif id(node) not in tops:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


_PAGES_SQL = (
    "page_id long, url string, host string, k1 long, k2 long, page long, blocks array<struct<text:string,box:int>>, "
    "boxes array<struct<outer:int,digest:long>>, subtrees array<long>, aside array<long>"
)
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("box", pa.int32())]))
_BOXES = pa.list_(pa.struct([("outer", pa.int32()), ("digest", pa.int64())]))


def _selected(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )


def _content_hash(html: str, size: int = 8) -> bytes:
    return blake2b(html.encode("utf-8", "replace"), digest_size=size).digest()


def _read(rows: DataFrame) -> DataFrame:
    """Every page read once: its blocks and boxes, the hashes of all its subtrees, and ``page``, which names it by its main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {name: [] for name in ("host", "k1", "k2", "page", "blocks", "boxes", "subtrees", "aside")}
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                root = parse(html or "")
                hash_subtrees(root)
                key = _content_hash(html or "", 16)
                blocks, boxes = pieces(root)
                main = _content_hash("\n".join(t for t, _ in blocks) or html or "")
                for name, value in (
                    ("host", host(url)), ("k1", int.from_bytes(key[:8], "little", signed=True)), ("k2", int.from_bytes(key[8:], "little", signed=True)),
                    ("page", int.from_bytes(main, "little", signed=True)), ("blocks", [{"text": t, "box": b} for t, b in blocks]),
                    ("boxes", [{"outer": o, "digest": d} for o, d in boxes]), ("subtrees", list(subtrees(root))), ("aside", set_aside(root)),
                ):
                    made[name].append(value)
            kinds = {"host": pa.string(), "blocks": _BLOCKS, "boxes": _BOXES, "subtrees": pa.list_(pa.int64()), "aside": pa.list_(pa.int64())}
            arrays = [batch.column(0), batch.column(1), *[pa.array(v, kinds.get(name, pa.int64())) for name, v in made.items()]]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", *made])

    return rows.mapInArrow(run, _PAGES_SQL)


def templates(read: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, digest) of the subtrees that stand on at least ``least_pages`` different pages of their host."""
    each = read.select("host", "page", F.explode("subtrees").alias("digest"))
    pages = each.groupBy("host", "digest", "page").agg(F.lit(1).alias("one"))
    return pages.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("host", "digest")


def _judged(rows: DataFrame) -> DataFrame:
    """The texts of (page_id, url, blocks, boxes, gone) rows without the boxes that are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, boxes, gone in zip(*(batch.column(n).to_pylist() for n in ("blocks", "boxes", "gone")), strict=True):
                kept = without_boxes([(b["text"], b["box"]) for b in blocks], [(b["outer"], b["digest"]) for b in boxes], set(gone))
                texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "url", "texts"])

    return rows.select("page_id", "url", "blocks", "boxes", "gone").mapInArrow(run, "page_id long, url string, texts array<string>")


def main_text(
    pages: DataFrame, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) per row: the blocks of the main text, joined by an empty line.

    A null or empty page gives an empty text; a null url stays null and belongs to the host without a name. Rows
    are taken as they are, repeated rows and null ids too. An empty table gives no rows.
    """
    read = written(_read(_selected(pages, id_col, url_col, html_col)), "pages")
    found = written(templates(read, least_pages), "templates")
    # A block outside every box stays whatever the counts say: such pages need not meet them.
    boxed = F.exists("blocks", lambda b: b["box"] >= 0)
    held = read.where(boxed).select("host", "k1", "k2", F.explode(F.array_distinct(F.col("boxes.digest"))).alias("digest"))
    gone = held.join(found, ["host", "digest"]).groupBy("host", "k1", "k2").agg(F.collect_set("digest").alias("gone"))
    judged = read.where(boxed).join(gone, ["host", "k1", "k2"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
    plain = read.where(~boxed).select("page_id", "url", F.col("blocks.text").alias("texts"))
    texts = plain.unionByName(_judged(judged))
    text = F.array_join("texts", "\n\n")
    return texts.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def shares_of_counts(pages: DataFrame, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row: pages, elements that lists or the choice of the article set aside, and how many of these the counts take by themselves."""
    read = written(_read(_selected(pages, id_col, url_col, html_col)), "pages")
    aside = read.select("host", F.explode("aside").alias("digest"))
    met = aside.join(templates(read, least_pages).withColumn("counted", F.lit(1)), ["host", "digest"], "left")
    return met.agg(F.count("*").alias("set_aside"), F.count("counted").alias("by_counts")).join(read.agg(F.count("*").alias("pages")), F.lit(True))
