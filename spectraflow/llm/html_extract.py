"""Main text of web pages, with each site's template taken out.

Subtrees of a page's element tree are hashed; Spark counts on how many pages of
a host, different in what they say, each hash occurs, and those on many are the
site's template and are deleted. What a page says about its own parts (tags,
roles, class names) takes out the rest. Copies and mirrors of a page count once,
a subtree isn't counted on a page of whose text it is over half, and paragraphs
of an article are never template: articles that are published twice, or quote
the same passage, keep their text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraflow.llm.common import batch_of, materialise

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Names of HTML elements, and names that sites give their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("aside button dialog fieldset footer form head label legend menu nav input".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article main section div body html".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
NAMED = frozenset("div section span p ul ol table dl figure details header".split())
#: Inside an article only these can be template.
CONTAINERS = frozenset("div section ul ol table dl figure".split())


class Node:
    __slots__ = ("tag", "skip", "main", "children", "hash")

    def __init__(self, tag: str, skip: bool = False, main: bool = False) -> None:
        self.tag, self.skip, self.main = tag, skip, main
        self.children: list[Node | str] = []
        self.hash: int | None = None


def _node(tag: str, rest: str) -> Node:
    if tag in DROPPED:
        return Node(tag, True)
    main = tag in ("article", "main")
    if "=" not in rest and "hidden" not in rest:
        return Node(tag, False, main)
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(rest)}
    role = values.get("role", "")
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", ""))
    named = re.split(r"[\s_-]+", f"{values.get('class', '')} {values.get('id', '')}")
    # an article may be a reader's comment; other elements that name themselves parts of a page are such parts
    apart = not NAMES.isdisjoint(named) if tag in NAMED else tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(named)
    return Node(tag, bool(hidden or role in ROLES or apart), main and not apart or role == "main")


def parse(html: str | None) -> Node:
    """Element tree of a whole page, however malformed."""
    root = Node("html")
    stack, open_tags = [root], Counter()

    def close(k: int) -> None:
        open_tags.subtract(n.tag for n in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(html or ""):
        tag = m["tag"]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(m[0])
            continue
        tag = tag.lower()
        if m["end"]:
            if open_tags[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS and open_tags["p"] > 0:  # a block ends an open paragraph, with whatever is open inside
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if closed := CLOSES.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        node = _node(tag, m["rest"])
        stack[-1].children.append(node)
        if tag not in VOID and not m["rest"].endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    return root


def regions(root: Node) -> list[Node]:
    """Where a page's main text is: its articles, else its main part, else the whole page."""
    mains, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.main:
            mains.append(node)
        if not node.main or node.tag == "main":
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skip)
    return [m for m in mains if m.tag == "article"] or mains[:1] or [root]


def hash_subtrees(top: Node) -> None:
    """Give the subtrees that may be template their hash: tags and white-space-normal text of a block and all below it."""
    order, todo = [], [(top, top.main)]
    while todo:  # parents before children
        node, inside = todo.pop()
        order.append((node, inside))
        todo.extend((c, inside or c.main) for c in node.children if isinstance(c, Node))
    whole: dict[int, str] = {}
    for node, inside in reversed(order):
        parts = [whole.pop(id(c)) if isinstance(c, Node) else " ".join(c.split()) for c in node.children]
        text = f"<{node.tag}>{' '.join(p for p in parts if p)}</>"
        can = node.tag in (CONTAINERS if inside else BLOCKS) and not node.main and not node.skip
        if can and any(parts):
            node.hash = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        whole[id(node)] = text if len(text) < 4096 else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def blocks_of(root: Node) -> list[tuple[str, list[int]]]:
    """The blocks of a page's main text in page order, each with the hashes of the subtrees it lies in."""
    found: list[tuple[list[str], tuple | None]] = [([], None)]  # parts, and the chain (hash, outer chain)
    for top in regions(root):
        hash_subtrees(top)
        todo: list = [(top, False, None)]
        while todo:
            node, headings, chain = todo.pop()
            if node is None:  # a block ends
                found.append(([], chain))
            elif isinstance(node, str):
                found[-1][0].append(node)
            elif not node.skip:
                headings = headings or node.tag == "header"
                outer = chain
                if node.hash is not None:
                    chain = (node.hash, chain)
                if node.tag in BLOCKS:
                    found.append(([], chain))
                    todo.append((None, headings, outer))
                if node.tag in ("br", "wbr"):
                    found[-1][0].append(" ")
                silent = headings and node.tag not in HEADINGS
                todo.extend((c, silent, chain) for c in reversed(node.children) if isinstance(c, Node) or not silent)
    out = []
    for parts, chain in found:
        if parts and (line := " ".join(unescape("".join(parts)).split())):
            under = []
            while chain:
                under.append(chain[0])
                chain = chain[1]
            out.append((line, under))
    return out


def counted(blocks: list[tuple[str, list[int]]]) -> list[int]:
    """The subtrees that hold at most half of the page's text."""
    held: Counter = Counter()
    for line, under in blocks:
        for h in set(under):
            held[h] += len(line)
    whole = sum(len(line) for line, _ in blocks)
    return [h for h, n in held.items() if 2 * n <= whole]


def host(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def extract(pages: DataFrame, min_pages: int = 10) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    A subtree is template if at least ``min_pages`` pages of its host, and at
    least the square root of their number, have it beside other text; pages of
    equal text, rows that repeat or mirrors, count once. It is then deleted
    from all pages of the host. Pages without a host have no template. A null or
    empty page has the text ""; an empty table gives an empty one; other columns
    aren't read. A page is parsed once, and its html never shuffled; counts per
    host and hash are pre-aggregated, so a host may hold any share of all pages.
    """
    rows = pages.select("page_id", "url", "html").withColumn("__key", F.xxhash64("page_id", "url", "html"))
    kept = rows.drop("html")
    fields = "host string, said long, blocks array<struct<line:string,under:array<bigint>>>, hashes array<bigint>"
    schema = kept.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in (f.split(maxsplit=1) for f in fields.split(", ")))).schema
    long, block = pa.int64(), pa.list_(pa.struct([("line", pa.string()), ("under", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(parse(html)) for html in batch.column("html").to_pylist()]
            hosts = [host(u) for u in batch.column("url").to_pylist()]
            said = [int.from_bytes(hashlib.blake2b("\n".join(x for x, _ in f).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for f in found]
            listed = [[{"line": x.encode("utf-8", "replace").decode(), "under": u} for x, u in f] for f in found]
            own = [batch.column(c) for c in ("page_id", "url", "__key")]
            hashes = [counted(f) if h else [] for f, h in zip(found, hosts)]
            yield batch_of(["page_id", "url", "__key", "host", "said", "blocks", "hashes"], [*own, (hosts, pa.string()), (said, long), (listed, block), (hashes, pa.list_(long))])

    read = materialise(rows.mapInArrow(run, schema), "blocks")
    hosted = read.where("host != ''")
    each = hosted.select("host", "said", F.explode("hashes").alias("hash")).distinct()
    pages_of = hosted.select("host", "said").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    common = common.join(pages_of, "host").where(F.col("n") * F.col("n") >= F.col("pages")).select("host", "hash")
    lies = hosted.select("__key", "host", F.explode(F.array_distinct(F.flatten("blocks.under"))).alias("hash"))
    removed = lies.join(common, ["host", "hash"]).groupBy("__key").agg(F.collect_set("hash").alias("template"))
    joined = read.join(materialise(removed, "templates"), "__key", "left")
    stays = lambda b: ~F.coalesce(F.arrays_overlap(b["under"], F.col("template")), F.lit(False))
    text = F.array_join(F.transform(F.filter("blocks", stays), lambda b: b["line"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
