"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree of style nodes: elements with the
same tags and classes on the way from the root are one node, whatever their
number. A node's importance is entropy-based: with m pages that show it,

    content       -sum p log_m p over its distinct texts,
    presentation  -sum p log_m p over its distinct child sequences,
    importance    (1 - GAMMA) * presentation + GAMMA * content,

so a branch that says the same on most pages of its host tends to 0, and one
that differs from page to page to 1. A node on one page has importance 1. Pages
of a host with one text count once, so copies are no template.

Page roles that markup states outright, by tag, role or a whole class token,
are fixed: navigation, footers, notices, adverts, forms and comments are 0. An
article or main element is a prior only: with m pages, a node's importance i
inside one becomes (PRIOR + m i) / (PRIOR + m), and m i / (PRIOR + m) outside it
on a framed page, where articles hold at least half of the text; outside, a noise
word in a class is believed too. So on few pages the element decides and on many
the tree. Branches under ``LOW`` are cut from each page, other than html, body and
branches that hold more than half of the page's (or its articles') text outside
links.

Blocks are joined in page order by a line feed, white space in a block becomes
one space, and character references are decoded once. Null and empty pages,
and pages without text, give an empty text. Nodes are merged by counts that
are pre-aggregated, so a host with a third of all pages is no hot group; the
cut branches reach the pages by broadcast while their size is under
``BROADCAST_BYTES``, by a salted join above it. Repeated rows give equal rows, and very
long pages are parsed whole. Empty tables give empty results; other columns are
passed on.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import as_table

GAMMA = 0.9
LOW = 0.35
MIN_PAGES = 3
#: Pages that an article's prior counts as.
PRIOR = 6
#: Elements of a path that are spelled; a rolling hash stands for those below.
DEPTH = 12
BROADCAST_BYTES = 32 << 20
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas audio video select textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu
breadcrumb breadcrumbs footer sidebar cookie cookies consent notice notices gdpr newsletter subscribe subscription popup modal
overlay comment comments disqus share sharing social related recommended banner toolbar pagination pager skip login signup""".split())
#: Tags whose class is never taken for a role, anywhere and inside an article.
PLAIN = frozenset("html body main article".split())
PARTS = frozenset("h1 h2 h3 h4 h5 h6 section".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class Node:
    __slots__ = ("tag", "path", "noise", "inside", "hint", "link", "depth", "up", "kids", "text")

    def __init__(self, tag, path, noise, inside, hint=False, up=None):
        self.tag, self.path, self.noise, self.inside, self.hint, self.up, self.kids, self.text = tag, path, noise, inside, hint, up, [], []
        self.link = up is not None and (up.link or tag == "a")
        self.depth = 0 if up is None else up.depth + 1


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def opened(parent: Node, tag: str, attrs: str) -> Node:
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if "=" in attrs else {}
    names = _WORD.findall(found.get("class", "") + " " + found.get("id", ""))
    inside = parent.inside or tag in ("article", "main") or found.get("role") in ("main", "article")
    named = not (tag in PLAIN or (parent.inside and tag in PARTS)) and not NOISE_WORDS.isdisjoint(found.get("class", "").split())
    noise = parent.noise or tag in NOISE_TAGS or found.get("role") in NOISE_ROLES or named or (tag == "header" and not parent.inside)
    path = f"{parent.path}>{tag}" + ("." + ".".join(sorted(set(names))) if names else "")
    if parent.depth >= DEPTH:
        spelled = parent.path if parent.depth == DEPTH else parent.path.rpartition(">")[0]
        path = f"{spelled}>#{xxhash.xxh64_hexdigest(path.encode('utf-8', 'replace'))}"
    hint = parent.hint or (tag not in PLAIN and not NOISE_WORDS.isdisjoint(_WORD.findall(found.get("class", ""))))
    return Node(tag, path, noise, inside, hint, parent)


def above(node: Node):
    """The node and its ancestors, without the root."""
    while node.up is not None:
        yield node
        node = node.up


def bulk(blocks) -> set[str]:
    """Paths that hold more than half of the blocks' text outside links (of all
    text, where all is links)."""
    for plain in (True, False):
        total, held = 0, {}
        for node, text, n in blocks:
            n = n if plain else len(text)
            total += n
            for path in {x.path for x in above(node)}:
                held[path] = held.get(path, 0) + n
        if total:
            return {path for path, n in held.items() if 2 * n > total}
    return set()


def parse(html: str):
    """(text blocks with their open nodes, all nodes) of a page. A block is
    (node, text, characters outside links); nodes hold child sequences and own text."""
    root = Node("", "", False, False)
    stack, blocks, nodes, part, at, plain = [root], [], [], [], 0, 0

    def say(raw: str):
        nonlocal plain
        if raw:
            part.append(raw)
            if not raw.isspace():
                stack[-1].text.append(raw)
                plain += 0 if stack[-1].link else len(raw)

    def end_block():
        nonlocal plain
        if part:
            blocks.append((stack[-1], "".join(part), plain))
            part.clear()
            plain = 0

    find = _TOKEN.search
    while m := find(html, at):
        say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else len(html)
            if tag not in INLINE and tag not in ("script", "style", "template", "noscript"):
                end_block()
            continue
        if tag in INLINE or tag in VOID:
            if tag in ("br", "img", "wbr"):
                part.append("" if tag == "wbr" else " ")
            if tag in VOID and tag not in INLINE:
                end_block()
            if tag in VOID:
                continue
            node = opened(stack[-1], tag, m[3])
        else:
            end_block()
            while len(stack) > 1 and (stack[-1].tag in INLINE or stack[-1].tag == "p" or stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                stack.pop()
            node = opened(stack[-1], tag, m[3])
        stack[-1].kids.append(tag)
        if not m[3].endswith("/"):
            stack.append(node)
        nodes.append(node)
    say(html[at:])
    end_block()
    return blocks, nodes


STYLES = pa.schema([("host", pa.string()), ("path", pa.string()), ("page", pa.int64()), ("content", pa.int64()), ("shape", pa.int64())])
STYLES_DDL = "host string, path string, page bigint, content bigint, shape bigint"


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def is_framed(blocks) -> bool:
    """Whether articles hold at least half of the blocks' text outside links."""
    inside = [n or len(text) for node, text, n in blocks if node.inside]
    return bool(inside) and 2 * sum(inside) >= sum(inside) + sum(n for node, _, n in blocks if not node.inside)


def branch(node: Node, framed: bool):
    """(style node's name, element) of the elements that decide on a block: up to
    the article for one inside, up to the root else. Names inside an article start
    with "+", those outside it on a framed page with "-"."""
    sign = "+" if node.inside else "-" if framed else ""
    for x in above(node):
        if x.inside != node.inside:
            break
        yield sign + x.path, x


def style_rows(html: str | None) -> list[tuple[str, int, int, int]]:
    """(name, hash of the page's text, hash of text, hash of child sequence) of a
    page's style nodes, without inline ones and those whose role is fixed."""
    seen: dict[str, tuple[list, list]] = {}
    blocks, nodes = parse(html or "")
    blocks = [(node, " ".join(text.split()), n) for node, text, n in blocks if not (node.noise or text.isspace())]
    framed = is_framed(blocks)
    for n in nodes:
        if not (n.noise or n.tag in INLINE):
            name, _ = next(branch(n, framed))
            seen.setdefault(name, ([], []))[1].extend(dict.fromkeys(n.kids))
    for node, text, _ in blocks:
        for name in {name for name, _ in branch(node, framed)} & seen.keys():
            seen[name][0].append(text)
    page = hash64("\n".join(text for node, text, _ in blocks if node.inside or not framed))
    return [(p, page, hash64(" ".join(text)), hash64(" ".join(kids))) for p, (text, kids) in seen.items() if text]


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, importance) of the style nodes of each host; pages of
    one host with one text are one page."""

    def run(batches):
        for b in batches:
            rows = [(host(u), *x) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist()) for x in style_rows(h)]
            yield from as_table(STYLES, **{f.name: [r[i] for r in rows] for i, f in enumerate(STYLES)}).to_batches()

    each = pages.select("url", "html").mapInArrow(run, STYLES_DDL).groupBy("host", "path", "page").agg(F.min(F.struct("content", "shape")).alias("v"))
    each = each.select("host", "path", "v.content", "v.shape")

    def entropy(by: str) -> DataFrame:
        c = each.groupBy("host", "path", by).agg(F.count("*").alias("n"))
        # -sum p log p = log m - sum n log n / m
        s = c.groupBy("host", "path").agg(F.sum("n").alias("n_pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return s.withColumn(by, F.when(F.col("n_pages") > 1, 1 - F.col("s") / F.col("n_pages") / F.log("n_pages")).otherwise(1.0)).drop("s")

    both = entropy("content").join(entropy("shape").drop("n_pages"), ["host", "path"])
    return both.select("host", "path", "n_pages", (GAMMA * F.col("content") + (1 - GAMMA) * F.col("shape")).alias("importance"))


def text_of(html: str | None, ruled: frozenset) -> str:
    """The page's text, where ``ruled`` has its host's style nodes to cut and, with
    "-", those to keep outside an article."""
    blocks, _ = parse(html or "")
    blocks = [b for b in blocks if not (b[0].noise or b[1].isspace())]
    framed = is_framed(blocks)
    safe = bulk(blocks) | bulk([b for b in blocks if b[0].inside]) if ruled else ()
    out = []
    for node, raw, _ in blocks:
        if framed and not node.inside:
            names = [name for name, x in branch(node, framed) if x.tag not in INLINE]
            if node.hint or not names or not ruled.issuperset(names):
                continue
        elif ruled and any(name in ruled and x.path not in safe and x.tag not in ("html", "body") for name, x in branch(node, framed)):
            continue
        if text := " ".join(unescape(raw).split()):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with ``text`` in the place of ``html``."""
    pages = pages.drop("text", "cut_paths", "host_key", "salt")
    m, known = F.col("n_pages"), F.col("n_pages") * F.col("importance")
    inside, outside = F.col("path").startswith("+"), F.col("path").startswith("-")
    low = F.when(inside, (PRIOR + known) / (PRIOR + m) < LOW).when(outside, known / (PRIOR + m) >= LOW)
    ruled = style_tree(pages).where(low.otherwise((F.col("importance") < LOW) & (m >= MIN_PAGES)))
    cut = ruled.groupBy("host").agg(F.collect_set("path").alias("cut_paths")).withColumnRenamed("host", "host_key").checkpoint()
    size = cut.agg(F.sum(F.octet_length("host_key") + F.expr("aggregate(cut_paths, 0L, (a, p) -> a + length(p) + 16)"))).first()[0] or 0
    key = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern.replace("^", "(?i)^", 1), 1))
    pages = pages.withColumn("host_key", key)
    if size <= BROADCAST_BYTES:
        pages = pages.join(F.broadcast(cut), "host_key", "left")
    else:
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        pages = pages.join(cut.withColumn("salt", salts), ["host_key", "salt"], "left").drop("salt")
    pages = pages.drop("host_key")

    def run(batches):
        known: dict[tuple, frozenset] = {}
        for b in batches:
            text = []
            for h, paths in zip(b.column("html").to_pylist(), b.column("cut_paths").to_pylist()):
                paths = tuple(paths or ())
                if paths not in known:
                    known.clear() if len(known) > 1000 else None
                    known[paths] = frozenset(paths)
                text.append(text_of(h, known[paths]))
            t = pa.Table.from_batches([b]).drop_columns(["html", "cut_paths"])
            yield from t.append_column("text", pa.array(text, pa.string())).to_batches()

    return pages.mapInArrow(run, pages.drop("html", "cut_paths").selectExpr("*", "'' as text").schema)
