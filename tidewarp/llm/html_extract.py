"""Main-text extraction by wrapper induction over the pages of a host.

Pages become DOM trees of their block elements. The trees of a host are aligned by simple tree matching, which finds the
largest common tree that keeps parents and the order of siblings (runs of equal siblings count as one repeated node). What is
the same on all aligned pages is template; nodes whose text varies are slots. The wrapper of a host names the slots that
hold the article: marked ones (article, main) where the aligned tree has them, else the subtree that holds most of the varying
text. A page's text is the blocks inside those slots, without subtrees whose element, class, id or role marks them as
navigation, header, footer, sidebar, notice, advert, form, script, style or reader comments.
Outside marked articles, nodes with one text on three pages of different content or more, and lists of links, are left out
too. Copies of a page have the same content, so however many there are, they prove nothing constant.

Every page takes part in its host's wrapper: tasks align the pages they read, and partial wrappers meet in two levels,
so a host with a third of all pages costs one partial wrapper a task. A wrapper has at most ``NODES`` nodes: beyond that, equal
siblings become one, then the rarest nodes without marks are left out and count as varying. Where those hold so much of the text
that the wrapper cannot name its slots, the host has no rule and each page is judged on its own whole tree. Wrappers go back to the pages as a broadcast up to ``BROADCAST`` bytes, else by a join
with plain exchanges on both sides, which adaptive execution splits.

Defined results: elements nested deeper than ``DEPTH`` add their text, as blocks of their own, to the one at that depth, and are left out
where they are marked so; their labels and article marks do not count. Where a node has over ``KINDS`` children, siblings of one kind are one node of the wrapper.
Tags that never end are text. Null or empty html, and a page without article text, give the empty string. A null or unusual url has
the empty host. A page whose host's slots are missing from it is judged on its own tree. Repeated rows are each extracted;
a null page_id is carried along. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare, stage

NODES = 2000
DEPTH = 150  # of a tree; deeper elements are dissolved
KINDS = 64  # children of a wrapper's node before siblings of one kind are folded; an alignment costs its square at most
BROADCAST = 32 << 20
SURE_PAGES = 3  # pages of different content that prove a node constant

#: fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style title textarea noscript xmp iframe noembed noframes".split())
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul""".split())
CLOSES_P = BLOCK - {"html", "body", "tbody", "tfoot", "thead", "tr", "caption"}
#: what a start tag ends: itself and its siblings, up to the element that holds them
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
#: fixed values: elements and words in class, id and role that mark what is not article
NOT_TEXT = frozenset("""nav footer aside form script style noscript template svg math canvas button select option textarea iframe object applet audio video
head title menu dialog xmp noembed noframes datalist""".split())
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices notification alert announcement comment comments commentlist disqus respond replies sidebar aside rail menu nav navbar navigation breadcrumb
breadcrumbs footer masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription signup login search
popup modal overlay widget widgets pagination pager complementary contentinfo search dialog paywall skip""".split())
CONTENT_MARKS = frozenset({"main", "articlebody"})

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "label", "skip", "content", "children")

    def __init__(self, tag: str, label: str, skip: bool, content: bool):
        self.tag, self.label, self.skip, self.content = tag, label, skip, content
        self.children: list = []  # nodes of block elements, and strings; a link's text follows its Node("a")


def _make(tag: str, attrs: str) -> Node:
    skip, content, label = tag in NOT_TEXT, tag in ("article", "main"), tag
    low = attrs.lower()
    if low and ("class" in low or "id" in low or "role" in low or "hidden" in low or "itemprop" in low or "display" in low):
        given = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
        named = [given.get("class", ""), given.get("id", ""), given.get("role", "")]
        words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(named)).lower()))
        if tag not in ("html", "body", "article", "main") or given.get("role"):
            skip = skip or (not words.isdisjoint(MARKS) and tag not in ("html", "body", "main"))
        elif tag == "article":
            skip = not words.isdisjoint({"comment", "comments", "related", "ad", "advert", "sponsored", "promo"})
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", low) or "display:none" in low.replace(" ", ""):
            skip = True
        content = content or given.get("role", "").lower() == "main" or given.get("itemprop", "").lower() in CONTENT_MARKS
        label = tag + "".join("." + w for w in sorted(set(_WORDS.findall(named[0].lower())))[:4])  # ids differ from page to page
    return Node(tag, label, skip, content)


class _Open:
    """The open elements of a page under way, and how many there are of each tag."""

    def __init__(self):
        self.root = Node("#", "#", False, False)
        self.stack = [self.root]
        self.open: dict[str, int] = {}

    def add(self, child) -> None:
        self.stack[-1].children.append(child)

    def start(self, node: Node) -> None:
        """Open ``node``. Beyond DEPTH its children go to the node at that depth, or nowhere if it is skipped."""
        if len(self.stack) > DEPTH:
            holder = self.stack[-1].children
            if node.tag in BLOCK:
                holder.append(Node("hr", "hr", False, False))
            if not node.skip:
                node.children = holder
        else:
            self.add(node)
        self.stack.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def close(self, i: int) -> None:
        """End the elements from the ``i``th on."""
        for node in self.stack[i:]:
            self.open[node.tag] -= 1
        if len(self.stack) > DEPTH + 1 and any(n.tag in BLOCK for n in self.stack[max(i, DEPTH + 1):]):
            self.stack[max(i, DEPTH + 1) - 1].children.append(Node("hr", "hr", False, False))
        del self.stack[i:]

    def has(self, tags) -> bool:
        return any(self.open.get(t) for t in tags)


def parse(page: str) -> Node:
    """The tree of a page. Inline elements are dissolved into their text; links stay, to tell lists of links."""
    tree = _Open()
    stack = tree.stack
    at = 0
    size = len(page)
    end_of_tags = page.rfind(">")
    while at <= end_of_tags:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            text = page[at:m.start()]
            tree.add(entities.unescape(text) if "&" in text else text)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    tree.add(" ")
                continue
            if tree.has((tag,)):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        tree.close(i)
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK:
                        break
            continue
        if tag in VOID:
            if tag == "br":
                tree.add(" ")
            elif tag == "hr":
                tree.add(Node("hr", "hr", False, False))
            continue
        if tag in CLOSES_P and tree.has("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    tree.close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in ENDS:
            ended, inside = ENDS[tag]
            if tree.has(ended):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in inside:
                        break
                    if stack[i].tag in ended:
                        tree.close(i)
                        break
        node = _make(tag, m[3])
        if tag in RAW:
            tree.add(node)
            end = _raw_end(tag).search(page, at)
            if tag in ("title", "textarea"):
                node.children.append(entities.unescape(page[at:end.start() if end else size]))
            at = end.end() if end else size
        elif m[3].endswith("/") and tag in ("svg", "path", "use"):
            tree.add(node)
        else:
            tree.start(node)
    if at < size:
        rest = page[at:]
        comment = rest.find("<!--")  # one that never ends
        tree.add(entities.unescape(rest if comment < 0 else rest[:comment]))
    return tree.root


@lru_cache(maxsize=64)
def _raw_end(tag: str):
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I)


# ---------------------------------------------------------------- wrappers

class Slot:
    """Node of a wrapper: how many pages have it, its own text if constant (else None), characters of own text and of links,
    the ``SURE_PAGES`` smallest hashes of the contents of pages that have it, and the mass of children left out."""
    __slots__ = ("label", "pages", "text", "chars", "links", "content", "skip", "contents", "lost", "children")

    def __init__(self, label, content, skip):
        self.label, self.content, self.skip = label, content, skip
        self.pages, self.text, self.chars, self.links, self.contents, self.lost = 1, 0, 0, 0, (), 0
        self.children: list[Slot] = []

    def __reduce__(self):
        return _slot, (self.label, self.content, self.skip, self.pages, self.text, self.chars, self.links, self.contents, self.lost, self.children)

    @property
    def constant(self) -> bool:
        return bool(self.text) and len(self.contents) >= SURE_PAGES


def _slot(label, content, skip, pages, text, chars, links, contents, lost, children):
    s = Slot(label, content, skip)
    s.pages, s.text, s.chars, s.links, s.contents, s.lost, s.children = pages, text, chars, links, contents, lost, children
    return s


def _union(a: tuple, b: tuple) -> tuple:
    return a if a == b else tuple(sorted({*a, *b})[:SURE_PAGES])


def _own_text(node: Node) -> tuple[str, int]:
    """Text of a node without its block elements, and the characters of it in links."""
    out, links = [], 0
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in BLOCK and not c.skip:
            text, inner = _own_text(c)
            out.append(text)
            links += len(text) if c.tag == "a" else inner
    return "".join(out), links


def _blocks(node: Node):
    """Block elements right below a node, through inline ones."""
    for c in node.children:
        if not isinstance(c, str):
            if c.tag in BLOCK or c.skip:
                yield c
            else:
                yield from _blocks(c)


def outline(node: Node) -> Slot:
    """The tree of a page as a wrapper of one page; runs of siblings with one label are merged."""
    texts = hashlib.blake2b(digest_size=8)
    s = _outline(node, texts)
    contents = (int.from_bytes(texts.digest(), "little"),)
    todo = [s]
    while todo:
        t = todo.pop()
        t.pages, t.contents = 1, contents
        todo += t.children
    return s


def _outline(node: Node, texts) -> Slot:
    s = Slot(node.label, node.content, node.skip)
    if node.skip:
        return s
    text, s.links = _own_text(node)
    text = " ".join(text.split())
    if text:
        texts.update(text.encode("utf-8", "replace") + b"\n")
    s.text, s.chars = (zlib.crc32(text.encode("utf-8", "replace")) if text else 0), len(text)
    for c in _blocks(node):
        child = _outline(c, texts)
        if s.children and s.children[-1].label == child.label:
            s.children[-1] = merge(s.children[-1], child)
        else:
            s.children.append(child)
    return _bounded(s)


def _bounded(s: Slot) -> Slot:
    """Fold the children of ``s`` by kind where there are over KINDS."""
    if len(s.children) > KINDS:
        s.children = _fold(s.children)
    return s


def _match(a: Slot, b: Slot) -> int:
    """Simple tree matching: nodes in the largest common tree of two trees whose roots match."""
    if a.label != b.label:
        return 0
    if [c.label for c in a.children] == [c.label for c in b.children]:
        return 1 + sum(map(_match, a.children, b.children))
    return 1 + _align(a.children, b.children)[-1][-1]


def _align(a: list[Slot], b: list[Slot]) -> list[list[int]]:
    table = [[0] * (len(b) + 1)]
    for x in a:
        above, row = table[-1], [0]
        for j, y in enumerate(b):
            row.append(max(above[j + 1], row[j], above[j] + _match(x, y) if x.label == y.label else 0))
        table.append(row)
    return table


def merge(a: Slot, b: Slot) -> Slot:
    """Two aligned trees as one; nodes of only one of them stay with the pages they have."""
    a.pages += b.pages
    a.text = a.text if a.text == b.text else None
    a.chars += b.chars
    a.links += b.links
    a.contents = _union(a.contents, b.contents)
    a.lost += b.lost
    if [c.label for c in a.children] == [c.label for c in b.children]:
        a.children = [merge(x, y) for x, y in zip(a.children, b.children)]
        return a
    table = _align(a.children, b.children)
    i, j, out = len(a.children), len(b.children), []
    while i or j:
        if i and j and a.children[i - 1].label == b.children[j - 1].label and \
                table[i][j] == table[i - 1][j - 1] + _match(a.children[i - 1], b.children[j - 1]):
            i, j = i - 1, j - 1
            out.append(merge(a.children[i], b.children[j]))
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            out.append(a.children[i])
        else:
            j -= 1
            out.append(b.children[j])
    a.children = out[::-1]
    return _bounded(a)


def _count(s: Slot) -> int:
    return 1 + sum(map(_count, s.children))


def _fold(slots: list[Slot]) -> list[Slot]:
    """Siblings of one kind as one node, all the way down."""
    kinds: dict = {}
    for s in slots:
        kinds.setdefault((s.label, s.skip, s.content), []).append(s)
    for first, *others in kinds.values():
        children = first.children
        for s in others:
            first.pages = max(first.pages, s.pages)
            first.text = first.text if first.text == s.text else None
            first.chars += s.chars
            first.links += s.links
            first.contents = _union(first.contents, s.contents)
            first.lost += s.lost
            children = children + s.children
        first.children = _fold(children)
    return [same[0] for same in kinds.values()]


def _cut(s: Slot, least: int, keep_marked: bool) -> bool:
    """Leave out the nodes below ``s`` on fewer than ``least`` pages; is ``s`` or a node below it marked and kept?"""
    marked, kept = s.content and not s.skip and keep_marked, []
    for c in s.children:
        inside = _cut(c, least, keep_marked)
        if inside or c.pages >= least:
            kept.append(c)
            marked = marked or inside
        else:
            s.lost += _mass(c, True)
    s.children = kept
    return marked


def _trim(s: Slot) -> Slot:
    """Hold a wrapper to NODES nodes by folding siblings and leaving out the rarest."""
    if _count(s) > NODES:
        s.children = _fold(s.children)
    least = 1
    while _count(s) > NODES and least <= s.pages:
        least *= 2
        _cut(s, least, True)
    if _count(s) > NODES:  # marked nodes alone
        _cut(s, least, False)
    return s


def _mass(s: Slot, marked: bool = False) -> float:
    """Characters of varying text (in marked nodes, of any text) outside links in a subtree."""
    if s.skip:
        return 0.0
    own = 0.0 if s.constant and not marked else max(0, s.chars - 2 * s.links)
    return own + s.lost + sum(_mass(c, marked) for c in s.children)


def wrapper(s: Slot) -> tuple[frozenset[str], frozenset, bool] | None:
    """(paths of the slots that hold the article, constant (path, text) pairs, whether the slots are marked); None where
    nodes left out may hold the slots."""
    marked: list[tuple[str, bool]] = []

    def find(t: Slot, path: str):
        path = f"{path}>{t.label}"
        if t.skip:
            return
        if t.content:
            inner = len(marked)
            for c in t.children:
                find(c, path)
            if len(marked) == inner or t.label.startswith("article"):  # the innermost marked node; an article holds all of its own
                del marked[inner:]
                marked.append((path, _mass(t, True) > 0))
            return
        for c in t.children:
            find(c, path)

    find(s, "")
    paths = frozenset(p for p, full in marked if full)
    if paths:
        return paths, frozenset(), True
    constant = set()

    def collect(t: Slot, path: str):
        path = f"{path}>{t.label}"
        if not t.skip:
            if t.constant:
                constant.add((path, t.text))
            for c in t.children:
                collect(c, path)

    collect(s, "")
    at, path = s, f">{s.label}"
    while True:
        whole = _mass(at)
        best = max(at.children, key=_mass, default=None)
        if best is None or not whole or _mass(best) < 0.7 * whole or best.label.split(".")[0] in ("p", "li", "h1", "h2", "h3", "tr", "pre", "blockquote"):
            if at.lost > 0.3 * whole:
                return None
            return frozenset([path]), frozenset(constant), False
        at, path = best, f"{path}>{best.label}"


# ---------------------------------------------------------------- extraction

def _emit(node: Node, out: list[list[str]], in_header: bool = False) -> None:
    """Blocks of text below a node; out[-1] is the block being written."""
    for c in node.children:
        if isinstance(c, str):
            if not in_header:
                out[-1].append(c)
        elif c.skip:
            if c.tag in BLOCK:
                out.append([])
        elif c.tag in BLOCK and c.tag != "tr":
            out.append([])
            # of a header inside the article only the headings belong to it
            _emit(c, out, (in_header or c.tag == "header") and c.tag not in ("h1", "h2", "h3", "h4", "h5", "h6"))
            out.append([])
        elif c.tag in ("tr", "td", "th"):
            if c.tag == "tr":
                out.append([])
            else:
                out[-1].append(" ")
            _emit(c, out, in_header)
        else:
            _emit(c, out, in_header)


def _link_mass(node: Node, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """Characters below a node and those of them in links; ``known`` keeps them by node."""
    if id(node) not in known:
        text, links = _own_text(node)
        chars = len(text.strip())
        for c in _blocks(node):
            if not c.skip:
                more, inside = _link_mass(c, known)
                chars, links = chars + more, links + inside
        known[id(node)] = chars, links
    return known[id(node)]


def _link_list(node: Node, known: dict[int, tuple[int, int]]) -> bool:
    chars, links = _link_mass(node, known)
    return chars > 0 and links > 0.6 * chars


def extract(root: Node, rule) -> str | None:
    """Text of a page by a wrapper's rule; None if the page has none of its slots."""
    paths, constant, marked = rule
    out: list[list[str]] = [[]]
    found = False
    known: dict[int, tuple[int, int]] = {}  # a subtree is asked about before any of it is pruned

    def prune(node: Node, path: str) -> None:
        for c in list(_blocks(node)):
            here = f"{path}>{c.label}"
            if c.skip:
                continue
            text = " ".join(_own_text(c)[0].split())
            if (text and (here, zlib.crc32(text.encode("utf-8", "replace"))) in constant) or (c.tag in ("ul", "ol", "div", "table", "dl") and _link_list(c, known)):
                c.skip = True
            else:
                prune(c, here)

    def walk(node: Node, path: str) -> None:
        nonlocal found
        path = f"{path}>{node.label}"
        if path in paths:
            found = True
            if not marked:
                prune(node, path)
            out.append([])
            _emit(node, out)
            out.append([])
            return
        for c in _blocks(node):
            if not c.skip:
                walk(c, path)

    walk(root, "")
    if not found:
        return None
    blocks = (" ".join("".join(b).split()) for b in out)
    return "\n\n".join(b for b in blocks if b)


def page_text(page: str | None, rule=None) -> str:
    """Main text of a page, by its host's rule or on its own."""
    if not page:
        return ""
    root = parse(page)
    text = extract(root, rule) if rule else None
    if text is None:
        text = extract(root, wrapper(outline(root)))
    return text or ""


# ---------------------------------------------------------------- on Spark

def _host():
    """Host of a url, lower case, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, rule binary) for each host of ``pages`` (url, html); staged."""
    names = ["host", "bucket", "tree"]

    def rows(found):
        hosts = list(found)
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in hosts], pa.string()), pa.array([k for _, k in hosts], pa.int32()),
                                           pa.array([zlib.compress(pickle.dumps(_trim(found[h])), 1) for h in hosts], pa.binary())], names)

    def induce(batches):
        found: dict = {}
        for b in batches:
            for host, bucket, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                page = page.as_py()
                if page:
                    s = outline(parse(page))
                    key = (host, bucket)
                    found[key] = merge(found[key], s) if key in found else s
                    if found[key].pages % 256 == 0:
                        _trim(found[key])
            if len(found) > 5000:  # hosts held at a time; what goes out early meets again below
                yield rows(found)
                found = {}
        yield rows(found)

    def fuse(t: pa.Table) -> Slot:
        out = None
        for x in t.column("tree"):
            s = pickle.loads(zlib.decompress(x.as_py()))
            out = s if out is None else _trim(merge(out, s))
        return out

    def half(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows({(t.column("host")[0].as_py(), 0): fuse(t)})])

    def rule(t: pa.Table) -> pa.Table:
        made = pickle.dumps(wrapper(fuse(t)))
        return pa.Table.from_arrays([t.column("host").slice(0, 1), pa.array([made], pa.binary())], ["host", "rule"])

    buckets = F.pmod(F.spark_partition_id(), F.lit(256)).cast("int")
    partial = pages.select(_host().alias("host"), buckets.alias("bucket"), "html").mapInArrow(induce, "host string, bucket int, tree binary")
    met = partial.groupBy("host", "bucket").applyInArrow(half, "host string, bucket int, tree binary")
    return stage(met.groupBy("host").applyInArrow(rule, "host string, rule binary"), "html-wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    prepare(pages.sparkSession)
    rules = wrappers(pages)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("host")), F.lit(0))).first()[0]
    joined = (pages.select("page_id", "url", "html").withColumn("host", _host())
              .join(F.broadcast(rules) if size <= BROADCAST else rules, "host", "left").select("page_id", "url", "html", "rule"))

    def run(batches):
        known: dict = {}
        for b in batches:
            texts = []
            for page, raw in zip(b.column(2), b.column(3).to_pylist()):
                if raw is not None and raw not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[raw] = pickle.loads(raw)
                texts.append(page_text(page.as_py(), known.get(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
