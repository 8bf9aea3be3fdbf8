"""Operator 10, main text of web pages by wrapper induction.

1. Every page becomes a DOM tree by one pass over its characters (implied end tags, raw text of
   scripts, unclosed tags and quotes); for alignment, inline elements are text and runs of
   like siblings are one list node.
2. The trees of one host are aligned by simple tree matching (largest order-preserving match
   of equal nodes, top down) and merged into the host's wrapper: each task merges the pages
   it sees, each structure once; partial wrappers are merged in two grouped steps.
3. Each page is aligned with its host's wrapper, so each of its blocks stands in a slot: a node
   of the wrapper or, below nodes that the wrapper lacks, a path of keys. Spark counts (host,
   slot, text) over the host's different pages. A text that at least ``CONSTANT`` of the
   pages with this slot share (``LEAST_PAGES`` at least) is template; the rest is content.
   Copies count once, and so do near copies: pages of which most blocks are such texts count
   as one page together, and the texts are counted anew.
4. Slots in parts that HTML marks as something else (menus, headers, footers, asides, forms,
   scripts, adverts, notices, comments by tag, role, class or id) are left out; of the rest
   the article element with its sibling articles, else main, else the densest part of the body
   is the text. A class or id never takes the article away (see ``settle``).

Defined results: null or empty html gives empty text; a null url, or one without a host, has
no wrapper; elements nested deeper than ``DEPTH`` hang on the last open one of that depth; a
tag without end stops at the next "<"; more than ``WIDE`` unlike children of one node are
aligned in order instead of best; repeated rows and ids are extracted row by row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import common as C
from flowlens.llm.urlfilter import host_of

DEPTH, WIDE, LEAST_PAGES, CONSTANT = 200, 400, 5, 0.8
#: Wrapper nodes kept per host (the most frequent; others are slots by their path); tables of hosts
#: up to so many bytes are broadcast.
NODES, BROADCAST_BYTES = 2000, 8 << 20
HOSTS_AT_ONCE, STRUCTURES = 5000, 2000

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
STOP = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# fixed values: elements of HTML
RAW = {tag: re.compile(f"</{tag}\\s*>", re.I)
       for tag in "script style textarea title noscript iframe template svg xmp".split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
            "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("caption dd dt li td th tr tbody thead tfoot option optgroup legend summary html head body".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "tbody": {"table"}, "p": {"button", "td", "th", "table", "object", "li"}}
# fixed values: what is not the article
OTHER_TAGS = set("script style noscript template iframe svg head title nav footer aside form button select textarea input label "
                 "object embed dialog menu menuitem canvas audio video map xmp".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_WORDS = set("ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar "
                  "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices "
                  "alert popup overlay modal newsletter subscribe subscription signup share sharing social related recommended "
                  "recommendations comment comments commentlist disqus respond reply replies widget widgets toolbar pagination pager "
                  "copyright legal disclaimer login search skip hidden".split())
# words of states and sizes: "has-sidebar" or "comments-open" tell of the page, not of the element
STATE_WORDS = set("has no not with without is open closed enabled disabled on off active inactive sm md lg xs xl".split())
# words that never name the part that holds the article
SURE_WORDS = set("ad ads advert adverts advertisement advertising adsense adslot cookie cookies consent gdpr newsletter signup "
                 "comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs pagination pager "
                 "recommended recommendations related".split())


class Node:
    """An element; ``parts`` holds child elements and texts in order. ``hits`` is 2 if a whole class name or
    the id is one of ``OTHER_WORDS``, 1 if only a part of one is; ``sure`` if one of ``SURE_WORDS`` is among them."""

    __slots__ = ("tag", "key", "other", "parts", "hits", "sure")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts = tag, []
        found = {}
        if attributes.strip(" /\n\t"):
            for name, value in ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), unescape(value.strip("\"'")) if value else "")
        names = f"{found.get('id', '')} {found.get('class', '')}"
        self.key = f"{tag}.{re.sub('[0-9]+', '', names).strip().lower()}" if names.strip() else tag
        whole = set(names.lower().split()) & OTHER_WORDS
        hit = set(whole)
        for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().replace("_", "-").split():
            words = set(name.split("-"))
            if not words & STATE_WORDS:
                hit |= words & OTHER_WORDS
        self.hits = 0 if tag in ("html", "body", "main") or not hit else 2 if whole else 1
        self.sure = bool(hit & SURE_WORDS)
        self.other = (tag in OTHER_TAGS or found.get("role", "").lower() in OTHER_ROLES or "hidden" in found
                      or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower())


def settle(root: Node) -> None:
    """Mark what classes and ids name as something else, but not the article.

    Kept are an article that only parts of names hit, what holds the article or main element if
    no other is free, and what holds most of the page's text: by parts of names, or by whole
    names if nothing else is left (never by ``SURE_WORDS``).
    """
    sizes: dict[int, int] = {}
    holds: set[int] = set()
    free = False

    def walk(node: Node, marked: bool) -> None:
        nonlocal free
        marked = marked or node.hits == 2 or (node.hits == 1 and node.tag != "article")
        size, held = 0, node.tag in ("article", "main") and (node.hits < 2 or not node.sure)
        for p in node.parts:
            if isinstance(p, str):
                size += len("".join(p.split()))
            elif not p.other:
                walk(p, marked)
                size += sizes[id(p)]
                held = held or id(p) in holds
        sizes[id(node)] = size
        if held and size:
            holds.add(id(node))
            free = free or (node.tag in ("article", "main") and not marked)

    def mark(node: Node, last: bool) -> int:
        left = 0
        for p in node.parts:
            if isinstance(p, str):
                left += len("".join(p.split()))
            elif not p.other:
                most = 2 * sizes[id(p)] > sizes[id(root)] and not p.sure
                if (not p.hits or (p.hits == 1 and (p.tag == "article" or most))
                        or (not free and id(p) in holds) or (last and most)):
                    left += mark(p, last)
                else:
                    held_back.append(p)
                    p.other = True
        return left

    held_back: list[Node] = []
    walk(root, False)
    if not mark(root, False) and sizes[id(root)]:
        for p in held_back:
            p.other = False
        mark(root, True)


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of texts, start and end tags, in one pass: no character is read again but
    those of attributes. Kinds: text, start, end; raw elements and comments give nothing."""
    at, size = 0, len(html)
    lost: set[str] = set()             # characters known not to come any more

    def find(what: str, start: int) -> int:
        if what in lost:
            return -1
        found = html.find(what, start)
        if found < 0:
            lost.add(what)
        return found

    def skip(end: str, start: int) -> int:
        """Behind the next ``end``; without one at the next "<" or the end of the page."""
        found = find(end, start)
        if found >= 0:
            return found + len(end)
        found = find("<", start)
        return found if found >= 0 else size

    while at < size:
        low = find("<", at)
        if low != at:
            yield "text", "", html[at:low if low >= 0 else size]
            if low < 0:
                return
        name = NAME.match(html, low + 1)
        if name:
            tag, stop = name[0].lower(), name.end()
            while True:                # to ">", "<" or the end, past quoted values
                m = STOP.search(html, stop)
                if m is None or m[0] in "<>":
                    break
                stop = m.end()
                if html[max(name.end(), m.start() - 64):m.start()].rstrip().endswith("="):
                    closing = find(m[0], stop)
                    stop = closing + 1 if closing >= 0 else stop
            end = m.start() if m else size
            at = end + 1 if m and m[0] == ">" else end
            if tag in RAW and m and m[0] == ">":
                closing = None if tag in lost else RAW[tag].search(html, at)
                if closing is None:
                    return             # the rest of the page is the element's
                at = closing.end()
            else:
                yield "start", tag, html[name.end():end]
        elif html.startswith("<!--", low):
            found = find("-->", low + 4)
            if found < 0:
                return
            at = found + 3
        elif html.startswith(("<!", "<?"), low):
            at = skip(">", low + 2)
        elif html.startswith("</", low):
            name = NAME.match(html, low + 2)
            at = skip(">", name.end() if name else low + 2)
            if name:
                yield "end", name[0].lower(), ""
        else:
            yield "text", "", "<"
            at = low + 1


def parse(html: str) -> Node:
    """Tree of a page."""
    root = Node("#page")
    stack, opened, in_blocks = [root], {}, []      # places in the stack, by tag and of block elements

    def last(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def cut(at: int) -> None:
        while len(stack) > at:
            node = stack.pop()
            opened[node.tag].pop()
            if node.tag in BLOCK:
                in_blocks.pop()

    def close(tags: set[str], scope: set[str]) -> None:
        border = last(scope)
        while (at := last(tags)) > border:
            cut(at)

    for kind, tag, rest in scan(html):
        if kind == "text":
            stack[min(len(stack), DEPTH) - 1].parts.append(unescape(rest))
        elif kind == "start":
            if tag in CLOSES_P and (at := last({"p"})) > last(SCOPES["p"]):
                cut(at)
            if tag in SIBLING_ENDS:
                close(SIBLING_ENDS[tag], SCOPES.get(tag, set()))
            node = Node(tag, rest)
            stack[min(len(stack), DEPTH) - 1].parts.append(node)
            if tag not in VOID and not rest.endswith("/"):
                opened.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    in_blocks.append(len(stack))
                stack.append(node)
        else:
            at = last({tag})
            if at and (tag in BLOCK or not in_blocks or at > in_blocks[-1]):   # an inline end tag stays in its block
                cut(at)
    settle(root)
    return root


def _blocks(node: Node, out: list[tuple[str, Node]], open_text: list[str], owner: Node, articles: bool) -> None:
    """Blocks of text with the block element they stand in, in page order."""
    for part in node.parts:
        if isinstance(part, str):
            open_text.append(part)
        elif part.other or (part.tag == "header" and not articles):
            open_text.append(" ")
        elif part.tag == "br":
            open_text.append(" ")
        elif part.tag in BLOCK:
            _flush(open_text, out, owner)
            _blocks(part, out, open_text, part, articles or part.tag in ("article", "main"))
            _flush(open_text, out, part)
        else:
            _blocks(part, out, open_text, owner, articles)


def _flush(open_text: list[str], out: list[tuple[str, Node]], owner: Node) -> None:
    text = " ".join("".join(open_text).split())
    open_text.clear()
    if text:
        out.append((text, owner))


def blocks(node: Node, articles: bool = False) -> list[tuple[str, Node]]:
    """(text, block element) of everything that is not marked as something else."""
    out: list[tuple[str, Node]] = []
    rest: list[str] = []
    _blocks(node, out, rest, node, articles)
    _flush(rest, out, node)
    return out


# ---------------------------------------------------------------- wrappers

def slots(node: Node) -> tuple[list, dict[int, list]]:
    """The page as an alignment tree ``[key, pages, number, children]`` and, per block element, its
    node. Neighbouring children of equal key are one node; numbers come with the wrapper."""
    made: dict[int, list] = {}

    def build(nodes: list[Node]) -> list:
        out = [nodes[0].key, 1, 0, []]
        inner: list[Node] = []
        for n in nodes:
            made[id(n)] = out
            inner += _block_children(n)
        at = 0
        while at < len(inner):
            to = at
            while to < len(inner) and inner[to].key == inner[at].key:
                to += 1
            out[3].append(build(inner[at:to]))
            at = to
        return out

    return build([node]), made


def _block_children(node: Node) -> list[Node]:
    out: list[Node] = []
    for part in node.parts:
        if isinstance(part, Node) and not part.other:
            if part.tag in BLOCK:
                out.append(part)
            else:
                out += _block_children(part)
    return out


def number(text: str) -> int:
    """A 63-bit name of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def match(a: list, b: list, memo: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: (size of the largest match, matched child positions)."""
    if memo is None:
        memo = {}
    if (id(a), id(b)) in memo:
        return memo[id(a), id(b)]
    if a[0] != b[0]:
        return 0, []
    x, y = a[3], b[3]
    if len(x) > WIDE and len(y) > WIDE:
        memo[id(a), id(b)] = out = _in_order(x, y, memo)
        return out
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    gain = {}
    for i, p in enumerate(x, 1):
        row, above = table[i], table[i - 1]
        for j, q in enumerate(y, 1):
            best = max(above[j], row[j - 1])
            if p[0] == q[0]:
                gain[i, j] = above[j - 1] + match(p, q, memo)[0]
                best = max(best, gain[i, j])
            row[j] = best
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if (i, j) in gain and table[i][j] == gain[i, j]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[id(a), id(b)] = out = (table[-1][-1] + 1, pairs[::-1])
    return out


def _in_order(x: list, y: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Each child of x with the next free child of y of its key: for very wide nodes."""
    places: dict[str, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j][0], []).append(j)
    size, at, pairs = 1, -1, []
    for i, p in enumerate(x):
        free = places.get(p[0], [])
        while free and free[-1] <= at:
            free.pop()
        if free and free[-1] - at <= WIDE:         # a far one would pass over many others
            at = free.pop()
            size += match(p, y[at], memo)[0]
            pairs.append((i, at))
    return size, pairs


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """Wrapper of two wrappers: matched nodes add up, the others keep their place as options."""
    memo = {} if memo is None else memo
    pairs = match(a, b, memo)[1]
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[3]), len(b[3]))]:
        children += a[3][i:p] + b[3][j:q]
        if p < len(a[3]) and q < len(b[3]):
            children.append(merge(a[3][p], b[3][q], memo))
        i, j = p + 1, q + 1
    return [a[0], a[1] + b[1], 0, children]


def pruned(wrapper: list) -> list:
    """The wrapper without its rarest nodes beyond ``NODES`` of them."""
    counts: list[int] = []
    todo = [wrapper]
    while todo:
        node = todo.pop()
        counts.append(node[1])
        todo += node[3]
    if len(counts) <= NODES:
        return wrapper
    least = sorted(counts, reverse=True)[NODES]

    def keep(node):
        return [node[0], node[1], 0, [keep(c) for c in node[3] if c[1] > least]]

    return keep(wrapper)


def numbered(wrapper: list) -> list:
    """The wrapper with its nodes numbered from 1, top down."""
    todo, n = [wrapper], 0
    while todo:
        node = todo.pop()
        n += 1
        node[2] = n
        todo += reversed(node[3])
    return wrapper


def aligned(tree: list, wrapper: list | None) -> dict[int, int]:
    """Alignment node -> slot: the number of its wrapper node, else a name made of the slot above
    and its key."""
    out: dict[int, int] = {}
    memo: dict = {}

    def walk(a: list, w: list | None, above: int) -> None:
        out[id(a)] = slot = w[2] if w is not None else number(f"{above} {a[0]}")
        pairs = dict(match(a, w, memo)[1]) if w is not None else {}
        for i, child in enumerate(a[3]):
            walk(child, w[3][pairs[i]] if i in pairs else None, slot)

    walk(tree, wrapper if wrapper is not None and wrapper[0] == tree[0] else None, 0)
    return out


# ---------------------------------------------------------------- main text

def _size(found: list[tuple[str, Node]]) -> int:
    return sum(len(t) for t, _ in found)


def weigh(root: Node) -> dict[int, tuple[int, int]]:
    """Element -> (letters of its text, those within links); what is marked as something else has none."""
    out: dict[int, tuple[int, int]] = {}

    def walk(node: Node, articles: bool) -> tuple[int, int]:
        size = links = 0
        for p in node.parts:
            if isinstance(p, str):
                size += sum(map(len, p.split()))
            elif not p.other and (p.tag != "header" or articles):
                a, b = walk(p, articles or p.tag in ("article", "main"))
                size, links = size + a, links + (a if p.tag == "a" else b)
        out[id(node)] = size, links
        return size, links

    walk(root, False)
    return out


def _named(node: Node, tag: str) -> list[list[Node]]:
    """Outermost elements of a tag outside the parts marked as something else; those of one parent together."""
    below = [p for p in node.parts if isinstance(p, Node) and not p.other]
    same = [p for p in below if p.tag == tag]
    return [same] * bool(same) + [g for p in below if p.tag != tag for g in _named(p, tag)]


def main_parts(root: Node, weights: dict[int, tuple[int, int]]) -> list[Node]:
    """The article and its siblings, else main, else the densest part of the page."""
    for tag in ("article", "main"):
        sized = [(max(_size(blocks(n, True)) for n in group), group) for group in _named(root, tag)]
        if any(size for size, _ in sized):
            return max(sized, key=lambda x: x[0])[1]
    node = root
    while True:
        whole = weights.get(id(node), (0, 0))[0]
        below = [p for p in _block_children(node) if id(p) in weights
                 and 10 * (weights[id(p)][0] - weights[id(p)][1]) >= 8 * whole > 0]
        if not below or below[0].tag in ("p", "pre", "blockquote", "ul", "ol", "table", "li", "td"):
            return [node]
        node = below[0]


def main_blocks(root: Node) -> list[tuple[str, Node]]:
    """(text, block element) of the main part, in page order."""
    weights = weigh(root)
    parts = main_parts(root, weights)
    marked = parts[0].tag in ("article", "main")
    found = [block for part in parts for block in blocks(part, marked)]
    if not marked:     # rows of links in an unmarked page are menus
        found = [(t, o) for t, o in found
                 if 2 * weights.get(id(o), (0, 0))[1] <= len(t) or o.tag in ("p", "h1", "h2", "h3")]
    return found


def main_text(html: str) -> str:
    """Main text of a page without its host's wrapper; its blocks joined by a line feed."""
    return "\n".join(t for t, _ in main_blocks(parse(html)))


def page_slots(html: str, wrapper: list | None) -> list[dict]:
    """The main blocks of a page with their slots in the wrapper."""
    root = parse(html)
    tree, made = slots(root)
    place = aligned(tree, wrapper)
    return [{"slot": place[id(made[id(o)])], "key": number(t), "text": t} for t, o in main_blocks(root)]


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of ``pages(host, html)``; a structure that repeats is merged once."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        seen: dict[str, set[int]] = {}

        def given():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(json.dumps, held.values()), pa.string())],
                                             names=["host", "wrapper"])
            held.clear()
            seen.clear()

        for batch in batches:
            for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                tree = slots(parse(html or ""))[0]
                known = seen.setdefault(host, set())
                shape = number(json.dumps(tree))
                if shape not in known:
                    if len(known) < STRUCTURES:
                        known.add(shape)
                    held[host] = pruned(merge(held[host], tree)) if host in held else tree
            if len(held) > HOSTS_AT_ONCE:
                yield from given()
        yield from given()

    def merged(key: tuple, table: pa.Table, last: bool) -> pa.Table:
        trees = [json.loads(w) for w in sorted(table["wrapper"].to_pylist())]
        out = trees[0]
        for t in trees[1:]:
            out = pruned(merge(out, t))
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(numbered(out) if last else out)]})

    parts = pages.mapInArrow(partial, "host string, wrapper string").withColumn("part", F.xxhash64("wrapper") % 32)
    some = parts.groupBy("host", "part").applyInArrow(lambda k, t: merged(k, t, False), "host string, wrapper string")
    return some.groupBy("host").applyInArrow(lambda k, t: merged(k, t, True), "host string, wrapper string")


def _by_host(left: DataFrame, hosts: DataFrame, size: Column) -> DataFrame:
    """Left join by host; the table of hosts is broadcast only if it is small."""
    small = (hosts.agg(F.sum(size + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES
    return left.join(F.broadcast(hosts) if small else hosts, "host", "left")


def fixed_texts(pages: DataFrame) -> DataFrame:
    """(host, fixed): the template texts (slot, key) of each host, from all its different pages.

    ``pages(host, blocks)``: one row per page. Every count is a grouped sum, so a host with a
    third of all pages is added up in many tasks."""
    pair = F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), b["key"].alias("key")))
    different = (pages.select("host", F.array_distinct(pair).alias("pairs"), F.xxhash64(pair).alias("page"))
                 .groupBy("host", "page").agg(F.first("pairs").alias("pairs")))

    def constant(rows: DataFrame, weight: Column) -> DataFrame:
        """Texts that enough of the pages with their slot have; rows of a host whose pages count together
        have ``together`` set."""
        texts = rows.select("host", "together", F.explode("pairs").alias("x")).select("host", "together", "x.*")
        n = (texts.groupBy("host", "slot", "key").agg(weight.alias("n"))
             .where(F.col("n") >= LEAST_PAGES))
        slot = F.explode(F.array_distinct(F.transform("pairs", lambda x: x["slot"]))).alias("slot")
        of = rows.select("host", "together", slot).groupBy("host", "slot").agg(weight.alias("of"))
        return (n.join(of.where(F.col("of") >= LEAST_PAGES), ["host", "slot"]).where(F.col("n") >= CONSTANT * F.col("of"))
                .groupBy("host").agg(F.collect_list(F.struct("slot", "key")).alias("fixed")))

    once = C.staged(different, "different-pages")
    alone = once.withColumn("together", F.lit(False))
    first = C.staged(constant(alone, F.count(F.lit(1))), "often")
    judged = _by_host(once, first, 16 * F.size("fixed")).where("fixed is not null")
    shared = F.array_intersect("pairs", "fixed")
    near = judged.select("host", "pairs", (2 * F.size(shared) > F.size("pairs")).alias("together"))
    weight = F.count_if(~F.col("together")) + F.max(F.col("together").cast("int"))
    return constant(near, weight)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; see the module's docstring."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"),
                     host_of(url).alias("host"))
    wrappers = C.staged(induce(rows.where("host <> ''").select("host", "html")), "wrappers")
    joined = _by_host(rows, wrappers, F.octet_length("wrapper")).select("id", "url", "host", "html", "wrapper")
    block = pa.list_(pa.struct([("slot", pa.int64()), ("key", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            for part in C.text_slices(batch, "html"):
                found = []
                for html, raw in zip(part["html"].to_pylist(), part["wrapper"].to_pylist(), strict=True):
                    if raw is not None and raw not in known:
                        if len(known) > 200:
                            known.clear()
                        known[raw] = json.loads(raw)
                    found.append(page_slots(html or "", known[raw] if raw is not None else None))
                yield pa.RecordBatch.from_arrays([part["id"], part["url"], part["host"], pa.array(found, block)],
                                                 names=["id", "url", "host", "blocks"])

    blocks_type = T.ArrayType(T.StructType([T.StructField("slot", T.LongType()), T.StructField("key", T.LongType()),
                                            T.StructField("text", T.StringType())]))
    pages = C.staged(joined.mapInArrow(run, T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("url", T.StringType()),
        T.StructField("host", T.StringType()), T.StructField("blocks", blocks_type)])), "page-blocks")
    fixed = C.staged(fixed_texts(pages.where("host <> ''").select("host", "blocks")), "fixed-texts")
    judged = _by_host(pages, fixed, 16 * F.size("fixed"))
    template = lambda b: F.array_contains("fixed", F.struct(b["slot"].alias("slot"), b["key"].alias("key")))
    kept = F.filter("blocks", lambda b: ~F.coalesce(template(b), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return judged.select("id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: main text of every page."""
    return extract(C.table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
