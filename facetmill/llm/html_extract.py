"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tag and text tokens. The streams of one host are aligned one after another into
a wrapper, an expression of tags in which mismatches have become optional groups (seen in some pages
only), repeated groups (neighbours of one kind) and text slots (texts that differ). Alignment goes
level by level, by the longest common sequence of keys. Pages of one shape (equal keys throughout) need
no alignment: tasks merge them as they read them, in any order with one result. The shapes of a host
are then aligned in the order of their hashes, by ranges of hashes in three steps, so the wrapper
doesn't hang on how pages lie in partitions, a hot host is spread over many tasks, and a fold holds two
wrappers at a time.

A wrapper tells the host's content root (the group whose slots hold most text outside links) and its
constant texts: those that stand in a group on every page that shows it, also among the others of a
repeated group. A page's main text is what stands in the content root, without menus, headers, footers,
sidebars, notices, adverts, forms, comments and the wrapper's constants. Only where the wrapper is of no
use (few pages, no group below the body that stands out, little text that differs) or the page lacks its
content root do element names choose: the article, else main, else the likeliest root.

Defined results: null or empty html, and pages without text, give an empty text; pages without a host
share one wrapper; repeated rows stay, and count as one page in telling constants; of groups with
equally much text the first in page order leads on to the content root; pages are read whole and in
linear time, however long; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm.common import bound_batches, materialize

#: A comment, a tag (quoted values only after an equals sign, as browsers read them), a declaration, or
#: text. Possessive throughout, so no page is scanned more than once.
TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>"'=]++|=\s*+(?>"[^"]*+"|'[^']*+')|[="'])*+)>|<[!?][^>]*+>|([^<]++|<)""",
    re.S,
)
#: The same with tags ending at the next bracket, for pages whose quotes keep running open.
SIMPLE = re.compile(r"<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>|([^<]++|<)", re.S)
OPEN_QUOTES = 20
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Numbers in ids and, but for the small ones of grids, in classes differ by page.
NUMBER, PAGE_NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")

RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main "
    "figure figcaption address header footer nav aside form fieldset details summary body html hr center menu dialog".split()
)
PARAGRAPHS = frozenset("p blockquote h1 h2 h3 h4 h5 h6 dd figcaption caption".split())
#: A start tag of the key closes an open element of these kinds first, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("div section article main body html ul ol table td th blockquote header footer nav aside form dl".split())
#: Elements whose text is never part of an article.
LEFT_OUT = frozenset("head script style noscript template svg form button select option textarea nav menu footer aside dialog iframe object canvas audio video map title input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS_OUT = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer footers sidebar sidebars aside ad ads advert adverts "
    "advertisement advertisements adbox adslot adunit adsbygoogle banner banners promo promos promotion sponsor sponsored cookie "
    "cookies consent gdpr notice notices alert alerts newsletter subscribe subscription popup modal overlay share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets toolbar "
    "pagination pager login signin signup search skip hidden paywall tags toc outbrain taboola".split()
)
HEADER_WORDS = frozenset("header headers topbar".split())
WORDS_WRAP = frozenset("content main wrapper container page layout article post entry story body".split())
CONTENT_WORDS = frozenset("content article post entry story".split())
#: Distinct pages a host must show before its constants count; levels a wrapper has, and children of a
#: node it keeps apart: beyond, its rarest share slots.
LEAST_PAGES, DEPTH, WIDTH = 5, 24, 200
#: Least share of a group's slot text in its content root; of a host's whole text in the root's slots.
MOST, DIFFERENT = 0.7, 0.3
#: Bytes of host rules that may be sent to all executors; beyond, pages are joined by host.
BROADCAST_BYTES = 32 << 20


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def _left_out(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether an element and all in it is no part of an article; ``inside`` an article or main."""
    if tag in LEFT_OUT:
        return True
    if tag == "header":
        return not inside
    if not at:
        return False
    if at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", at.get("class", "") + " " + at.get("id", "")).lower()))
    if tag in ("html", "body", "main"):
        return False
    if words & {"comment", "comments", "commentlist"}:
        return True
    if tag == "article" or (words & WORDS_WRAP and not words & {"ad", "ads", "advert", "sponsored", "related"}):
        return False
    return bool(words & WORDS_OUT) or bool(words & HEADER_WORDS) and not inside


class Block:
    __slots__ = ("path", "text", "place", "links")

    def __init__(self, path: tuple[str, ...], text: str, place: int, links: int):
        self.path, self.text, self.place, self.links = path, text, place, links


def parse(page: str) -> list[Block]:
    """The page's text blocks outside left-out elements, in page order. ``place`` is 3 inside an
    article, 2 inside main, 1 inside an element named like content, else 0."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, key, left out, place
    parts: list[str] = []
    links = 0
    in_link = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(tuple(k for _, k, _, _ in stack), text, stack[-1][3] if stack else 0, links))
            parts.clear()
        links = 0

    at, failed, last_end = 0, 0, page.rfind(">")
    while at < len(page):
        if at > last_end:  # no tag ends any more
            if not (stack and stack[-1][2]):
                parts.append(page[at:].partition("<!--")[0])
            break
        m = (TOKEN if failed < OPEN_QUOTES else SIMPLE).match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            failed += m[4] == "<" and page[at : at + 1].isalpha()
            if m[4] is not None and not (stack and stack[-1][2]):
                parts.append(m[4])
                if in_link:
                    links += len(m[4])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCKS and any(t in BLOCKS for t, *_ in stack[i + 1 :]):
                        break
                    del stack[i:]
                    break
                if tag == "p" and stack[i][0] in CONTAINERS:
                    break
            continue
        if tag in RAW:
            if tag == "title":
                flush()
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag == "a":
            in_link = 1
        attributes = _attributes(m[3])
        if tag in BLOCKS or tag in LEFT_OUT:
            flush()
            closed = CLOSES.get(tag, {"p"} if tag in BLOCKS else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed or (stack[i][0] == "p" and tag in BLOCKS):
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINERS and stack[i][0] not in closed:
                    break
        elif not attributes and tag not in LEFT_OUT:
            continue  # plain inline markup
        if tag == "hr" or m[3].endswith("/"):
            continue
        out = bool(stack and stack[-1][2])
        place = stack[-1][3] if stack else 0
        if not out:
            out = _left_out(tag, attributes, place >= 2)
        if tag not in BLOCKS and not out:
            continue
        if not out:
            kind = attributes.get("class", "").split()
            if tag == "article":
                place = 3
            elif tag == "main" or attributes.get("role", "").lower() == "main":
                place = max(place, 2)
            elif place == 0 and tag not in ("html", "body") and set(re.findall(r"[a-z]+", (attributes.get("class", "") + " " + attributes.get("id", "")).lower())) & CONTENT_WORDS:
                place = 1
            key = tag + ("." + PAGE_NUMBER.sub("0", kind[0]) if kind else "#" + NUMBER.sub("0", attributes["id"].replace(" ", "_")) if attributes.get("id") else "")
        else:
            key = tag
        stack.append((tag, key, out, place))
    flush()
    return blocks


# A wrapper node is [key, flags, texts, characters, children, pages]: flags 1 optional, 2 repeated; texts (of a
# leaf) stand in it on every page that shows it, each with its characters outside links, summed, and
# digests of some pages; characters are those of all other texts, the slot. A node of key REST is the
# slot of neighbours that few pages have.
OPTIONAL, REPEATED, REST = 1, 2, "*"


def _mark(text: str) -> str:
    """What a constant text is known by: itself, or if long its start, length and hash."""
    import xxhash

    return text if len(text) <= 60 else f"{text[:24]}... {len(text)} {xxhash.xxh3_128_hexdigest(text)}"


def _page_tree(blocks: list[Block], page: int = 0) -> list:
    root = ["", 0, {}, 0, [], 1]
    last: tuple[str, ...] = ()
    open_nodes = [root]
    for b in blocks:
        path = b.path[:DEPTH]
        same = 0
        while same < min(len(path), len(last)) and path[same] == last[same] and same < len(path) - 1:
            same += 1
        del open_nodes[same + 1 :]
        for key in path[same:]:
            node = [key, 0, {}, 0, [], 1]
            open_nodes[-1][4].append(node)
            open_nodes.append(node)
        open_nodes[-1][4].append(["#", 0, {_mark(b.text): [max(len(b.text) - b.links, 0), [page]]}, 0, [], 1])
        last = path
    return _fold_repeats(root)


def _fold_repeats(node: list) -> list:
    """Neighbours of one key become one repeated group, their contents aligned."""
    out: list = []
    for child in node[4]:
        child = _fold_repeats(child)
        if out and out[-1][0] == child[0]:
            out[-1] = _align(out[-1], child, True)
            out[-1][1] |= REPEATED
        else:
            out.append(child)
    node[4] = _narrow(out, True)
    return node


def _whole(node: list) -> int:
    """Characters outside links of all texts of a node."""
    return node[3] + sum(n for n, _ in node[2].values()) + sum(map(_whole, node[4]))


def _narrow(children: list, within: bool = False) -> list:
    """``WIDTH`` children at most. If there are more, those of one key become one repeated group at the
    first one's place; then the rarest, and of equals those far from both ends, become slots."""
    if len(children) <= WIDTH:
        return children
    out: list = []
    first: dict[str, int] = {}
    for c in children:
        if c[0] in first:
            same = out[first[c[0]]]
            out[first[c[0]]] = _align(same, c, True)
            out[first[c[0]]][1] |= REPEATED
        else:
            if c[0] != REST:
                first[c[0]] = len(out)
            out.append(c)
    if len(out) <= WIDTH:
        return out
    order = sorted(first.values(), key=lambda i: (-out[i][5], min(i, len(out) - 1 - i)))
    apart = set(order[: WIDTH // 2 - 1])
    children, out = out, []
    for i, c in enumerate(children):
        if i in apart:
            out.append(c)
        elif out and out[-1][0] == REST:
            out[-1] = [REST, out[-1][1] | c[1] | (REPEATED if within else 0), {}, out[-1][3] + _whole(c), [], max(out[-1][5], c[5])]
        else:
            out.append([REST, OPTIONAL | c[1], {}, _whole(c), [], c[5]])
    return out


def _common_keys(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common sequence of keys."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start][0] == b[start][0]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end][0] == b[-1 - end][0]:
        end += 1
    both = [(i, i) for i in range(start)]
    ends = [(len(a) - i, len(b) - i) for i in range(end, 0, -1)]
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    i, j = 0, 0
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            both.append((start + i, start + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return both + ends


def _align(a: list, b: list, within: bool = False) -> list:
    """The expression that covers both nodes, which have one key. ``within`` a page the texts of both
    stand in the group, else those that both have."""
    texts, slot = {}, a[3] + b[3]
    for t in a[2] | b[2]:
        x, y = a[2].get(t), b[2].get(t)
        if x and y:
            texts[t] = [x[0] + y[0], sorted({*x[1], *y[1]})[:LEAST_PAGES]]
        elif within:
            texts[t] = x or y
        else:
            slot += (x or y)[0]
    if [c[0] for c in a[4]] == [c[0] for c in b[4]]:
        children = [_align(x, y, within) for x, y in zip(a[4], b[4])]
    else:
        children, i, j = [], 0, 0
        for x, y in [*_common_keys(a[4], b[4]), (len(a[4]), len(b[4]))]:
            for lone in a[4][i:x] + b[4][j:y]:
                lone[1] |= OPTIONAL
                if children and children[-1][0] == lone[0]:
                    children[-1] = _align(children[-1], lone, within)
                    children[-1][1] |= OPTIONAL | REPEATED
                else:
                    children.append(lone)
            if x < len(a[4]):
                children.append(_align(a[4][x], b[4][y], within))
            i, j = x + 1, y + 1
        children = _narrow(children)
    return [a[0], a[1] | b[1], texts, slot, children, max(a[5], b[5]) if within else a[5] + b[5]]


class Wrapper:
    """A host's expression with the digests of some distinct pages it was made from."""

    def __init__(self, root: list | None = None, pages: list[int] | None = None):
        self.root, self.pages = root, pages or []

    def add(self, other: Wrapper) -> None:
        self.root = other.root if self.root is None else _align(self.root, other.root) if other.root else self.root
        self.pages = sorted({*self.pages, *other.pages})[:LEAST_PAGES]

    def dump(self) -> str:
        return json.dumps([self.root, self.pages], separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))

    def expression(self) -> str:
        """As a readable regular expression of tags."""

        def show(node: list) -> str:
            inner = "".join(map(show, node[4]))
            own = ("#" if node[3] or len(node[2]) != 1 else repr(*node[2])) if node[0] == "#" else f"<{node[0]}>{inner}</>" if node[0] else inner
            return f"({own})" + {0: "", 1: "?", 2: "+", 3: "*"}[node[1]] if node[1] else own

        return show(self.root) if self.root else ""

    def rules(self) -> tuple[list[str], list[str], bool]:
        """The path of the content root, the constant texts (each after its path), and whether the
        wrapper is fit to choose the content root."""
        known = len(self.pages) >= LEAST_PAGES

        def slots(node: list) -> int:
            several = node[3] or len(node[2]) > 1
            texts = sum(n for n, pages in node[2].values() if (len(pages) < LEAST_PAGES if known else several))
            return node[3] + texts + sum(map(slots, node[4]))

        def split(node: list) -> list:
            """A node's children, the rare ones as one, named after the others."""
            inner = [c for c in node[4] if c[0] != "#"]
            rare = [c for c in inner if known and (c[5] < LEAST_PAGES or c[0] == REST)]
            if len(rare) < 2 and not any(c[0] == REST for c in rare):
                return inner
            often = [c for c in inner if not any(c is r for r in rare)]
            flags = OPTIONAL | max(c[1] & REPEATED for c in rare)
            return [*often, [" ".join([REST, *sorted({c[0] for c in often})]), flags, {}, sum(map(_whole, rare)), [], 0]]

        path: list[str] = []
        node = self.root
        while node and (inner := split(node)):
            best = max(inner, key=slots)
            if best[1] & REPEATED or slots(best) < MOST * slots(node) or not slots(best):
                break
            node = best
            path.append(node[0])
        fit = known and bool(path) and path[-1].partition(".")[0].partition("#")[0] not in ("html", "body")
        constants: list[str] = []

        def gather(node: list, at: tuple[str, ...]) -> None:
            constants.extend(" > ".join(at) + " = " + t for t, (_, pages) in node[2].items() if len(pages) >= LEAST_PAGES)
            for c in node[4]:
                gather(c, (*at, node[0]) if node[0] else at)

        if self.root and known:
            gather(self.root, ())
        return path, constants, fit and slots(node) >= DIFFERENT * _whole(self.root)


def _under(path: tuple[str, ...], content: list[str]) -> bool:
    """Whether a block's path leads into the content root; the rest of a node is what it doesn't name."""
    return len(path) >= len(content) and all(k == c or c[0] == REST and k not in c.split(" ") for k, c in zip(path, content))


def main_text(page: str, content: list[str], constants: frozenset[str], fit: bool = False) -> str:
    """The blocks of the page's main text, joined by newlines; ``fit`` as ``rules`` tells it."""
    blocks = parse(page)
    constant = {id(b) for b in blocks if constants and " > ".join(b.path[:DEPTH]) + " = " + _mark(b.text) in constants}
    inner = [b for b in blocks if _under(b.path, content)] if content else []
    if fit and inner:
        return "\n".join(b.text for b in inner if id(b) not in constant)
    kept = [b for b in blocks if b.place == 3 or id(b) not in constant]
    for place in (3, 2):
        if any(b.place == place for b in kept):
            return "\n".join(b.text for b in kept if b.place == place or b.place > place)
    if content:
        inner = [b for b in inner if id(b) not in constant]
        if inner:
            kept = inner
    elif any(b.place == 1 for b in kept):
        kept = [b for b in kept if b.place == 1]
    # Outside marked articles and content roots a block that is all links is a menu, unless it is a paragraph.
    return "\n".join(b.text for b in kept if b.links < 0.8 * len(b.text) or b.path and b.path[-1].partition(".")[0].partition("#")[0] in PARAGRAPHS)


def _shape(node: list) -> str:
    """The keys of a tree, in order and nested."""
    return f"{node[0]}({','.join(map(_shape, node[4]))})"


def _size(node: list) -> int:
    return 1 + sum(map(_size, node[4]))


def _fold(rows: DataFrame, bits: int) -> DataFrame:
    """Aligns the wrappers of each host whose numbers ``no`` have equal first ``bits`` (of ``BITS``), in
    the order of the numbers; wrappers of one number are of one shape. Rows of a group come one after
    another in sorted partitions. The groups' first bits are the new numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, same, whole = None, None, Wrapper(), Wrapper()

        def send(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "no", "wrapper"])

        def close() -> list[tuple]:
            whole.add(same)
            return [(*group, whole.dump())] if group else []

        for batch in batches:
            done: list[tuple] = []
            for host, part, no, wrapper in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (host, part) != group:
                    done += close()
                    group, number, same, whole = (host, part), no, Wrapper(), Wrapper()
                elif no != number:
                    whole.add(same)
                    number, same = no, Wrapper()
                same.add(Wrapper.load(wrapper))
            yield send(done)
        yield send(close())

    part = F.shiftright("no", BITS - bits) if bits else F.lit(0).cast("long")
    dealt = rows.select("host", part.alias("part"), "no", "wrapper").repartition("host", "part").sortWithinPartitions("host", "part", "no")
    out = dealt.mapInArrow(run, "host string, no long, wrapper string")
    return out.withColumn("no", F.shiftleft("no", BITS - bits)) if bits else out


#: Bits of a shape's number, and those that tell the groups of each step apart.
BITS, STEPS = 48, (12, 6, 0)
#: Nodes of wrappers that a task holds while it reads pages.
HELD_NODES = 100_000


def infer(pages: DataFrame, html: str = "html", host: str = "host") -> DataFrame:
    """``host`` and ``wrapper`` (JSON), from all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        found: dict[tuple[str, int], Wrapper] = {}
        nodes = 0

        def send() -> pa.RecordBatch:
            columns = [[h for h, _ in found], [n for _, n in found], [w.dump() for w in found.values()]]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["host", "no", "wrapper"])

        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page:
                    digest = xxhash.xxh3_64_intdigest(page) >> 1
                    tree = _page_tree(parse(page), digest)
                    key = h, xxhash.xxh3_64_intdigest(_shape(tree)) >> (64 - BITS)
                    if key not in found:
                        nodes += _size(tree)
                    found.setdefault(key, Wrapper()).add(Wrapper(tree, [digest]))
            if nodes > HELD_NODES:
                yield send()
                nodes = 0
        yield send()

    out = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, no long, wrapper string")
    for bits in STEPS:
        out = _fold(out, bits)
    return out.select("host", "wrapper")


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars`` of every page."""
    spark = pages.sparkSession
    bound_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [json.dumps(Wrapper.load(w).rules()) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], ["host", "rules"])

    hosts = materialize(infer(rows).mapInArrow(decide, "host string, rules string"), "host-rules")
    size = hosts.agg(F.coalesce(F.sum(F.length("host") + F.length("rules") + 40), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        hosts = F.broadcast(hosts)
    joined = rows.join(hosts, "host", "left").select("key", "url", "html", "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[str], frozenset[str], bool]] = {}
        for batch in batches:
            texts = []
            for page, rules in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if rules not in known:
                    if len(known) > 5000:
                        known.clear()
                    content, constants, fit = json.loads(rules) if rules else ([], [], False)
                    known[rules] = content, frozenset(constants), fit
                texts.append(main_text(page, *known[rules]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
