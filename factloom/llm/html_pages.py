"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a tree; neighbouring siblings of one kind (tag, class, id) fold into one node. Trees of a host are aligned by
simple tree matching into one wrapper per host: text that a slot shows on nearly every page that has the slot is template, a slot whose
text varies is content. Pages count once per host and content, so copies show no template. Regions that by name are no article (menus, headers, footers, adverts, ...) are left out as well.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import BROADCAST_BYTES, small_batches, stored

LEAST_PAGES = 3  # pages of different content that must have a slot before a text of it counts as template
SHARE = 0.9  # part of the pages with a slot that must show the same text there
SPREAD = 0.1  # part of the pages of the host that must have the slot
TEXTS = 16  # texts counted per slot
ARTICLE = 1 / 3  # part of a page's text that one <article> or <main> must hold to stand for it, on hosts of fewer pages than LEAST_PAGES
HOSTS_HELD = 1_000  # partial wrappers that a task holds before it passes them on
SALTS = 32  # parts in which the partial wrappers of one host are first merged
NODES = 256  # slots of a wrapper above which those on few of the pages since they first came up are left out
RARE = SPREAD / 5  # that part of the pages

# Elements by their role in HTML, and names by which pages mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg math object".split())
FOREIGN = frozenset("svg math object".split())  # RAW elements that may close themselves, and whose missing end tag hides nothing
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ASIDE_TAGS = frozenset("nav footer aside form head script style noscript template iframe svg math object button select dialog menu textarea input".split())
ASIDE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer bottombar colophon
    sidebar aside widget widgets related recommended trending cookie cookies consent gdpr notice notices notification alert popup modal overlay
    newsletter subscribe subscription signup login search share sharing social comment comments commentlist disqus respond reply replies
    skip tags copyright legal disclaimer""".split())
# Words that say nothing beside such a name, words of an article, beside which only the names that follow say no article, and words that turn a name round.
NEUTRAL = frozenset("site main list area box container posts item items wrapper wrap primary secondary inner outer user users block panel row column left right global".split())
OF_ARTICLE = frozenset("article post entry story".split())
BESIDE_ARTICLE = ASIDE_NAMES - frozenset("header footer tags search legal copyright disclaimer notice notices skip banner alert".split())
TURNED = frozenset("has with no without not".split())
SECTIONS = frozenset("article main section".split())  # a <header> inside one of them is its heading, any other the page's
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
KEPT_TAGS = frozenset("html body article main".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _names_aside(token: str) -> bool:
    """Whether a class or id says no article: ``cookie-notice`` and ``related-posts`` do, ``has-sidebar``, ``search-result`` and ``post-tags`` do not."""
    names = {n.lower() for n in _NAME.findall(token)}
    marks = names & (BESIDE_ARTICLE if names & OF_ARTICLE else ASIDE_NAMES)
    return bool(marks) and not names & TURNED and names <= marks | NEUTRAL | OF_ARTICLE


class Node:
    """An element: tag, kind (tag with class and id), whether it is marked as no article, and what it contains."""

    __slots__ = ("aside", "content", "kind", "tag", "template")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kind, self.aside, self.template, self.content = tag, tag, tag in ASIDE_TAGS, False, []
        if attributes.strip():
            found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            named = f"{found.get('class', '')} {found.get('id', '')}"
            names = [n.lower() for n in _NAME.findall(named)]
            if names and tag not in KEPT_TAGS:
                self.kind = f"{tag}.{'.'.join(dict.fromkeys(names))}"
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if tag not in KEPT_TAGS:
                self.aside |= any(_names_aside(token) for token in named.split()) or found.get("role", "").lower() in ASIDE_ROLES or hidden

    def children(self) -> Iterator[Node]:
        return (c for c in self.content if isinstance(c, Node))

    def find(self, tags: frozenset) -> Iterator[Node]:
        """Outermost elements of these tags outside of what is marked as no article."""
        todo = [self]
        while todo:
            node = todo.pop()
            if node.aside:
                continue
            if node.tag in tags:
                yield node
            else:
                todo += reversed([*node.children()])


def parse(page: str) -> Node:
    """Tree of a page; missing and unmatched end tags are settled as browsers do for the common elements."""
    root = Node("#page")
    stack, at = [root], 0
    for_text = root.content
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            tail = page[at:]
            if tail:
                for_text.append(tail)
            return root
        if found.start() > at:
            for_text.append(page[at:found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag == tag:
                    del stack[place:]
                    break
        else:
            _close_implied(stack, tag)
            node = Node(tag, found[3])
            if tag == "header" and not any(above.tag in SECTIONS for above in stack):
                node.aside = True
            stack[-1].content.append(node)
            closed = found[3].rstrip().endswith("/")
            if tag in RAW:
                if closed and tag in FOREIGN:
                    for_text = stack[-1].content
                    continue
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else at if tag in FOREIGN else len(page)
            elif tag not in VOID and not closed:
                stack.append(node)
        for_text = stack[-1].content


def _close_implied(stack: list[Node], tag: str) -> None:
    ends = CLOSES.get(tag)
    if ends:
        for place in range(len(stack) - 1, 0, -1):
            if stack[place].tag in SCOPES[tag]:
                break
            if stack[place].tag in ends:
                del stack[place:]
                break
    if tag in BLOCKS:
        for place in range(len(stack) - 1, 0, -1):
            if stack[place].tag == "p":
                del stack[place:]
                break
            if stack[place].tag in BLOCKS or stack[place].tag in ("td", "th", "button"):
                break


# ---------------------------------------------------------------- wrappers
# A wrapper node is [kind, pages, texts, pages whose text is not counted, children, pages before it first came up (0 if left out)], with
# texts as a list of [hash, pages], or 0 where no page has text; a page is a wrapper of one page. Texts that are no article are not in it. Trees may be as deep as pages
# like: all walks have stacks of their own, and what is stored is flat.


def folded(node: Node, members: list | None = None) -> list:
    """Page tree without what is marked as no article, as a wrapper of one page; siblings of one kind side by side are one slot.

    ``members`` gets (slot, elements) pairs, for taking decisions about slots back to the page.
    """
    top = _slot([node])
    todo = [(top, [node])]
    while todo:
        slot, nodes = todo.pop()
        if members is not None:
            members.append((slot, nodes))
        for group in _groups(nodes):
            child = _slot(group)
            slot[4].append(child)
            todo.append((child, group))
    return top


def _slot(nodes: list[Node]) -> list:
    own = [c for node in nodes for c in node.content if isinstance(c, str)]
    text = _SPACE.sub(" ", html.unescape(" ".join(own))).strip()
    return [nodes[0].kind, 1, [[xxhash.xxh64_intdigest(text.encode("utf-8", "replace")), 1]] if text else 0, 0, []]


def _groups(nodes: list[Node]) -> list[list[Node]]:
    groups: list[list[Node]] = []
    for node in nodes:
        for c in node.children():
            if c.aside:
                continue
            if groups and groups[-1][0].kind == c.kind:
                groups[-1].append(c)
            else:
                groups.append([c])
    # Kinds that alternate beneath several folded siblings would make long lists: each kind is one slot per run of siblings.
    if len(nodes) > 1:
        by_kind: dict[str, list[Node]] = {}
        for group in groups:
            by_kind.setdefault(group[0].kind, []).extend(group)
        groups = list(by_kind.values())
    return groups


def alignments(left: list, right: list) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching of two trees of equal root: per pair of slots (by ``id``) that can meet, see ``alignment``."""
    found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(left, right, None)]
    while todo:
        one, two, same = todo.pop()
        if same is None:
            places: dict[str, list[int]] = {}
            for j, slot in enumerate(two[4]):
                places.setdefault(slot[0], []).append(j)
            same = [(i, j) for i, slot in enumerate(one[4]) for j in places.get(slot[0], ())]
            todo.append((one, two, same))
            todo += [(one[4][i], two[4][j], None) for i, j in same]
        else:
            score = {(i, j): found[id(one[4][i]), id(two[4][j])][0] for i, j in same}
            found[id(one), id(two)] = _aligned(len(one[4]), len(two[4]), score)
    return found


def _aligned(m: int, n: int, score: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    pairs = sorted(score)
    if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])):
        return sum(score.values()) + 1, pairs  # no two pairs compete
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + score.get((i, j), 0))
    pairs, i, j = [], m, n
    while i and j:
        if (i - 1, j - 1) in score and best[i][j] == best[i - 1][j - 1] + score[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, pairs[::-1]


def alignment(left: list, right: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: largest number of matched nodes of two trees, and the matched places among their children."""
    return alignments(left, right)[id(left), id(right)] if left[0] == right[0] else (0, [])


def merged(left: list, right: list) -> list:
    """One wrapper out of two with equal root: matched nodes are counted together, the others stay in their place."""
    found = alignments(left, right)
    top = _joined(left, right)
    todo = [(left, right, top)]
    while todo:
        one, two, whole = todo.pop()
        kids, i, j = whole[4], 0, 0
        for p, q in found[id(one), id(two)][1]:
            kids += one[4][i:p] + _later(two[4][j:q], left[1])
            kids.append(_joined(one[4][p], two[4][q]))
            todo.append((one[4][p], two[4][q], kids[-1]))
            i, j = p + 1, q + 1
        kids += one[4][i:] + _later(two[4][j:], left[1])
    return top


def _since(slot: list) -> int:
    return slot[5] if len(slot) > 5 else 0


def _later(slots: list[list], pages: int) -> list[list]:
    """The same subtrees, come up after so many more pages."""
    out = [[*s[:5], _since(s) + pages] for s in slots]
    todo = [*out]
    while todo:
        slot = todo.pop()
        slot[4] = [[*s[:5], _since(s) + pages] for s in slot[4]]
        todo += slot[4]
    return out


def pruned(tree: list) -> list:
    """The tree without slots that were on less than ``RARE`` of the pages since they first came up.

    None of them can be template as they stand; what is left is bounded by the size of pages, not by their number, and the pages
    that a slot on ``SPREAD`` of them loses by this are fewer than ``RARE`` of all.
    """
    top = [*tree[:5], _since(tree)]
    todo = [top]
    while todo:
        slot = todo.pop()
        slot[4] = [[*s[:5], _since(s)] for s in slot[4] if s[1] >= RARE * (tree[1] - _since(s))]
        todo += slot[4]
    return top


def _joined(left: list, right: list) -> list:
    if not left[2] or not right[2]:
        return [left[0], left[1] + right[1], left[2] or right[2], left[3] + right[3], [], _since(left)]
    texts = dict(left[2])
    for text, n in right[2]:
        texts[text] = texts.get(text, 0) + n
    lost = 0
    if len(texts) > TEXTS:
        # Misra-Gries: what is taken off all counters is at most a seventeenth of the pages, and none of a text that is on all.
        lost = sorted(texts.values())[-TEXTS - 1]
        texts = {t: n - lost for t, n in texts.items() if n > lost}
    return [left[0], left[1] + right[1], sorted(map(list, texts.items())), left[3] + right[3] + lost, [], _since(left)]


def flat(tree: list) -> list:
    """The nodes of a tree, parents first, with the number of children in place of the children."""
    out, todo = [], [tree]
    while todo:
        slot = todo.pop()
        out.append([*slot[:4], len(slot[4]), _since(slot)])
        todo += reversed(slot[4])
    return out


def nested(nodes: list) -> list:
    """The tree of ``flat`` nodes."""
    todo: list = []
    for *slot, count, since in reversed(nodes):
        todo.append([*slot, [todo.pop() for _ in range(count)], since])
    return todo[0]


def content_digest(tree: list) -> int:
    """Hash of the texts of a one-page wrapper: what makes it another page, whatever its adverts, menus and class names are."""
    return xxhash.xxh64_intdigest(json.dumps([slot[2][0][0] for slot in flat(tree) if slot[2]]))


class Wrapper:
    """The wrapper of a host: aligned tree of its pages of different content."""

    def __init__(self, tree: list):
        self.tree = tree

    def add(self, other: Wrapper) -> Wrapper:
        tree = merged(self.tree, other.tree)
        return Wrapper(pruned(tree) if len(flat(tree)) > NODES else tree)

    def dump(self) -> str:
        return json.dumps(flat(self.tree))

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(nested(json.loads(text)))

    def template_of(self, slot: list) -> int | None:
        """Hash of the text that nearly all pages with the slot show in it; none where too few pages have the slot."""
        if not slot[2] or slot[1] < self.least():
            return None
        text, n = max(slot[2], key=lambda t: t[1])
        return text if n + slot[3] >= SHARE * slot[1] else None

    def decided(self) -> Wrapper:
        """The same wrapper with nothing but the template text of each slot, without slots on too few pages: small, as what is sent about should be."""
        top = [*self.tree[:5]]
        todo = [top]
        while todo:
            slot = todo.pop()
            text = self.template_of(slot)
            slot[2], slot[3] = [[text, slot[1]]] if text is not None else 0, 0
            slot[4] = [[*s[:5]] for s in slot[4] if s[1] >= self.least()]
            todo += slot[4]
        return Wrapper(top)

    def least(self) -> float:
        """Pages that have to have a slot for a text of it to be template."""
        return max(LEAST_PAGES, SPREAD * self.tree[1])

    def mark(self, page: Node) -> None:
        """Mark the elements of a page whose text is the template text of their slot."""
        members: list = []
        tree = folded(page, members)
        of = {id(slot): nodes for slot, nodes in members}
        found = alignments(self.tree, tree)
        todo = [(self.tree, tree)]
        while todo:
            slot, own = todo.pop()
            if own[2] and own[2][0][0] == self.template_of(slot):
                for node in of[id(own)]:
                    node.template = True
            todo += [(slot[4][p], own[4][q]) for p, q in found[id(slot), id(own)][1]]


# ---------------------------------------------------------------- text


def _blocks(top: Node, out: list[list[str]]) -> None:
    todo: list = [top]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out[-1].append(at)
        elif at is None:
            out.append([])
        else:
            if at is not top and at.tag in ("br", "td", "th"):
                out[-1].append(" ")
                todo.append(" ")
            if at.aside:
                continue
            if at.tag in BLOCKS:
                out.append([])
                todo.append(None)
            todo += [c for c in reversed(at.content) if not (at.template and isinstance(c, str))]


def block_texts(node: Node) -> list[str]:
    out: list[list[str]] = [[]]
    _blocks(node, out)
    found = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in out)
    return [b for b in found if b]


def main_text(page: str | None, wrapper: Wrapper | None) -> str:
    """Blocks of the article: all text in varying slots of the wrapper.

    Where the host has too few different pages for that, ``<article>`` or else ``<main>`` elements decide, if the largest of them holds
    a good part of the text; otherwise all text that is not marked as no article.
    """
    if not page:
        return ""
    root = parse(page)
    if wrapper is not None and wrapper.tree[1] >= LEAST_PAGES:
        wrapper.mark(root)
        return "\n".join(block_texts(root))
    whole = block_texts(root)
    size = sum(map(len, whole))
    for tags in (frozenset(["article"]), frozenset(["main"])):
        found = [block_texts(node) for node in root.find(tags)]
        largest = max((sum(map(len, blocks)) for blocks in found), default=0)
        if largest and largest >= ARTICLE * size:
            return "\n".join(b for blocks in found for b in blocks)
    return "\n".join(whole)


# ---------------------------------------------------------------- operator


def host_of(url):
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` from all of ``pages(url, html)``.

    Pages become small trees of hashes, of which one per host and content stays. Tasks fold the trees they read into one
    partial wrapper per host; partial wrappers are first merged in ``SALTS`` parts per host, then per host.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, found = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                if text := page.as_py():
                    tree = folded(parse(text))
                    hosts.append(host)
                    digests.append(content_digest(tree) - (1 << 63))
                    found.append(Wrapper(tree).dump())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(found, pa.string())],
                                             names=["host", "content", "wrapper"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        number = TaskContext.get().partitionId()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([number % SALTS] * len(held), pa.int32()),
                                              pa.array([w.dump() for w in held.values()], pa.string())], names=["host", "salt", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for host, tree in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                own = Wrapper.load(tree)
                held[host] = held[host].add(own) if host in held else own
                if len(held) >= HOSTS_HELD:
                    yield passed_on()
        yield passed_on()

    def merge(group: pa.Table) -> pa.Table:
        whole = None
        for text in group.column("wrapper").to_pylist():
            own = Wrapper.load(text)
            whole = own if whole is None else whole.add(own)
        return group.slice(0, 1).set_column(group.column_names.index("wrapper"), "wrapper", pa.array([whole.dump()]))

    def last(group: pa.Table) -> pa.Table:
        whole = merge(group)
        decided = Wrapper.load(whole.column("wrapper")[0].as_py()).decided()
        return whole.set_column(whole.column_names.index("wrapper"), "wrapper", pa.array([decided.dump()]))

    read = small_batches(pages.select(host_of(F.col("url")).alias("host"), "html")).mapInArrow(trees, "host string, content long, wrapper string")
    different = read.groupBy("host", "content").agg(F.min("wrapper").alias("wrapper")).select("host", "wrapper")
    parts = different.mapInArrow(partial, "host string, salt int, wrapper string")
    salted = parts.groupBy("host", "salt").applyInArrow(merge, "host string, salt int, wrapper string")
    return salted.groupBy("host").applyInArrow(last, "host string, salt int, wrapper string").select("host", "wrapper")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    White space inside a block becomes one space, blocks follow each other by one line feed. Null or empty html, and
    pages without an article, have an empty text; pages without a host share the wrapper of the empty host. Repeated rows
    are extracted each and count as one page in the wrapper.
    """
    wrappers = stored(induce_wrappers(pages), "wrappers")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"))
    if (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        rows = rows.withColumn("_wrapper", F.lit(None).cast("string"))
    else:
        known = None
        rows = rows.join(wrappers.withColumnsRenamed({"host": "_of", "wrapper": "_wrapper"}), F.col("_host") == F.col("_of"), "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Wrapper] = {}

        def wrapper(host: str, text: str | None) -> Wrapper | None:
            if host not in loaded:
                text = known.value.get(host) if known else text
                if len(loaded) >= HOSTS_HELD:
                    loaded.clear()
                loaded[host] = Wrapper.load(text) if text is not None else None
            return loaded[host]

        for batch in batches:
            found = [main_text(page.as_py(), wrapper(host, text)) for page, host, text in
                     zip(batch.column("html"), batch.column("_host").to_pylist(), batch.column("_wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                                              pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "_host", "_wrapper").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
