"""Main text of web pages by wrapper induction.

1. Every page is parsed to a tree of its block elements, like siblings folded into one
   node.  Its text pieces name the node (slot) they stand in.
2. Pages of one host are brought together by the shape of their trees; per slot only
   sums are kept: pages, text length, length inside links, least and greatest text
   hash (equal if the text is the same on all pages).
3. Within a host the shapes are aligned by simple tree matching into templates.  Slots
   that meet in one template node share their sums: a node with the same text on
   all pages is template, one with varying text is a slot for content.
4. Of the varying slots those inside the article are kept, unless their place says that
   they are something else (menus, adverts, forms, comments and the like).  Hosts
   without an article element keep what is varying and not mostly links.

A host with very many shapes is split, so that a bounded number of shapes is aligned
at once; pages themselves are never brought together.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ratingloom.session import stage

#: Shapes that are aligned at once, about.
SHAPES = 512
#: Nodes deeper than this are folded into their ancestor, unless they turn article to something else or back.
DEPTH = 40
#: Pages that a host must have before a constant slot inside an article is taken for template.
CONSTANT_PAGES = 5
#: Share of equal nodes from which a shape joins a template.
ALIKE = 0.6

# Fixed values of the HTML language.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What places that hold no article text are called.
_NEVER_TAGS = set(
    "script style noscript template title head nav aside form button select option textarea input iframe svg canvas object "
    "dialog menu footer audio video math datalist fieldset".split()
)
_NEVER_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NEVER_WORDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|footer\w*|"
    r"masthead|site-?header|page-?header|top-?bar|cookie\w*|consent|gdpr|notice\w*|alerts?|pop-?up\w*|modal\w*|overlay|"
    r"newsletter\w*|subscri\w*|sign-?up|share\w*|sharing|social\w*|related\w*|recommend\w*|read-?more|comments?|comment-?\w*|"
    r"disqus|repl(?:y|ies)|discussion|respond|widget\w*|pagination|pager|toolbar|log-?in|search\w*|skip-?link|hidden|"
    r"visually-?hidden|sr-?only|outbrain|taboola|tag-?cloud)"
)
# Elements that a class or id never makes such a place, words of states and topics, and words that follow the naming one.
_WHOLE_TAGS = {"html", "body", "main", "article"}
_STATE_FIRST = set("has with without no not is tag tags category categories cat topic format status type".split())
_STATE_LAST = set("open opened closed enabled disabled active inactive visible on off collapsed expanded fixed sticky".split())
_HOLDERS = set(
    "list lists item items box boxes bar bars area areas wrap wrapper container block blocks section link links icon icons "
    "button buttons btn form inner outer left right top bottom primary secondary main row column col group content panel region "
    "zone slot unit cta title heading label text body author avatar meta count copyright law policy message posts articles "
    "stories news video videos toggle desktop mobile".split()
)
_MAIN_WORDS = re.compile(
    r"(?<![a-z])(?:article-?(?:body|content|text)|post-?(?:body|content|text)|entry-?(?:content|body)|story-?(?:body|content)|"
    r"main-?(?:content|text)|page-?content|body-?(?:text|copy)|content|post|entry|story|article)(?![a-z])"
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"[0-9]+")
_TELLING = ("class", "id", "role", "itemprop")


def _label(tag: str, attributes: str) -> str:
    """A node's tag with those attributes that tell what it is for; digits do not count."""
    if not attributes or not attributes.strip(" /"):
        return tag
    told = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = next((v for v in values if v), "")
        if name in _TELLING:
            told += [f"{name}={t}" for t in _DIGITS.sub("0", html.unescape(value).lower()).split()]
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            told.append("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            told.append("hidden")
    return " ".join([tag, *sorted(told)]).replace("(", "").replace(")", "").replace(",", "")


@dataclass
class Node:
    """A node of a shape, or of a template."""

    label: str
    slot: int = -1
    children: list[Node] = field(default_factory=list)

    def text(self) -> str:
        return self.label + ("(" + ",".join(c.text() for c in self.children) + ")" if self.children else "")

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def read_shape(text: str) -> Node:
    """The tree that :meth:`Node.text` wrote, slots numbered in its order."""
    root = Node("", 0)
    stack, node, slots = [], root, 0
    for piece in re.finditer(r"([^(),]*)([(),]|\Z)", text):
        if piece[1]:
            node.label = piece[1]
        if piece[2] == "(":
            stack.append(node)
            slots += 1
            node = Node("", slots)
            stack[-1].children.append(node)
        elif piece[2] == ",":
            slots += 1
            node = Node("", slots)
            stack[-1].children.append(node)
        elif piece[2] == ")":
            node = stack.pop()
    return root


def parse(page: str) -> tuple[Node, list[tuple[Node, bool, str]]]:
    """A page's tree, and its text pieces: node, whether inside a link, text with white space as single spaces.

    A piece that begins a block begins with a space.
    """
    root = Node("html")
    open_: list[tuple[str, Node]] = [("html", root)]
    pieces: list[tuple[Node, bool, str]] = []
    links, fresh = 0, True

    def said(text: str) -> None:
        nonlocal fresh
        if not text:
            return
        text = html.unescape(text)
        words = text.split()
        if not words:
            if not fresh and pieces:
                node, link, before = pieces[-1]
                pieces[-1] = (node, link, before + " ")
            return
        body = " ".join(words)
        if fresh or text[0].isspace():
            body = " " + body
        if text[-1].isspace():
            body += " "
        pieces.append((open_[-1][1], links > 0, body))
        fresh = False

    def close(count: int) -> None:
        nonlocal links, fresh
        for tag, _ in open_[count:]:
            links -= tag == "a"
            fresh |= tag not in _INLINE
        del open_[count:]

    position = 0
    while True:
        token = _TOKEN.search(page, position)
        if token is None:
            said(page[position:])
            break
        said(page[position : token.start()])
        position = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    close(k)
                    break
                if open_[k][0] in ("table", "article", "body") and tag in _INLINE:
                    break
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in open_):
            continue
        if tag == "br" or tag == "hr":
            fresh = True
        if tag in _VOID:
            continue
        if tag in _RAW:
            # Their content is not markup, and none of it is text of the page.
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, position)
            if end is None:
                break
            stop = page.find(">", end.end())
            position = len(page) if stop < 0 else stop + 1
            continue
        if tag in _ENDS_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] not in _INLINE:
                    break
        elif tag in _ENDS:
            ended, within = _ENDS[tag]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in within:
                    break
                if open_[k][0] in ended:
                    close(k)
                    if tag != "tr":
                        break
        parent = open_[-1][1]
        label = _label(tag, token[3] or token[6] or "")
        if tag in _INLINE and label == tag or len(open_) > DEPTH and not _turns(label, parent.label):
            node = parent  # says nothing about the place
        else:
            node = next((c for c in parent.children if c.label == label), None)
            if node is None:
                node = Node(label)
                parent.children.append(node)
        links += tag == "a"
        fresh |= tag not in _INLINE
        open_.append((tag, node))
    return root, pieces


def _number(root: Node) -> None:
    """Number the slots in the order in which :func:`read_shape` does."""
    stack, slot = [root], 0
    while stack:
        node = stack.pop()
        node.slot = slot
        slot += 1
        stack.extend(reversed(node.children))


def match(one: Node, two: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the number of matched nodes, and the pairs."""
    if one.label != two.label:
        return 0, []
    rows, columns = len(one.children), len(two.children)
    inner = [[match(a, b) for b in two.children] for a in one.children]
    best = np.zeros((rows + 1, columns + 1), int)
    for i in range(rows):
        for j in range(columns):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + inner[i][j][0])
    pairs, i, j = [(one, two)], rows, columns
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            pairs += inner[i - 1][j - 1][1]
            i, j = i - 1, j - 1
    return 1 + int(best[rows, columns]), pairs


@dataclass
class _Sums:
    pages: int = 0
    chars: int = 0
    linked: int = 0
    least: int = 2**63 - 1
    most: int = -(2**63)

    def add(self, pages: int, chars: int, linked: int, least: int, most: int) -> None:
        self.pages += pages
        self.chars += chars
        self.linked += linked
        self.least, self.most = min(self.least, least), max(self.most, most)

    @property
    def constant(self) -> bool:
        return self.least == self.most


def _grow(template: Node, shape: Node, place: dict[int, Node]) -> None:
    """Match a shape into a template; what does not match becomes new nodes."""
    for known, node in match(template, shape)[1]:
        place[node.slot] = known
    stack = [shape]
    while stack:
        node = stack.pop()
        for child in node.children:
            if child.slot not in place:
                place[child.slot] = Node(child.label)
                place[node.slot].children.append(place[child.slot])
            stack.append(child)


def _names_other(value: str) -> bool:
    """Whether a class or id, as a whole or by its head noun, names a place that holds no article text."""
    if _NEVER_WORDS.fullmatch(value):
        return True
    parts = [p for p in (p.strip("0") for p in re.split("[^a-z0-9]+", value)) if len(p) > 1]
    if not parts or parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST:
        return False
    while len(parts) > 1 and parts[-1] in _HOLDERS:
        parts.pop()
    return any(_NEVER_WORDS.fullmatch("-".join(parts[k:])) for k in range(max(0, len(parts) - 2), len(parts)))


def _avoided(label: str, by_name: bool = True) -> bool:
    tag, *told = label.split(" ")
    if tag in _NEVER_TAGS or "hidden" in told:
        return True
    for t in told:
        name, _, value = t.partition("=")
        if name == "role" and value in _NEVER_ROLES:
            return True
        if by_name and name in ("class", "id") and tag not in _WHOLE_TAGS and _names_other(value):
            return True
        if name == "itemprop" and value in ("comment", "comments"):
            return True
    return False


def _rank(label: str) -> int:
    """How surely a node is the article: 3 by its element, 2 by its role, 1 by its name."""
    tag, *told = label.split(" ")
    if tag == "article" or "itemprop=articlebody" in told:
        return 3
    if tag == "main" or "role=main" in told or "role=article" in told:
        return 2
    return int(any(t.split("=")[0] in ("class", "id") and _MAIN_WORDS.fullmatch(t.partition("=")[2]) is not None for t in told))


def _turns(label: str, above: str) -> bool:
    """Whether a node is kept however deep: nothing below an avoided place, else an avoided one or a surer article."""
    if _avoided(above):
        return False
    return _avoided(label) or _rank(label) > _rank(above)


def _wraps_article(node: Node) -> bool:
    """Whether a form is one that some servers put around the whole page."""
    below = list(node.children) if node.label.split(" ")[0] == "form" else []
    while below:
        child = below.pop()
        if not _avoided(child.label):
            if _rank(child.label) >= 2:
                return True
            below.extend(child.children)
    return False


def _holds_article(node: Node) -> bool:
    """Whether an article element outside avoided places lies below a node."""
    below = list(node.children)
    while below:
        child = below.pop()
        if not _avoided(child.label):
            if _rank(child.label) == 3:
                return True
            below.extend(child.children)
    return False


def content_nodes(template: Node, sums: dict[int, _Sums], pages: int) -> set[int]:
    """The identities of a template's nodes whose text is content.

    If that leaves none, the names of places around an article are not heeded.
    """
    return _content(template, sums, pages, False) or _content(template, sums, pages, True)


def _content(template: Node, sums: dict[int, _Sums], pages: int, around: bool) -> set[int]:
    own: list[tuple[Node, int]] = []  # nodes outside avoided places, with the best rank above or at them
    stack = [(template, 0)]
    while stack:
        node, rank = stack.pop()
        if node is not template and _avoided(node.label) and not _wraps_article(node):
            if not around or _avoided(node.label, by_name=False) or not _holds_article(node):
                continue
        tag = node.label.split(" ")[0]
        # A page's header is no content, an article's is.
        if tag == "header" and rank == 0:
            continue
        rank = max(rank, _rank(node.label))
        own.append((node, rank))
        stack.extend((c, rank) for c in node.children)
    filled = [(n, r) for n, r in own if sums.get(id(n), _Sums()).chars]
    best = max((r for _, r in filled), default=0)
    inside = [n for n, r in filled if r == best]
    varying = [n for n in inside if not sums[id(n)].constant]
    kept = set()
    for node in inside:
        s = sums[id(node)]
        # With few pages, or pages that are all alike, nothing can be told from constancy.
        if s.constant and varying and pages >= (CONSTANT_PAGES if best else 2) and s.pages >= pages * (0.5 if best else 0.8):
            continue
        if best == 0 and s.linked > 0.5 * s.chars:
            continue
        kept.add(id(node))
    return kept


def _induced(group: pd.DataFrame) -> pd.DataFrame:
    """``host, shape_id, kept``: the slots of every shape that hold content."""
    group = group.sort_values(["pages", "shape"], ascending=[False, True], kind="stable")
    templates: list[dict] = []
    placed: list[tuple[dict, dict[int, Node]]] = []
    for shape, pages, slots in zip(group["shape"], group["pages"], group["slots"]):
        tree = read_shape(shape)
        size = tree.size()
        scores = [2 * match(t["tree"], tree)[0] / (t["size"] + size) for t in templates]
        place: dict[int, Node] = {}
        if scores and max(scores) >= ALIKE:
            template = templates[int(np.argmax(scores))]
        else:
            template = {"tree": Node(tree.label), "sums": {}, "pages": 0, "size": 0}
            templates.append(template)
        _grow(template["tree"], tree, place)
        template["size"] = template["tree"].size()
        template["pages"] += int(pages)
        for s in slots:
            sums = template["sums"].setdefault(id(place[s["slot"]]), _Sums())
            sums.add(s["pages"], s["chars"], s["linked"], s["least"], s["most"])
        placed.append((template, place))
    for template in templates:
        template["kept"] = content_nodes(template["tree"], template["sums"], template["pages"])
    kept = [[slot for slot, node in sorted(place.items()) if id(node) in t["kept"]] for t, place in placed]
    return pd.DataFrame({"host": group["host"], "shape_id": group["shape_id"], "kept": kept})


_PARSED = "shape string, shape_id long, pieces array<struct<slot:int,text:string>>, sums array<struct<slot:int,chars:long,linked:long,hash:long>>"


def _parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host`` with each page's shape, text pieces and sums per slot."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    chosen = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = chosen.drop("html").schema
    for extra in _parse_datatype_string(_PARSED):
        schema = schema.add(extra)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for page in batch.column(3).to_pylist():
                root, pieces = parse(page)
                _number(root)
                text = root.text()
                slots: dict[int, list] = {}
                for node, link, body in pieces:
                    s = slots.setdefault(node.slot, [0, 0, xxhash.xxh64()])
                    s[0] += len(body)
                    s[1] += len(body) * link
                    s[2].update(body.encode("utf-8", "surrogatepass"))
                sums = [{"slot": k, "chars": c, "linked": n, "hash": h.intdigest() - 2**63} for k, (c, n, h) in slots.items()]
                for column, value in zip(columns, (
                    text, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63,
                    [{"slot": node.slot, "text": body} for node, _, body in pieces], sums,
                )):
                    column.append(value)
            new = [pa.array(c, shape.field(3 + k).type) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *new], schema=shape)

    return chosen.mapInArrow(run, schema)


def main_text(pages: DataFrame, shapes: int = SHAPES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null html is an empty page with an empty text.  Pages without a host share one.
    Repeated rows each get their text; a host with one page, or with pages that are all
    alike, is judged by its elements alone.  Broken markup is read as far as it goes.  An
    empty table gives no rows.  Other columns are ignored.
    """
    parsed = stage(_parsed(pages), "pages-parsed")
    slots = parsed.select("host", "shape_id", F.explode("sums").alias("s")).groupBy("host", "shape_id", "s.slot").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("s.chars").alias("chars"), F.sum("s.linked").alias("linked"),
        F.min("s.hash").alias("least"), F.max("s.hash").alias("most"),
    )
    slots = slots.groupBy("host", "shape_id").agg(
        F.collect_list(F.struct("slot", "pages", "chars", "linked", "least", "most")).alias("slots")
    )
    found = parsed.groupBy("host", "shape_id").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("pages"))
    per_host = found.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / shapes).alias("parts"))
    found = found.join(slots, ["host", "shape_id"]).join(per_host, "host")
    found = found.withColumn("part", F.pmod("shape_id", "parts"))
    wrappers = found.groupBy("host", "part").applyInPandas(
        _induced, "host string, shape_id long, kept array<int>"
    )
    judged = parsed.select("page_id", "url", "host", "shape_id", "pieces").join(stage(wrappers, "pages-wrappers"), ["host", "shape_id"], "left")
    kept = F.filter("pieces", lambda p: F.array_contains("kept", p["slot"]))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["text"]), ""), " +", " "))
    return judged.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
