"""HTML extraction by composite text density (Sun, Song and Liao, DOM Based Content Extraction via Text Density, 2011).

A page becomes a tree. For every node: characters for each tag, adjusted by how much of the text is links. A node's
density sum adds its children's densities; the node with the largest sum is the heart of the article. Going up from
it to the body, the least density on the way is the threshold: what lies below it is not content, and within each
node at or above it the subtree of largest density sum is taken, or what encloses it: the article, the main part that
holds this article only, or the common parent of dense siblings. Elements of a line (b, span, ...) are no subtrees of
their own: a sum reaches through them to the blocks inside. A page's only article, else the part of its title, is where the
heart is looked for; the title and what stands between it and the heart belong to the article.

What is never article (scripts, styles, menus, forms, adverts, reader comments and so on) leaves the tree before densities are
computed: by element, and for containers by a name (class, id or role) that says nothing else. Reader comments are also known by their
heading or by their form: like parts, each with an author or a time. Elements of a line stay, whatever their names, but for adverts;
so do paragraphs but for adverts and notices.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import slices, spare

#: Elements without text of the article.
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video map menu dialog datalist".split())
#: Elements whose content is characters up to their end tag.
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are part of a line: they count as tags, but a block's text isn't divided by them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags that reach no further than the block around.
NEAR = frozenset("p b i a span em strong".split())
#: An open element of the first kind ends where one of the others starts.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
#: Elements that the search for one to close doesn't leave.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

#: A name is unwanted if it is one of these words, alone or between words that only say where or in what form.
ADVERT = "ads? adverts? advertisements? advertising adsense adsbygoogle ad-?slot sponsor(?:ed|s)? promo(?:tion|tions|s)?"
COMMENTS = "comments? comment-?list disqus replies guestbook talkback"
NOTICE = "cookies? consent gdpr notices? alerts? popups? newsletter subscribe subscription"
CHROME = "nav navbar navigation menus? breadcrumbs? side-?bar footer masthead top-?bar toolbar banner modal overlay sign-?up social shar(?:e|ing) related recommended recommendations widgets? login search pagination pager skip-?link"
WHERE = "site page main top bottom left right primary secondary global user reader post article blog header footer cookie social sticky similar mobile the wp"
FORM = "wrapper wrap container area list box bar section block inner outer links? widget buttons? icons? form items? thread feed panel row col column unit slot message msg text content posts? articles? stories top bottom left right sidebar menu nav banner notice signup sign-?up subscribe"
#: Names that say as much of what is written about: such a container goes only if it isn't text (see is_text).
BARE = frozenset("search menu menus navigation share sharing social login banner overlay modal widget widgets related recommended recommendations alert alerts notice notices promotion promotions subscription consent".split())
#: Outside of article and main, such a container after other text holds comments. A discussion may also be a paper's: it does if its
#: parts name their authors or times.
TALK, DISCUSSION = "responses respond reactions feedback", "discussions?"
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Marks of one reader's comment, on elements within it.
BY = re.compile(r"(?:^|[\s-])(?:author|user|username|avatar|date|time|timestamp|byline|meta|posted|reply|nick|name|commenter|poster|by|when|who)(?:$|[\s-])")
#: What a comment says of its author or time, and headings of comments.
SAID = re.compile(r"\b(?:says|said|wrote|writes|replied|posted|commented)\s*:|\bago\b", re.I)
TALKS = re.compile(r"(?:\d+|no|all|reader|readers'?|user|your|join the|leave a|add a|post a|show|view)?\s*(?:comments?|responses?|replies|reply|reactions?)(?:\s*(?:\(?\d+\)?|on\b.*|to\b.*))?\s*:?", re.I)


def _names(*kinds: str) -> re.Pattern:
    word = lambda x: "|".join(x.split())
    return re.compile(rf"(?:(?:{word(WHERE)})-)?(?:{'|'.join(word(k) for k in kinds)})(?:-(?:{word(FORM)}|\d+))*\d*")


_ADVERT, _NOTICE, _COMMENTS, _UNWANTED, _TALK, _DISCUSSION = _names(ADVERT), _names(ADVERT, NOTICE), _names(COMMENTS), _names(ADVERT, COMMENTS, NOTICE, CHROME), _names(TALK), _names(DISCUSSION)
_OUTSIDE = re.compile(r"(?:(?:site|top|global|the)-)?header(?:-(?:wrapper|wrap|container|area|bar|inner|top|nav|menu))*\d*")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*)(?:>|$)", re.S)
_MARKS = re.compile(r"(?<![\w-])(class|id|role|aria-hidden|itemprop|itemtype)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "parent", "kids", "marks", "chars", "tags", "link_chars", "link_tags", "articles", "prose", "named", "cited", "timed", "density", "sum", "best")

    def __init__(self, tag: str, parent: Node | None, marks: str = ""):
        self.tag, self.parent, self.kids, self.marks = tag, parent, [], marks  # kids: nodes and strings


def marks_of(attributes: str) -> tuple[list[str], set[str]]:
    """The names in class and id, and other marks, lower-cased."""
    names, other = [], set()
    for name, a, b, c in _MARKS.findall(attributes) if "=" in attributes else ():
        value = (a or b or c).lower()
        if name.lower() in ("class", "id"):
            names += value.replace("_", "-").split()
        else:
            other.add(f"{name.lower()}={value}")
    return names, other


def unwanted(tag: str, names: list[str], other: set[str], inside: bool) -> bool:
    """inside: within main or article, whose headers hold the title."""
    if tag in DROPPED or tag == "header" and not inside or "aria-hidden=true" in other:
        return True
    if any(x == "itemprop=comment" or x.endswith("schema.org/comment") for x in other):
        return True
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return False
    if tag in INLINE or tag == "p":
        return any((_ADVERT if tag in INLINE else _NOTICE).fullmatch(x) for x in names)
    if tag == "article":
        return any(_COMMENTS.fullmatch(x) for x in names)
    if any(x[5:] in ROLES for x in other if x.startswith("role=")):
        return True
    return any(x not in BARE and _UNWANTED.fullmatch(x) or not inside and _OUTSIDE.fullmatch(x) for x in names)


class Open:
    """The open elements of a page, with the places of each tag among them, so that no end tag is looked for twice."""

    def __init__(self):
        self.path = [Node("body", None)]
        self.places: dict[str, list[int]] = {}
        self.walls = [0]  # blocks other than paragraphs

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        if node.tag in BLOCK and node.tag != "p":
            self.walls.append(len(self.path))
        self.path.append(node)

    def cut(self, place: int) -> None:
        """Ends all elements from this place on."""
        while len(self.path) > place:
            self.places[self.path.pop().tag].pop()
            if self.walls[-1] == len(self.path):
                self.walls.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost open one; -1 if there is none."""
        return places[-1] if (places := self.places.get(tag)) else -1

    def first(self, tag: str, after: int) -> int:
        """The place of the outermost open one beyond a place."""
        places = self.places.get(tag, ())
        at = bisect_right(places, after)
        return places[at] if at < len(places) else len(self.path)

    def starts(self, tag: str) -> None:
        """Ends what an element of this tag ends by starting."""
        if tag in BLOCK and self.last("p") > self.walls[-1]:
            self.cut(self.last("p"))
        if tag in CLOSES:
            wall = max(self.last(w) for w in WALLS[tag])
            self.cut(min(self.first(c, wall) for c in CLOSES[tag]))


def parse(page: str) -> Node:
    """The tree of what may be article; broken markup is closed as browsers do in the common cases. Time is linear in the page."""
    opened = Open()
    skipped: list[str] = []  # open elements from the first unwanted one on
    among: dict[str, int] = {}  # how many of each tag are skipped
    pos, end = 0, len(page)

    def skip(tag: str) -> None:
        skipped.append(tag)
        among[tag] = among.get(tag, 0) + 1

    def unskip() -> str:
        among[tag := skipped.pop()] -= 1
        return tag

    while pos < end:
        m = _TOKEN.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not skipped:
            opened.path[-1].kids.append(page[pos:stop])
        if not m:
            break
        pos = m.end()
        if not m[3]:
            if m[1] and not skipped:
                opened.path[-1].kids.append(m[1])
            continue
        tag, attributes = m[3].lower(), m[4]
        if m[2]:
            if skipped:
                if among.get(tag):
                    while unskip() != tag:
                        pass
                    continue
                if tag not in ("article", "main", "body", "html"):
                    continue
                skipped.clear()  # the unwanted element was never closed, but what holds it is
                among.clear()
            place = opened.last(tag)
            if place > (opened.walls[-1] if tag in NEAR else 0):
                opened.cut(place)
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(page, pos)
            if tag in ("xmp", "noembed", "noframes") and not skipped:
                opened.path[-1].kids.append(page[pos : close.start() if close else end])
            pos = close.end() if close else end
            continue
        if tag in ("html", "body"):
            if tag == "body":
                skipped.clear()
                among.clear()
            continue
        empty = tag in VOID or attributes.endswith("/")
        if skipped:
            if tag in ("li", "p", "option", "dt", "dd") and skipped[-1] == tag and len(skipped) > 1:
                unskip()
            if not empty:
                skip(tag)
            continue
        opened.starts(tag)
        names, other = marks_of(attributes)
        if unwanted(tag, names, other, opened.last("article") > 0 or opened.last("main") > 0):
            if not empty:
                skip(tag)
            continue
        node = Node(tag, opened.path[-1], " ".join(names))
        opened.path[-1].kids.append(node)
        if tag not in VOID:
            opened.push(node)
    return opened.path[0]


#: The share of an article's characters that stands between it and a title that is no h1, at most.
LITTLE = 0.25
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


def inner(node: Node) -> list[Node]:
    return [k for k in node.kids if not isinstance(k, str)]


def pages_order(root: Node) -> list[Node]:
    """All nodes, in page order."""
    out, stack = [], [root]
    while stack:
        out.append(node := stack.pop())
        stack.extend(reversed(inner(node)))
    return out


def text_of(node: Node) -> str:
    """A node's text, white space as one space."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            stack.extend(reversed(x.kids))
            parts.append(" ")
    return " ".join("".join(parts).split())


def first_words(node: Node) -> str:
    """The first piece of text in a node."""
    stack = [node]
    while stack:
        x = stack.pop()
        if not isinstance(x, str):
            stack.extend(reversed(x.kids))
        elif not x.isspace():
            return " ".join(x.split())
    return ""


def is_text(node: Node, root: Node, inside: bool) -> bool:
    """Whether a container with a name that may be of its subject is the article or a part of it: it holds most of the page's text, or
    stands in an article and is paragraphs, nearly without links."""
    plain = node.chars - node.link_chars
    return 2 * plain >= root.chars - root.link_chars or inside and node.prose > 1 and 10 * node.link_chars <= node.chars


def alike(node: Node) -> list[Node]:
    """The parts of one kind (element, class and id) that make most of a container; none if it isn't made of such."""
    kinds: dict[tuple, list[Node]] = {}
    for k in inner(node):
        if k.tag in ("div", "li", "section", "article", "dd", "blockquote") and k.chars:
            kinds.setdefault((k.tag, k.marks), []).append(k)
    most = max(kinds.values(), key=lambda x: sum(k.chars for k in x), default=[])
    return most if len(most) > 1 and sum(k.chars for k in most) >= 0.6 * node.chars else []


def said_by(node: Node, headed: bool) -> bool:
    """Whether a part names its author or time, as a reader's comment does. Interviews name the one and histories the other: cite or
    address, and time, count together, or under a heading of comments."""
    return node.named or node.cited and node.timed or headed and (node.cited or node.timed) or bool(SAID.search(first_words(node)))


def are_comments(node: Node, inside: bool) -> bool:
    """Whether a container after other text holds reader comments: by heading, or by the form of its parts."""
    like = alike(node)
    first = next((k for k in node.kids if not isinstance(k, str) and k.chars), None)
    headed = first is not None and first.tag in HEADINGS and first.chars < node.chars and bool(TALKS.fullmatch(text_of(first)))
    if not inside and (headed or any(_TALK.fullmatch(x) for x in node.marks.split())):
        return True
    called = not inside and any(_DISCUSSION.fullmatch(x) for x in node.marks.split())
    return bool((headed or not inside) and like and sum(said_by(k, headed or called) for k in like) >= 0.8 * len(like))


def without_comments(root: Node) -> bool:
    """Takes containers of reader comments off the tree, if they come after other text and don't hold the title, and those of BARE names that
    aren't text. Whether there were any."""
    order = pages_order(root)
    title = next((n for n in order if n.tag == "h1" and n.chars), None)
    kept, up = set(), title
    while up is not None:
        kept.add(id(up))
        up = up.parent
    least, before, any_gone = title.chars if title else 0, 0, False
    gone, inside = set(), set()
    for node in order:
        if id(node.parent) in gone:
            gone.add(id(node))
            continue
        if node.tag in ("article", "main") or id(node.parent) in inside:
            inside.add(id(node))
        bare = node.marks and node.tag in BLOCK and node.tag not in HEADINGS and node.tag != "article" and any(x in BARE for x in node.marks.split())
        if bare and id(node) not in kept and node.chars and not is_text(node, root, id(node) in inside):
            gone.add(id(node))
            any_gone = True
        elif before > least and node.chars and node.tag in ("div", "section", "ul", "ol", "dl") and id(node) not in kept and are_comments(node, id(node) in inside):
            gone.add(id(node))
            any_gone = True
        else:
            before += sum(len(k.strip()) for k in node.kids if isinstance(k, str))
    for node in order:
        if any(id(k) in gone for k in inner(node)):
            node.kids = [k for k in node.kids if isinstance(k, str) or id(k) not in gone]
    return any_gone


def weigh(root: Node) -> list[Node]:
    """Sets counts, densities and sums; the nodes, parents first."""
    order = [root]
    for node in order:
        order.extend(k for k in node.kids if not isinstance(k, str))
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = node.articles = node.prose = 0
        node.named = node.cited = node.timed = False
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len("".join(k.split()))
            else:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
                node.articles += k.articles
                node.prose += k.prose or k.tag == "p" and k.chars > 2 * k.link_chars
                node.named |= k.named or bool(k.marks and BY.search(k.marks))
                node.cited |= k.cited or k.tag in ("cite", "address")
                node.timed |= k.timed or k.tag == "time"
        if node.tag == "a":
            node.link_chars = node.chars
        if node.tag == "article" and node.chars:
            node.articles = 1  # those inside are parts of it
    body_share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t = node.chars, max(node.tags, 1)
        if not c:
            node.density = 0.0
        else:
            lc, lt, plain = node.link_chars, max(node.link_tags, 1), max(c - node.link_chars, 1)
            base = math.log(c / plain * lc + body_share * c + math.e)
            node.density = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1e-9) / base if lc else c / t * math.log(max(c * t / lt, 1.0) + 1e-9) / base
        kids = inner(node)
        node.sum = sum(k.sum if k.tag in INLINE else k.density for k in kids)
        node.best = node
        for k in kids:
            if k.best.tag not in INLINE and (k.best.sum > node.best.sum or node.best.tag in INLINE):
                node.best = k.best
    return order


def enclosing(best: Node, top: Node, threshold: float) -> Node:
    """What the subtree of largest density sum is a part of, up to top."""
    marked, node = None, best
    while node is not top.parent:
        if node.tag == "article" or node.tag == "main" and (marked is None or node.articles == 1):
            marked = node
        node = node.parent
    if marked is not None:
        return marked
    while best is not top and best.parent is not top:
        beside = [k for k in inner(best.parent) if k is not best and k.tag not in INLINE]
        if not any(k.chars and k.density >= threshold for k in beside):
            break
        best = best.parent
    return best


def above(node: Node | None) -> list[Node]:
    """The node and what holds it, up to the root."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def heart_of(root: Node, order: list[Node]) -> tuple[Node, str]:
    """The subtree of largest density sum where the article is, and what says so: an element, the title, or nothing else.

    That is in the only article, unless a title stands in another part of the page; else among what the page's title is
    with, if that is an article by its size, or what is denser is a list of parts alike.
    """
    title = next((n for n in order if n.tag == "h1" and n.chars), None)
    if root.articles == 1:
        only = next(n for n in order if n.tag == "article" and n.chars)
        if title is None or title.parent in above(only) or only in above(title):
            return only.best if only.best.tag not in INLINE else only, "element"
    heart = root.best
    if title is not None and not root.articles:
        part, paragraphs = title, 0
        while part is not root and paragraphs < 2:
            part = part.parent
            paragraphs = sum(1 for k in part.kids if not isinstance(k, str) and k.tag not in HEADINGS and k.tag not in INLINE and k.chars > k.link_chars)
        if part is not root and part not in above(heart) and (2 * (part.chars - title.chars) >= heart.chars or alike(heart)):
            return part.best, "title"
    return heart, ""


def titled(top: Node, order: list[Node]) -> list[Node]:
    """The title before a subtree, if that doesn't hold it, and what stands between; without any h1, the last heading of the highest level before
    it, with little between, is the title."""
    way = above(top)
    at = {id(n): i for i, n in enumerate(order)}
    on_way = {id(n) for n in way}
    before = [n for n in order[: at[id(top)]] if n.tag in HEADINGS and n.chars and id(n) not in on_way]
    level = "h1" if any(n.tag == "h1" and n.chars for n in order) else min((n.tag for n in before), default="h1")
    if level == "h1" and any(n.tag == "h1" and n.chars for n in pages_order(top)):
        return []
    held = {id(n) for n in way}
    title = next((n for n in reversed(order[: at[id(top)]]) if n.tag == level and n.chars and id(n) not in held), None)
    if title is None:
        return []
    branch = above(title)
    k = next(i for i, n in enumerate(branch) if id(n) in held)
    common, first = branch[k], branch[k - 1]
    last = way[way.index(common) - 1]
    kids = inner(common)
    plain = lambda x: x.chars > 2 * x.link_chars
    between = kids[kids.index(first) + 1 : kids.index(last)]
    little = LITTLE * top.chars
    if level != "h1" and sum(x.chars for x in between) > little:
        return []
    whole = plain(first) and (level == "h1" or first.chars <= title.chars + little)
    return [first if whole else title, *(x for x in between if x.chars and plain(x))]


def chosen(root: Node) -> list[Node]:
    """The subtrees that are content, in page order."""
    weigh(root)
    if without_comments(root):
        weigh(root)
    order = pages_order(root)
    heart, by = heart_of(root, order)
    way = above(heart)
    threshold = min(n.density for n in way)
    if by == "element":
        top = enclosing(heart, root, threshold)
        return [*titled(top, order), top]
    on_way = {id(n) for n in way}
    out, stack, top = [], [root], None
    while stack:
        node = stack.pop()
        if node.density < threshold:
            continue
        best = enclosing(heart if id(node) in on_way else node.best, node, threshold)
        if id(node) in on_way:
            top = best
        if best is node or node is heart:
            out.append(node)
            continue
        # the subtree, and what beside the way to it is dense enough
        down, up = {id(best)}, best
        while up is not node:
            up = up.parent
            down.add(id(up))
        walk = [node]
        while walk:
            x = walk.pop()
            if x is best:
                out.append(x)
                continue
            for k in reversed(inner(x)):
                if id(k) in down:
                    walk.append(k)
                elif k.chars and k.density >= threshold and not (by == "title" and alike(k)):
                    stack.append(k)
    if top is not None and (more := titled(top, order)):
        inside = {id(n) for x in out for n in pages_order(x)}
        more = [x for x in more if id(x) not in inside]
        around = {id(n) for x in more for n in pages_order(x)}
        out = [x for x in out if id(x) not in around] + more
    at = {id(n): i for i, n in enumerate(order)}
    return sorted(out, key=lambda x: at[id(x)])


def blocks(nodes: list[Node]) -> list[str]:
    """Their blocks of text in page order: white space is one space, character references are decoded."""
    out: list[str] = []
    part: list[str] = []

    def flush():
        if part:
            if text := " ".join(html.unescape("".join(part)).split()):
                out.append(text)
            part.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                part.append(x)
            elif x is None:
                flush()
            elif x.tag == "br":
                part.append(" ")
            else:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.kids))
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by an empty line (two \\n); empty without text."""
    return "\n\n".join(blocks(chosen(parse(page)))) if page else ""


def extract(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Columns `keep` (None: all but the html) with text and its code points.

    One row out for each row in; null and empty pages have an empty text. Columns of `keep` with the new names are replaced. Pages are
    parsed one at a time in Arrow batches, without a shuffle.
    """
    keep = [c for c in ([x for x in pages.columns if x != html_column] if keep is None else keep) if c not in (text, n_chars)]
    last = spare(pages, "html_of")
    x = pages.select(*keep, F.col(html_column).cast("binary").alias(last))
    schema = T.StructType([*x.drop(last).schema.fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches):
        for batch in slices(batches):
            found = [main_text(p.as_py().decode("utf-8", "replace") if p.is_valid else None) for p in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[*keep, text, n_chars])

    return x.mapInArrow(run, schema)
