"""Main text of web pages by tag-path ratios.

The page is read as a sequence of blocks, each with its tag path from the root. For each path
the lengths of text and the punctuation marks of all its blocks are summed and divided by the
number of its blocks; the ratios are smoothed over the page's sequence of blocks, fused with each
other and with the share of text outside of links, and paths under the threshold drop out.

Classes and ids that stand for menus, adverts and the like are a weight on the paths below them:
such a path is content only if it outweighs all others even so. Names weigh nothing on an article
or main element, nor on an element with most of the page's plain text, unless an article or main
stands outside of it; only names of readers' comments always weigh. Elements that are never text
(nav, footer, form and so on) drop out, but for the headings of an article's own header.

The paths that are left name the content nodes: the articles and mains that hold them, or else the
element around all containers with a share of the page's ratios. These nodes give the text: all
their blocks in page order that no name speaks against, and the page's title where they have none. Content
besides them counts only where they have less than half of what was chosen, or if by its name it leads into them. Names are known in English, German,
French and Spanish; furniture inside of an article under other names, or without one, is told by its ratios alone.

Reading is linear in the page: tags that never end, quotes that never close, elements that stay
open and nesting of any depth are read in one pass.

Defined results: a null or empty page has an empty text, and so has one without any content path;
repeated pages have one row each; very long pages are read whole; broken markup is read as far as
it goes; all other columns pass through, and a column that already has a result column's name is
replaced.
"""

from __future__ import annotations

import heapq
import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: elements without content, with raw content, inside a line, never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style textarea title noscript iframe noembed noframes template svg math object nav header footer aside form button select option menu dialog canvas audio video map".split())
# Elements that end an open paragraph or an open element of their own kind.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_KIND = {"li": "entry", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option"}
# Elements inside of which an entry of that kind is none of the open one's neighbours.
ENDS = {"ul": ["entry"], "ol": ["entry"], "menu": ["entry"], "dl": ["term"], "table": ["row", "cell"], "tr": ["cell"], "select": ["option"]}

#: Words in classes, ids and roles that mark what isn't the article.
NOISE_WORDS = r"""ad ads adv advertisement adbox adslot adunit advert\w* adsense banner\w* sponsor\w* promo\w* breadcrumbs? \w*menu\w* nav\w* \w*nav
\w*sidebar\w* side aside \w*footer\w* foot \w*header masthead topbar toolbar discussion reviews feedback bio trending popular
cookie\w* consent gdpr notice\w* notification\w* alert\w* modal\w* popup\w* overlay newsletter\w* subscribe\w* subscription
signup login search\w* share\w* sharing social\w* related\w* recommend\w* widget\w* tags? pagination pager copyright legal disclaimer
hidden skip\w* toc complementary contentinfo navigation form
\w*werbung\w* anzeigen? reklame seitenleiste fusszeile kopfzeile teilen empfehlung\w* verwandte\w* publicite\w* pub publi annonces? partager
pied entete publicidad\w* anuncios? patrocinad\w* compartir relacionad\w* pie"""
#: The same for what readers write; it may well be longer than the article.
COMMENT_WORDS = r"\w*kommentar\w* commentaires? comentarios? g(?:ae|ä)stebuch guestbook responses? comment comments commentlist \w*comments replies reply respond disqus\w*"
NOISE = re.compile(r"(?:" + "|".join(NOISE_WORDS.split()) + r")\d*", re.IGNORECASE)
COMMENT = re.compile(r"(?:" + "|".join(COMMENT_WORDS.split()) + r")\d*", re.IGNORECASE)
#: Words for what leads into an article, as the last of a name.
LEAD = re.compile(r"lead|lede|intro|standfirst|dek|vorspann|chapeau|chapo|entradilla", re.IGNORECASE)
#: Words that, before others in a name, may as well say what an article is about.
TOPIC = re.compile(r"tags?|social\w*|side|foot|legal|form", re.IGNORECASE)
#: Last words of a name that don't say what an element is for.
SHAPE = re.compile(r"wrap|wrapper|container|inner|outer|lists?|items?|links?|box|block|area|section|bar|buttons?|icons?|cloud|left|right|\d+", re.IGNORECASE)
#: A small letter before a capital starts a new word of a name.
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Names that only say what an element has beside it, or that it heads a piece of text.
ABOUT = re.compile(r"\b(?:has|with|no|without)[-_]\S+|\b(?:article|entry|post|story|content|section|chapter|title|text|news|blog)[-_]?header\b", re.IGNORECASE)
#: Share of the chosen text from which on articles are all of it, but for a lead before them.
MOST_INSIDE = 0.5
# Tags as HTML reads them: quotes count after an equals sign only. No part is ever tried twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?(?![\w-])", re.IGNORECASE)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
MARK = re.compile(r"[.,;:!?。，；：！？、…¿¡]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a piece of text rather than a part of the page.
PIECES = HEADINGS | frozenset("p li ul ol dl dt dd td th tr table tbody thead tfoot caption blockquote pre figure figcaption address center".split())
#: A path is content if its fused ratio reaches this share of the page's largest; so is a container.
THRESHOLD = 0.05
#: What a name that speaks against an element leaves of the ratio of its paths.
NAMED_WEIGHT = 0.05
SMOOTH = (0.25, 0.5, 0.25)


RAW_END = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in RAW}


class Node:
    """An open element. What its blocks need to know of its ancestors is handed down."""

    __slots__ = ("comment", "content", "dropped", "holder", "label", "lead", "name", "named", "near", "parent", "part", "place", "serial")

    def __init__(self, name, parent, serial, place, label, never, kind, lead):
        self.name, self.parent, self.serial, self.place, self.label = name, parent, serial, place, label
        #: The nearest element with content of its own: article or main.
        self.content = self if name in ("article", "main") else parent and parent.content
        #: 1 in the header of an article, 2 in what is never text.
        self.dropped = max(parent.dropped if parent else 0, (1 if name == "header" and self.content else 2) if never else 0)
        #: The nearest element that a name speaks against, and whether one of them holds comments.
        self.named = self if kind else parent and parent.named
        self.comment = kind == 2 or bool(parent and parent.comment)
        #: Whether a name says that it leads into an article.
        self.lead = lead or bool(parent and parent.lead)
        #: The nearest element that isn't inside a line, and the nearest list entry of each kind.
        self.holder = parent.holder if name in INLINE and parent else self
        self.near = parent.near if parent else {}
        #: The nearest element that is a part of the page, not a piece of text.
        self.part = parent and parent.part if name in PIECES or name in INLINE else self
        if name in ENDS:
            near = dict(self.near)
            for kind_ in ENDS[name]:
                near[kind_] = None
            self.near = near
        if name in OWN_KIND:
            self.near = self.near | {OWN_KIND[name]: self}


class Block:
    """A run of text between tags of blocks."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, node):
        self.node, self.text, self.linked = node, [], 0


def _kind(value: str) -> tuple[int, bool]:
    """2 if a name among those of an attribute starts or ends with a word for comments, 1 for other noise; whether
    one ends with a word for what leads into an article."""
    found, lead = 0, False
    for name in ABOUT.sub("", value).split():
        words = [w for w in re.split(r"[_-]+", CAMEL.sub("-", name)) if w]
        while len(words) > 1 and SHAPE.fullmatch(words[-1]):
            words.pop()
        if words and (COMMENT.fullmatch(words[-1]) or COMMENT.fullmatch(words[0])):
            return 2, False
        lead = lead or bool(words and LEAD.fullmatch(words[-1]))
        if words and (NOISE.fullmatch(words[-1]) or NOISE.fullmatch(words[0]) and not TOPIC.fullmatch(words[0])):
            found = 1
    return found, lead


def _noise(name: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is never text, and what its names say: see ``_kind``."""
    if name in DROPPED:
        return True, 0, False
    kind, lead = 0, False
    if attributes and name not in ("html", "body"):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN_STYLE.search(value):
                return True, 0, False
            if key in ("class", "id", "role") and name not in ("article", "main"):
                said, leads = _kind(value)
                kind, lead = max(kind, said), lead or leads
    return False, kind, lead


class _Stack:
    """The open elements, with the places of each name."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.labels: dict[tuple[int, str], int] = {}
        self.links = self.serial = 0

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def push(self, name: str, attributes: str) -> None:
        parent = self.top()
        over = parent.holder.label if parent else 0
        label = over if name in INLINE else self.labels.setdefault((over, name), len(self.labels) + 1)
        self.serial += 1
        self.places.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(Node(name, parent, self.serial, len(self.nodes), label, *_noise(name, attributes)))
        self.links += name == "a"

    def pop_to(self, place: int) -> None:
        """Close the elements from a place on."""
        for node in reversed(self.nodes[place:]):
            self.places[node.name].pop()
            self.links -= node.name == "a"
        del self.nodes[place:]


def blocks(html: str) -> list[Block]:
    """The page's blocks: runs of text between block-level tags, in one pass."""
    out: list[Block] = []
    stack = _Stack()
    current: Block | None = None
    at, size, last, tag, no_cdata_end = 0, len(html), html.rfind(">"), TAG, False

    def text(raw: str):
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(stack.top())
            out.append(current)
        current.text.append(raw)
        if stack.links:
            current.linked += len(raw)

    while at < size:
        start = html.find("<", at)
        if start < 0 or start > last:
            # No tag ends any more, but a comment may begin.
            start = html.find("<!--", at)
            text(html[at : start if start >= 0 else size])
            break
        text(html[at:start])
        mark = html[start + 1 : start + 2]
        if mark in ("!", "?"):
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
                continue
            if html.startswith("<![CDATA[", start) and not no_cdata_end:
                end = html.find("]]>", start)
                if end >= 0:
                    text(html[start + 9 : end])
                    at = end + 3
                    continue
                no_cdata_end = True
            at = html.find(">", start) + 1
            continue
        m = tag.match(html, start)
        if m is None and tag is TAG and PLAIN_TAG.match(html, start):
            # A quote holds the last end of a tag: from here on quotes don't count.
            tag = PLAIN_TAG
            m = tag.match(html, start)
        if m is None:
            text("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            places, top = stack.places.get(name), stack.top()
            # Inside a line an end tag doesn't reach beyond the block around it.
            if places and (name not in INLINE or top.holder.name in INLINE or top.holder.place < places[-1]):
                stack.pop_to(places[-1])
            if name not in INLINE:
                current = None
            continue
        if name == "br":
            text(" ")
            continue
        if name not in INLINE:
            current = None
        if name in VOID:
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = RAW_END[name].search(html, at)
                at = end.end() if end else size
            continue
        if name in CLOSES_P:
            top = stack.top()
            if top and top.holder.name == "p":
                stack.pop_to(top.holder.place)
        if name in OWN_KIND:
            top = stack.top()
            before = top.near.get(OWN_KIND[name]) if top else None
            if before:
                stack.pop_to(before.place)
        if m[3].endswith("/") and name not in INLINE:
            continue
        stack.push(name, m[3])
    return out


def _clear(found: list[tuple[Block, str]], plain: np.ndarray) -> np.ndarray:
    """Whether no name speaks against a block. A name doesn't count on an element with most of the
    page's plain text but for comments, unless an article or main with text stands outside of it."""
    held: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    own: dict[int, float] = {}  # of the elements that names speak against: text of articles inside
    whole, articles = 0.0, 0.0
    for (b, _), n in zip(found, plain, strict=True):
        named, content = (b.node.named, b.node.content) if b.node else (None, None)
        if not (b.node and b.node.comment):
            whole += n
        if content:
            articles += n
        if named:
            held[named.serial] = held.get(named.serial, 0.0) + n
            nodes[named.serial] = named
            if content:
                own[named.serial] = own.get(named.serial, 0.0) + n
    # What an element holds goes up to the next one around it; inner ones have larger numbers.
    heap = [-k for k in nodes]
    heapq.heapify(heap)
    order = []
    while heap:
        k = -heapq.heappop(heap)
        order.append(k)
        around = nodes[k].parent and nodes[k].parent.named
        if around:
            held[around.serial] = held.get(around.serial, 0.0) + held[k]
            own[around.serial] = own.get(around.serial, 0.0) + own.get(k, 0.0)
            if around.serial not in nodes:
                nodes[around.serial] = around
                heapq.heappush(heap, -around.serial)
    clear: dict[int, bool] = {}
    for k in reversed(order):
        around = nodes[k].parent and nodes[k].parent.named
        large = 2 * held[k] > whole and articles - own.get(k, 0.0) <= 1e-6 * whole and not nodes[k].comment
        clear[k] = large and (not around or clear[around.serial])
    return np.array([not (b.node and b.node.named) or clear[b.node.named.serial] for b, _ in found])


def _inside(node: Node | None, roots: set[int], memo: dict[int, bool]) -> bool:
    """Whether an element is one of ``roots`` or in one."""
    way = []
    while node is not None and node.serial not in memo:
        way.append(node.serial)
        if node.serial in roots:
            break
        node = node.parent
    inside = node is not None and (node.serial in roots or memo[node.serial])
    memo.update(dict.fromkeys(way, inside))
    return inside


def _around(nodes: list[Node]) -> Node | None:
    """The innermost element around all; None for the whole page. No element is passed twice."""
    common = nodes[0]
    under = {common.serial}
    for node in nodes[1:]:
        way = []
        while node is not None and node.serial not in under and node.place > common.place:
            way.append(node.serial)
            node = node.parent
        if node is not None and node.serial not in under:
            while common is not None and node is not common:
                if node.place >= common.place:
                    way.append(node.serial)
                    node = node.parent
                    if node is None:
                        return None
                else:
                    common = common.parent
            if common is None:
                return None
            way.append(common.serial)
        under.update(way)
    return common


def main_text(html: str) -> str:
    """The article of a page: its blocks, joined by newlines."""
    found = []
    for b in blocks(html):
        dropped = b.node.dropped if b.node else 0
        if dropped == 2 or dropped == 1 and b.node.holder.name not in HEADINGS:
            continue
        clean = " ".join(unescape("".join(b.text)).split())
        if clean:
            found.append((b, clean))
    if not found:
        return ""
    chars = np.array([len(t) for _, t in found], float)
    marks = np.array([len(MARK.findall(t)) for _, t in found], float)
    plain = np.array([max(0.0, 1 - b.linked / max(1, sum(map(len, b.text)))) for b, _ in found])
    clear = _clear(found, plain * chars)
    comment = np.array([bool(b.node and b.node.comment) for b, _ in found])
    holders = [b.node.holder if b.node else None for b, _ in found]
    labels = [(h.label if h else 0, bool(c), bool(x)) for h, c, x in zip(holders, clear, comment, strict=True)]
    of = {p: i for i, p in enumerate(dict.fromkeys(labels))}
    index = np.array([of[p] for p in labels])
    count = np.bincount(index)

    def smoothed(values):
        ratio = (np.bincount(index, values) / count)[index]
        padded = np.pad(ratio, 1, mode="edge")
        along = SMOOTH[0] * padded[:-2] + SMOOTH[1] * ratio + SMOOTH[2] * padded[2:]
        return np.bincount(index, along) / count

    share = np.bincount(index, plain * chars) / np.bincount(index, chars)
    fused = smoothed(chars) * np.sqrt(1 + smoothed(marks)) * share**2
    own = np.array([1.0 if c else 0.0 if x else NAMED_WEIGHT for _, c, x in of])
    total = fused * count * own
    if not total.max() > 0:
        own[:] = 1.0
        total = fused * count
        clear[:] = True
    most = total.max()
    # A path that a name speaks against must outweigh all the others.
    chosen = (total >= THRESHOLD * most) & ((own == 1) | (total >= most))
    kept = clear | chosen[index]
    core = np.flatnonzero(chosen[index])
    roots = {holders[i].content.serial for i in core if holders[i] and holders[i].content}
    if not roots:
        # Containers of links, and those with next to nothing of the ratios, don't count.
        containers = [h and h.part for h in holders]
        _, place = np.unique(np.array([h.serial if h else 0 for h in containers]), return_inverse=True)
        weight = np.bincount(place, total[index] * kept * chars / np.bincount(index, chars)[index])
        ratio = np.bincount(place, plain * chars) / np.bincount(place, chars)
        good = (weight >= THRESHOLD * weight.max()) & (ratio >= 0.5 * ratio[weight.argmax()])
        core = [i for i in core if good[place[i]]] or list(core)
        around = None if any(containers[i] is None for i in core) else _around([containers[i] for i in core])
        roots = {around.serial} if around else {0}
        chosen_here = np.isin(np.arange(len(found)), core)
    else:
        chosen_here = chosen[index]
    memo: dict[int, bool] = {}
    inside = np.array([0 in roots or _inside(h, roots, memo) for h in holders])
    # Where articles or mains have most of what was chosen, nothing outside of them belongs to the text; a page
    # whose text stands outside of a small one keeps both.
    whole = (total[index] * chars / np.bincount(index, chars)[index])[chosen_here]
    alone = whole[inside[chosen_here]].sum() >= MOST_INSIDE * whole.sum()
    # A header's headings belong to the text only inside of the article that it heads.
    wanted = kept & inside if alone else kept & (inside | chosen_here)
    # What by its name leads into the articles stands before them; it is text as what was chosen is.
    if alone and wanted.any():
        first = int(np.flatnonzero(wanted)[0])
        wanted[[i for i in range(first) if kept[i] and chosen_here[i] and holders[i] is not None and holders[i].lead]] = True
    # The title where it stands before the text, outside of it.
    titles = [i for i, h in enumerate(holders) if h is not None and h.name == "h1" and kept[i] and plain[i] > 0.5]
    if wanted.any() and titles and not any(wanted[i] for i in titles):
        before = [i for i in titles if i < int(np.flatnonzero(wanted)[0])]
        wanted[before[-1:]] = True
    return "\n".join(clean for (_, clean), w in zip(found, wanted, strict=True) if w)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text", length: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its number of code points; batches stream through."""
    kept = pages.drop(name, length)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType()), T.StructField(length, T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return kept.mapInArrow(run, schema)
