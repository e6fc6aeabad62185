"""Main text of web pages by tree scoring.

A tolerant tokenizer builds the element tree (optional end tags are implied). Elements that are never
article text by tag are left out. Each paragraph passes points for its length and commas to its ancestors,
halved and so on with distance; a container's points are discounted by its link density. The best container
(raised to the article or main element around it), other articles, and those of its siblings and cousins
that look like text are kept, and their blocks come out in page order.

Role, class and id only cast suspicion. A name speaks of what its last word says (share-price-analysis is
about an analysis, post-comments are comments), and has-sidebar of nothing. A suspect is left out unless it
holds most of the page's text, as a wrapper does; one that a name merely touches only if it has
little text or many links. A header counts as the article's where it lies inside the chosen container. If
nothing is left, names are not regarded.

Null or empty html, and pages without text: an empty string. Broken markup never fails. Extra columns
are ignored, repeated rows are extracted each, an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[a-z]+")

# Elements of HTML, and words by which pages mark what is not the article.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template svg math canvas iframe object embed audio video nav footer aside button select option textarea input dialog menu title noembed noframes xmp".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
BARRIERS = (CLOSES_P | DROPPED) - {"address", "div", "p"}  # no li, dt or dd ends one beyond these
SCOPE = frozenset("table td th caption button html body".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
JUNK_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription comment comments disqus respond replies reply footer masthead related recommended share sharing social widget pagination pager toolbar login signin signup skip disclaimer".split())
GOOD_WORDS = frozenset("article main content post entry story body text page column primary wrapper container".split())
KEPT_TAGS = frozenset("html body article main".split())

COMMENT_WORDS = frozenset("comment comments disqus respond replies reply".split())
STATE_WORDS = frozenset("has no not is with without".split())
PLACE_WORDS = frozenset("area bar block body bottom box button buttons by center col container content desktop entry footer form google header heading holder info inner item items large left link links list main middle mobile news outer page panel post posts primary reading right row secondary section site slot small stories story text title toggle top unit wrap wrapper x zone".split())

BASE_POINT, CHARS_PER_POINT, MOST_LENGTH_POINTS = 1.0, 100.0, 3.0
SIBLING_SHARE, MOST_LINKS = 0.2, 0.25
LEAST_TEXT, SHORT_TEXT = 80, 25  # characters outside links: of a container further off, of a neighbour
MOST_SHARE, WRAPPER_SHARE = 0.9, 0.5  # of the page's text: a suspect's, and one's around the title or main
NEAR_SHARE = 1e-9  # points fade below it some thirty elements up
NONE, SKIP, STRONG, COMMENTS, FORM, HEADER, WEAK = range(7)


def _name_kind(name: str) -> int:
    words = NAME_PART.findall(name)
    if not words or words[0] in STATE_WORDS or not JUNK_WORDS.intersection(words):
        return NONE
    head = words[:]
    while len(head) > 1 and head[-1] in PLACE_WORDS and head[-1] not in JUNK_WORDS - {"footer"}:
        head.pop()
    about = head[-1] if head[-1] in JUNK_WORDS and not (len(head) < len(words) and len(head) > 1 and head[0] in GOOD_WORDS and words[-1] in GOOD_WORDS) else None
    if about is None and words[0] in JUNK_WORDS and all(w in PLACE_WORDS or w in JUNK_WORDS for w in words[1:]):
        about = words[0]
    if about is None:
        return WEAK
    return COMMENTS if about in COMMENT_WORDS else STRONG


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    """What an element's tag, and the names on it, say of it."""
    if tag in DROPPED:
        return SKIP
    kind = FORM if tag == "form" else HEADER if tag == "header" and not in_article else NONE
    if not attrs or tag in KEPT_TAGS:
        return kind
    names: list[str] = []
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += value.split()
        elif key == "role" and value in JUNK_ROLES:
            kind = kind or STRONG
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return SKIP
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return SKIP
    if kind or any(set(p) <= GOOD_WORDS for p in map(NAME_PART.findall, names) if p):
        return kind
    kinds = {_name_kind(n) for n in names} - {NONE}
    if not kinds and not in_article and any("header" in NAME_PART.findall(n) for n in names):
        return HEADER
    return min(kinds, default=NONE)


class Page:
    def __init__(self):
        self.tag, self.parent, self.kind = ["#root"], [-1], [NONE]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links

    def node(self, tag: str, parent: int, kind: int = NONE) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.kind, kind)):
            column.append(value)
        return len(self.tag) - 1

    def flush(self, at: int, buffer: list[str], links: int) -> None:
        """A block of text inside node `at` ends."""
        text = " ".join("".join(buffer).split())
        if text:
            self.blocks.append((at, text, min(links, len(text))))

    def sums(self, out: list[bool]) -> tuple[list[int], list[int]]:
        """Each element's characters and those in links, without the blocks left out. Children come behind
        their parents."""
        chars, links = [0] * len(self.tag), [0] * len(self.tag)
        for (at, text, linked), gone in zip(self.blocks, out, strict=True):
            if not gone:
                chars[at] += len(text)
                links[at] += linked
        for i in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            links[self.parent[i]] += links[i]
        return chars, links

    def points(self, out: list[bool]) -> list[float]:
        points = [0.0] * len(self.tag)
        for (at, text, _), gone in zip(self.blocks, out, strict=True):
            if gone:
                continue
            gain = BASE_POINT + text.count(",") + min(len(text) / CHARS_PER_POINT, MOST_LENGTH_POINTS)
            node, share = (self.parent[at] if self.tag[at] in PARAGRAPH else at), 1.0
            while node > 0 and share > NEAR_SHARE:
                points[node] += gain * share
                node, share = self.parent[node], share / 2
        return points

    def below(self, marked: list[bool]) -> list[bool]:
        """Whether each element is marked or inside a marked one."""
        found = marked[:]
        for i in range(1, len(found)):
            found[i] = found[i] or found[self.parent[i]]
        return found

    def left_out(self) -> list[bool]:
        """The suspects that are left out, and what they hold."""
        chars, links = self.sums([False] * len(self.blocks))
        plain = [c - k for c, k in zip(chars, links, strict=True)]
        titled = [t in ("h1", "main") for t in self.tag]
        for i in range(len(titled) - 1, 0, -1):
            titled[self.parent[i]] = titled[self.parent[i]] or titled[i]
        out = [False] * len(self.tag)
        for i, kind in enumerate(self.kind):
            if kind == WEAK:
                out[i] = links[i] > MOST_LINKS * chars[i] or plain[i] < SHORT_TEXT
            elif kind in (STRONG, FORM):
                wraps = plain[i] >= WRAPPER_SHARE * plain[0] and (kind == FORM or titled[i])
                out[i] = not (wraps or plain[i] >= MOST_SHARE * plain[0])
            else:
                out[i] = kind in (COMMENTS, HEADER)
        return self.below(out)


class Open:
    """Open elements from the outermost in, with the places of each tag, so that nothing walks through them."""

    def __init__(self):
        self.tags: list[str] = []
        self.nodes: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: int = 0) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        while len(self.tags) > to:
            tag = self.tags.pop()
            self.nodes.pop()
            if tag:
                self.at[tag].pop()
                if tag not in INLINE:
                    self.blocks.pop()

    def forget(self, place: int) -> None:
        """End an element that others go on inside."""
        self.at[self.tags[place]].pop()
        self.tags[place] = ""

    def last(self, *tags: str) -> int:
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)

    def first_behind(self, tags, place: int) -> int:
        """The outermost element of these tags inside the one at this place, -1 if there is none."""
        found = [p[bisect_right(p, place)] for t in tags if (p := self.at.get(t)) and p[-1] > place]
        return min(found, default=-1)

    def ended_by(self, tag: str) -> int:
        """The place of the element that an end tag ends, -1 if there is none: an inline one ends nothing beyond
        its block."""
        at = self.last(tag)
        return -1 if tag in INLINE and self.blocks and self.blocks[-1] > at else at

    def implied(self, tag: str) -> int:
        """The place from which a start tag ends elements, by the rules on optional end tags, or -1."""
        found = []
        if tag in CLOSES_P and (at := self.last("p")) > self.last(*SCOPE):
            found.append(at)
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            if any(self.at.get(t) for t in ends):
                found.append(self.first_behind(ends, self.last(*(scope | BARRIERS if tag in ("li", "dt", "dd") else scope))))
        return min((at for at in found if at >= 0), default=-1)


def parse(source: str) -> Page:
    page = Page()
    stack = Open()  # inline elements share their block's node
    stack.push("#root")
    skip = Open()  # open elements inside a left-out one, with it
    links = 0
    buffer: list[str] = []
    place, end = 0, len(source)

    def text(chunk: str) -> None:
        nonlocal links
        chunk = entities.unescape(chunk) if "&" in chunk else chunk
        buffer.append(chunk)
        if stack.at.get("a"):
            links += len(chunk)

    def end_block() -> None:
        nonlocal links
        if buffer:
            page.flush(stack.nodes[-1], buffer, links)
            buffer.clear()
        links = 0

    def end_ends_skip(tag: str) -> bool:
        """An end tag inside a left-out element: whether it belongs to an open element around that one."""
        barrier = skip.blocks[-1] if tag in INLINE and skip.blocks else skip.last("table") if tag in TABLE_PARTS else skip.last(*(SCOPE if tag == "p" else SCOPE - {"button"}))
        at = skip.last(tag)
        if at >= 0:
            if at >= barrier:
                skip.cut(at)
            return False
        return barrier < 0 and stack.ended_by(tag) > 0

    def start_ends_skip(tag: str) -> bool:
        """A start tag inside a left-out element: whether an end tag that it implies ends that one."""
        if skip.tags == ["head"] and tag not in HEAD_TAGS:
            skip.cut(0)
            return True
        at = skip.implied(tag)
        if at >= 0:
            skip.cut(at)
        else:
            rules = [({"p"}, SCOPE)] if tag in CLOSES_P else []
            if tag in IMPLIED:
                ends, scope = IMPLIED[tag]
                rules.append((ends, scope | BARRIERS if tag in ("li", "dt", "dd") else scope))
            for ends, scope in rules:
                if skip.last(*scope) < 0 and stack.last(*ends) > stack.last(*scope):
                    skip.cut(0)
        return not skip.tags

    while place < end:
        m = TOKEN.search(source, place)
        if m is None:
            if not skip.tags:
                text(source[place:])
            break
        if m.start() > place and not skip.tags:
            text(source[place : m.start()])
        place = m.end()
        name = m[2] or m[5]
        if not name:
            if source.startswith("<![CDATA[", m.start()) and not skip.tags:
                text(source[m.start() + 9 : m.end()].removesuffix("]]>"))
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if skip.tags:
                if not end_ends_skip(tag):
                    continue
                skip.cut(0)
            if tag not in INLINE:
                end_block()
            if (at := stack.ended_by(tag)) > 0:
                stack.cut(at)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, place)
            place = end if stop is None else source.find(">", stop.start()) + 1 or end
            continue
        alone = tag in VOID or attrs.endswith("/") and tag in ("path", "use", "rect", "circle", "line", "g")
        if skip.tags and (tag in ("html", "body") and skip.tags[0] != "head" or not start_ends_skip(tag)):
            if not alone and tag not in ("html", "body") and not (attrs.endswith("/") and (skip.at.get("svg") or skip.at.get("math"))):
                skip.push(tag)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        kind = _kind(tag, attrs, bool(stack.at.get("article") or stack.at.get("main")))
        if tag in INLINE and kind in (NONE, WEAK):
            if tag == "a" and (at := stack.last("a")) > 0:  # links do not nest
                stack.forget(at)
            if not alone and (tag != "a" or "href" in attrs.lower()):
                stack.push(tag, stack.nodes[-1])
            continue
        if tag not in INLINE:
            end_block()
            if (at := stack.implied(tag)) > 0:
                stack.cut(at)
        if alone or tag in ("html", "body") and stack.at.get(tag):
            continue
        if kind == SKIP or tag in INLINE:
            skip.push(tag)
            continue
        stack.push(tag, page.node(tag, stack.nodes[-1], kind))
    if not skip.tags:
        end_block()
    elif buffer:
        page.flush(stack.nodes[-1], buffer, links)
    return page


def _chosen(page: Page, gone: list[bool]) -> list[bool]:
    """The blocks of the best container and of what belongs to it."""
    out = [gone[at] for at, _, _ in page.blocks]
    if all(out):
        return [False] * len(out)
    chars, links = page.sums(out)
    density = [k / c if c else 0.0 for c, k in zip(chars, links, strict=True)]
    score = [p * (1 - d) for p, d in zip(page.points(out), density, strict=True)]
    plain = [c - k for c, k in zip(chars, links, strict=True)]
    top = best = max(range(len(score)), key=lambda i: (score[i], -i))
    around = [top]
    while around[-1] > 0:
        around.append(page.parent[around[-1]])
    for wanted in ("article", "main"):
        if up := next((i for i in around if page.tag[i] == wanted), 0):
            top = up
            break
    kept = [False] * len(page.tag)
    kept[top] = True
    if top == 0 or page.tag[top] in ("article", "main", "body"):
        for i, tag in enumerate(page.tag):
            kept[i] = kept[i] or tag == "article" and page.tag[top] == "article" and plain[i] >= LEAST_TEXT and density[i] < MOST_LINKS
    else:
        path = set(around)
        sentence = [False] * len(page.tag)
        for at, text, _ in page.blocks:
            sentence[at] = sentence[at] or text[-1] in ".!?\u2026\u201d\u3002"
        for i in range(len(sentence) - 1, 0, -1):
            sentence[page.parent[i]] = sentence[page.parent[i]] or sentence[i]
        for i, parent in enumerate(page.parent):
            if parent not in path or i in path or not chars[i] or density[i] >= MOST_LINKS:
                continue
            beside = parent == page.parent[top] and (page.tag[i] in HEADINGS or plain[i] >= SHORT_TEXT or sentence[i])
            kept[i] = beside or plain[i] >= LEAST_TEXT and score[i] >= SIBLING_SHARE * score[best]
    own = page.below(kept)
    # A header inside what is kept is the article's own; so are its blocks, but for suspects in it.
    if top > 0 and page.tag[top] not in ("html", "body"):
        suspect = page.below([k in (STRONG, COMMENTS, FORM) and gone[i] for i, k in enumerate(page.kind)])
        headers = page.below([k == HEADER and own[i] for i, k in enumerate(page.kind)])
        gone = [g and not (h and not s) for g, h, s in zip(gone, headers, suspect, strict=True)]
    return [own[at] and not gone[at] for at, _, _ in page.blocks]


def main_text(source: str | None) -> str:
    """The article's blocks joined by newlines; each block's white space is folded into single spaces."""
    page = parse(source or "")
    if not page.blocks:
        return ""
    gone = page.left_out()
    if all(gone[at] for at, _, _ in page.blocks):
        gone = page.below([k in (HEADER, COMMENTS) for k in page.kind])
    if all(gone[at] for at, _, _ in page.blocks):
        gone = [False] * len(gone)
    chosen = _chosen(page, gone)
    return "\n".join(text for (_, text, _), wanted in zip(page.blocks, chosen, strict=True) if wanted)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""

    def run(batches):
        for part, sources in text_chunks(batches, "html"):
            texts = [main_text(s) for s in sources]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
