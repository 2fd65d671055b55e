"""Pages as trees of blocks: a tolerant reader of HTML.

Nodes are block elements and text runs (the text of a block between its child blocks),
in page order, each with its parent's number and its features. Inline elements only
leave their marks on a run: how much of it is linked, and white space at line breaks.
"""

from __future__ import annotations

import re
from html import unescape

# fixed values: elements by kind, as HTML defines them
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "form fieldset legend button select option textarea label figure figcaption blockquote pre address details summary dialog hr center hgroup menu search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg math title canvas audio video".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
FOREIGN = frozenset("svg math".split())
HOSTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())  # what may hold HTML inside svg and math
RAW = frozenset("script style noscript iframe textarea title".split())
CLOSES_P = BLOCKS - frozenset("html body button option label".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = frozenset("label button".split())  # part of the line that they stand in, unless they belong to a form
LINES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote figcaption caption pre address summary".split())  # blocks that hold lines of text
SCOPES = frozenset("html body ul ol dl table article section nav aside main div form blockquote select td th".split())

ENCLOSED = re.compile(r"<(?:template|object|svg|math|canvas|audio|video)[\s>]", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>"'])*+|[^>]*)>""", re.S)
NAMED = re.compile(r"""(class|id|role|itemprop|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")

#: Words in class, id, role and itemprop that tell a block's purpose; the model learns what they mean.
HINTS = frozenset(
    "article content main post entry body story text page ad ads adv advert advertisement banner promo sponsor sponsored nav navigation navbar menu header masthead footer foot sidebar side "
    "aside widget cookie cookies consent notice alert popup modal overlay newsletter subscribe signup comment comments reply replies discussion thread related recommended share sharing social breadcrumb breadcrumbs "
    "pagination pager login form search copyright legal toolbar tags meta author byline caption hidden complementary contentinfo".split()
)


class Page:
    """parent, tag and features by node; text by node, None for elements; truth by node where data-main tells it."""

    def __init__(self):
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.features: list[list[str]] = []
        self.text: list[str | None] = []
        self.truth: list[bool] = []

    def add(self, parent: int, tag: str, features: list[str], text: str | None, truth: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.features.append(features)
        self.text.append(text)
        self.truth.append(truth)
        return len(self.tag) - 1


def _step(n: float, edges: tuple) -> int:
    return sum(n >= e for e in edges)


def _raw_end(html: str, name: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
    return end.end() if end else len(html)


def _hidden(html: str) -> dict[int, int]:
    """Where each closed element of ENCLOSED ends, by the end of its start tag.

    One is unclosed, and hides nothing, if before its end tag an ancestor ends, the body begins,
    or a block begins right in svg or math. A template ends by its own tag only.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}

    def cut(i):
        for gone, _ in stack[i:]:
            held[gone] -= 1
        del stack[i:]

    at = 0
    while found := TAG.search(html, at):
        at = found.end()
        closing, name, rest = found.groups()
        name = (name or "").lower()
        if name in RAW and name in UNSEEN:
            if not closing and not rest.endswith("/"):
                at = _raw_end(html, name, at)
        elif name not in BLOCKS and name not in UNSEEN and name not in HOSTS and name != "head":
            continue
        elif closing:
            if name == "head":
                cut(0)
            elif held.get(name):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        if name in UNSEEN:
                            ends[stack[i][1]] = at
                        cut(i)
                        break
                    if stack[i][0] == "template" and name != "template":
                        break
        elif name not in VOID and not (rest.endswith("/") and name not in BLOCKS):
            if name == "body":
                cut(0)
            if name in BLOCKS:
                while stack and stack[-1][0] in FOREIGN:
                    cut(len(stack) - 1)
            if any(held.get(x) for x in CLOSES.get(name, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[name]:
                        cut(i)
                        break
                    if stack[i][0] in SCOPES or stack[i][0] == "template":
                        break
            stack.append((name, at))
            held[name] = held.get(name, 0) + 1
    return ends


def _linked(page: Page, links: dict[int, int]) -> None:
    """Tell each text run how much is linked of all that stands with it: of the list, table or section around its line.

    An item that is one link says little: in a menu all others are links too.
    """
    around, total = {}, {}
    for i, linked in links.items():
        at = page.parent[i]
        while at > 0 and (page.tag[at] in LINES or page.tag[at] in ("tr", "tbody", "thead", "tfoot")):
            at = page.parent[at]
        around[i] = at
        a, b = total.get(at, (0, 0))
        total[at] = a + linked, b + len(page.text[i])
    for i, at in around.items():
        share = total[at][0] / max(1, total[at][1])
        page.features[i].append(f"text:linked{_step(share, (0.05, 0.4, 0.9))}")


def read(html: str) -> Page:
    """The page's tree. Any string is a page: unknown or unbalanced tags never fail."""
    page = Page()
    root = page.add(-1, "#page", ["tag:#page"], None, False)
    stack, in_head = [(root, "#page", False)], False
    hidden = _hidden(html) if ENCLOSED.search(html) else {}
    run: list[str] = []
    linked = links = 0
    in_link = False
    forms = 0  # that are open
    found_links: dict[int, int] = {}  # by text node

    def flush():
        nonlocal linked, links
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                node, tag, truth = stack[-1]
                share = min(1.0, linked / len(text))
                found_links[len(page.tag)] = min(linked, len(text))
                page.add(node, "#text", [
                    "text", f"text:in:{tag}", f"text:size{_step(len(text), (15, 40, 80, 160, 400))}",
                    f"text:links{min(links, 3)}", "text:stop" if text[-1] in ".!?\"”»" else "text:open", *(["text:copyright"] if "©" in text else []),
                    *(["text:prose"] if len(text) >= 60 and share < 0.2 and text[-1] in ".!?" else []),
                ], text, truth)
            run.clear()
        linked = links = 0

    at, size = 0, len(html)
    while at < size:
        found = TAG.search(html, at)
        piece = html[at : found.start()] if found else html[at:]
        if in_head and piece.strip():
            in_head = False
        if piece and not in_head:
            run.append(piece)
            if in_link:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        closing, name, rest = found.groups()
        if not name:
            continue
        name = name.lower()
        if name in UNSEEN:
            if not closing and not rest.endswith("/"):
                at = _raw_end(html, name, at) if name in RAW else hidden.get(at, at)
            if not closing and name not in IN_HEAD:
                in_head = False
            continue
        if name == "head":
            in_head = not closing
        elif in_head and (name in ("body", "html", "br") if closing else name not in IN_HEAD):
            in_head = False
        if in_head:
            continue
        if name == "a":
            in_link, links = not closing, links + (not closing)
        if name in ("br", "img", "input", "wbr"):
            if name != "wbr":
                run.append(" ")
            continue
        if name not in BLOCKS or (name in WITHIN and stack[-1][1] in LINES and not forms):
            continue
        flush()
        in_link = False
        if name == "form":
            forms = max(0, forms + (-1 if closing else 1))
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] == name:
                    del stack[i:]
                    break
            continue
        if name in CLOSES_P and stack[-1][1] == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i][1] in SCOPES:
                break
        parent, _, truth = stack[-1]
        features = [f"tag:{name}"]
        for key, a, b, c in NAMED.findall(rest) if "=" in rest else ():
            value = (a or b or c).lower()
            if key.lower() == "data-main":
                truth = value == "1"
            else:
                features += {f"hint:{w}" for w in WORD.findall(value) if w in HINTS}
        node = page.add(parent, name, features, None, truth)
        if name not in VOID:
            stack.append((node, name, truth))
    flush()
    _linked(page, found_links)
    for i in range(len(page.tag) - 1, 0, -1):  # what holds main content is labelled so up to the root
        page.truth[page.parent[i]] |= page.truth[i]
    return page
