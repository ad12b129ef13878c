"""Elements of a web page, and its blocks of text."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlsplit

#: Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style noscript template iframe object svg math canvas audio video select textarea button title".split())
VERBATIM = set("script style textarea title noscript iframe template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var".split()
)
CLOSES_PARAGRAPH = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre section table ul".split()
)
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements and class or role words that declare what is not the page's text, and what is.
APART = set("nav footer aside form menu dialog header".split())
APART_WORDS = set(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter "
    "subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead toolbar comment comments "
    "reply replies disqus respond share sharing social related recommended teaser widget pagination pager copyright disclaimer search".split()
)
MAIN = {"article", "main"}
#: Elements that hold the page or its text, whatever words they carry.
NEVER_APART = MAIN | {"html", "body"}

#: Those that name adverts, comments, notices or a frame of the page, and so tell more as a part of a name.
FIRM_WORDS = set(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo cookie cookies consent menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer header comment comments reply replies disqus related recommended newsletter".split()
)
#: Parts of a name that turn it into a state of the page.
STATES = set("no not with without has is hide open closed enabled disabled".split())

OPENING = re.compile(r"</?[a-zA-Z]|<[!?]")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: ">" within quotes does not end it.
REST = re.compile(r"([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
#: After so many tags of a page that are never closed, quotes no longer hide a ">".
OPEN_TAGS = 64
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[-_]+")


@dataclass(slots=True)
class Element:
    tag: str
    presentation: str  # element with its classes, digits masked
    parent: int  # place of the enclosing element in the page, -1 for the root
    key: int  # stands for the presentations from the root down
    apart: bool  # declared to be no text of the page, here or above
    hint: int  # a part of its name says so: 2 by a firm word, 1 by another, 0 not at all
    main: bool  # within an article or main element
    hidden: bool
    inline: dict[str, int] = field(default_factory=dict)  # inline elements open in it


@lru_cache(1 << 16)
def node_key(above: int, presentation: str) -> int:
    """Key of an element by its parent's key and its presentation."""
    data = above.to_bytes(8, "little", signed=True) + presentation.encode()
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _present(tag: str, attributes: str) -> tuple[str, set[str]]:
    """Presentation and names: whole classes, ids and roles."""
    if not attributes or attributes.isspace():
        return tag, set()
    named = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    classes = sorted(set(named.get("class", "").split()))
    words = {w for name in named.values() for w in name.split()}
    return ".".join([tag, *(DIGITS.sub("#", c) for c in classes)]), words


def _hint(names: set[str], main: bool) -> int:
    """What parts of names hint at, where no whole name declares it. Within the main
    text a header is text."""
    hint = 0
    for name in names:
        parts = set(PARTS.split(name))
        if len(parts) > 1 and not parts & STATES:
            said = (parts & APART_WORDS) - ({"header"} if main else set())
            hint = max(hint, 2 if said & FIRM_WORDS else 1 if said else 0)
    return hint


def _tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, name, attributes, closing) of each tag; comments and
    declarations have no name. A page of any kind is read in linear time."""
    at, size, left_open = 0, len(page), 0
    last = page.rfind(">")
    while match := OPENING.search(page, at):
        begin = match.start()
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = stop + 3 if stop >= 0 else size
            yield begin, at, "", "", False
        elif begin > last:
            return
        elif page[begin + 1] in "!?":
            at = page.index(">", begin) + 1
            yield begin, at, "", "", False
        else:
            name = NAME.match(page, begin)
            rest = REST.match(page, name.end()) if left_open < OPEN_TAGS else None
            if rest:
                at, attributes = rest.end(), rest[1]
            elif left_open < OPEN_TAGS:
                left_open += 1
                at = begin + 1
                continue
            else:
                at = page.index(">", begin) + 1
                attributes = page[name.end() : at - 1]
            # The caller may send on past a verbatim element.
            at = (yield begin, at, name[2].lower(), attributes, bool(name[1])) or at


def read(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """Elements in page order, a root first, and the blocks in page order: place of
    the element that holds it, and the text with character references decoded and
    white space made one space."""
    elements = [Element("", "", -1, 0, False, 0, False, False)]
    stack = [0]  # places of the open elements
    opened: dict[str, int] = {}  # how many of a tag are open
    found: list[tuple[int, str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text and not elements[stack[-1]].hidden:
                found.append((stack[-1], text))

    def close(depth: int) -> None:
        flush()
        for place in stack[depth:]:
            opened[elements[place].tag] -= 1
        del stack[depth:]

    tags, past, to = _tags(page), 0, None
    while True:
        try:
            begin, end, name, attributes, closing = tags.send(to)
        except StopIteration:
            break
        to = None
        if begin > past:
            held.append(html.unescape(page[past:begin]))
        past = end
        top = elements[stack[-1]]
        if not name:
            continue
        if closing:
            if name in INLINE:
                if top.inline.get(name):
                    top.inline[name] -= 1
                elif top.tag == name:
                    close(len(stack) - 1)
            elif opened.get(name):
                depth = len(stack) - 1
                while elements[stack[depth]].tag != name:
                    depth -= 1
                close(depth)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        presentation, names = _present(name, attributes)
        apart = name in APART or (name not in NEVER_APART and bool(names & APART_WORDS))
        if name in INLINE and not apart:
            top.inline[name] = top.inline.get(name, 0) + 1
            continue
        if name in CLOSES_PARAGRAPH or name in OWN_KIND:
            ends = {"p"} if name in CLOSES_PARAGRAPH else OWN_KIND[name]
            for depth in range(len(stack) - 1, 0, -1):
                tag = elements[stack[depth]].tag
                if tag in ends:
                    close(depth)
                    break
                if tag != "p":
                    break
        flush()
        above = elements[stack[-1]]
        element = Element(
            name, presentation, stack[-1], node_key(above.key, presentation),
            above.apart or (apart and not (name == "header" and above.main)),
            0 if name in NEVER_APART else _hint(names, above.main), above.main or name in MAIN, above.hidden or name in UNSEEN,
        )
        if name in VERBATIM:
            stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, end)
            close_at = page.find(">", stop.start()) if stop else -1
            past = to = close_at + 1 if close_at >= 0 else len(page)
            if name not in UNSEEN:
                held.append(page[end : stop.start() if stop else past])
            continue
        stack.append(len(elements))
        elements.append(element)
        opened[name] = opened.get(name, 0) + 1
    if past < len(page):
        held.append(html.unescape(page[past:]))
    flush()
    return elements, found


def host_of(url: str | None) -> str:
    """Lower-case host of a URL, without a leading www; empty if there is none."""
    try:
        host = (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""
    return host.removeprefix("www.")
