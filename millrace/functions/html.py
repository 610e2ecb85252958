"""HTML as an ordered stream of events: text, anchors, automatically loaded resources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

# Which elements break lines, which loaded addresses are read, and from where.
BLOCKS = frozenset(
    "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
    "section summary table tbody tfoot thead tr ul".split()
)
CELLS, UNREAD = frozenset(("td", "th")), frozenset(("script", "style", "template"))
LOADED = {
    "img": ("img", "src"), "input": ("img", "src"), "source": ("img", "src"), "video": ("other", "src poster"), "iframe": ("iframe", "src"), "frame": ("iframe", "src"),
    "link": ("link", "href"), "object": ("other", "data"), "embed": ("other", "src"), "audio": ("other", "src"), "track": ("other", "src"),
    "body": ("other", "background"), "table": ("other", "background"), "td": ("other", "background"), "th": ("other", "background"),
}
SPACES = dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
IMPORT = re.compile(r"""@import\s+(?:"([^"]*)"|'([^']*)')""", re.IGNORECASE)

#: Fixed value: a reference to a part by its Content-ID.
CID = re.compile(r"""(?<![\w+.-])cid:([^\s"'<>()?#]+)""", re.IGNORECASE)

_OPENS = re.compile(r"""url\(\s*+(["'])?""", re.IGNORECASE)
_CLOSES = re.compile(r"\s*+\)")
_BARE = re.compile(r"([^)\s]*+)\s*+(\))?")


#: What :func:`tags_removed` reads. Case is folded as the SQL's engine does it: besides ASCII, of the long s and the Kelvin sign.
_OPENS_UNREAD = re.compile("<!--|<(?:script|style|template)")
_CLOSES_UNREAD = re.compile("</(?:script|style|template)>")
_NAMES = "|".join(sorted(BLOCKS)).replace("s", "[s\u017f]").replace("k", "[k\u212a]")
_BREAKS, _CELL, _TAG = (re.compile(p, re.IGNORECASE | re.ASCII) for p in (rf"</?(?:{_NAMES})(?: [^>]*)?>|<br[^>]*>", "<t[dh][^>]*>", "<[^>]*>"))
_CLOSED = {"&copy;": "\xa9", "&middot;": "\xb7", "&quot;": '"', "&amp;": "&"}


class Event(NamedTuple):
    kind: str  # text, anchor or resource
    href: str | None
    text: str | None
    element: str | None


def css_urls(css: str) -> Iterator[str]:
    """What each ``url(...)`` holds, quoted or not, in order; then what is imported by name.

    An opening that nothing closes is skipped. All openings of a stretch without white space
    end where it ends, so one that fails unquoted speaks for the rest of its stretch; and the
    next quote after a place is the same until it is passed."""
    at = barren = 0
    quoted = {'"': -1, "'": -1}
    while m := _OPENS.search(css, at):
        at = m.start() + 1
        if quote := m[1]:
            if quoted[quote] < m.end():
                found = css.find(quote, m.end())
                quoted[quote] = found if found >= 0 else len(css)
            if closed := _CLOSES.match(css, quoted[quote] + 1):
                yield css[m.end() : quoted[quote]]
                at = closed.end()
                continue
        start = m.start(1) if quote else m.end()
        if start >= barren:
            bare = _BARE.match(css, start)
            if bare[2]:
                yield bare[1]
                at = bare.end()
            else:
                barren = bare.end(1)
    for m in IMPORT.finditer(css):
        yield m[1] or m[2] or ""


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []
        self.shown: list[str] = []
        self.unread: list[str] = []
        self.anchor: tuple[str, list[str]] | None = None

    def gap(self, tag: str) -> None:
        if tag in BLOCKS:
            self.shown.append("\n")
        elif tag in CELLS:
            self.shown.append(" ")

    def loads(self, element: str, *addresses: str) -> None:
        self.events += [Event("resource", a, None, element) for a in map(str.strip, addresses) if a]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNREAD:
            self.unread.append(tag)
            return
        has = {k: v or "" for k, v in attrs}
        self.gap(tag)
        if tag == "br":
            self.shown.append("\n")
        if tag in LOADED and (tag != "input" or has.get("type", "").lower() == "image"):
            element, names = LOADED[tag]
            self.loads(element, *(has.get(n, "") for n in names.split()))
        if tag in ("img", "source"):
            self.loads("img", *(c.strip().split(" ")[0] for c in has.get("srcset", "").split(",")))
        self.loads("style", *css_urls(has.get("style", "")))
        href = has.get("href", "").strip()
        if href and tag == "a":
            self.close_anchor()
            self.anchor = (href, [])
        elif href and tag == "area":
            self.events.append(Event("anchor", href, None, tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in UNREAD:
            self.unread.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in UNREAD:
            del self.unread[-1:]
            return
        if tag == "a":
            self.close_anchor()
        self.gap(tag)

    def handle_data(self, data: str) -> None:
        if self.unread:
            if self.unread[-1] == "style":
                self.loads("style", *css_urls(data))
            return
        self.shown.append(data)
        self.events.append(Event("text", None, data, None))
        if self.anchor:
            self.anchor[1].append(data)

    def close_anchor(self) -> None:
        if self.anchor:
            href, text = self.anchor
            self.anchor = None
            self.events.append(Event("anchor", href, "".join(text).strip() or None, "a"))


def settled(text: str) -> str:
    """White space as it is shown: runs are one space, three line breaks or more are two."""
    text = re.sub(r"[ \t\f\v]+", " ", text.replace("\r\n", "\n").replace("\r", "\n").translate(SPACES))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def read_html(html: str) -> tuple[list[Event], str]:
    """Events in document order, and the text that a reader would see."""
    r = _Reader()
    try:
        r.feed(html)
        r.close()
    except Exception:  # hostile markup never costs more than its own rest
        pass
    r.close_anchor()
    return r.events, settled("".join(r.shown))


def _without_unread(html: str) -> str:
    """Without comments and unread elements that are closed. What nothing closes stays, and an
    end that is not found once is not searched for again."""
    pieces, kept, at = [], 0, 0
    comments = elements = True
    while (comments or elements) and (m := _OPENS_UNREAD.search(html, at)):
        at, end = m.end(), -1
        if m[0] == "<!--":
            if comments and (close := html.find("-->", m.end())) >= 0:
                end = close + 3
            else:
                comments = False
        elif elements:
            opened = html.find(">", m.end())
            if opened >= 0 and (close := _CLOSES_UNREAD.search(html, opened + 1)):
                end = close.end()
            else:
                elements = False
        if end >= 0:
            pieces.append(html[kept : m.start()])
            kept = at = end
    return "".join([*pieces, html[kept:]])


def _replaced(tags: re.Pattern[str], by: str, text: str) -> str:
    """No tag ends after the last ``>``, so none is searched for there."""
    last = text.rfind(">") + 1
    return tags.sub(by, text[:last]) + text[last:]


def tags_removed(html: str) -> str:
    """The text of HTML as plain replacements give it: tags are what stands between ``<`` and
    ``>``, and four named references are read, each with its ``;``. Linear in the text. What a
    reader would see is :func:`read_html`'s."""
    t = _replaced(_TAG, "", _replaced(_CELL, " ", _replaced(_BREAKS, "\n", _without_unread(html))))
    for reference, char in _CLOSED.items():
        t = t.replace(reference, char)
    return re.sub(r"\n{3,}", "\n\n", re.sub(" ?\n ?", "\n", re.sub(r"[ \t\f\v]+", " ", t))).strip(" \n")


def pointed(html: str, names: dict[str, str]) -> str:
    """The HTML with every reference to a named part's Content-ID, matched whole, made its name."""
    pieces, at = [], 0
    for m in CID.finditer(html):
        if m[1] in names:
            pieces += html[at : m.start()], names[m[1]]
            at = m.end()
    return "".join([*pieces, html[at:]])
