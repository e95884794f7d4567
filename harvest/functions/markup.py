"""Executor-side helpers: one HTML text to a flat element list, and selector matching on it.

No Spark in here. Elements are kept in document order; an element's descendants are the
ordinals ``ord + 1 .. last``. Visible text pieces are stored once, already stripped, and an
element refers to them by a slice.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

# Elements that never hold children.
VOID_TAGS = frozenset(
    """area base basefont bgsound br col command embed frame hr image img input isindex keygen
    link menuitem meta nextid param source spacer track wbr""".split()
)
# Elements whose strings are not part of the text of the elements around them.
QUIET_TAGS = frozenset("rp rt script style template".split())
# Bodies written without escaping / kept with their white space.
RAW_BODY_TAGS = frozenset("script style".split())
KEEP_SPACE_TAGS = frozenset("pre textarea".split())

_SPACE = " \n\t\f\r"


def _escaped_len(text: str) -> int:
    return len(text) + 4 * text.count("&") + 3 * (text.count("<") + text.count(">"))


class Element:
    __slots__ = ("tag", "attrs", "classes", "parent", "depth", "last",
                 "str_from", "str_to", "quiet_from", "text_len", "html_len", "own_text")

    def __init__(self, tag, attrs, classes, parent, depth, str_from, quiet_from, html_start):
        self.tag, self.attrs, self.classes = tag, attrs, classes
        self.parent, self.depth, self.last = parent, depth, -1
        self.str_from, self.str_to, self.quiet_from = str_from, str_from, quiet_from
        self.text_len, self.html_len, self.own_text = 0, html_start, None


class PageTree(HTMLParser):
    """Unclosed tags nest, an end tag closes back to its nearest open match or is ignored."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.elements: list[Element] = []
        self.strings: list[str] = []
        self._str_chars = [0]       # running length of self.strings
        self._quiet: list[tuple[str, str]] = []
        self._stack: list[int] = []
        self._open: dict[str, int] = {}
        self._quiet_stack: list[str] = []
        self._pieces: list[str] = []
        self._written = 0           # serialized characters so far
        self.feed(html)
        self.close()
        self._flush()
        while self._stack:
            self._close_top()

    # -- parser events -------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID_TAGS:
            self._close_top()

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self._close_top()

    def handle_endtag(self, tag):
        if tag in VOID_TAGS or not self._open.get(tag):
            self._flush()
            return
        self._flush()
        while self.elements[self._stack[-1]].tag != tag:
            self._close_top()
        self._close_top()

    def handle_data(self, data):
        self._pieces.append(data)

    def handle_entityref(self, name):
        self._pieces.append(html5.get(name + ";") or "&" + name)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            text = bytes([code]).decode("windows-1252", "ignore") if code < 256 else ""
            text = text or chr(code)
        except (ValueError, OverflowError):
            text = "\N{REPLACEMENT CHARACTER}"
        self._pieces.append(text)

    def handle_comment(self, data):
        self._flush()
        self._written += len(data) + 7

    def handle_decl(self, decl):
        self._flush()
        self._written += len(decl) + 4

    def handle_pi(self, data):
        self._flush()
        self._written += len(data) + 3

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._keep_string(data[6:])
            self._written += len(data) + 6
        else:
            self._written += len(data) + 4

    def updatepos(self, i, j):
        return j                    # line numbers are not needed

    # -- tree building -------------------------------------------------------------------

    def _start(self, tag, attrs):
        self._flush()
        values = {k: "" if v is None else v for k, v in attrs}
        classes = values.get("class", "").split()
        start = self._written
        self._written += len(tag) + 2
        for key, value in values.items():
            if key == "class":
                value = " ".join(classes)
            size = _escaped_len(value)
            if '"' in value and "'" in value:
                size += 5 * value.count('"')
            self._written += len(key) + size + 4
        here = len(self.elements)
        self.elements.append(Element(
            tag, values, classes, self._stack[-1] if self._stack else -1, len(self._stack),
            len(self.strings), len(self._quiet), start))
        self._stack.append(here)
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag in QUIET_TAGS:
            self._quiet_stack.append(tag)

    def _close_top(self):
        self._flush()
        element = self.elements[self._stack.pop()]
        tag = element.tag
        self._open[tag] -= 1
        self._written += 1 if tag in VOID_TAGS else len(tag) + 3
        element.last = len(self.elements) - 1
        element.html_len = self._written - element.html_len
        element.str_to = len(self.strings)
        if tag in QUIET_TAGS:
            self._quiet_stack.pop()
            element.own_text = "".join(
                text for text, kind in self._quiet[element.quiet_from:] if kind == tag)
            element.text_len = len(element.own_text)
        else:
            element.text_len = self._str_chars[element.str_to] - self._str_chars[element.str_from]

    def _flush(self):
        if not self._pieces:
            return
        text = "".join(self._pieces)
        self._pieces.clear()
        if not text.strip(_SPACE) and not any(self._open.get(t) for t in KEEP_SPACE_TAGS):
            text = "\n" if "\n" in text else " "
        parent = self.elements[self._stack[-1]].tag if self._stack else ""
        self._written += len(text) if parent in RAW_BODY_TAGS else _escaped_len(text)
        if self._quiet_stack:
            if text.strip():
                self._quiet.append((text.strip(), self._quiet_stack[-1]))
        else:
            self._keep_string(text)

    def _keep_string(self, text):
        text = text.strip()
        if text:
            self.strings.append(text)
            self._str_chars.append(self._str_chars[-1] + len(text))

    # -- reading -------------------------------------------------------------------------

    def text(self, ordinal: int) -> str:
        element = self.elements[ordinal]
        if element.own_text is not None:
            return element.own_text
        return "".join(self.strings[element.str_from:element.str_to])


# -- selectors -----------------------------------------------------------------------------

_IDENT = r"(?:-?[A-Za-z_\u00a0-\U0010ffff]|--)[A-Za-z0-9_\u00a0-\U0010ffff-]*"
_PART = re.compile(
    rf"(?P<tag>\*|{_IDENT})|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})"
    rf"|\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~|^$*!]?=)\s*"
    rf"(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>{_IDENT}))\s*)?\]"
)
_BETWEEN = re.compile(r"\s*([>,])\s*|\s+")


def compile_selector(text: str) -> list:
    """Comma alternatives, each a list of (combinator, tag, conditions); ValueError if unsupported."""
    alternatives, steps, link, pos = [], [], " ", 0
    text = text.strip()
    while True:
        tag, conditions, start = None, [], pos
        while part := _PART.match(text, pos):
            if part["tag"] is not None:
                if pos != start:
                    break
                tag = part["tag"].lower()
            elif part["id"] is not None:
                conditions.append(("id", "=", part["id"]))
            elif part["cls"] is not None:
                conditions.append(("class", "has", part["cls"]))
            else:
                value = next((part[g] for g in ("dq", "sq", "bare") if part[g] is not None), None)
                conditions.append((part["attr"].lower(), part["op"] or "set", value))
            pos = part.end()
        if pos == start:
            raise ValueError(f"unsupported selector: {text!r}")
        steps.append((link, None if tag == "*" else tag, conditions))
        if pos == len(text):
            return alternatives + [steps]
        gap = _BETWEEN.match(text, pos)
        if gap is None:
            raise ValueError(f"unsupported selector: {text!r}")
        pos = gap.end()
        link = ">" if gap[1] == ">" else " "
        if gap[1] == ",":
            alternatives.append(steps)
            steps = []


def _holds(element: Element, name: str, op: str, want: str | None) -> bool:
    if op == "has":
        return want in element.classes
    have = element.attrs.get(name)
    if op == "set":
        return have is not None
    if have is None:
        return op == "!="
    if name == "class":
        have = " ".join(element.classes)
    if name == "type":              # the one attribute whose values ignore case in HTML
        have, want = have.lower(), want.lower()
    if op in ("=", "!="):
        return (have == want) == (op == "=")
    if op == "|=":
        return have == want or have.startswith(want + "-")
    if not want:
        return False
    if op == "~=":
        return want in have.split()
    return {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](want)


def match_selector(elements: list[Element], alternatives: list) -> list[int]:
    """Ordinals of matching elements in document order; one pass per step."""
    found: set[int] = set()
    for steps in alternatives:
        hit: list[bool] = []
        for number, (link, tag, conditions) in enumerate(steps):
            inside = [False] * len(elements)    # has an ancestor in the previous step
            now = [False] * len(elements)
            for i, e in enumerate(elements):
                up = e.parent
                near = number > 0 and up >= 0 and hit[up]
                inside[i] = near or (up >= 0 and inside[up])
                if number == 0 or (near if link == ">" else inside[i]):
                    now[i] = (tag is None or e.tag == tag) and all(
                        _holds(e, *c) for c in conditions)
            hit = now
        found.update(i for i, ok in enumerate(hit) if ok)
    return sorted(found)
