"""Text of web pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom.functions.text import let, squash


def page_text_regex(html: Column) -> Column:
    """Text of the lines of a page that hold ``<span`` or ``<p``, in this order.

    Works by line and pattern, without reading the markup's structure.
    """
    rest = F.regexp_replace(html, C.PAGE_HEAD, "")
    for pattern in C.PAGE_REMOVED:
        rest = F.regexp_replace(rest, pattern, "")

    def read(text: Column) -> Column:
        found = F.concat(
            F.regexp_extract_all(text, F.lit(C.PAGE_SPAN), F.lit(0)),
            F.regexp_extract_all(text, F.lit(C.PAGE_PARAGRAPH), F.lit(0)),
        )
        texts = F.transform(found, lambda line: F.regexp_extract(line, C.PAGE_TEXT, 1))
        return F.array_join(F.filter(texts, lambda t: t != ""), " ")

    return let(rest, read)


def page_text(body: Column, content_type: Column) -> Column:
    """JSON documents as they are, pages as text."""
    return F.when(content_type == "application/json", body).otherwise(page_text_regex(body))


def clean_html(html: Column, limit: int | None = None) -> Column:
    """Markup without scripts and styles; whole, unless the caller states a limit."""
    cleaned = F.regexp_replace(html, C.SCRIPT_OR_STYLE, "")
    return cleaned if limit is None else F.left(cleaned, F.lit(limit))


# The void elements of the HTML standard, and elements whose own text does not belong
# to the text around them.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ASIDE = frozenset("script style template rt rp".split())

_TOKEN = re.compile(r"[.#]?[\w-]+|\*|\[\s*([\w-]+)\s*(?:(\^?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


def _compound(text: str) -> list:
    """Tests of one element: (kind, name, operator, value)."""
    tests, end = [], 0
    for token in _TOKEN.finditer(text):
        if token.start() != end:
            break
        word, end = token.group(), token.end()
        if word[0] == "[":
            tests.append(("attr", token.group(1).lower(), token.group(2), token.group(3)))
        elif word[0] in ".#":
            tests.append(("class" if word[0] == "." else "id", word[1:], None, None))
        elif word != "*":
            tests.append(("tag", word.lower(), None, None))
    if end != len(text) or not text:
        raise ValueError(f"selector not supported: {text!r}")
    return tests


def parse_selector(selector: str) -> list[list]:
    """Alternatives, each a list of compound tests from the outer element to the inner one.

    Understood are ``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``, ``[attr^=v]``, their
    combinations, descendants (blank) and alternatives (comma).
    """
    return [
        [_compound(c) for c in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", part)]
        for part in selector.split(",")
        if part.strip()
    ] or [[_compound("")]]


def _fits(element: tuple, tests: list) -> bool:
    tag, attrs = element
    for kind, name, operator, value in tests:
        if kind == "tag":
            ok = tag == name
        elif kind == "class":
            ok = name in (attrs.get("class") or "").split()
        elif kind == "id":
            ok = attrs.get("id") == name
        else:
            have = attrs.get(name)
            ok = name in attrs and (
                operator is None
                or (have == value if operator == "=" else bool(value) and (have or "").startswith(value))
            )
        if not ok:
            return False
    return True


class _Selected(HTMLParser):
    """Collects the text of the elements a selector picks, in document order."""

    def __init__(self, alternatives: list[list]):
        super().__init__(convert_charrefs=True)
        self.alternatives = alternatives
        self.open: list[tuple] = []
        self.texts: list[list[str]] = []
        self.running: list[tuple[int, list[str]]] = []

    def _picked(self) -> bool:
        for compounds in self.alternatives:
            if not _fits(self.open[-1], compounds[-1]):
                continue
            left = len(compounds) - 2
            for element in reversed(self.open[:-1]):
                if left < 0:
                    break
                left -= _fits(element, compounds[left])
            if left < 0:
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, dict(attrs)))
        if self._picked():
            self.texts.append([])
            self.running.append((len(self.open), self.texts[-1]))
        if tag in _VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close()

    def handle_endtag(self, tag):
        if any(name == tag for name, _ in self.open):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        while self.running and self.running[-1][0] == len(self.open):
            self.running.pop()
        return self.open.pop()[0]

    def handle_data(self, data):
        inner = len(self.open)
        aside = bool(inner) and self.open[-1][0] in _ASIDE
        for depth, text in self.running:
            if not aside or depth == inner:
                text.append(data)


def select_text(html: str | None, alternatives: list[list]) -> str:
    """The selected elements' text, joined by blanks."""
    if not html:
        return ""
    page = _Selected(alternatives)
    page.feed(html)
    page.close()
    return " ".join("".join(text) for text in page.texts)


def select_texts(pages: pa.Array, alternatives: list[list]) -> pa.Array:
    """``select_text`` of each page; one page at a time is a Python text."""
    return pa.array((select_text(page.as_py(), alternatives) for page in pages), pa.string())


def selected_text(html: Column, selector: str) -> Column:
    """Text of the elements a selector picks, white space collapsed.

    Reading markup has no built-in counterpart, so this runs in Arrow batches in Python. Pages are taken
    out of a batch one at a time, so that a task holds no second copy of it.
    """
    alternatives = parse_selector(selector)

    @F.arrow_udf("string")
    def pick(pages: pa.Array) -> pa.Array:
        return select_texts(pages, alternatives)

    return squash(F.replace(pick(html), F.lit("\r"), F.lit("")))
