"""Per-value markup work on verse texts: HTML spans, footnotes, visible text.

Each function is an Arrow UDF over a column of XML; the parsers are the
standard library's.  Everything around them (numbering, joining, grouping) is
relational.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from xml.dom import minidom
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.functions.betacode import convert_with_sigmas

TextHook = Callable[[str, dict], str]
NodeHook = Callable[[str, dict], "str | None"]

_SEGMENT = re.compile(r"\s+|[\[\],.:;]|[^\s\[\],.:;]+")
_NO_WORD = re.compile(r"[\s\[\],.:;]")


def _greek_if_asked(text: str, language: str | None) -> str:
    return convert_with_sigmas(text) if language is not None and language.lower() == "greek" else text


class _Spans(HTMLParser):
    """Writes every element as a span whose class is the tag; attributes become ``data-`` attributes."""

    def __init__(self, text_hook: TextHook | None, node_hook: NodeHook | None, root_tag: str | None):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, dict]] = []
        self.text_hook, self.node_hook, self.root_tag = text_hook, node_hook, root_tag
        self.seen = 0

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        custom = self.node_hook(tag, attributes) if self.node_hook else None
        name = self.root_tag if self.root_tag and self.seen == 0 else "span"
        self.seen += 1
        if custom is not None:
            self.out.append(custom)
        else:
            shown = "" if name != "span" else f" class={quoteattr(tag)}"
            shown += "".join(f" data-{k}={quoteattr(v)}" for k, v in attributes.items())
            self.out.append(f"<{name}{shown}>")
        self.open.append((name if custom is None else "span", {"tag": tag, **attributes}))

    def handle_endtag(self, tag):
        if self.open:
            self.out.append(f"</{self.open.pop()[0]}>")

    def handle_data(self, data):
        if self.open:
            self.out.append(self.text_hook(data, self.open[-1][1]) if self.text_hook else escape(data))

    def text(self) -> str:
        return "".join(self.out) + "".join(f"</{name}>" for name, _ in reversed(self.open))


def _wrapping_hook(language: str | None, wrap: bool) -> TextHook:
    """Convert text by the language of its element and wrap words; notes and English stay."""

    def hook(text: str, parent: dict) -> str:
        lang = parent.get("lang", language)
        if parent["tag"] == "note" or lang is None or lang.lower() == "english":
            return escape(text)
        if not wrap:
            return escape(_greek_if_asked(text, lang))
        return "".join(
            escape(s) if _NO_WORD.match(s) else f'<span class="word">{escape(_greek_if_asked(s, lang))}</span>'
            for s in _SEGMENT.findall(text)
        )

    return hook


def html_converter(
    text_hook: TextHook | None = None, node_hook: NodeHook | None = None, wrap_words: bool = False, root_tag: str | None = None
) -> Callable[[Column, Column], Column]:
    """Make a column function (xml, language) -> HTML.

    ``text_hook`` (text, element) and ``node_hook`` (tag, attributes) override
    how text is written and how an element is opened.
    """

    @F.pandas_udf(T.StringType())
    def convert(xml: pd.Series, language: pd.Series) -> pd.Series:
        def one(x, lang):
            if x is None:
                return None
            parser = _Spans(text_hook or _wrapping_hook(lang, wrap_words), node_hook, root_tag)
            parser.feed(x)
            parser.close()
            return parser.text()

        return pd.Series([one(x, lang) for x, lang in zip(xml, language)], dtype=object)

    return convert


class _Notes(HTMLParser):
    """Visible text with ``[n]`` where a note stands, and the notes' texts."""

    def __init__(self, language: str | None, first: int):
        super().__init__(convert_charrefs=True)
        self.language, self.first = language, first
        self.visible: list[str] = []
        self.notes: list[list[str]] = []
        self.inner: list[list[str]] = []
        self.depth = 0
        self.langs: list[str | None] = []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += 1
        elif tag == "note":
            self.visible.append(f"[{self.first + len(self.notes)}]")
            self.notes.append([])
            self.depth = 1
        self.langs.append(dict(attrs).get("lang"))

    def handle_endtag(self, tag):
        if self.langs:
            self.langs.pop()
        if self.depth:
            self.depth -= 1

    def handle_data(self, data):
        language = (self.langs[-1] if self.langs else None) or self.language
        # The words of a note are its own; converted are those of elements inside it.
        own = self.depth == 1
        text = data if own else _greek_if_asked(data, language)
        (self.notes[-1] if self.depth else self.visible).append(text)


NOTE_TEXT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(NOTE_TEXT)
def text_and_notes(xml: pd.Series, language: pd.Series, first_number: pd.Series) -> pd.DataFrame:
    """Visible text, notes replaced by ``[n]`` counting from ``first_number``, and the note texts."""
    texts, notes = [], []
    for x, lang, first in zip(xml, language, first_number):
        if x is None:
            texts.append(None)
            notes.append(None)
            continue
        parser = _Notes(lang, int(first))
        parser.feed(x)
        parser.close()
        texts.append("".join(parser.visible))
        notes.append(["".join(n) for n in parser.notes])
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "notes": pd.Series(notes, dtype=object)})


class _AllNotes(HTMLParser):
    """Texts of all notes, nested ones too, in order of their start."""

    def __init__(self, language: str | None):
        super().__init__(convert_charrefs=True)
        self.language = language
        self.found: list[list[str]] = []
        self.open: list[tuple[str, int | None, str | None]] = []

    def handle_starttag(self, tag, attrs):
        number = None
        if tag == "note":
            number = len(self.found)
            self.found.append([])
        self.open.append((tag, number, dict(attrs).get("lang")))

    def handle_endtag(self, tag):
        if self.open:
            self.open.pop()

    def handle_data(self, data):
        own = bool(self.open) and self.open[-1][0] == "note"
        language = (self.open[-1][2] if self.open else None) or self.language
        text = data if own else _greek_if_asked(data, language)
        for _, number, _ in self.open:
            if number is not None:
                self.found[number].append(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def footnotes(xml: pd.Series, language: pd.Series) -> pd.Series:
    """Texts of the footnotes of a verse or division."""

    def one(x, lang):
        if x is None:
            return None
        parser = _AllNotes(lang)
        parser.feed(x)
        parser.close()
        return ["".join(n) for n in parser.found]

    return pd.Series([one(x, lang) for x, lang in zip(xml, language)], dtype=object)


def _hidden(node) -> bool:
    return node.nodeName in ("sup", "span") and "hide" in node.getAttribute("class").split(" ")


@F.pandas_udf(T.StringType())
def prune_hidden(xml: pd.Series) -> pd.Series:
    """XML without its hidden ``sup`` and ``span`` sub-trees; what is not well formed comes back unchanged."""

    def one(x):
        try:
            document = minidom.parseString(x.encode("utf-8"))
        except ExpatError:
            return x
        stack = [document.documentElement]
        while stack:
            node = stack.pop()
            for child in list(node.childNodes):
                if child.nodeType == child.ELEMENT_NODE:
                    if _hidden(child):
                        node.removeChild(child)
                    else:
                        stack.append(child)
        return document.documentElement.toxml()

    return xml.map(one, na_action="ignore")
