"""Cuts the HTML of a page into tokens, inside a Spark task: a small helper around the tokenizer of the standard library.

Nothing here knows what is open: start tags, end tags and strings are listed as they come. Whatever the tree is, Spark derives
(``operators.parse``). A tag of a void element is followed by its end at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa

# Elements without content.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Tokens and characters of HTML per Arrow batch, to bound the memory of the worker (one page at least).
_BATCH_TOKENS = 200_000
_BATCH_CHARS = 32_000_000


class Tokens(HTMLParser):
    """Writes the tokens of one page after the other into growing columns: kind, name or string, attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.clear()

    def clear(self) -> None:
        self.kind, self.value, self.attrs, self.ends = [], [], [], [0]

    def read(self, html: str) -> str | None:
        """Adds one page; returns why reading stopped early, if it did."""
        self.reset()
        self.strings: list[str] = []
        self.closed_void: Counter[str] = Counter()
        error = None
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError) as problem:
            error = str(problem)
        self._string("text")
        self.ends.append(len(self.kind))
        return error

    def _add(self, kind: str, value: str, attrs: dict | None = None) -> None:
        self.kind.append(kind)
        self.value.append(value)
        self.attrs.append(attrs)

    def _string(self, kind: str) -> None:
        if self.strings:
            self._add(kind, "".join(self.strings))
            self.strings = []

    def _special(self, data: str, kind: str) -> None:
        self._string("text")
        self.strings.append(data)
        self._string(kind)

    def handle_starttag(self, tag, attrs):
        self._string("text")
        self._add("start", tag, {name: value or "" for name, value in attrs})
        if tag in VOID_TAGS:
            self._add("end", tag)
            self.closed_void[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._string("text")
        self._add("start", tag, {name: value or "" for name, value in attrs})
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.closed_void[tag]:
            self.closed_void[tag] -= 1
        else:
            self._string("text")
            self._add("end", tag)

    def handle_data(self, data):
        self.strings.append(data)

    def handle_charref(self, name):
        self.strings.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.strings.append(html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self._special(data, "comment")

    def handle_decl(self, decl):
        self._special(decl[8:] if decl[:8].upper() == "DOCTYPE " else decl, "doctype")

    def unknown_decl(self, data):
        if data[:6].upper() == "CDATA[":
            self._special(data[6:], "text")
        else:
            self._special(data, "declaration")

    def handle_pi(self, data):
        self._special(data, "instruction")


def _to_batch(made: Tokens, ids: list, urls: list, errors: list) -> pa.RecordBatch:
    listed = [list((a or {}).items()) for a in made.attrs]
    ends = np.cumsum([0, *map(len, listed)]).astype(np.int32)
    text = lambda values: pa.array(values, pa.string())
    attrs = pa.MapArray.from_arrays(pa.array(ends), text([k for a in listed for k, _ in a]), text([v for a in listed for _, v in a]))
    tokens = pa.StructArray.from_arrays([text(made.kind), text(made.value), attrs], ["kind", "value", "attrs"])
    lists = pa.ListArray.from_arrays(pa.array(made.ends, pa.int32()), tokens)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), text(urls), lists, text(errors)], ["page_id", "url", "tokens", "error"])


def tokenize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, ids, urls, errors, chars = Tokens(), [], [], [], 0
    for batch in batches:
        for page_id, url, html in zip(*(batch.column(c) for c in range(3))):
            text = html.as_py() or ""
            chars += len(text)
            errors.append(made.read(text))
            ids.append(page_id.as_py())
            urls.append(url.as_py())
            if len(made.kind) >= _BATCH_TOKENS or chars >= _BATCH_CHARS:
                yield _to_batch(made, ids, urls, errors)
                made.clear()
                ids, urls, errors, chars = [], [], [], 0
    if ids:
        yield _to_batch(made, ids, urls, errors)
