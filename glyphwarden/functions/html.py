"""HTML parsing on the executors, in Arrow batches."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from glyphwarden import rules
from glyphwarden.functions.screening import _matches, _rule_bits

HTML_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("hidden", T.ArrayType(T.StringType())),
    T.StructField("scripts", T.ArrayType(T.StringType())),
    T.StructField("script_injection", T.IntegerType()),
    T.StructField("script_exfil", T.IntegerType()),
])
_HIDDEN = re.compile(rules.HIDDEN_STYLE, re.IGNORECASE)
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
# Their text is program text, not page text.
_RAW = frozenset(["script", "style", "template"])
# Their white space is kept as it is.
_PREFORMATTED = frozenset(["pre", "textarea"])


class _PageParser(HTMLParser):
    """Collects runs of page text, texts of hidden elements and script bodies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[tuple[str, int | None]] = []  # (tag, slot in hidden or scripts' raw text)
        self.run: list[str] = []
        self.texts: list[str] = []
        self.hidden: list[list[str] | None] = []
        self.scripts: list[list[str]] = []

    def _flush(self) -> None:
        run, self.run = "".join(self.run), []
        if not run:
            return
        # A run of nothing but ASCII white space is one line feed or one blank.
        if not run.strip(" \n\t\f\r") and not any(tag in _PREFORMATTED for tag, _ in self.open):
            run = "\n" if "\n" in run else " "
        raw_tag = next((tag for tag, _ in reversed(self.open) if tag in _RAW), None)
        if raw_tag == "script" and self.open[-1][0] == "script":
            self.scripts[-1].append(run)
        if raw_tag is None:
            self.texts.append(run)
        for tag, slot in self.open:
            if slot is not None and (raw_tag is None or (tag == raw_tag and self.open[-1][0] == raw_tag)):
                self.hidden[slot].append(run.strip())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag in _VOID:
            return
        slot = None
        style = next((value or "" for name, value in reversed(attrs) if name == "style"), "")
        if _HIDDEN.search(style):
            slot = len(self.hidden)
            self.hidden.append([])
        if tag == "script":
            self.scripts.append([])
        self.open.append((tag, slot))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_entityref(self, name: str) -> None:
        self.run.append(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name: str) -> None:
        self.run.append(unescape(f"&#{name};"))

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self.run.append(data[len("CDATA["):])
            self._flush()


def parse_page(source: str) -> tuple[str, list[str], list[str]]:
    """(visible text joined by newlines, texts of hidden elements, script bodies)."""
    parser = _PageParser()
    parser.feed(source)
    parser.close()
    parser._flush()
    hidden = ["".join(pieces) for pieces in parser.hidden]
    return "\n".join(parser.texts), [h for h in hidden if h], ["".join(s) for s in parser.scripts]


def _per_page(bits: np.ndarray, counts: list[int]) -> np.ndarray:
    """OR of the bits of each page's scripts."""
    result = np.zeros(len(counts), dtype=np.int32)
    np.bitwise_or.at(result, np.repeat(np.arange(len(counts)), counts), bits)
    return result


@F.arrow_udf(HTML_TYPE)
def _parse_udf(pages: pa.Array) -> pa.Array:
    parsed = [parse_page(source) if source else ("", [], []) for source in pages.to_pylist()]
    scripts = [p[2] for p in parsed]
    bodies = pa.array([body for page in scripts for body in page], pa.string())
    counts = [len(page) for page in scripts]
    return pa.StructArray.from_arrays(
        [
            pa.array([p[0] for p in parsed], pa.string()),
            pa.array([p[1] for p in parsed], pa.list_(pa.string())),
            pa.array(scripts, pa.list_(pa.string())),
            pa.array(_per_page(_rule_bits(bodies, rules.INJECTION_SCREEN), counts)),
            pa.array(_per_page(_rule_bits(bodies, rules.EXFIL_SCREEN), counts)),
        ],
        ["text", "hidden", "scripts", "script_injection", "script_exfil"],
    )


def parse(html: Column) -> Column:
    return _parse_udf(html)


MARKUP_TYPE = T.StructType([T.StructField("hides", T.BooleanType()), T.StructField("scripts", T.BooleanType())])


def screen_markup(pages: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which pages may have hidden elements, and which scripts that a rule hits; no page that has them is missed.

    A style that hides is an attribute called style, whose value is in the markup as it is unless
    a character reference stands in it. A script's body is in the markup as it is.
    """
    if isinstance(pages, pa.ChunkedArray):
        pages = pages.combine_chunks()
    hides = _matches(pages, "(?i)style")
    rows = np.flatnonzero(hides)
    if len(rows):
        hides[rows] = _matches(pages.take(pa.array(rows)), rules.HIDDEN_SCREEN)
    scripts = _matches(pages, "(?i)<script")
    rows = np.flatnonzero(scripts)
    if len(rows):
        candidates = pages.take(pa.array(rows))
        scripts[rows] = (_rule_bits(candidates, rules.INJECTION_SCREEN) | _rule_bits(candidates, rules.EXFIL_SCREEN)) != 0
    return hides, scripts


@F.arrow_udf(MARKUP_TYPE)
def _screen_udf(pages: pa.Array) -> pa.Array:
    hides, scripts = screen_markup(pages)
    return pa.StructArray.from_arrays([pa.array(hides), pa.array(scripts)], ["hides", "scripts"])


def screen(html: Column) -> Column:
    """struct<hides, scripts>: whether a page is worth parsing for hidden elements or for its scripts."""
    return _screen_udf(html)
