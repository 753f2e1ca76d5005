"""The two Arrow functions. Callers pass null for rows the native path settles."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Charsets tried in this order after UTF-8 has failed.
LEGACY_CHARSETS = ("gb18030", "big5")

# Classes of page furniture whose subtree holds no book text.
JUNK_CLASSES = (
    "mw-editsection", "headerContainer", "navbox", "noprint", "printfooter",
    "catlinks", "sisterproject", "mw-empty-elt", "ws-noexport", "license",
    "references", "mw-indicators", "error", "mw-revision",
)
CONTENTS_HEADINGS = ("目錄", "目录")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

SECTIONS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))


def _decode(data: bytes | None) -> str | None:
    if data is None:
        return None
    for charset in LEGACY_CHARSETS:
        try:
            return bytes(data).decode(charset)
        except UnicodeDecodeError:
            pass
    return bytes(data).decode("utf-8", errors="replace")


@F.pandas_udf(T.StringType())
def decode_legacy(content: pd.Series) -> pd.Series:
    return content.map(_decode)


class _Sections(HTMLParser):
    """Sections of one page whose page furniture is nested too deep for the native rule."""

    def __init__(self, levels: tuple[str, ...], junk: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.levels, self.junk = levels, junk
        self.open: list[tuple[str, bool]] = []
        self.sections = [["", []]]
        self.heading: list[str] | None = None
        self.block: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag == "br":
                self._data("\n")
            return
        classes = dict(attrs).get("class") or ""
        self.open.append((tag, any(j in classes for j in self.junk)))
        if tag in self.levels:
            self.heading, self.inside = [], len(self.open)
        elif tag in ("p", "li") and not self._hidden():
            self.block = []

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self._data("\n")

    def handle_endtag(self, tag):
        if tag in self.levels and self.heading is not None:
            self.sections.append(["".join(self.heading).strip(), []])
            self.heading, self.block = None, []
        elif tag in ("p", "li") and not self._hidden():
            line = "".join(self.block).strip()
            if line:
                self.sections[-1][1].append(line)
            self.block = []
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_data(self, data):
        self._data(data)

    def _hidden(self) -> bool:
        return any(junk for _, junk in self.open)

    def _data(self, data: str) -> None:
        if self.heading is not None:
            if not any(junk for _, junk in self.open[self.inside :]):
                self.heading.append(data)
        elif not self._hidden():
            self.block.append(data)

    def result(self) -> list[dict]:
        kept = [(t, lines) for t, lines in self.sections if (t or lines) and t not in CONTENTS_HEADINGS]
        return [{"title": t, "text": "\n".join(lines)} for t, lines in kept]


def sections_nested(levels: tuple[str, ...], junk: tuple[str, ...]):
    """Arrow function: page to array of sections."""

    @F.pandas_udf(SECTIONS)
    def parse(page: pd.Series) -> pd.Series:
        def one(text):
            parser = _Sections(levels, junk)
            parser.feed(text)
            parser.close()
            return parser.result()

        return page.map(one, na_action="ignore")

    return parse
