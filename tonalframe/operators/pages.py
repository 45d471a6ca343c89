"""Small parsers for pages and broken JSON, applied to batches of rows."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is dropped, elements that begin a line, and those whose end does.
DROPPED = frozenset(["script", "style", "nav", "header", "footer", "noscript", "svg"])
BREAKS = frozenset(["p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "pre"])
ENDS = frozenset(["p", "div", "tr", "li", "pre"])


class _Lines(HTMLParser):
    """Text of a page with a line break before an element of BREAKS and after one of ENDS; what stands in dropped elements goes."""

    def __init__(self):
        super().__init__()
        self.dropped, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped.append(tag)
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.dropped[-1:] == [tag]:
            self.dropped.pop()
        elif tag in ENDS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)


def lines_of(page: str | None) -> list[str]:
    parser = _Lines()
    parser.feed(page or "")
    parser.close()
    return [x for x in map(str.strip, "".join(parser.parts).split("\n")) if x]


def text_lines(pages: DataFrame, html_col: str) -> DataFrame:
    """page_id, line_no, line."""

    @F.pandas_udf("array<string>")
    def lines(html: pd.Series) -> pd.Series:
        return html.map(lines_of)

    return pages.select("page_id", F.posexplode(lines(F.col(html_col))).alias("line_no", "line"))


def closers(text: str) -> str | None:
    """The brackets that would close a JSON text; None if it ends inside a string."""
    stack, inside, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not inside and stack[-1:] == [c]:
            stack.pop()
    return None if inside else "".join(reversed(stack))


def closed(text: str | None) -> str | None:
    """A readable JSON object from a text that is cut off: the longest beginning that ends with a closed bracket, or, if there is none, the
    text without its unfinished string, each closed by the brackets still open. Null if neither can be read."""
    if text is None:
        return None
    ends = [m.end() for m in re.finditer(r"[\]}]", text)]
    begun = text if closers(text) is not None else text[: text.rfind('"')].rstrip(", \t\r\n")
    for part in (*(text[:e] for e in reversed(ends)), begun):
        tail = closers(part)
        if tail is not None:
            try:
                if isinstance(json.loads(part + tail), dict):
                    return part + tail
            except ValueError:
                continue
    return None


def salvaged(rows: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf("string")
    def repair(text: pd.Series) -> pd.Series:
        return text.map(closed)

    return rows.withColumn(column, F.when(F.try_parse_json(column).isNotNull(), F.col(column)).otherwise(repair(F.col(column))))
