"""Text of HTML pages: a chain of built-in expressions for well-formed pages, an Arrow function with a real parser for any."""
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# Tags that begin a line when they open or close.
OPENING = ("p", "br", "div", "section", "article", "tr", "li", "h1", "h2", "h3", "h4", "td")
CLOSING = ("p", "div", "section", "article", "tr", "li", "h1", "h2", "h3", "h4")


def stripped(html: Column, bare: tuple[str, ...] | None = None) -> Column:
    """The text of a page, a line for each block, blank lines left out; entities are decoded twice, as the line join and clean both do; `bare` as in unescape().

    For pages without > inside attribute values and with closed scripts; other ones need parsed()."""
    out = F.coalesce(html, F.lit(""))
    for pattern, new in (
        (r"(?is)<(script|style)\b.*?</\1\s*>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"<![^>]*>", ""),
        (rf"(?i)<(?:{'|'.join(OPENING)})(?=[\s/>])[^>]*>", "\n"),
        (rf"(?i)</(?:{'|'.join(CLOSING)})\s*>", "\n"),
        (r"<[^>]*>", ""),
    ):
        out = F.regexp_replace(out, pattern, new)
    lines = F.regexp_replace(T.unescape(out, bare), r"(?U)\s*[\n\r\x0B\f\x1c-\x1e\x85  ]\s*", "\n")
    return T.clean(lines, bare)


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in OPENING:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in CLOSING:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str | None, bare: tuple[str, ...] | None = None) -> str:
    """The parser decodes every reference with or without a semicolon; with `bare`, those of other names without one are kept as they are."""
    kept = html or ""
    if bare is not None:
        kept = re.sub(rf"&(?!(?:{'|'.join(bare) or '(?!)'})(?![A-Za-z0-9]))(?=[A-Za-z][A-Za-z0-9]*+(?!;))", "&amp;", kept)
    p = _Lines()
    p.feed(kept)
    return "\n".join(x for line in "".join(p.parts).splitlines() if (x := line.strip()))


def parsed(html: Column, bare: tuple[str, ...] | None = None) -> Column:
    """As stripped(), for any page, by a parser in Arrow batches."""

    @F.pandas_udf(StringType())
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: text_of(x, bare))

    return T.clean(of(html), bare)


def meta(html: Column, name: str) -> Column:
    """The content of the meta tag of that name or property; empty if there is none."""
    return T.strip(T.unescape(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?i)<meta\s+[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"'][^>]*>", 1)))


# Where the bodies of article pages begin and end, in the order in which they are tried.
BODIES = (
    r"(?is)<div\s+class=[\"']detail-news[\"'][^>]*>(.*?)(?:</div>\s*</div>|<div\s+class=[\"']pages|<script\b)",
    r"(?is)<div\s+class=[\"']content[\"'][^>]*>(.*?)(?:</div>\s*</div>\s*<div\s+class=[\"']footer|<div\s+class=[\"']footer|</body>)",
)


def article(html: Column, bare: tuple[str, ...] | None = None) -> Column:
    """Title and date of the meta tags, then the text of the article's body, or of the whole page."""
    body = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in BODIES], html)
    head = F.array_join(F.filter(F.array(meta(html, "ArticleTitle"), meta(html, "PubDate")), lambda x: x != ""), "\n")
    return T.strip(F.concat(F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(""), stripped(body, bare)))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))
