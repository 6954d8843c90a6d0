"""HTML expressions. Only the unescaping of entities needs Python, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tomeflow.functions.text import col, collapse_space, strip

PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(html.unescape, na_action="ignore")


def strip_html(c: Column | str) -> Column:
    """Tags as spaces, then entities unescaped."""
    return unescape(F.regexp_replace(col(c), "<[^>]+>", " "))


def page_text(c: Column | str) -> Column:
    return collapse_space(strip_html(c))


def without_tags(c: Column | str) -> Column:
    """Tags removed without a space, entities kept."""
    return strip(F.regexp_replace(col(c), "<[^>]+>", ""))


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(PARAGRAPH), F.lit(1)), without_tags), lambda p: p != "")


def title(c: Column | str, fallback_index: Column | str) -> Column:
    """The first heading; else a first paragraph that is short, or chapter-like and not long; else a numbered title."""
    h = col(c)
    has_heading = h.rlike(r"(?is)<h[1-3][^>]*>.*?</h[1-3]>")
    first = without_tags(F.regexp_extract(h, PARAGRAPH, 1))
    chapter_like = first.rlike("(?d)^第.{1,20}[章节卷回]")
    return (
        F.when(has_heading, without_tags(F.regexp_extract(h, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1)))
        .when((chapter_like & (F.length(first) <= 50)) | F.length(first).between(1, 30), first)
        .otherwise(F.format_string("第%d章", col(fallback_index)))
    )


def escape(c: Column | str) -> Column:
    out = col(c)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def chapter_page(heading: Column | str, body: Column | str) -> Column:
    """An XHTML page of a chapter's title and paragraphs; paragraphs that repeat the title are left out."""
    t = col(heading)
    kept = F.filter(col(body), lambda p: strip(p) != strip(t))
    lines = F.concat(F.array(F.concat(F.lit("<h2>"), escape(t), F.lit("</h2>"))), F.transform(kept, lambda p: F.concat(F.lit("<p>"), escape(p), F.lit("</p>"))))
    return F.concat(
        F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), escape(t),
        F.lit('</title><link rel="stylesheet" type="text/css" href="style/default.css"/></head><body>\n'), F.array_join(lines, "\n"), F.lit("\n</body></html>"),
    )
