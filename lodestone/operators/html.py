"""HTML to markdown: an ordered chain of rewrites, in one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import code_point, js_trim

#: Elements dropped with their content.
DROPPED = ("script", "style", "nav", "header", "footer")
_LINE = "[^\\n\\r\\u2028\\u2029]*?"

#: Pattern and replacement, in order; a pattern's ``.`` stays within a line unless it is written out.
REWRITES: tuple[tuple[str, str], ...] = (
    *((f"(?i)<{t}[^>]*>[\\s\\S]*?</{t}>", "") for t in DROPPED),
    *((f"(?i)<h{n}[^>]*>({_LINE})</h{n}>", "#" * n + " $1\n") for n in (1, 2, 3, 4)),
    ("(?i)<pre[^>]*><code[^>]*>([\\s\\S]*?)</code></pre>", "```\n$1\n```\n"),
    (f"(?i)<code[^>]*>({_LINE})</code>", "`$1`"),
    (f'(?i)<a[^>]*href="([^"]*)"[^>]*>({_LINE})</a>', "[$2]($1)"),
    (f"(?i)<li[^>]*>({_LINE})</li>", "- $1\n"),
    ("(?i)<p[^>]*>([\\s\\S]*?)</p>", "$1\n\n"),
    ("(?i)<br\\s*/?>", "\n"),
    ("<[^>]+>", ""),
)
#: Named entities in order; the ampersand comes after the numeric ones, so nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))


def _numeric(text: Column, pattern: str, base: int) -> Column:
    """Numeric entities as characters; those that name none go."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
    prefix = "&#x" if base == 16 else "&#"

    def replace(t: Column, digits: Column) -> Column:
        n = F.when(F.char_length(F.ltrim(F.lit("0"), digits)) <= 7, F.conv(digits, base, 10).cast("long")).otherwise(-1)
        return F.replace(t, F.concat(F.lit(prefix), digits, F.lit(";")), code_point(n))

    return F.when(F.size(found) > 0, F.aggregate(found, text, replace)).otherwise(text)


def html_to_markdown(html: Column) -> Column:
    """The markdown of an HTML text; null stays null."""
    out = html
    for pattern, replacement in REWRITES:
        out = F.regexp_replace(out, pattern, replacement)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = _numeric(_numeric(out, "&#([0-9]+);", 10), "&#x([0-9a-fA-F]+);", 16)
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return js_trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def preview(text: Column, chars: int = 3072) -> Column:
    """The first characters, with a mark if there are more."""
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("\n…(truncated)"))).otherwise(text)
