"""Character classes and column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of browser regular expressions, which Java's classes do not equal.
SPACE = r"\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WEB_TOKEN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACE}]"
RUN = rf"[{SPACE}]+|[^{SPACE}]+"
#: The same for Python's re.
PY_SPACE = "\\x09-\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def web_tokens(text: Column) -> Column:
    """Array of lower-cased word runs and single other characters; null text gives null, none gives an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WEB_TOKEN), 0)


def runs(text: Column) -> Column:
    """Array of maximal runs of white space and of anything else, which together are the text."""
    return F.regexp_extract_all(text, F.lit(RUN), 0)


def html(text: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text
