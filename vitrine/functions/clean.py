"""Plain text from product fields: an exact form over Arrow batches and a form in JVM expressions."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most characters of each cleaned field.
FIELD_LIMITS = {"title": 512, "brand": 128, "color": 128, "bullets": 2048, "description": 4096}
#: What is no text: comments, declarations and whole elements of code, then any tag.
_NO_TEXT = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|</?[A-Za-z][^>]*>", re.S)


@cache
def _control_table() -> dict[int, str]:
    """Every character of a Unicode category C with a blank, for ``str.translate``."""
    return {cp: " " for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)).startswith("C")}


def clean_text_exact(value: str | None, limit: int = 4096) -> str:
    """``value`` with blanks for its tags, references resolved, NFKC, without control characters and runs of blanks,
    cut to ``limit``; null is empty."""
    text = html.unescape(_NO_TEXT.sub(" ", value or ""))
    words = unicodedata.normalize("NFKC", text).translate(_control_table()).split()
    return " ".join(words)[:limit].rstrip()


def clean_exact(col: Column | str, limit: int = 4096) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: clean_text_exact(v if isinstance(v, str) else None, limit))

    return run(col)


#: The references that shopping text holds, resolved by the JVM form; &amp; comes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"), ("&eacute;", "é"), ("&amp;", "&"))


def clean_sql(x: str, limit: int = 4096, spark: bool = True) -> str:
    """The JVM form as SQL for Spark or DuckDB: tags to blanks, the common references resolved, compatibility
    forms of shopping text folded (case kept), control characters to blanks, blanks collapsed, cut."""
    from vitrine.functions.text import LIGATURES, PLAIN, WIDE, sql_literal

    quote = sql_literal if spark else (lambda t: "'" + t.replace("'", "''") + "'")
    sub = lambda y, pattern, to: f"regexp_replace({y}, {quote(pattern)}, {quote(to)})" if spark else f"regexp_replace({y}, {quote(pattern)}, {quote(to)}, 'g')"
    y = sub(f"coalesce({x}, '')", r"<!--[^>]*-->|<[!?][^>]*>|</?[A-Za-z][^>]*>", " ")
    for a, b in (*REFERENCES, *LIGATURES[:-1]):  # the last ligature is a letter of its own
        y = f"replace({y}, {quote(a)}, {quote(b)})"
    y = f"translate({y}, {quote(WIDE)}, {quote(PLAIN)})"
    y = sub(sub(y, r"\p{C}", " "), r"[\s 　]+", " ")
    return f"rtrim({'substring' if spark else 'substr'}(trim({y}), 1, {limit}))"


def clean(col: str, limit: int = 4096) -> Column:
    """:func:`clean_sql` as a column."""
    return F.expr(clean_sql(col, limit))


def attribute(col: str, limit: int = 4096) -> Column:
    """Cleaned and in lower case; empty is null."""
    return F.nullif(F.lower(clean(col, limit)), F.lit(""))
