"""Text functions: JVM column expressions where Spark has the semantics, Arrow batches where it does not."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_query(text: str | None) -> str | None:
    """NFKC, case folding, runs of white space to one blank, ends stripped."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def normalize_query_udf(col: Column | str) -> Column:
    """:func:`normalize_query` over Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalize_query, na_action="ignore")

    return run(col)


def sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _single_nfkc() -> tuple[str, str]:
    """Full-width forms, half-width katakana and odd blanks with the one character that NFKC makes of them."""
    src, dst = [], []
    for cp in [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, *range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0)]:
        to = unicodedata.normalize("NFKC", chr(cp))
        if len(to) == 1 and to != chr(cp):
            src.append(chr(cp))
            dst.append(to)
    return "".join(src), "".join(dst)


WIDE, PLAIN = _single_nfkc()
#: The Latin ligatures and what NFKC and case folding make of them.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss"))
#: Letters and digits with inner hyphens or apostrophes.
TOKEN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"


def fold_sql(x: str, spark: bool = True) -> str:
    """Case folding and the compatibility forms that occur in shopping text, as SQL for Spark or DuckDB."""
    quote = sql_literal if spark else (lambda t: "'" + t.replace("'", "''") + "'")
    y = f"lower(translate({x}, {quote(WIDE)}, {quote(PLAIN)}))"
    for a, b in LIGATURES:
        y = f"replace({y}, {quote(a)}, {quote(b)})"
    return y


def strip_tags_sql(x: str, spark: bool = True) -> str:
    return f"regexp_replace({x}, '<[^<>]*>', ' ')" if spark else f"regexp_replace({x}, '<[^<>]*>', ' ', 'g')"


def tokens_sql(x: str, spark: bool = True) -> str:
    """The terms of a text in order, folded; null text has none."""
    pattern = TOKEN.replace("\\", "\\\\") if spark else TOKEN
    if spark:
        return f'regexp_extract_all({fold_sql(x)}, "{pattern}", 0)'
    return f"regexp_extract_all({fold_sql(x, False)}, '{pattern.replace(chr(39), chr(39) * 2)}')"
