"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions.columns import as_col

# Every character that counts as blank, line ends and Unicode spaces included.
BLANKS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def _as_class(chars: str) -> str:
    """Regular-expression class of the characters, neighbours joined to ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


BLANK_CLASS = _as_class(BLANKS)
# Marks and tokens of the text rules.
ESCAPED_ZERO_WIDTH = "\\u200b"  # the six characters, as they stand in the raw files
ZERO_WIDTH = "\u200b"
EMPTY_SECRET = "(vazia)"
SHORT_SECRET = "***"
ANONYMOUS = "anon"


def strip(col: Column | str) -> Column:
    """Remove blanks of every kind at both ends; ``trim`` alone removes only spaces."""
    return F.btrim(as_col(col), F.lit(BLANKS))


def clean_value(col: Column | str, zero_width: bool = True) -> Column:
    """Drop zero-width marks, turn line ends into spaces, strip.

    ``zero_width=False`` removes only the escaped six-character spelling.
    """
    swaps = [(ESCAPED_ZERO_WIDTH, ""), ("\n", " "), ("\r", " ")]
    if zero_width:
        swaps.append((ZERO_WIDTH, ""))
    out = as_col(col)
    for old, new in swaps:
        out = F.replace(out, F.lit(old), F.lit(new))
    return strip(out)


def clean_text(df: DataFrame, zero_width: bool = True, null_as_text: bool = False) -> DataFrame:
    """``clean_value`` on every string column; ``null_as_text`` writes NULL as 'None'."""
    cleaned = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            value = F.col(f"`{field.name}`")
            if null_as_text:
                value = F.coalesce(value, F.lit("None"))
            cleaned[field.name] = clean_value(value, zero_width)
    return df.withColumns(cleaned)


def clean_category(col: Column | str) -> Column:
    return strip(F.lower(as_col(col)))


def clean_categories(df: DataFrame, cols: list[str], null_as_text: bool = False) -> DataFrame:
    """Lower-case and strip the listed columns that exist."""
    out = {}
    for name in cols:
        if name in df.columns:
            value = F.col(f"`{name}`").cast("string")
            if null_as_text:
                value = F.coalesce(value, F.lit("none"))
            out[name] = clean_category(value)
    return df.withColumns(out)


def normalize_text(col: Column | str) -> Column:
    """Lower-case, strip, and reduce each run of blanks to one space; NULL stays NULL."""
    return F.regexp_replace(clean_category(col), f"{BLANK_CLASS}+", " ")


def slug(col: Column | str) -> Column:
    return F.translate(F.lower(as_col(col)), " -", "__")


def mask(col: Column | str) -> Column:
    """Show only the ends of a secret."""
    c = F.coalesce(as_col(col), F.lit(""))
    ends = F.concat(F.substring(c, 1, 4), F.lit("..."), F.substring(c, -4, 4))
    return (
        F.when(c == "", F.lit(EMPTY_SECRET))
        .when(F.char_length(c) <= 8, F.lit(SHORT_SECRET))
        .otherwise(ends)
    )


def canonical_email(col: Column | str) -> Column:
    return clean_category(col)


def user_token(col: Column | str) -> Column:
    """First 12 characters of a key without hyphens, or the anonymous token."""
    token = F.substring(F.replace(strip(col), F.lit("-"), F.lit("")), 1, 12)
    return F.coalesce(F.nullif(token, F.lit("")), F.lit(ANONYMOUS))


def parse_list(col: Column | str, null_as_text: bool = False) -> Column:
    """Array of the trimmed, non-empty items of a text such as ``['a', 'b']``."""
    value = as_col(col)
    value = F.coalesce(value, F.lit("None" if null_as_text else ""))
    items = F.split(F.translate(value, "[]'", ""), ",")
    return F.filter(F.transform(items, strip), lambda item: item != "")
