"""Column-name rules, whitespace and date-pattern helpers."""
from __future__ import annotations

import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TablePrepError

# Every character Python's str.strip() removes, derived by rule (str.isspace).
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())


def standard_name(name: str, style: str) -> str:
    """``lowercase_underscore``: strip, lower, runs of whitespace -> ``_``;
    ``lowercase``: strip and lower only; any other style leaves names alone."""
    if style == "lowercase_underscore":
        return re.sub(r"\s+", "_", str(name).strip().lower())
    if style == "lowercase":
        return str(name).strip().lower()
    return name


# Strftime directive -> Spark datetime pattern letters.
STRFTIME_TO_SPARK = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd",
    "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
    "p": "a", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "DDD",
}


def strftime_to_spark(fmt: str) -> str:
    """Translate a strftime format; literal text is quoted for Spark."""
    out: list[str] = []
    literal: list[str] = []

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'" if re.search(r"[A-Za-z']", text) else text)
            literal.clear()

    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            if d == "%":
                literal.append("%")
            elif d in STRFTIME_TO_SPARK:
                flush()
                out.append(STRFTIME_TO_SPARK[d])
            else:
                raise TablePrepError(f"Unsupported date directive: %{d}")
            i += 2
            continue
        literal.append(ch)
        i += 1
    flush()
    return "".join(out)


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
# The words that stand for an infinite number.
INFINITE = r"^(?i)[+-]?(inf|infinity)$"


def is_integer(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE)).rlike(INTEGER)


def number(col: Column) -> Column:
    """A decimal number as double, else null.  Spark's own cast also takes
    ``12d``, ``1F`` and ``0x1p3``."""
    text = F.btrim(col, F.lit(WHITESPACE))
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(
        text.rlike(INFINITE), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))


# Parse patterns tried in order for text dates (month first,
# as pandas does for slash dates).
DEFAULT_DATE_INPUTS = [
    "yyyy-M-d HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-M-d'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-M-d HH:mm",
    "yyyy-M-d'T'HH:mm",
    "yyyy-M-d",
    "yyyy/M/d",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy HH:mm",
    "M/d/yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
]

# Where one pattern is sought for a whole column: month first before day first.
_MONTH_FIRST, _DAY_FIRST = ([f"{a}{sep}{b}{sep}yyyy{time}" for sep in "/-." for time in ("", " HH:mm", " HH:mm:ss")] for a, b in ("Md", "dM"))
COLUMN_DATE_INPUTS = [*[p for p in DEFAULT_DATE_INPUTS if p not in _MONTH_FIRST + _DAY_FIRST], *_MONTH_FIRST, *_DAY_FIRST]


def pattern_guard(pattern: str) -> str:
    """A lenient regex for the shape of a Spark datetime pattern.

    Digits for numeric fields, letters for text fields, literals as written;
    every string the pattern can parse matches, so using it to skip a parse
    never changes a result -- it only avoids the cost of failed parses.
    """
    out = [r"^\s*"]
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "'":
            j, lit = i + 1, []
            while j < len(pattern):
                if pattern[j] == "'":
                    if j + 1 < len(pattern) and pattern[j + 1] == "'":
                        lit.append("'")
                        j += 2
                        continue
                    break
                lit.append(pattern[j])
                j += 1
            out.append(re.escape("".join(lit)) if j > i + 1 else "'")
            i = j + 1
            continue
        if ch.isalpha():
            j = i
            while j < len(pattern) and pattern[j] == ch:
                j += 1
            run = j - i
            if ch in "yuYdDHhKkmsSnMLQqwWe" and not (ch in "MLQqe" and run >= 3):
                out.append(r"[+-]?\d+" if ch in "yuY" else r"\d+")
            elif ch in "MLEeaGBQq":
                out.append(r"[^\d\s]+")
            else:
                out.append(r".*?")
            i = j
            continue
        out.append(r"\s+" if ch.isspace() else "(?:" if ch == "[" else ")?" if ch == "]" else re.escape(ch))
        i += 1
    out.append(r"\s*$")
    return "".join(out)
