"""Row predicates with the null behaviour of a pandas ``query``.

pandas compares with two-valued logic: a comparison involving a missing value
is False, except ``!=``, which is True, and ``not`` flips the result.  SQL
would drop such rows in every case.  Each condition built here compiles to a
Column that is never null, so ``&``, ``|`` and ``~`` combine exactly like the
pandas masks.  NaN counts as missing (it is pandas' null marker), so a NaN
operand never satisfies ``>`` -- unlike Spark's NaN ordering.

Values of a variant column are compared by their own type: a number never equals or exceeds
a text, and only ``!=`` holds between them.

    from tableprep.functions.predicates import c, where
    where(df, (c("age") > 30) & ~c("city").isin(["Oslo"]))

Operands support ``+ - * / % **`` (``/`` by zero gives a missing value, ``%``
follows the sign of the divisor as in Python) and the math helpers below.
Nothing here parses text; a SQL string is accepted only through
``where_sql(..., trusted=True)``.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TablePrepError
from .variant import compare, is_variant, present, views

_FLOATS = (T.FloatType, T.DoubleType)


class Operand:
    """A column expression awaiting a DataFrame to learn its type.

    ``plain`` marks a bare column and ``value`` a literal; only comparisons
    between those two also yield a predicate Spark can push to the scan.
    """

    def __init__(self, build: Callable[[DataFrame], Column], plain: bool = False, value=None,
                 is_literal: bool = False, refs: frozenset = frozenset()):
        self._build = build
        self.plain = plain
        self.value = value
        self.is_literal = is_literal
        self.refs = refs  # column names used, known before any DataFrame

    def raw(self, df: DataFrame) -> Column:
        return self._build(df)

    def typed(self, df: DataFrame) -> tuple[Column, T.DataType]:
        """The operand with missing values as null, and its type."""
        expr = self._build(df)
        dtype = df.select(expr).schema.fields[0].dataType
        if isinstance(dtype, _FLOATS):
            expr = F.nanvl(expr, F.lit(None).cast(dtype))
        return (present(expr) if is_variant(dtype) else expr), dtype

    def compile(self, df: DataFrame) -> Column:
        """As ``typed``; of a variant column its numbers, which arithmetic and functions take."""
        expr, dtype = self.typed(df)
        return views(expr, dtype)["number"] if is_variant(dtype) else expr

    def text(self, df: DataFrame) -> Column:
        """As text; of a variant column only the values that are text."""
        expr, dtype = self.typed(df)
        return views(expr, dtype)["text"] if is_variant(dtype) else expr.cast("string")

    def compared(self, other: "Operand", df: DataFrame, op) -> Column:
        """``op`` on both; values of variant columns are compared by their own type."""
        (a, kind), (b, other_kind) = self.typed(df), other.typed(df)
        if is_variant(kind) or is_variant(other_kind):
            return compare(views(a, kind), views(b, other_kind), op)
        return op(a, b)

    def mixed(self, df: DataFrame) -> bool:
        return is_variant(df.select(self.raw(df)).schema.fields[0].dataType)

    # arithmetic -------------------------------------------------------
    def _bin(self, other, op) -> "Operand":
        o = _operand(other)
        return Operand(lambda df: op(self.compile(df), o.compile(df)), refs=self.refs | o.refs)

    def __add__(self, o): return self._bin(o, lambda a, b: a + b)
    def __radd__(self, o): return _operand(o)._bin(self, lambda a, b: a + b)
    def __sub__(self, o): return self._bin(o, lambda a, b: a - b)
    def __rsub__(self, o): return _operand(o)._bin(self, lambda a, b: a - b)
    def __mul__(self, o): return self._bin(o, lambda a, b: a * b)
    def __rmul__(self, o): return _operand(o)._bin(self, lambda a, b: a * b)
    def __truediv__(self, o): return self._bin(o, lambda a, b: F.try_divide(a, b))
    def __rtruediv__(self, o): return _operand(o)._bin(self, lambda a, b: F.try_divide(a, b))
    def __mod__(self, o): return self._bin(o, _python_mod)
    def __rmod__(self, o): return _operand(o)._bin(self, _python_mod)
    def __floordiv__(self, o): return self._bin(o, _floor_divide)
    def __rfloordiv__(self, o): return _operand(o)._bin(self, _floor_divide)
    def __pow__(self, o): return self._bin(o, lambda a, b: F.pow(a, b))
    def __rpow__(self, o): return _operand(o)._bin(self, lambda a, b: F.pow(a, b))
    def __neg__(self): return Operand(lambda df: -self.compile(df), refs=self.refs)

    def apply(self, fn: Callable[[Column], Column]) -> "Operand":
        """Any built-in function of one column, e.g. ``c("x").apply(F.abs)``."""
        return Operand(lambda df: fn(self.compile(df)), refs=self.refs)

    # comparisons ------------------------------------------------------
    def _cmp(self, other, op, when_missing: bool) -> "Cond":
        o = _operand(other)
        implied = None
        if not when_missing and self.plain and o.is_literal and o.value is not None:
            # a necessary condition Spark can push down: exact => raw comparison
            implied = lambda df: F.lit(True) if self.mixed(df) else op(self.raw(df), F.lit(o.value))
        return Cond(lambda df: F.coalesce(self.compared(o, df, op), F.lit(when_missing)), implied,
                    self.refs | o.refs)

    def __eq__(self, o): return self._cmp(o, lambda a, b: a == b, False)  # type: ignore[override]
    def __ne__(self, o): return self._cmp(o, lambda a, b: a != b, True)  # type: ignore[override]
    def __lt__(self, o): return self._cmp(o, lambda a, b: a < b, False)
    def __le__(self, o): return self._cmp(o, lambda a, b: a <= b, False)
    def __gt__(self, o): return self._cmp(o, lambda a, b: a > b, False)
    def __ge__(self, o): return self._cmp(o, lambda a, b: a >= b, False)
    __hash__ = None  # type: ignore[assignment]

    def between(self, low, high, inclusive: str = "neither") -> "Cond":
        """Chained ``low < x < high`` (``inclusive``: neither/both/left/right)."""
        lo_ok = self >= low if inclusive in ("both", "left") else self > low
        hi_ok = self <= high if inclusive in ("both", "right") else self < high
        return lo_ok & hi_ok

    def isin(self, values: Iterable) -> "Cond":
        vals = list(values)
        implied = (lambda df: F.lit(True) if self.mixed(df) else self.raw(df).isin(vals)) if self.plain else None

        def build(df):
            if self.mixed(df):
                return reduce(lambda a, b: a | b, [(self == v).compile(df) for v in vals if v is not None], F.lit(False))
            return F.coalesce(self.compile(df).isin(vals), F.lit(False))
        return Cond(build, implied, self.refs)

    def not_in(self, values: Iterable) -> "Cond":
        return ~self.isin(values)

    def isnull(self) -> "Cond":
        return Cond(lambda df: self.typed(df)[0].isNull(), refs=self.refs)  # NaN counts: no plain implied form

    def notnull(self) -> "Cond":
        return ~self.isnull()

    # string methods (missing values give False, as with na=False) -------
    def contains(self, pattern: str, regex: bool = True, case: bool = True) -> "Cond":
        def build(df):
            x = self.text(df)
            if regex:
                return x.rlike(pattern if case else "(?i)" + pattern)
            if not case:
                return F.lower(x).contains(pattern.lower())
            return x.contains(pattern)
        return Cond(lambda df: F.coalesce(build(df), F.lit(False)), refs=self.refs)

    def startswith(self, prefix: str) -> "Cond":
        implied = (lambda df: F.lit(True) if self.mixed(df) else self.raw(df).startswith(prefix)) if self.plain else None
        return Cond(lambda df: F.coalesce(self.text(df).startswith(prefix), F.lit(False)),
                    implied, self.refs)

    def endswith(self, suffix: str) -> "Cond":
        implied = (lambda df: self.raw(df).endswith(suffix)) if self.plain else None
        return Cond(lambda df: F.coalesce(self.text(df).endswith(suffix), F.lit(False)),
                    implied, self.refs)


class Cond:
    """A two-valued row condition.

    ``implied`` optionally builds a plain SQL predicate that every matching
    row satisfies (a necessary condition).  ``where`` adds it as an extra
    conjunct so that Catalyst can push it to the scan (row-group skipping);
    the exact two-valued test still decides.  It survives ``&`` and ``|``
    and is dropped by ``~``.
    """

    def __init__(self, build: Callable[[DataFrame], Column], implied=None, refs: frozenset = frozenset()):
        self._build = build
        self.implied = implied
        self.refs = refs

    def compile(self, df: DataFrame) -> Column:
        return self._build(df)

    def __and__(self, o: "Cond") -> "Cond":
        o = _cond(o)
        parts = [x for x in (self.implied, o.implied) if x is not None]
        implied = None
        if len(parts) == 2:
            implied = lambda df: parts[0](df) & parts[1](df)
        elif parts:
            implied = parts[0]
        return Cond(lambda df: self.compile(df) & o.compile(df), implied, self.refs | o.refs)

    def __or__(self, o: "Cond") -> "Cond":
        o = _cond(o)
        implied = None
        if self.implied is not None and o.implied is not None:
            a, b = self.implied, o.implied
            implied = lambda df: a(df) | b(df)
        return Cond(lambda df: self.compile(df) | o.compile(df), implied, self.refs | o.refs)

    def __invert__(self) -> "Cond":
        return Cond(lambda df: ~self.compile(df), refs=self.refs)

    def __bool__(self):
        raise TablePrepError("use & | ~ to combine conditions, not and/or/not")


def c(name_or_col) -> Operand:
    """Operand for a column name or any Column expression."""
    if isinstance(name_or_col, Operand):
        return name_or_col
    if isinstance(name_or_col, str):
        name = name_or_col

        def build(df):
            if name not in df.columns:
                raise TablePrepError(f"no such columns: ['{name}']")
            return F.col(f"`{name}`")
        return Operand(build, plain=True, refs=frozenset([name]))
    if isinstance(name_or_col, Column):
        return Operand(lambda df: name_or_col)
    raise TablePrepError(f"not a column: {name_or_col!r}")


def lit(value) -> Operand:
    return Operand(lambda df: F.lit(value), value=value, is_literal=True)


def _operand(x) -> Operand:
    if isinstance(x, Operand):
        return x
    if isinstance(x, Column):
        return c(x)
    return lit(x)


def _cond(x) -> Cond:
    if isinstance(x, Cond):
        return x
    if isinstance(x, Column):
        return Cond(lambda df: F.coalesce(x, F.lit(False)))
    raise TablePrepError(f"not a condition: {x!r}")


def _python_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor; missing for a zero divisor."""
    m = F.try_mod(a, b)
    return F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


def _floor_divide(a: Column, b: Column) -> Column:
    """Rounded down; missing for a zero divisor.  The remainder goes first, so
    that the division is exact up to 2**53."""
    return F.floor(F.try_divide(a - _python_mod(a, b), b) + F.lit(0.5))


def _arg(x) -> Operand:
    """Function argument: a string names a column here, not a literal."""
    return c(x) if isinstance(x, str) else _operand(x)


# math helpers, same names as the functions a pandas query exposes
def abs_(x) -> Operand: return _arg(x).apply(F.abs)
def sqrt(x) -> Operand: return _arg(x).apply(F.sqrt)
def exp(x) -> Operand: return _arg(x).apply(F.exp)
def log(x) -> Operand: return _arg(x).apply(F.ln)
def log10(x) -> Operand: return _arg(x).apply(F.log10)
def floor(x) -> Operand: return _arg(x).apply(F.floor)
def ceil(x) -> Operand: return _arg(x).apply(F.ceil)
def sin(x) -> Operand: return _arg(x).apply(F.sin)
def cos(x) -> Operand: return _arg(x).apply(F.cos)
def tan(x) -> Operand: return _arg(x).apply(F.tan)
def arcsin(x) -> Operand: return _arg(x).apply(F.asin)
def arccos(x) -> Operand: return _arg(x).apply(F.acos)
def arctan(x) -> Operand: return _arg(x).apply(F.atan)
def arctan2(y, x) -> Operand: return _arg(y)._bin(_arg(x), F.atan2)
def sinh(x) -> Operand: return _arg(x).apply(F.sinh)
def cosh(x) -> Operand: return _arg(x).apply(F.cosh)
def tanh(x) -> Operand: return _arg(x).apply(F.tanh)
def arcsinh(x) -> Operand: return _arg(x).apply(F.asinh)
def arccosh(x) -> Operand: return _arg(x).apply(F.acosh)
def arctanh(x) -> Operand: return _arg(x).apply(F.atanh)
def log1p(x) -> Operand: return _arg(x).apply(F.log1p)
def expm1(x) -> Operand: return _arg(x).apply(F.expm1)


_OPS = {
    "==": lambda a, v: a == v,
    "!=": lambda a, v: a != v,
    "<": lambda a, v: a < v,
    "<=": lambda a, v: a <= v,
    ">": lambda a, v: a > v,
    ">=": lambda a, v: a >= v,
    "in": lambda a, v: a.isin(v),
    "not in": lambda a, v: a.not_in(v),
    "isnull": lambda a, v: a.isnull(),
    "notnull": lambda a, v: a.notnull(),
    "contains": lambda a, v: a.contains(v),
    "startswith": lambda a, v: a.startswith(v),
    "endswith": lambda a, v: a.endswith(v),
}


def from_triples(conditions, combine: str = "and") -> Cond:
    """``[(column, op, value), ...]`` joined by ``and``/``or``."""
    conds = []
    for item in conditions:
        if isinstance(item, Cond):
            conds.append(item)
            continue
        col, op, *rest = item
        if op not in _OPS:
            raise TablePrepError(f"Unsupported operator: {op}")
        conds.append(_OPS[op](c(col), rest[0] if rest else None))
    if not conds:
        raise TablePrepError("no condition given")
    out = conds[0]
    for x in conds[1:]:
        out = out & x if combine == "and" else out | x
    return out


def where(df: DataFrame, cond) -> DataFrame:
    """Filter with two-valued logic; ``cond`` is a Cond, a Column or triples."""
    if isinstance(cond, (list, tuple)):
        cond = from_triples(cond)
    cond = _cond(cond)
    exact = cond.compile(df)
    if cond.implied is not None:
        return df.where(cond.implied(df) & exact)
    return df.where(exact)


def where_sql(df: DataFrame, condition: str, *, trusted: bool = False) -> DataFrame:
    """A SQL boolean expression, for trusted callers only (SQL null logic)."""
    if not trusted:
        raise TablePrepError("SQL text conditions need trusted=True")
    return df.where(F.expr(condition))
