"""Differential tests against pandas, whose semantics the operators follow.

Random small frames with missing values; the same condition is evaluated by
``pandas.DataFrame.query`` and by the predicate builder, and cleaning steps
are compared with their pandas counterparts.  Row identity is an ``i``
column (the pandas position).
"""
import math
import random

import pandas as pd
import pytest

from tableprep.functions import predicates as P
from tableprep.functions.predicates import c
from tableprep.operators import clean as C

SCHEMA = "i long, a double, b double, s string"


def frame(rng: random.Random, n: int = 40):
    rows = []
    for i in range(n):
        a = rng.choice([None, float("nan"), -3.0, 0.0, 1.0, 2.5, 7.0])
        b = rng.choice([None, 0.0, 1.0, 2.0, 10.0])
        s = rng.choice([None, "xy", "z", "Oslo", "ab"])
        rows.append((i, a, b, s))
    return rows


def leaves(rng):
    """(pandas text, Cond) pairs with the same meaning."""
    v = rng.choice([0, 1, 2.5, 3])
    col = rng.choice(["a", "b"])
    ops = [
        (f"{col} > {v}", c(col) > v), (f"{col} >= {v}", c(col) >= v), (f"{col} < {v}", c(col) < v),
        (f"{col} <= {v}", c(col) <= v), (f"{col} == {v}", c(col) == v), (f"{col} != {v}", c(col) != v),
        (f"{col} in [1, 2.5]", c(col).isin([1, 2.5])), (f"{col} not in [1, 2.5]", c(col).not_in([1, 2.5])),
        ("s == 'xy'", c("s") == "xy"), ("s != 'xy'", c("s") != "xy"),
        (f"a + b > {v}", c("a") + c("b") > v), (f"a * 2 < {v}", c("a") * 2 < v),
        (f"0 < {col} < 3", c(col).between(0, 3)), ("a != a", c("a").isnull()),
        ("s in ['z', 'ab']", c("s").isin(["z", "ab"])),
    ]
    return rng.choice(ops)


def condition(rng, depth=2):
    if depth == 0 or rng.random() < 0.4:
        return leaves(rng)
    kind = rng.choice(["and", "or", "not"])
    if kind == "not":
        t, cnd = condition(rng, depth - 1)
        return f"not ({t})", ~cnd
    (t1, c1), (t2, c2) = condition(rng, depth - 1), condition(rng, depth - 1)
    return (f"({t1}) {kind} ({t2})", (c1 & c2) if kind == "and" else (c1 | c2))


@pytest.mark.parametrize("seed", range(12))
def test_conditions_match_pandas_query(spark, seed):
    rng = random.Random(seed)
    rows = frame(rng)
    pdf = pd.DataFrame(rows, columns=["i", "a", "b", "s"]).astype({"a": float, "b": float})
    sdf = spark.createDataFrame(rows, SCHEMA)
    for _ in range(6):
        text, cond = condition(rng)
        want = sorted(pdf.query(text)["i"].tolist())
        got = sorted(r[0] for r in P.where(sdf, cond).select("i").collect())
        assert got == want, text


def test_dedupe_trim_names_match_pandas(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, " a", "a", "b\t", "b"]), rng.choice([None, 1.0, 2.0])) for i in range(60)]
    pdf = pd.DataFrame(rows, columns=["i", "s", "x"])
    sdf = spark.createDataFrame(rows, "i long, s string, x double")
    want = pdf.drop_duplicates(subset=["s", "x"], keep="first")["i"].tolist()
    got = sorted(r[0] for r in C.dedupe(sdf, ["s", "x"], order_by=["i"]).select("i").collect())
    assert got == sorted(want)
    want_trim = [None if v is None else v.strip() for v in pdf["s"]]
    got_trim = [r[0] for r in C.trim_whitespace(sdf, ["s"]).orderBy("i").select("s").collect()]
    assert got_trim == want_trim
    names = [" First Name ", "AGE", "e-mail  Addr", "x\ty"]
    import re
    for style in ("lowercase_underscore", "lowercase"):
        out = C.standardize_columns(spark.createDataFrame([(1, 2, 3, 4)], names), style).columns
        ref = [re.sub(r"\s+", "_", n.strip().lower()) if style == "lowercase_underscore" else n.strip().lower()
               for n in names]
        assert out == ref


def test_numeric_casts_match_pandas(spark):
    texts = ["30", "1e3", "2.5", "x", None, " 7 ", "-4", "3.0", "inf", "nan", "1,000", "0x10", "+5"]
    sdf = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    ser = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce")
    floats = [r[0] for r in C.cast_columns(sdf, {"t": "float"}).orderBy("i").select("t").collect()]
    for got, want in zip(floats, ser):
        assert (got is None and (want is None or math.isnan(want))) or \
            (got is not None and not math.isnan(want) and (got == want or (math.isinf(got) and math.isinf(want))))
    ints = [r[0] for r in C.cast_columns(sdf, {"t": "int"}).orderBy("i").select("t").collect()]
    for got, want in zip(ints, ser):
        whole = want is not None and not math.isnan(want) and not math.isinf(want) and float(want).is_integer()
        assert got == (int(want) if whole else None)
