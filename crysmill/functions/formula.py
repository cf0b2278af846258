"""Chemical formulas: from any common spelling to an exact composition.

``parse`` understands flat and bracketed formulas, decimal amounts, blanks between symbols, Unicode, HTML, LaTeX and
underscore subscripts. Anything else (null, blank, placeholders, unknown symbols, zero amounts) is ``None``.
"""

from __future__ import annotations

import re
from decimal import Decimal
from fractions import Fraction
from math import gcd, lcm

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .elements import ELECTRONEGATIVITY, KNOWN, NUMBER

_SUBSCRIPTS = str.maketrans("₀₁₂₃₄₅₆₇₈₉", "0123456789")
_MARKUP = re.compile(r"</?su[bp]>|\\mathrm|[\s_${}]", re.IGNORECASE)
_TOKEN = re.compile(r"([A-Z][a-z]?)(\d+\.?\d*|\.\d+)?|([(\[])|([)\]])(\d+\.?\d*|\.\d+)?")


def _amount(text: str | None) -> int | Fraction:
    if not text:
        return 1
    return Fraction(Decimal(text)) if "." in text else int(text)


def parse(text: str | None, markup: bool = True) -> dict[str, int | Fraction] | None:
    """Element -> amount, or None if ``text`` is no composition. With ``markup=False`` only plain formulas count."""
    if not isinstance(text, str):
        return None
    s = _MARKUP.sub("", text.translate(_SUBSCRIPTS)) if markup else text.strip()
    if not s:
        return None
    stack: list[dict[str, int | Fraction]] = [{}]
    at = 0
    while at < len(s):
        m = _TOKEN.match(s, at)
        if not m:
            return None
        at = m.end()
        symbol, amount, opened, closed, times = m.groups()
        if symbol:
            n = _amount(amount)
            if symbol not in KNOWN or n <= 0:
                return None
            stack[-1][symbol] = stack[-1].get(symbol, 0) + n
        elif opened:
            stack.append({})
        else:
            if len(stack) < 2 or not stack[-1]:
                return None
            n = _amount(times)
            if n <= 0:
                return None
            inner = stack.pop()
            for k, v in inner.items():
                stack[-1][k] = stack[-1].get(k, 0) + v * n
    return stack[0] if len(stack) == 1 and stack[0] else None


def integer_ratio(amounts: dict[str, int | Fraction]) -> dict[str, int]:
    scale = lcm(*(v.denominator for v in amounts.values()))
    whole = {k: int(v * scale) for k, v in amounts.items()}
    g = gcd(*whole.values())
    return {k: v // g for k, v in whole.items()}


def composition_key(text: str | None) -> str | None:
    """Spelling-independent key: symbols in alphabetical order with their smallest integer ratio, ``Al2O3``."""
    amounts = parse(text)
    if amounts is None:
        return None
    return "".join(f"{k}{v if v > 1 else ''}" for k, v in sorted(integer_ratio(amounts).items()))


def reduced(text: str | None) -> str | None:
    """Reduced formula with symbols ordered by electronegativity, then by name."""
    amounts = parse(text)
    if amounts is None:
        return None
    ratio = integer_ratio(amounts)
    if len(ratio) == 1 and next(iter(ratio)) in ("H", "N", "O", "F", "Cl"):
        return next(iter(ratio)) + "2"
    order = sorted(ratio, key=lambda k: (ELECTRONEGATIVITY.get(k, 0), k))
    return "".join(f"{k}{ratio[k] if ratio[k] > 1 else ''}" for k in order)


def _mapped(values: pd.Series, f) -> pd.Series:
    """f over the distinct values of a batch only."""
    return values.map({v: f(v) for v in values.dropna().unique()}).astype(object).where(values.notna(), None)


@F.pandas_udf(T.StringType())
def composition_key_udf(values: pd.Series) -> pd.Series:
    return _mapped(values, composition_key)


@F.pandas_udf(T.StringType())
def reduced_formula_udf(values: pd.Series) -> pd.Series:
    return _mapped(values, reduced)


@F.pandas_udf(T.ArrayType(T.StringType()))
def formula_elements_udf(values: pd.Series) -> pd.Series:
    return _mapped(values, lambda v: sorted(parse(v) or {}) or None)


def flat_tokens(formula: Column) -> Column:
    """Array of (symbol, amount) of a flat formula, inside the JVM; empty array where it has none."""
    return F.transform(
        F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?\d*\.?\d*)"), F.lit(1)),
        lambda t: F.struct(
            F.regexp_extract(t, r"^([A-Z][a-z]?)", 1).alias("symbol"),
            F.coalesce(F.expr("try_cast(NULL as double)"), F.when(F.regexp_extract(t, r"(\d*\.?\d+)$", 1) == "", F.lit(1.0)).otherwise(F.regexp_extract(t, r"(\d*\.?\d+)$", 1).try_cast("double"))).alias("amount"),
        ),
    )


def atomic_number_map() -> Column:
    return F.create_map(*[x for s, z in NUMBER.items() for x in (F.lit(s), F.lit(z))])
