"""Personal data in texts: types and counts; matched values never leave the plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of the kinds of personal data (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"(?<!\d)(?:\+?1[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]\d{3}[\s.\-]\d{4}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
}
SPANS = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def has(text: Column, kind: str) -> Column:
    return F.coalesce(text.rlike(PATTERNS[kind]), F.lit(False))


def count(text: Column, kind: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[kind])), F.lit(0))


def types(text: Column) -> Column:
    """Kinds found, sorted."""
    return F.filter(F.array(*[F.when(has(text, k), F.lit(k)) for k in sorted(PATTERNS)]), lambda k: k.isNotNull())


def values(text: Column) -> Column:
    """All matched values; for comparison inside a plan only."""
    found = [F.coalesce(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), F.array().cast("array<string>")) for p in PATTERNS.values()]
    return reduce(F.array_union, found)


def leaked(true: Column, generated: Column) -> Column:
    """Whether any value of ``true`` stands verbatim among those of ``generated``."""
    return F.size(F.array_intersect(values(true), values(generated))) > 0


@F.pandas_udf(SPANS)
def spans(text):
    """Every match of every kind, overlapping ones too, by (start, end)."""
    compiled = {k: re.compile(p) for k, p in PATTERNS.items()}

    def found(t):
        rows = [(m.start(), m.end(), k) for k, p in compiled.items() for m in p.finditer(t or "")]
        return [{"pii_type": k, "start": a, "end": b} for a, b, k in sorted(rows)]

    return text.map(found)
