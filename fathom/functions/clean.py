"""Row-level cleaning: blanks, numbers, labels, keys, bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_present(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """The first non-blank of the columns that df has, trimmed."""
    have = [blank_to_null(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


def number(c: Column | str) -> Column:
    """A double, or null where the cell isn't a number; nan and inf are numbers here."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c).try_cast("double")


def finite(c: Column | str) -> Column:
    """c, or null where it is nan or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y"), F.lit(False))


def label(c: Column | str, default: str = "unknown") -> Column:
    """Trimmed, in lower case, with - and spaces as _."""
    return F.coalesce(F.nullif(F.translate(F.lower(F.trim(c)), "- ", "__"), F.lit("")), F.lit(default))


def encode(c: Column | str, vocabulary: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    """Place in the vocabulary after aliases are resolved; 0 for what it lacks."""
    c = F.col(c) if isinstance(c, str) else c
    pairs = {v: i for i, v in enumerate(vocabulary)} | {a: vocabulary.index(v) for a, v in (aliases or {}).items()}
    codes = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(codes[c], F.lit(0))


def listed(c: Column | str) -> Column:
    """Items of a cell separated by , or ; without blanks."""
    return F.filter(F.transform(F.split(F.translate(c, ",", ";"), ";"), lambda x: F.trim(x)), lambda x: x != "")


def place_id(c: Column | str) -> tuple[Column, Column, Column]:
    """Chain, number and insertion code of <chain>_<number><code>, split from the right."""
    pattern = r"^(.*)_(-?\d+)(.*)$"
    c = F.col(c) if isinstance(c, str) else c
    whole = c.rlike(pattern)
    pick = lambda k: F.regexp_extract(c, pattern, k)
    return F.when(whole, pick(1)).otherwise(c), F.when(whole, pick(2).try_cast("int")).otherwise(0), F.when(whole, pick(3)).otherwise("")


def bin_labels(edges: Sequence[float]) -> list[tuple[float, float | None, str]]:
    """low, high and label of [low, high) bins, the last one open; edges must rise."""
    if len(edges) < 2 or any(a >= b for a, b in zip(edges[:-1], edges[1:], strict=True)):
        raise ValueError("edges must be strictly increasing, two at least")
    show = lambda x: f"{x:g}".replace(".", "p")
    return [*((a, b, f"{show(a)}to{show(b)}") for a, b in zip(edges[:-1], edges[1:], strict=True)), (edges[-1], None, f"gt{show(edges[-1])}")]


def binned(c: Column, edges: Sequence[float]) -> Column:
    out = None
    for lo, hi, name in bin_labels(edges):
        test = (c >= lo) if hi is None else (c >= lo) & (c < hi)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def first_match(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The value of the first rule one of whose substrings the cell has, in lower case."""
    low, out = F.lower(c), None
    for words, value in rules:
        test = None
        for w in words:
            test = low.contains(w) if test is None else test | low.contains(w)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)
