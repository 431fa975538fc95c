from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_id(c: Column | str, letters: str = "A-Z") -> Column:
    """Last path segment, trimmed, if it is one capital letter and digits; else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, rf"(?:^|/)\s*([{letters}][0-9]+)\s*/*\s*\z", 1), F.lit(""))


def instant_micros(c: Column | str) -> Column:
    """Microseconds since 1970 in UTC of a date or time in any common ISO-like spelling.

    Without an offset the text is UTC, without a time it is midnight; null, blank and unreadable
    texts give null. Does not depend on the session's time zone.
    """
    c = F.col(c) if isinstance(c, str) else c
    def plain(s: Column) -> Column:
        s = F.upper(F.trim(s))
        s = F.regexp_replace(s, r"^(\d{4})[/.-]?(\d{2})[/.-]?(\d{2})(?=$|[T ])", "$1-$2-$3")
        s = F.regexp_replace(s, r"[T ]\s*(\d{2})(\d{2})(\d{2})?(?=$|[.,Z+ -])", "T$1:$2:$3")
        s = F.regexp_replace(F.regexp_replace(s, r"(\d):(?=$|[.,Z+ -])", "$1"), r"(\d),(\d)", "$1.$2")
        s = F.regexp_replace(s, r"(?<=\d)\s+(?=Z|UTC|[+-]\d)", "")
        s = F.regexp_replace(F.regexp_replace(s, r"(UTC|GMT)$", "Z"), r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
        return F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2})(?=$|Z|[+-])", "$1:00")

    def zoned(s: Column) -> Column:
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z"))).when(
            s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.concat(s, F.lit("Z"))
        ).otherwise(s)

    def micros(s: Column) -> Column:
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:.*(Z|[+-]\d{1,2}(:\d{2})?)$"), F.unix_micros(s.try_cast("timestamp")))

    clean = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")  # the usual case needs no repair
    return F.when(clean, F.unix_micros(c.try_cast("timestamp"))).otherwise(once(once(once(c, plain), zoned), micros))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it (expressions are otherwise copied)."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), 0)


def sorted_set(c: Column | str) -> Column:
    """Sorted distinct non-null values of a group."""
    return F.array_sort(F.collect_set(c))


def union_arrays(c: Column | str) -> Column:
    """Sorted distinct non-null elements over the arrays of a group."""
    merged = F.array_distinct(F.flatten(F.collect_list(c)))
    return F.array_sort(F.filter(merged, lambda x: x.isNotNull()))


def sample_ids(c: Column | str, n: int = 10) -> Column:
    """First n of the sorted distinct values of a group."""
    return F.slice(sorted_set(c), 1, n)


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def compact_flags(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds; a null condition gives no label."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b in double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return safe_divide(shared, a + b - shared)


def overlap_coefficient(shared: Column, a: Column, b: Column) -> Column:
    return safe_divide(shared, F.least(a, b))


def relative_change(value: Column, base: Column) -> Column:
    return F.abs(value - base) / F.greatest(F.abs(base), F.lit(1e-12))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a null equals a null; the right side's other columns are added, its keys are not.

    The right side's keys get names of their own first, so both sides may come from one table.
    """
    r = right.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"__key_{k}" for k in keys])
