"""String and list codecs (S-*, A-1) and optional predicates (FLT-1 to FLT-3, FLT-5)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Named = Column | str


def col(c: Named) -> Column:
    return F.col(c) if isinstance(c, str) else c


def opt_between(c: Named, lo, hi) -> Column:
    """True if a bound is missing; false if the value is."""
    if lo is None or hi is None:
        return F.lit(True)
    return F.coalesce(col(c).between(lo, hi), F.lit(False))


def opt_overlaps(c: Named, values: Sequence | None, *, array: bool = True) -> Column:
    """Whether an array (or one value) has a wanted value; true without wanted values, false for null."""
    if not values:
        return F.lit(True)
    wanted = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.arrays_overlap(col(c), wanted) if array else col(c).isin(list(values)), F.lit(False))


def opt_equal(c: Named, value) -> Column:
    return F.lit(True) if value is None else F.coalesce(col(c) == value, F.lit(False))


def param(params: dict[str, list[str]], name: str) -> str | None:
    """The first value of a task parameter, or None."""
    found = params.get(name) or []
    return found[0] if isinstance(found, list) and found else None


def param_list(params: dict[str, list[str]], name: str) -> list[str]:
    """All values, whether comma-joined in one string or given apart."""
    return [x for v in params.get(name) or [] for x in v.split(",") if x]


def pipe_get(s: Named, key: str) -> Column:
    """Field of ``k=v|k=v``: the first with the key; null if it is empty or holds a further ``=``."""
    parts = F.transform(F.split(col(s), r"\|"), lambda x: F.split(x, "="))
    named = F.filter(parts, lambda p: (F.size(p) == 2) & (p[0] == key) & (p[1] != ""))
    return F.try_element_at(named, F.lit(1))[1]


def pipe_set(s: Named, key: str, value: Named) -> Column:
    """Sets the first field with the key; an unknown key changes nothing."""
    parts = F.split(col(s), r"\|")
    first = F.array_position(F.transform(parts, lambda x: F.split(x, "=")[0]), key)
    new = F.concat(F.lit(f"{key}="), col(value))
    return F.array_join(F.transform(parts, lambda x, i: F.when(i + 1 == first, new).otherwise(x)), "|")


def is_blank(c: Named) -> Column:
    return F.coalesce(col(c), F.lit("")) == ""


def not_blank(c: Named) -> Column:
    return ~is_blank(c)


def trim_comma(c: Named) -> Column:
    """Without one leading and one trailing comma."""
    return F.regexp_replace(col(c), "^,|,$", "")


def pad2(c: Named) -> Column:
    """One zero before anything that hasn't two characters."""
    return F.when(F.length(col(c)) == 2, col(c)).otherwise(F.concat(F.lit("0"), col(c)))


def csv_to_longs(c: Named) -> Column:
    """Numbers of a comma list; what is no number is left out."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def join_with(c: Named, separator: str) -> Column:
    return F.array_join(col(c), separator)


def ratio(a: Named, b: Named, scale: int | None = None) -> Column:
    """a / b, half-up to ``scale`` places if given; null for no b."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if scale is None else F.round(out, scale)


def indexed_name(c: Named) -> Column:
    """``x[3]`` as (base, idx); without an index it is 1."""
    idx = F.coalesce(F.regexp_extract(col(c), r"^[^\[]*\[(\d+)\]", 1).try_cast("int"), F.lit(1))
    return F.struct(F.substring_index(col(c), "[", 1).alias("base"), F.when(F.contains(col(c), F.lit("[")), idx).otherwise(1).alias("idx"))


def parse_kv_list(c: Named) -> Column:
    """``k=v,k=v`` without spaces as (key, value); a value is empty unless there are exactly two parts."""
    parts = F.transform(F.split(F.replace(col(c), F.lit(" "), F.lit("")), ","), lambda x: F.split(x, "="))
    return F.transform(parts, lambda p: F.struct(p[0].alias("key"), F.when(F.size(p) == 2, p[1]).otherwise("").alias("value")))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)
