"""JSON helpers (J-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Named, col


def parse_json_obj(c: Named) -> Column:
    """A map of the object's fields; null for what is no object."""
    return F.from_json(col(c), "map<string,string>")


def json_path(c: Named, path: str) -> Column:
    return F.get_json_object(col(c), f"$.{path}")


def json_merge(a: Named, b: Named) -> Column:
    """Both maps' entries; of a key in both, b's."""
    a, b = (F.coalesce(col(x), F.create_map().cast("map<string,string>")) for x in (a, b))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def fields_of(row: Column) -> Column:
    """A struct as a map of variants: numbers, texts and nested values keep their types."""
    return F.parse_json(F.to_json(row)).cast("map<string,variant>")


def json_put(c: Named, key: str, value: Named) -> Column:
    return json_merge(c, F.create_map(F.lit(key), col(value).cast("string")))


def to_json_str(c: Named) -> Column:
    return F.to_json(col(c))


def struct_to_map(df: DataFrame, columns: list[str]) -> Column:
    """A row's columns as text by name, nulls left out."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[df[c].cast("string") for c in columns])), lambda _, v: v.isNotNull())


def project_json(payload: Named, columns: Named) -> Column:
    """The fields of a map that a comma list names."""
    names = F.transform(F.split(col(columns), ","), lambda x: F.trim(x))
    return F.map_filter(col(payload), lambda k, _: F.array_contains(names, k))


def product_status(extend_info: Named) -> Column:
    return F.get_json_object(col(extend_info), "$.product_status").try_cast("int")
