"""Vector expressions and the sparse map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector as doubles, scaled to length one; a zero vector as it is."""
    # a list of one binds the norm, which would else be taken for each element
    return F.transform(F.array(norm(a)), lambda n: F.transform(_doubles(a), lambda x: F.when(n == 0, x).otherwise(x / n)))[0]


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def sparse_entries(m: Column) -> Column:
    """Entries of a sparse map, sorted by index; null as none."""
    return F.coalesce(F.array_sort(F.map_entries(m)), F.array().cast("array<struct<key:int,value:double>>"))


def sparse_of(indices: Column, values: Column) -> Column:
    """A sparse map of parallel arrays; unequal lengths are an error."""
    checked = F.when(F.size(indices) != F.size(values), F.raise_error(F.lit("indices and values differ in length")).cast("map<int,double>"))
    return checked.otherwise(F.map_from_arrays(indices, values))
