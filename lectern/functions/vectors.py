"""Column functions on vectors, and the hashing embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import hash_tokens


def dot(a: Column, b: Column) -> Column:
    """Dot product; what the longer vector has beyond the shorter counts nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))), F.lit(0.0), lambda s, x: s + x)


def distance_to_score(distance: Column) -> Column:
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))


def token_slot(token: Column, dim: int = 256) -> Column:
    """Struct (slot, sign) of a token: the first four digest bytes choose the slot, the fifth the sign."""
    digest = F.sha2(token, 256)
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    return F.struct((number(1, 8) % dim).cast("int").alias("slot"), F.when(number(9, 2) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or lambdas inside it use it."""
    return F.transform(F.array(value), body)[0]


def sparse_embedding(text: Column, dim: int = 256) -> Column:
    """Unit-length map from slot to weight of a text's tokens; empty if it has none or they cancel out.

    Works inside the row, so it suits few or short texts; tables of chunks are embedded with a shuffle by slot.
    """

    def summed(slots: Column) -> Column:
        total = lambda i: F.aggregate(slots, F.lit(0.0), lambda a, s: a + F.when(s["slot"] == i, s["sign"]).otherwise(0.0))
        sums = F.transform(F.array_distinct(F.transform(slots, lambda s: s["slot"])), lambda i: F.struct(i.alias("key"), total(i).alias("value")))
        return F.map_from_entries(F.filter(sums, lambda s: s["value"] != 0))

    return let(let(F.transform(hash_tokens(text), lambda t: token_slot(t, dim)), summed), unit)


def unit(weights: Column) -> Column:
    """A map of weights divided by its Euclidean norm."""
    norm = F.sqrt(F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x * x))
    return let(norm, lambda n: F.transform_values(weights, lambda _, v: v / n))


def dense(weights: Column, dim: int = 256) -> Column:
    """The vector of a sparse map."""
    return let(weights, lambda w: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(w, i), F.lit(0.0))))


def hashing_embedding(text: Column, dim: int = 256) -> Column:
    """The dense vector of a text; all zero if it has no tokens."""
    return dense(sparse_embedding(text, dim), dim)
