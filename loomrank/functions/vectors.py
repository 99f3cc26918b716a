"""Vectors: products of dense arrays, and a hashed bag of words kept as (id, dim, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from . import vocab as V


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hashed_dim(token: Column, size: int = V.BOW_SIZE) -> Column:
    """md5(token) modulo ``size``: 2**32 is 256 modulo 768, so the four words of the digest need no wide number."""
    def modulo(h: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(4):
            out = F.pmod(out * ((1 << 32) % size) + F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long"), F.lit(size))
        return out.cast("int")

    return X.let(F.md5(token), modulo)


def counted(values: Column) -> Column:
    """array<struct<value, n, of>> of an array: each distinct value, how often it stands there, and the array's size. Sorts, and reads runs."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("value"), i.alias("at"))), lambda p: (p["at"] == 0) | (F.get(s, p["at"] - 1) != p["value"]))
        return X.let(starts, lambda st: F.transform(st, lambda p, j: F.struct(p["value"].alias("value"), (F.coalesce(F.get(st, j + 1)["at"], F.size(s)) - p["at"]).cast("long").alias("n"), F.size(s).alias("of"))))

    return X.let(F.sort_array(values), runs)


def token_counts(rows: DataFrame, ids: list[str], text: str = "text", only: list[str] | None = None) -> DataFrame:
    """(ids..., token, n, len): how often each token (of ``only``, if given) stands in each text, and the text's number of tokens.

    A row's counts are made in the row, without a shuffle; ``ids`` name a row.
    """
    if only is None:
        of = counted(X.tokens(F.col(text)))
    else:
        of = X.let(X.tokens(F.col(text)), lambda t: F.transform(counted(F.filter(t, lambda x: x.isin(only))), lambda c: F.struct(c["value"].alias("value"), c["n"].alias("n"), F.size(t).alias("of"))))
    return rows.select(*ids, F.explode(of).alias("_c")).select(*ids, F.col("_c.value").alias("token"), F.col("_c.n").alias("n"), F.col("_c.of").alias("len"))


def bag_of_words(rows: DataFrame, ids: list[str], text: str = "text", only: list[int] | None = None) -> DataFrame:
    """(ids..., dim, v): unit vectors of texts over hashed dimensions, made in the row, without a shuffle; ``ids`` name a row.

    With ``only``, values of these dimensions leave the row; the length is that of all.
    """

    def unit(r: Column) -> Column:
        length = F.sqrt(F.aggregate(r, F.lit(0).cast("long"), lambda s, c: s + c["n"] * c["n"]).cast("double"))
        wanted = r if only is None else F.filter(r, lambda c: c["value"].isin(only))
        return X.let(length, lambda size: F.transform(wanted, lambda c: F.struct(c["value"].alias("dim"), (c["n"] / size).alias("v"))))

    dims = F.transform(X.tokens(F.col(text)), lambda t: hashed_dim(t))
    return rows.select(*ids, F.explode(X.let(counted(dims), unit)).alias("_c")).select(*ids, "_c.dim", "_c.v")


def sparse_cosine(left: DataFrame, left_ids: list[str], right: DataFrame, right_ids: list[str]) -> DataFrame:
    """(left ids..., right ids..., sim) for pairs that share a dimension, by an inverted join on it."""
    both = left.select(*left_ids, "dim", F.col("v").alias("lv")).join(right.select(*right_ids, "dim", F.col("v").alias("rv")), "dim")
    return both.groupBy(*left_ids, *right_ids).agg(F.sum(F.col("lv") * F.col("rv")).alias("sim"))
