"""Scalar functions on Columns: parsing, strings, bits, arrays, pairs, JSON and random numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.predicates import field

#: Spark types of the edge value types of files.
VALUE_TYPES: dict[str, str] = {"int": "int", "uint": "bigint", "short": "smallint", "long": "bigint", "float": "float", "double": "double", "char": "string", "bool": "boolean"}


def parse_value(token: Column, kind: str) -> Column:
    """A token as a value of a kind; null if it is none. 'int-int' and 'float-float' are pairs of the token with itself, and
    kind:list is a list of values parted by colons."""
    if kind.endswith(":list"):
        return F.transform(F.split(token, ":"), lambda t: parse_value(t, kind.removesuffix(":list")))
    if "-" in kind:
        left, right = kind.split("-")
        return F.struct(parse_value(token, left).alias("left"), parse_value(token, right).alias("right"))
    if kind == "char":
        return F.substring(token, 1, 1)
    if kind == "bool":
        return F.when(token.isNotNull(), F.coalesce(token.try_cast("int") == 1, F.lit(False)))
    return token.try_cast(VALUE_TYPES[kind])


def trimmed(s: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(s, F.lit(" \t\r\n\f\v"))


def without_newline(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n]+\z", "")


def tokens(s: Column, delimiters: str = "\t, ") -> Column:
    """Non-empty tokens between any of some delimiters."""
    from re import escape

    return F.filter(F.split(s, "[" + "".join(map(escape, delimiters)) + "]+"), lambda t: t != "")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("left"), right.alias("right"))


def old_value(p: Column, iteration: Column) -> Column:
    """The side of a pair that an iteration reads: left in even ones."""
    return F.when(iteration % 2 == 0, p["left"]).otherwise(p["right"])


def set_new_value(p: Column, iteration: Column, x: Column) -> Column:
    """The pair with x on the side that an iteration writes."""
    even = iteration % 2 == 0
    return pair(F.when(even, p["left"]).otherwise(x), F.when(even, x).otherwise(p["right"]))


def list_add(a: Column, x: Column) -> Column:
    return F.array_append(F.coalesce(a, F.array()), x)


def list_get(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def list_size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def list_clear(a: Column) -> Column:
    return F.filter(a, lambda _: F.lit(False))


def list_set(a: Column, i: int, x: Column) -> Column:
    return F.transform(a, lambda v, k: F.when(k == i, x).otherwise(v))


def json_kind(v: Column) -> Column:
    """null, boolean, integer, float, string, object or array."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null").when(s == "BOOLEAN", "boolean").when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float").when(s == "STRING", "string").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
    )


def is_number(v: Column) -> Column:
    return json_kind(v).isin("integer", "float")


def is_primitive(v: Column) -> Column:
    return ~json_kind(v).isin("object", "array")


def json_at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def json_has(v: Column, key: str) -> Column:
    return field(v, key).isNotNull()


def json_size(v: Column) -> Column:
    """Elements of an array or keys of an object, 0 of null, 1 of anything else."""
    kind = json_kind(v)
    n = F.when(kind == "array", F.size(v.try_cast("array<variant>"))).when(kind == "object", F.size(v.try_cast("map<string,variant>")))
    return F.when(kind == "null", 0).otherwise(F.coalesce(n, F.lit(1)))


#: Kinds of JSON values in the order in which values of different kinds stand. Fixed.
KIND_ORDER = ("null", "boolean", "integer", "float", "object", "array", "string")


def json_equal(a: Column, b: Column) -> Column:
    """Equality of JSON values, numbers by value."""
    both = is_number(a) & is_number(b)
    return F.when(both, a.try_cast("double") == b.try_cast("double")).otherwise(F.to_json(a) == F.to_json(b))


def json_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: numbers by value, strings and booleans by theirs, arrays element by element, objects by their text with sorted
    keys, and values of different kinds by the order of their kinds."""
    ka, kb = json_kind(a), json_kind(b)
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    rank = lambda k: F.when(k == "float", KIND_ORDER.index("integer")).otherwise(F.array_position(F.array(*map(F.lit, KIND_ORDER)), k) - 1)
    text = lambda x: F.to_json(x)
    elements = lambda x: F.transform(x.try_cast("array<variant>"), lambda v: F.to_json(v))
    same = (
        F.when(is_number(a), sign(a.try_cast("double"), b.try_cast("double")))
        .when(ka == "string", sign(a.try_cast("string"), b.try_cast("string")))
        .when(ka == "boolean", sign(a.try_cast("boolean").cast("int"), b.try_cast("boolean").cast("int")))
        .when(ka == "array", sign(elements(a), elements(b)))
        .when(ka == "object", sign(text(a), text(b)))
        .otherwise(0)
    )
    return F.when(rank(ka) == rank(kb), same).otherwise(sign(rank(ka), rank(kb))).cast("int")


def json_front(v: Column) -> Column:
    """The first element of an array; any other value itself."""
    return F.when(json_kind(v) == "array", F.get(v.try_cast("array<variant>"), F.lit(0))).otherwise(v)


def json_back(v: Column) -> Column:
    elements = v.try_cast("array<variant>")
    return F.when(json_kind(v) == "array", F.get(elements, F.size(elements) - 1)).otherwise(v)


def json_empty(v: Column) -> Column:
    return json_size(v) == 0


def json_push(v: Column, x: Column) -> Column:
    """An array with an element more; null becomes an array of it, other values null."""
    kind = json_kind(v)
    start = F.when(kind == "array", v.try_cast("array<variant>")).when(kind == "null", F.array().cast("array<variant>"))
    return F.to_variant_object(F.array_append(start, x))


def json_insert(v: Column, at: int, x: Column) -> Column:
    """An array with an element put before the one at a place."""
    elements = v.try_cast("array<variant>")
    return F.to_variant_object(F.concat(F.slice(elements, 1, at), F.array(x), F.slice(elements, at + 1, F.greatest(F.size(elements) - at, F.lit(0)))))


def json_set(v: Column, key: str, x: Column) -> Column:
    """An object with a key set; null becomes an object of it."""
    members = F.when(json_kind(v) == "object", v.try_cast("map<string,variant>")).when(json_kind(v) == "null", F.create_map().cast("map<string,variant>"))
    return F.to_variant_object(F.map_concat(F.map_filter(members, lambda k, _: k != key), F.create_map(F.lit(key), x)))


def json_erase(v: Column, key: str | int) -> Column:
    """An object without a key, or an array without the element at a place; others as they are."""
    if isinstance(key, int):
        elements = v.try_cast("array<variant>")
        return F.when(json_kind(v) == "array", F.to_variant_object(F.filter(elements, lambda _, i: i != key))).otherwise(v)
    return F.when(json_kind(v) == "object", F.to_variant_object(F.map_filter(v.try_cast("map<string,variant>"), lambda k, _: k != key))).otherwise(v)


def json_clear(v: Column) -> Column:
    """The empty value of the same kind."""
    kind = json_kind(v)
    empty = F.when(kind == "object", "{}").when(kind == "array", "[]").when(kind == "string", '""').when(kind == "boolean", "false").when(kind == "integer", "0").when(kind == "float", "0.0").otherwise("null")
    return F.parse_json(empty)


def json_dump(v: Column, indent: bool = False) -> Column:
    """The text of a value, on one line, or with the members of an object or array on lines of their own, indented."""
    if not indent:
        return F.to_json(v)
    pretty = {"pretty": "true"}
    kind = json_kind(v)
    return F.when(kind == "object", F.to_json(v.try_cast("map<string,variant>"), pretty)).when(kind == "array", F.to_json(v.try_cast("array<variant>"), pretty)).otherwise(F.to_json(v))


# --- arrays as lists of probabilities, and random numbers -------------------------------------------------------------


def pdf_to_cdf(p: Column) -> Column:
    """Running sums of an array divided by its sum."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(_running(p), lambda x: x / total)


def _running(p: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("l"))
    return F.aggregate(p, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["l"], a["s"] + x).alias("l")))["l"]


def multinomial_cdf(cdf: Column, seed: int = 0) -> Column:
    """The number of a class drawn from running sums."""
    # One draw a row, bound by the outer lambda.
    below = F.transform(F.array(F.rand(seed)), lambda u: F.size(F.filter(cdf, lambda x: x < u)))
    return F.least(F.get(below, F.lit(0)), F.size(cdf) - 1)


def multinomial(pdf: Column, seed: int = 0) -> Column:
    return multinomial_cdf(pdf_to_cdf(pdf), seed)


def uniform(low: float, high: float, seed: int = 0) -> Column:
    return F.lit(low) + F.rand(seed) * (high - low)


def uniform_int(low: int, high: int, seed: int = 0) -> Column:
    """A whole number from low to high, both included."""
    return (F.lit(low) + F.floor(F.rand(seed) * (high - low + 1))).cast("long")


def gaussian(mean: float = 0.0, std: float = 1.0, seed: int = 0) -> Column:
    return F.lit(mean) + F.randn(seed) * std


def bernoulli(p: float, seed: int = 0) -> Column:
    return F.rand(seed) < p


def gamma(alpha: float, key: Column, seed: int = 0) -> Column:
    """Gamma draws of shape alpha; the same key gives the same draw."""

    @F.pandas_udf("double")
    def draw(keys: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(k) & (1 << 63) - 1]).gamma(alpha) for k in keys])

    return draw(F.xxhash64(key))


def permutation(n: Column, seed: int = 0) -> Column:
    """The numbers below n in an order that the seed fixes."""
    return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(F.lit(seed), i).alias("h"), i.alias("i")))), lambda x: x["i"])


def check(condition: Column, message: str) -> Column:
    """Null where the condition holds; the query fails where it does not."""
    return F.assert_true(condition, message)


def fold(f: Callable[[Column, Column], Column], a: Column, start: Column) -> Column:
    return F.aggregate(a, start, f)
