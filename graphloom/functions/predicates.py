"""Attribute predicates of query nodes as Columns.

A node's predicate is a conjunction over its keys. A string in the data contains the wanted string; other values are equal as JSON,
numbers by value whatever their type. A missing key, a null vertex and a string compared with something else do not match.
"""

from __future__ import annotations

import json
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import RESERVED, Graph, Pattern


def field(data: Column, key: str, kind: str = "variant") -> Column:
    """The field `key` of a variant as a kind, or null. A path has no way to write a key with both sorts of quotes."""
    if "'" in key and '"' in key:
        return F.try_variant_get(F.try_element_at(data.try_cast("map<string,variant>"), F.lit(key)), "$", kind)
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(data, f"$[{quote}{key}{quote}]", kind)


def _exact(want: Any) -> bool:
    """Whether a wanted value is a whole number that a decimal(38, 0) holds."""
    return isinstance(want, int) and not isinstance(want, bool) and abs(want) < 10**38


def variant_matches(data: Column, key: str, want: Any) -> Column:
    """Whether the field `key` of a variant matches."""
    value = field(data, key, "variant")
    kind = F.schema_of_variant(value)
    if isinstance(want, str):
        ok = (kind == "STRING") & F.contains(field(data, key, "string"), F.lit(want))
    elif want is None:
        ok = F.is_variant_null(value)
    elif isinstance(want, bool):
        ok = (kind == "BOOLEAN") & (field(data, key, "boolean") == want)
    elif isinstance(want, int | float):
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        ok = numeric & (field(data, key, "double") == float(want))
        if _exact(want):
            # As doubles, whole numbers from 2**53 on would match their neighbours.
            whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+, ?0\)$")
            ok = F.when(whole, field(data, key, "decimal(38,0)") == F.lit(Decimal(want))).otherwise(ok)
    else:
        ok = F.to_json(value) == json.dumps(want, sort_keys=True, separators=(",", ":"))
    return F.coalesce(value.isNotNull() & ok, F.lit(False))


def column_matches(value: Column, kind: T.DataType, want: Any) -> Column:
    """The same for a typed column."""
    if isinstance(kind, T.StringType):
        ok = F.contains(value, F.lit(want)) if isinstance(want, str) else F.lit(False)
    elif isinstance(kind, T.BooleanType):
        ok = value == want if isinstance(want, bool) else F.lit(False)
    elif isinstance(kind, T.IntegralType) and _exact(want):
        ok = value.cast("decimal(38,0)") == F.lit(Decimal(want))
    elif isinstance(kind, T.NumericType):
        ok = value.cast("double") == float(want) if isinstance(want, int | float) and not isinstance(want, bool) else F.lit(False)
    else:
        ok = F.lit(False)
    return F.coalesce(ok, F.lit(False))


def node_matches(graph: Graph, node: dict[str, Any]) -> Column:
    """The predicate of one query node over graph.vertices."""
    keys = [k for k in node if k not in RESERVED]
    if graph.attrs:
        data = F.col(graph.attrs)
        some = data.isNotNull() & ~F.coalesce(F.is_variant_null(data), F.lit(False))
        return reduce(lambda a, b: a & b, (variant_matches(data, k, node[k]) for k in keys), some)
    schema = graph.vertices.schema
    if any(k not in schema.fieldNames() for k in keys):
        return F.lit(False)
    return reduce(lambda a, b: a & b, (column_matches(F.col(k), schema[k].dataType, node[k]) for k in keys), F.lit(True))


def candidate_mask(graph: Graph, pattern: Pattern) -> Column:
    """Bit q is set where query node q's predicate holds: one projection for all nodes."""
    bits = [F.when(node_matches(graph, n), F.lit(1 << q).cast("long")).otherwise(F.lit(0).cast("long")) for q, n in enumerate(pattern.nodes)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))
