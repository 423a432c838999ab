"""VARIANT helpers: typed access that never turns an object into text by accident."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.text import filled, let, lit_array, strip

# JSON texts of empty scalars.
_FALSY = ("null", '""', "0", "0.0", "-0.0", "false")


def parse(c: Column) -> Column:
    return F.try_parse_json(c)


def field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def text_of(v: Column) -> Column:
    """JSON text of a value, null when it is absent."""
    return F.to_json(v)


def is_object(v: Column) -> Column:
    # A cast to a struct only looks its fields up; printing the value would walk all of it.
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def is_array(v: Column) -> Column:
    return as_list(v).isNotNull()


def is_container(v: Column) -> Column:
    return is_object(v) | is_array(v)


def is_string(v: Column) -> Column:
    return let(
        v, lambda x: F.when(is_container(x), False).otherwise(F.coalesce(text_of(x).startswith('"'), F.lit(False)))
    )


def is_scalar(v: Column) -> Column:
    """Number, boolean or string."""
    return let(v, lambda x: F.when(is_container(x), False).otherwise(F.coalesce(text_of(x) != "null", F.lit(False))))


def truthy(v: Column) -> Column:
    return (
        F.when(is_object(v), F.size(as_map(v)) > 0)
        .when(is_array(v), F.size(as_list(v)) > 0)
        .otherwise(F.coalesce(~text_of(v).isin(*_FALSY), F.lit(False)))
    )


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def string_value(v: Column) -> Column:
    """The stripped value of a JSON string that is not blank."""
    return let(v, lambda x: F.when(is_string(x), filled(as_text(x))))


def scalar_text(v: Column) -> Column:
    """Stripped text of a scalar; objects, arrays and null give the empty string."""
    return F.when(is_container(v), F.lit("")).otherwise(F.coalesce(strip(as_text(v)), F.lit("")))


def first_of(m: Column, keys: Sequence[str], pick: Callable[[Column], Column]) -> Column:
    """First value of a ``map<string,variant>`` that ``pick`` turns into something.

    The expression has the same size for any number of keys. The map and each value are bound, so
    that what gives them (parsing a text, say) runs once a row however often ``pick`` names them.
    """

    def found(bound: Column) -> Column:
        picked = F.transform(lit_array(keys), lambda k: let(F.try_element_at(bound, k), pick))
        return F.try_element_at(F.filter(picked, lambda x: x.isNotNull()), F.lit(1))

    return let(m, found)


def first_truthy(m: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that is not empty, zero, false or null."""
    return first_of(m, keys, lambda x: F.when(truthy(x), x))


def ordered_entries(raw: Column) -> Column:
    """Entries of a JSON object in document order, values as text (strings unquoted)."""
    return F.map_entries(F.from_json(raw, "map<string,string>"))


def raw_items(raw: Column) -> Column:
    """Elements of a JSON array as text."""
    return F.from_json(raw, "array<string>")


def nested_objects(
    df: DataFrame, body: str, name: str, need: Sequence[Sequence[str]], known: Sequence[str]
) -> DataFrame:
    """Add ``name``: objects of a payload with a value under a key of every group in ``need``.

    They come in document order as JSON texts holding only the ``known`` keys, whose values are
    not searched. A payload may nest to any depth, which no fixed expression can follow. Rows
    whose ``body`` is null are not searched and get null. An Arrow pass over whole rows, unlike
    a UDF column, is never moved into a pushed-down filter.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))])

    def search(text: str | None) -> list[str] | None:
        if text is None:
            return None
        found, todo = [], [json.loads(text)]
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                if all(any(value.get(k) for k in group) for group in need):
                    found.append(json.dumps({k: value[k] for k in known if k in value}))
                value = [v for k, v in value.items() if k not in known]
            if isinstance(value, list):
                todo.extend(v for v in reversed(value) if isinstance(v, (dict, list)))
        return found

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(body)).to_pylist()
            found = pa.array([search(t) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, name])

    return df.mapInArrow(searched, schema)
