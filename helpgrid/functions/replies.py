"""Reading model replies: fences, strict JSON, typed fields with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helpgrid.functions.text import strip

FENCE = "```"


def without_fence(raw: Column) -> Column:
    """The reply, stripped; if it starts with a fence, the text up to the next fence.

    A ``json`` tag directly after the opening fence is dropped. A fence inside the payload cuts
    it short.
    """
    text = strip(raw)
    inside = F.get(F.split(text, F.lit(FENCE)), F.lit(1))
    return F.when(
        F.startswith(text, F.lit(FENCE)), F.regexp_replace(inside, "^json", "")
    ).otherwise(text)


def strict_json(text: Column) -> Column:
    """The text as a variant, or null unless it is exactly one JSON value.

    The parser ignores what follows the first value. A value that parses both as the only item of
    a list and as the only field of an object has nothing after it, since no text can close both.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.value", "variant"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.lit(False))


def has_field(value: Column, name: str) -> Column:
    """Whether the object has the key, be its value null or not."""
    return F.try_variant_get(value, f"$.{name}", "variant").isNotNull()


def field(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def field_or(value: Column, name: str, default: str | float, kind: str = "string") -> Column:
    """The field, or ``default`` where the key is missing."""
    return F.when(has_field(value, name), field(value, name, kind)).otherwise(F.lit(default))


def text_list(value: Column, name: str) -> Column:
    """A list field as strings; a single value becomes a list of one, a missing key an empty one."""
    single = field(value, name)
    return F.coalesce(
        field(value, name, "array<string>"),
        F.when(single.isNotNull(), F.array(single)),
        F.array().cast("array<string>"),
    )
