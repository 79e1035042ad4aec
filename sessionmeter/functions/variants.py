"""Reading loosely typed JSON: key synonyms and tolerant coercion over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_END = "\u241ferror-free\u241f"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wrapped_json(text: Column) -> Column:
    """A text read as the first element of an array whose second element is the end mark.

    The parser stops after the first complete value; only if all of the text is one value, the mark is in its place.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def whole_json(wrapped: Column) -> Column:
    """Whether all of a wrapped text is one JSON value."""
    return F.coalesce(F.try_variant_get(wrapped, "$[1]", "string") == _END, F.lit(False))


def unwrapped_json(wrapped: Column) -> Column:
    """The value of a wrapped text that is whole."""
    return F.try_variant_get(wrapped, "$[0]", "variant")


def parse_json(text: Column) -> Column:
    """The JSON value of a whole text, null unless all of it is one JSON value."""
    return let(wrapped_json(text), lambda w: F.when(whole_json(w), unwrapped_json(w)))


def is_json(text: Column) -> Column:
    return whole_json(wrapped_json(text))


def field(doc: Column, path: str) -> Column:
    """A value by path; SQL null when the key is absent, variant null for JSON null."""
    return F.try_variant_get(doc, "$." + path, "variant")


def members(doc: Column, *names: str, path: str = "$") -> Column:
    """Named members of an object as a struct of values, read in one pass; null unless it is an object.

    A member is SQL null when the key is absent, variant null for JSON null.
    """
    return F.try_variant_get(doc, path, "struct<" + ", ".join(f"`{n}`: variant" for n in names) + ">")


def first_where(values: list[Column], test) -> Column:
    return F.get(F.filter(F.array(*values), test), F.lit(0))


def holds(value: Column) -> Column:
    """True unless the value is absent or JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def present(value: Column) -> Column:
    """A plain column's value unless it is JSON null."""
    return F.when(~F.is_variant_null(value), value)


def first_present(*values: Column) -> Column:
    """First of several plain columns which holds something other than null."""
    return F.coalesce(*[present(v) for v in values])


def fields(doc: Column, *paths: str) -> list[Column]:
    return [field(doc, p) for p in paths]


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return kind(value) == "STRING"


def is_number(value: Column) -> Column:
    return kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def is_container(value: Column) -> Column:
    return (F.try_variant_get(value, "$", "struct<>").isNotNull()
            | F.try_variant_get(value, "$", "array<variant>").isNotNull())


def first_container(*values: Column) -> Column:
    """First of several plain columns which holds an object or array."""
    return F.coalesce(*[F.when(is_container(v), v) for v in values])


def text_in(v: Column) -> Column:
    """As :func:`raw_text`, of a plain column."""
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def raw_text(value: Column) -> Column:
    """The value if it is a string, even a blank one."""
    return let(value, text_in)


def is_whole(value: Column) -> Column:
    return kind(value) == "BIGINT"


def _whole(v: Column) -> Column:
    return F.try_variant_get(v, "$", "bigint")


def text_of(v: Column) -> Column:
    """As :func:`to_text`, of a plain column."""
    number = F.try_variant_get(v, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    text = F.try_variant_get(v, "$", "string")
    return (F.when(is_text(v), F.when(strip(text) != "", text)).when(is_whole(v), _whole(v).cast("string"))
            .when(is_number(v), F.when(whole, number.cast("bigint").cast("string")).otherwise(text)))


def to_text(value: Column) -> Column:
    """A non-blank string, or a number as text; anything else is null."""
    return let(value, text_of)


def text_number(text: Column) -> Column:
    """Number written as text; blank is 0, anything else that is no number is null."""
    return let(strip(text), _stripped_number)


def number_in(text: Column) -> Column:
    """As :func:`text_number`, of a plain column."""
    return _stripped_number(strip(text))


def _stripped_number(t: Column) -> Column:
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(t == "", F.lit(0.0)).when(t.rlike(plain), t.try_cast("double"))


def number_of(v: Column) -> Column:
    """As :func:`to_number`, of a plain column."""
    return (F.when(is_whole(v), _whole(v).cast("double")).when(is_number(v), F.try_variant_get(v, "$", "double"))
            .when(is_text(v), text_number(F.try_variant_get(v, "$", "string"))))


def to_number(value: Column) -> Column:
    """A finite number, or a string holding one; else null."""
    return let(value, number_of)


def instant(text: Column) -> Column:
    """Milliseconds of ISO text, or of a number written as text."""
    read = lambda t: F.coalesce(
        F.when(t.rlike(r"^[+-]?\d{4}(-|$)|[/:]"), F.unix_millis(F.try_to_timestamp(t))),
        F.floor(text_number(t)).cast("bigint"))
    return let(strip(text), read)


def instant_of(v: Column) -> Column:
    """As :func:`to_instant`, of a plain column."""
    return (F.when(is_whole(v), F.floor(_whole(v).cast("double")).cast("bigint"))
            .when(is_number(v), F.floor(F.try_variant_get(v, "$", "double")).cast("bigint"))
            .when(is_text(v), instant(F.try_variant_get(v, "$", "string"))))


def to_instant(value: Column) -> Column:
    """Milliseconds from a number or a text."""
    return let(value, instant_of)
