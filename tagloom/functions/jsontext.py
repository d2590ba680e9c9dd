"""Strict JSON reading on text columns.

``from_json`` reads a document and ignores whatever follows it. Wrapping the text in an object
that carries a sentinel after it makes trailing text visible: the sentinel is only reached when
the text was exactly one JSON document.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WRAPPED = "struct<v:variant,done:int>"
_STRICT = {"allowSingleQuotes": "false"}


def wrapped_document(text: Column) -> Column:
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"done":1}'))
    return F.from_json(wrapped, _WRAPPED, _STRICT)


def parse_document(text: Column) -> Column:
    """The text as a VARIANT, or NULL unless the whole text is one JSON document."""
    return F.element_at(
        F.transform(
            F.array(wrapped_document(text)),
            lambda doc: F.when(doc["done"] == 1, doc["v"]),
        ),
        1,
    )


def items_of(document: Column) -> Column:
    """The elements of a JSON array, NULL for anything else."""
    return F.try_variant_get(document, "$", "array<variant>")


def field_text(document: Column, name: str) -> Column:
    """A field of a JSON object as text; NULL when absent or when this is no object."""
    return F.try_variant_get(document, f"$.{name}", "string")


def quoted(text: Column) -> Column:
    """The text as a JSON string literal."""
    as_array = F.to_json(F.array(text))
    return F.substr(as_array, F.lit(2), F.length(as_array) - 2)
