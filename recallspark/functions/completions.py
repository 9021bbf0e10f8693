"""Lists out of model output: one JSON object, its expected key, or else its first list.

Model output counts only if it is exactly one JSON object. The object is read as
``map<string,variant>``, which keeps document order and tells a list from a text
that looks like one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import float_text, strip_blanks, unfence

STRICT = {"allowSingleQuotes": "false"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it.

    Columns made step by step would be written out again for every mention when a
    filter on the result is pushed down through them.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def object_entries(raw: Column) -> Column:
    """(key, value) pairs of the JSON object in ``raw``, in order; NULL if it is anything else."""

    def parse(body):
        # One value between two marks: trailing text or a second value breaks the array.
        framed = F.from_json(F.concat(F.lit('["",'), body, F.lit(',""]')), "array<string>", STRICT)
        return F.when(F.size(framed) == 3, F.map_entries(F.from_json(body, "map<string,variant>", STRICT)))

    body = bound(strip_blanks(raw), lambda bare: unfence(raw, bare))
    return bound(bound(body, parse), _last_of_repeated)


def _last_of_repeated(entries: Column) -> Column:
    """A repeated key keeps its first place and its last value."""

    def merged(keys):
        last = F.transform(keys, lambda k: F.struct(
            k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
        return F.when(F.size(keys) < F.size(entries), last).otherwise(entries)

    return bound(F.array_distinct(F.transform(entries, lambda e: e["key"])), merged)


def _as_list(value: Column) -> Column:
    """A variant's elements, NULL if it is not a list."""
    return F.try_variant_get(value, "$", "array<variant>")


def _value(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]


def _first_list(entries: Column) -> Column:
    lists = F.filter(F.transform(entries, lambda e: _as_list(e["value"])), lambda v: v.isNotNull())
    return F.get(lists, F.lit(0))


def _number(value: Column, kind: Column, text: Column) -> Column:
    """A number's text; those with a point or an exponent are spelled as Python spells floats."""
    is_float = kind.startswith("DECIMAL") | (kind == "DOUBLE")
    return F.when(is_float, bound(F.try_variant_get(value, "$", "double"), float_text)).otherwise(text)


def _point(value: Column) -> Column:
    """A list element as text; null and booleans are spelled None, True, False."""
    text = F.try_variant_get(value, "$", "string")
    spelled = bound(F.schema_of_variant(value), lambda kind: (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(_number(value, kind, F.coalesce(text, F.to_json(value))))
    ))
    return strip_blanks(spelled)


def resolved_points(raw: Column, key: str = "points") -> Column:
    """Texts of the list under ``key``, else of the first list, blank ones left out; an empty array if none."""
    items = bound(object_entries(raw), lambda e: F.coalesce(_as_list(_value(e, key)), _first_list(e)))
    points = F.filter(F.transform(items, _point), lambda p: p != "")
    return F.coalesce(points, F.array().cast("array<string>"))


def _cell(item: Column, name: str) -> Column:
    """(text, ok): what is stored for one half of a pair; missing, list and object halves are not ok."""

    def typed(value):
        text = F.try_variant_get(value, "$", "string")
        return bound(F.schema_of_variant(value), lambda kind: F.struct(
            F.when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).otherwise(_number(value, kind, text)).alias("text"),
            F.coalesce(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), F.lit(False)).alias("ok"),
        ))

    return bound(F.try_variant_get(item, f"$.{name}", "variant"), typed)


def resolved_pairs(raw: Column, key: str = "knowledge_points") -> Column:
    """Question/answer pairs, all or nothing; an empty array if there are none.

    The value under ``key`` counts whatever its type, so a non-list there gives no
    pairs; without the key the first list counts. One element that is not an object
    with storable ``q`` and ``a`` spoils the whole document.
    """

    def chosen(entries):
        has_key = F.exists(entries, lambda e: e["key"] == key)
        return F.when(has_key, _as_list(_value(entries, key))).otherwise(_first_list(entries))

    def checked(cells):
        good = F.forall(cells, lambda c: c["q"]["ok"] & c["a"]["ok"])
        return F.when(good, F.transform(cells, lambda c: F.struct(c["q"]["text"].alias("q"), c["a"]["text"].alias("a"))))

    cells = F.transform(
        bound(object_entries(raw), chosen),
        lambda item: F.struct(_cell(item, "q").alias("q"), _cell(item, "a").alias("a")),
    )
    return F.coalesce(bound(cells, checked), F.array().cast("array<struct<q:string,a:string>>"))
