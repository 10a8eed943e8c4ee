"""JSON navigation as column expressions over `variant` values.

All functions take and return columns and need no shuffle: one response is one
row, and its nested parts are handled in that row, inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def json_path(keys: Sequence[str]) -> str:
    """A JSON path with every key quoted, e.g. ``$["a"]["b c"]``."""
    path = "$"
    for key in keys:
        quote = "'" if '"' in key else '"'
        if quote in key:
            raise ValueError(f"a key cannot hold both kinds of quotes: {key}")
        path += f"[{quote}{key}{quote}]"
    return path


def parse(body: Column) -> Column:
    """Text to variant; null when the text does not begin with JSON.

    What follows the first value is not looked at; `is_json` judges whole texts.
    """
    return F.try_parse_json(body)


def is_json(body: Column) -> Column:
    """True when the whole text is exactly one JSON value.

    The text must parse both as the only item of an array and as the only
    member of an object: any trailing text breaks at least one of the two.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"value":'), body, F.lit("}")))
    one_item = F.size(as_items(in_array)) == 1
    return F.coalesce(one_item & in_object.isNotNull(), F.lit(False))


def as_items(value: Column, keys: Sequence[str] = ()) -> Column:
    """The elements of an array value, or null when it is no array."""
    return F.try_variant_get(value, json_path(keys), "array<variant>")


def member(value: Column, keys: Sequence[str]) -> Column:
    """The member at a path of objects; SQL null when missing, a variant null
    when the JSON holds a null there."""
    return F.variant_get(value, json_path(keys), "variant")


# Walks are written as SQL lambdas: Spark parses such a text at once, while the same
# expression put together call by call takes longer to build than to run.

#: Levels of arrays and objects a parsed document can have (the parser's own limit).
DEEPEST = 1000


def _let(value: Column, body: str) -> Column:
    """A SQL lambda applied to a value."""
    return F.call_function("transform", F.array(value), F.expr(body))[0]


def _text(value: str) -> str:
    """A SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _items(value: str, keys: Sequence[str] = ()) -> str:
    return f"try_variant_get({value}, {_text(json_path(keys))}, 'array<variant>')"


def _member(value: str, keys: Sequence[str]) -> str:
    return f"variant_get({value}, {_text(json_path(keys))}, 'variant')"


def _meets_array(value: str, keys: Sequence[str]) -> str:
    """Whether an array lies on the way."""
    return "(" + " OR ".join(f"{_items(value, keys[:depth])} IS NOT NULL" for depth in range(len(keys))) + ")"


def _paths(keys: Sequence[str]) -> str:
    """The path of each key by itself, to fold over: the expression stays small however many keys there are."""
    return "array(" + ", ".join(_text(json_path([key])) for key in keys) + ")"


def _piece(text: str, value: str = "CAST(NULL AS variant)") -> str:
    return f"named_struct('text', {text}, 'value', {value})"


# An array as pieces: its brackets and commas become text, its items are walked on.
_PARTS = f"""coalesce(
    concat(
        array({_piece("concat(p.text, '[')")}),
        transform({_items("p.value")}, (item, at) -> {_piece("if(at = 0, '', ',')", "item")}),
        array({_piece("']'")})
    ),
    array(p)
)"""

# Arrays are opened level by level; an opened array is two pieces or more, so equal
# sizes say that none is left.
_OPENED = f"""aggregate(
    sequence(1, {DEEPEST}), named_struct('pieces', pieces, 'open', true),
    (state, turn) -> if(state.open, transform(
        array(flatten(transform(state.pieces, p -> {_PARTS}))),
        level -> named_struct('pieces', level, 'open', size(level) > size(state.pieces))
    )[0], state)
).pieces"""

# One key: the member of every value; null if one lacks it.
_STEPPED = f"""transform(
    array(transform({_OPENED}, p -> named_struct(
        'text', p.text, 'value', variant_get(p.value, path, 'variant'), 'asked', p.value IS NOT NULL))),
    found -> if(exists(found, p -> p.asked AND p.value IS NULL), NULL, transform(found, p -> {_piece("p.text", "p.value")}))
)[0]"""


def _through_arrays(value: str, keys: Sequence[str]) -> str:
    """Follow keys through objects and, item by item, through arrays of any depth.

    The frontier of the walk is an array of pieces: text that is settled, then
    perhaps a value still to be walked. The pieces spell the result when the keys
    are done.
    """
    pieces = f"aggregate({_paths(keys)}, array({_piece(_text(''), value)}), (pieces, path) -> {_STEPPED})"
    return f"try_parse_json(array_join(transform({pieces}, p -> concat(p.text, coalesce(to_json(p.value), ''))), ''))"


def _of_each(items: str, keys: Sequence[str]) -> str:
    """The member of every item as an array; null where one lacks it."""
    found = f"transform({items}, item -> {_member('item', keys)})"
    return f"transform(array({found}), found -> if(exists(found, x -> x IS NULL), NULL, to_variant_object(found)))[0]"


def _through_one_item(index: int) -> Callable[[str, Sequence[str]], str]:
    """A walk through objects, and through one item of each array on the way."""
    item = f"if({_items('held')} IS NULL, held, try_element_at({_items('held')}, {index}))"
    down = f"aggregate(sequence(1, {DEEPEST}), value, (held, turn) -> {item})"
    return lambda value, keys: f"aggregate({_paths(keys)}, {value}, (value, path) -> variant_get({down}, path, 'variant'))"


def _walked(
    value: Column, keys: Sequence[str], once: Callable[[str, Sequence[str]], str], walk: Callable[[str, Sequence[str]], str]
) -> Column:
    """What a walk finds in the document, as a variant; null where it finds nothing.

    A path through objects is one lookup, and one array on the way (`once`) a lookup
    for its items. Only documents that hold arrays inside that array are walked.
    """
    keys = list(keys)
    found, deeper = [_member("document", keys)], []
    for depth in range(len(keys)):
        items, rest = _items("document", keys[:depth]), keys[depth:]
        found.append(once(items, rest))
        deeper.append(f"exists({items}, item -> {_meets_array('item', rest)})")
    return _let(value, f"document -> coalesce({', '.join(found)}, if(coalesce({', '.join(deeper)}), {walk('document', keys)}, NULL))")


def find(value: Column, keys: Sequence[str]) -> Column:
    """Follow `keys` through objects; an array on the way is mapped over.

    Null when any step misses, in any element. Arrays may nest in one another
    to any depth.
    """
    return _walked(value, keys, _of_each, _through_arrays)


def select_field(value: Column, keys: Sequence[str] | None) -> Column:
    """The selected part of a response, or the whole response when the path
    is not there."""
    if not keys:
        return value
    return F.coalesce(find(value, keys), value)


def as_records(value: Column) -> Column:
    """The records of a response: array elements, anything else as one record."""
    return F.coalesce(as_items(value), F.array(value))


def record_count(value: Column) -> Column:
    return F.coalesce(F.size(as_items(value)), F.lit(1))


def as_text(value: Column) -> Column:
    """Strings raw, other values as JSON text, JSON null as null."""
    return F.variant_get(value, "$", "string")


def cursor_value(value: Column, keys: Sequence[str], record: str = "last") -> Column:
    """The next-page cursor of a response as text.

    Where the path meets an array, its last (or first) record is asked.
    """
    try:
        index = {"first": 1, "last": -1}[record]
    except KeyError:
        raise ValueError(f"cursor record must be 'first' or 'last', not {record!r}") from None
    once = lambda items, rest: _member(f"try_element_at({items}, {index})", rest)
    return as_text(_walked(value, keys, once, _through_one_item(index)))
