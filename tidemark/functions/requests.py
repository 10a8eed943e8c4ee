"""Building request parameters and bodies as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Strftime directives and the datetime pattern that prints the same.
PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "b": "MMM", "h": "MMM", "B": "MMMM",
    "d": "dd", "j": "DDD", "a": "EEE", "A": "EEEE",
    "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss",
    "f": "SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS",
    ".3f": ".SSS", ".6f": ".SSSSSS", ".9f": ".SSSSSSSSS",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "X": "HH:mm:ss", "R": "HH:mm",
    "D": "MM/dd/yy", "x": "MM/dd/yy", "r": "hh:mm:ss a",
}
# Directives that print a constant, as bookmarks are always UTC.
CONSTANTS = {"%": "%", "n": "\n", "t": "\t", "Z": "UTC", "z": "+0000", ":z": "+00:00"}

_DIRECTIVE = re.compile(r"%(:z|\.?[369]f|.)", re.DOTALL)

DEFAULT_BOOKMARK_FORMAT = "%Y-%m-%d %H:%M:%S UTC"


def _tokens(fmt: str) -> list[tuple[str, str]]:
    """(kind, text) parts of a format: `text`, or a directive's code."""
    tokens: list[tuple[str, str]] = []

    def literal(text: str) -> None:
        if text and tokens and tokens[-1][0] == "text":
            tokens[-1] = ("text", tokens[-1][1] + text)
        elif text:
            tokens.append(("text", text))

    position = 0
    for match in _DIRECTIVE.finditer(fmt):
        literal(fmt[position:match.start()])
        position = match.end()
        code = match.group(1)
        if code in CONSTANTS:
            literal(CONSTANTS[code])
        else:
            tokens.append(("code", code))
    if "%" in fmt[position:]:
        raise ValueError("a bookmark format cannot end in a single %")
    literal(fmt[position:])
    return tokens


def bookmark_text(bookmark: Column, fmt: str = DEFAULT_BOOKMARK_FORMAT) -> Column:
    """Print a UTC timestamp with a strftime format.

    Runs of pattern directives and literal text become one `date_format` call;
    directives without a pattern get their own expression.
    """
    computed = {
        "s": F.unix_timestamp(bookmark).cast("string"),
        "e": F.lpad(F.date_format(bookmark, "d"), 2, " "),
        "u": (F.weekday(bookmark) + 1).cast("string"),
        "w": (F.dayofweek(bookmark) - 1).cast("string"),
    }
    parts: list[Column | str] = [""]
    for kind, text in _tokens(fmt):
        if kind == "code" and text in computed:
            parts += [computed[text], ""]
        elif kind == "code" and text not in PATTERNS:
            raise ValueError(f"unsupported bookmark directive %{text}")
        else:
            quoted = "'" + text.replace("'", "''") + "'"
            parts[-1] += PATTERNS[text] if kind == "code" else quoted
    columns = [F.date_format(bookmark, p) if isinstance(p, str) else p for p in parts if not (isinstance(p, str) and not p)]
    return F.concat(*columns) if columns else F.lit("")


def put_param(params: Column, key: str, value: Column) -> Column:
    """Add a query parameter, or replace the value of an existing one.

    A null value leaves the parameters as they are.
    """
    base = F.coalesce(params, F.create_map().cast("map<string,string>"))
    others = F.map_filter(base, lambda name, _: name != F.lit(key))
    changed = F.map_concat(others, F.create_map(F.lit(key), value))
    return F.when(value.isNull(), params).otherwise(changed)


def put_member(body: Column, key: str, value: Column) -> Column:
    """Insert a string member into a JSON object body, replacing an old one.

    A missing body becomes a new object; a body that is no object stays as it
    is, and so does any body when the value is null.
    """
    fresh = F.to_json(F.create_map(F.lit(key), value))
    members = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")
    others = F.map_filter(members, lambda name, _: name != F.lit(key))
    changed = F.to_json(F.map_concat(others, F.create_map(F.lit(key), value.cast("variant"))))
    return (
        F.when(value.isNull(), body)
        .when(body.isNull(), fresh)
        .otherwise(F.coalesce(changed, body))
    )


def is_body(location: str) -> bool:
    """`body`, or one of the two names of the URL query."""
    if location not in ("body", "header", "query"):
        raise ValueError(f"location must be body, header or query, not {location!r}")
    return location == "body"
