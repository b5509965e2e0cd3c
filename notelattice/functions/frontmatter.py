"""Frontmatter as column expressions: split off, decode seven typed keys, render, merge.

Only the YAML that notes use is decoded (scalars, block lists, flow lists). A block that goes beyond it
gets an error message instead of a guess, so that its page lands among the parse errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelattice.functions.text import text_from, trim_ws
from notelattice.schema import DEFAULT_PAGE_TYPE, DEFAULT_VISIBILITY, FRONTMATTER_KEYS, PAGE_TYPES

OPENING = "---\n"
CLOSING = "\n---\n"
LIST_KEYS = ["tags", "sources"]
NULLABLE_KEYS = ["date", "created_by"]
SCALAR_COLUMNS = [f"_scalar_{k}" for k in FRONTMATTER_KEYS if k not in LIST_KEYS]
RAW_COLUMNS = [*[f"_raw_{k}" for k in FRONTMATTER_KEYS], *[f"_items_{k}" for k in LIST_KEYS]]

SINGLE_QUOTED = r"'((?:[^']|'')*+)'"
DOUBLE_QUOTED = r'"((?:[^"\\]|\\.)*+)"'
FLOW_ITEM = r"""'(?:[^']|'')*+'|"(?:[^"\\]|\\.)*+"|[^,\[\]'"\s][^,\[\]]*+"""


def split_frontmatter(raw: Column) -> tuple[Column, Column, Column]:
    """(yaml text, body, error) of a note."""
    after = text_from(raw, len(OPENING) + 1)
    empty = after.startswith(OPENING)
    at = F.instr(after, CLOSING)
    error = F.when(~raw.startswith(OPENING), F.lit("missing opening frontmatter delimiter")).when(
        ~empty & (at == 0), F.lit("missing closing frontmatter delimiter")
    )
    yaml = F.when(empty, F.lit("")).otherwise(F.substring(after, F.lit(1), at - 1))
    body = F.when(empty, text_from(after, len(OPENING) + 1)).otherwise(text_from(after, at + len(CLOSING)))
    return F.when(error.isNull(), yaml), F.when(error.isNull(), body), error


def found_lines(yaml: Column) -> dict[str, Column]:
    """``_found``: the first lines of all keys in order, by one scan; ``_continued``: scalar keys that go on in a next line."""
    keys, scalars = "|".join(FRONTMATTER_KEYS), "|".join(k for k in FRONTMATTER_KEYS if k not in LIST_KEYS)
    return {
        "_found": F.regexp_extract_all(yaml, F.lit(rf"(?md)^((?:{keys}):(?:[ \t].*)?)$"), F.lit(1)),
        "_continued": F.regexp_extract_all(yaml, F.lit(rf"(?md)^({scalars}):(?=.*\n[ \t]+\S)"), F.lit(1)),
    }


def _lines_of(key: str) -> Column:
    return F.filter("_found", lambda line: line.startswith(f"{key}:"))


def _key_text(key: str) -> Column:
    """Text after ``key:`` on its first line; null where the key is missing."""
    return trim_ws(text_from(F.get(_lines_of(key), F.lit(0)), len(key) + 2))


# The single-letter escapes of double-quoted YAML scalars.
ESCAPES = {
    "0": "\0",
    "a": "\a",
    "b": "\b",
    "t": "\t",
    "n": "\n",
    "v": "\v",
    "f": "\f",
    "r": "\r",
    "e": "\x1b",
    " ": " ",
    '"': '"',
    "/": "/",
    "\\": "\\",
    "N": "\x85",
    "_": "\xa0",
    "L": "\u2028",
    "P": "\u2029",
}
#: Characters that a plain or single-quoted scalar cannot hold as they are.
CONTROL = r"[\x00-\x1F\x7F-\x9F\u2028\u2029\uFEFF]"


def _unescape(c: Column) -> Column:
    """Value of the inside of a double-quoted scalar, in one pass from left to right; null for an unknown escape."""
    parts = F.regexp_extract_all(
        c, F.lit(r"(?s)\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[^\\]+"), F.lit(0)
    )

    def value(part: Column) -> Column:
        letter = F.substr(part, F.lit(2), F.lit(1))
        digits = F.lpad(F.substr(part, F.lit(3)), 8, "0")
        code = F.conv(digits, 16, 10).cast("long")
        character = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # UTF-32 would take U+FEFF for a byte order mark.
        decoded = F.when(code < 0x10000, F.decode(F.unhex(F.substr(digits, F.lit(5))), "UTF-16BE"))
        out = F.when(F.length(part) > 2, F.when(character, decoded.otherwise(F.decode(F.unhex(digits), "UTF-32"))))
        for name, char in ESCAPES.items():
            out = out.when(letter == name, F.lit(char))
        return F.when(part.startswith("\\"), out).otherwise(part)

    values = F.transform(parts, value)
    return F.when(~F.exists(values, lambda x: x.isNull()), F.array_join(values, ""))


def _escape(c: Column) -> Column:
    """The inside of a double-quoted scalar; ``_unescape`` takes it back."""
    parts = F.regexp_extract_all(c, F.lit(rf"(?s){CONTROL}|[\\\"]|(?:(?!{CONTROL})[^\\\"])+"), F.lit(0))

    def text(part: Column) -> Column:
        code = F.lower(F.hex(F.ascii(part)))
        short = F.when(part == "\\", F.lit("\\\\")).when(part == '"', F.lit('\\"')).when(part == "\n", F.lit("\\n"))
        short = short.when(part == "\t", F.lit("\\t")).when(part == "\r", F.lit("\\r")).when(part == "\0", F.lit("\\0"))
        wide = F.concat(F.lit("\\u"), F.lpad(code, 4, "0"))
        return F.coalesce(short, F.when(part.rlike(rf"^{CONTROL}$"), wide).otherwise(part))

    return F.array_join(F.transform(parts, text), "")


def _decode_scalar(text: Column) -> Column:
    """Value of a scalar written plain, 'single' or "double" quoted; null when it is none of these."""
    tail = r"[ \t]*(?:#.*)?\z"
    # Long plain texts are common: what a pattern needs is looked for first.
    comment = F.regexp_replace(text, r"(?:\A|[ \t]+)#.*\z", "")
    plain = F.rtrim(F.when(text.contains("#"), comment).otherwise(text))
    return (
        F.when(
            text.startswith("'") & text.rlike(rf"(?s)\A{SINGLE_QUOTED}{tail}"),
            F.replace(F.regexp_extract(text, rf"(?s)\A{SINGLE_QUOTED}", 1), F.lit("''"), F.lit("'")),
        )
        .when(
            text.startswith('"') & text.rlike(rf"(?s)\A{DOUBLE_QUOTED}{tail}"),
            _unescape(F.regexp_extract(text, rf"(?s)\A{DOUBLE_QUOTED}", 1)),
        )
        .when(text.rlike(r"""\A[\[\]{}&*!|>'"%@`,]|\A[-?](?:\s|\z)""") | (text.contains(":") & text.rlike(r":(?:\s|\z)")), F.lit(None).cast("string"))
        .otherwise(plain)
    )


def _is_null_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:\A|[ \t]+)#.*\z", "").isin("", "~", "null", "Null", "NULL")


def _raw_list(yaml: Column, key: str) -> Column:
    """Texts of the items of a flow or block list; null when the value is no list."""
    flow = rf"(?md)^{key}:[ \t]*\[((?:\s*+(?:{FLOW_ITEM})?\s*+,?)*+)\][ \t]*(?:#.*)?$"
    block = rf"(?md)^{key}:[ \t]*(?:#.*)?\n((?:[ \t]*(?:-(?:[ \t].*)?|#.*)?(?:\n|\z))+)"
    flow_items = F.regexp_extract_all(F.regexp_extract(yaml, flow, 1), F.lit(FLOW_ITEM), F.lit(0))
    block_items = F.regexp_extract_all(
        F.regexp_extract(yaml, block, 1), F.lit(r"(?md)^[ \t]*-(?:[ \t]+(.*))?$"), F.lit(1)
    )
    nothing = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(F.size(_lines_of(key)), F.lit(0)) <= 0, nothing)
        .when(yaml.rlike(flow), flow_items)
        .when(yaml.rlike(block), block_items)
        .when(_key_text(key).rlike(r"\A(?:#.*)?\z"), nothing)
    )


def raw_values(yaml: Column) -> dict[str, Column]:
    """``_raw_<key>``: what stands behind every key, null where it is missing (a list: no items), from ``found_lines``."""
    return {
        f"_raw_{key}": _raw_list(yaml, key) if key in LIST_KEYS else _key_text(key)
        for key in FRONTMATTER_KEYS
    }


def read_values() -> dict[str, Column]:
    """``_scalar_<key>`` and ``_items_<key>`` of the columns of ``raw_values``: decoded, null where unreadable."""
    values: dict[str, Column] = {}
    for key in FRONTMATTER_KEYS:
        raw = F.col(f"_raw_{key}")
        if key in LIST_KEYS:
            values[f"_items_{key}"] = F.transform(raw, lambda x: _decode_scalar(trim_ws(x)))
        else:
            values[f"_scalar_{key}"] = F.when(raw.isNotNull(), _decode_scalar(raw)).otherwise(F.lit(""))
    return values


def decode_values() -> dict[str, Column]:
    """Typed value of every key, from the columns of ``raw_values`` and ``read_values``.

    Missing keys take their defaults, unknown keys are ignored.
    """
    defaults = {"title": "", "page_type": DEFAULT_PAGE_TYPE, "visibility": DEFAULT_VISIBILITY}
    values: dict[str, Column] = {}
    for key in FRONTMATTER_KEYS:
        if key in LIST_KEYS:
            items = F.col(f"_items_{key}")
            values[key] = F.when(~F.exists(items, lambda x: x.isNull()), items)
            continue
        present, scalar = F.col(f"_raw_{key}").isNotNull(), F.col(f"_scalar_{key}")
        if key in NULLABLE_KEYS:
            values[key] = F.when(present & ~_is_null_text(F.col(f"_raw_{key}")), scalar)
        else:
            values[key] = F.when(present, scalar).otherwise(F.lit(defaults[key]))
    return values


def decode_error() -> Column:
    """Why the columns of ``decode_values`` cannot be trusted; null when they can."""
    error = F.lit(None).cast("string")
    for key in FRONTMATTER_KEYS:
        twice = F.size(_lines_of(key)) > 1
        if key in LIST_KEYS:
            bad = F.when(F.col(key).isNull(), F.lit(f"{key}: expected a list of strings"))
        else:
            continued = F.array_contains("_continued", key)
            bad = F.when(F.col(f"_scalar_{key}").isNull() | continued, F.lit(f"{key}: unsupported scalar"))
        error = F.coalesce(error, F.when(twice, F.lit(f"duplicate field `{key}`")), bad)
        if key == "page_type":
            error = F.coalesce(error, bad_page_type(F.col(key)))
    return error


def bad_page_type(value: Column) -> Column:
    names = ", ".join(f"`{n}`" for n in PAGE_TYPES)
    return F.when(
        ~value.isin(PAGE_TYPES),
        F.concat(F.lit("page_type: unknown variant `"), value, F.lit(f"`, expected one of {names}")),
    )


def render_scalar(c: Column) -> Column:
    """A YAML scalar: plain where that is unambiguous, else quoted."""
    # Two branches at every position; all that can only stand at the beginning is one of them.
    not_plain = (
        r"\A(?:---|\.\.\.|[#,\[\]{}&*!|>'\"%@`]|[-?:](?:\s|\z)|\s|\z"
        r"|(?:~|null|Null|NULL|true|True|TRUE|false|False|FALSE)\z"
        r"|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\z"
        r"|[-+]?0(?:x[0-9a-fA-F]+|o[0-7]+|b[01]+)\z"
        r"|[-+]?\.(?:inf|Inf|INF)\z|\.(?:nan|NaN|NAN)\z)"
        r"|[:\s](?:(?<=:)(?:\s|\z)|(?<=\s)(?:#|\z))"
    )
    return (
        F.when(c.rlike(CONTROL), F.concat(F.lit('"'), _escape(c), F.lit('"')))
        .when(c.rlike(not_plain), F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))
        .otherwise(c)
    )


def render_frontmatter(values: dict[str, Column]) -> Column:
    """The block ``---\\n...---\\n`` with all seven keys in their fixed order."""
    parts = [F.lit(OPENING)]
    for key in FRONTMATTER_KEYS:
        value = values[key]
        if key in LIST_KEYS:
            lines = F.array_join(F.transform(value, lambda x: F.concat(F.lit("- "), render_scalar(x))), "\n")
            text = F.when(F.size(value) == 0, F.lit(" []")).otherwise(F.concat(F.lit("\n"), lines))
        else:
            text = F.concat(F.lit(" "), F.coalesce(render_scalar(value), F.lit("null")))
        parts += [F.lit(f"{key}:"), text, F.lit("\n")]
    return F.concat(*parts, F.lit(OPENING))


def updates_error(updates: Column) -> Column:
    """Why a JSON object text cannot be merged; null when it can. Anything but an object changes nothing."""
    raw = json_object(updates)
    variant = F.try_parse_json(updates)
    error = F.lit(None).cast("string")
    for key in FRONTMATTER_KEYS:
        given = F.map_contains_key(raw, key)
        kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant"))
        if key in LIST_KEYS:
            items = F.from_json(raw[key], "array<string>")
            bad = ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>") | F.exists(items, F.isnull)
            message = F.lit(f"{key}: expected a list of strings")
        elif key in NULLABLE_KEYS:
            bad, message = ~kind.isin("STRING", "VOID"), F.lit(f"{key}: expected a string or null")
        else:
            bad, message = kind != "STRING", F.lit(f"{key}: expected a string")
            if key == "title":
                message = F.when(kind == "VOID", F.lit("title cannot be null")).otherwise(message)
        error = F.coalesce(error, F.when(given & bad, message))
        if key == "page_type":
            error = F.coalesce(error, bad_page_type(json_string(raw[key])))
    return error


def json_object(text: Column) -> Column:
    """Map from key to the JSON text of its value (strings keep their quotes); null for a non-object."""
    keys = F.json_object_keys(text)
    # Values as raw JSON text: variant keeps the difference between "1" and 1.
    variant = F.try_parse_json(text)
    return F.map_from_entries(
        F.transform(
            F.filter(F.array(*[F.lit(k) for k in FRONTMATTER_KEYS]), lambda k: F.array_contains(keys, k)),
            lambda k: F.struct(k, _value_json(variant, k)),
        )
    )


def _value_json(variant: Column, key: Column) -> Column:
    value = F.lit(None).cast("string")
    for name in FRONTMATTER_KEYS:
        field = F.try_variant_get(variant, f"$.{name}", "variant")
        value = F.when(key == name, F.when(~F.is_variant_null(field), F.to_json(field))).otherwise(value)
    return value


def json_string(text: Column) -> Column:
    """The string in a JSON string literal."""
    return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")


def merged_value(key: str, raw: Column, existing: Column) -> Column:
    """Value of ``key`` after an update map (see ``json_object``): present keys replace, lists included."""
    text = raw[key]
    new = F.from_json(text, "array<string>") if key in LIST_KEYS else json_string(text)
    return F.when(F.coalesce(F.map_contains_key(raw, key), F.lit(False)), new).otherwise(existing)


def merge_frontmatter(existing: dict[str, Column], updates: Column) -> dict[str, Column]:
    raw = json_object(updates)
    return {key: merged_value(key, raw, existing[key]) for key in FRONTMATTER_KEYS}
