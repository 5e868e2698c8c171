"""Values out of JSON texts by configured paths: columns for Spark, and small helpers for samples."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, present


def json_path(path: str) -> str:
    """``a.b.0.c`` as a JSON path; numbers are places in lists."""
    out = "$"
    for part in re.split(r"[.\[\]]+", path.strip(".")):
        if part:
            out += f"[{part}]" if part.isdigit() else f".{part}"
    return out


def value(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, json_path(path))


def of_key(doc: Column, key: Column) -> Column:
    """The value of an object's key that is itself a column."""
    return F.call_function("get_json_object", doc, F.concat(F.lit("$['"), key, F.lit("']")))


def caseless(doc: Column, path: str) -> Column:
    """A dotted path in which case doesn't count; a key as it is written comes before others."""
    out = doc
    for part in path.split("."):
        keys = F.json_object_keys(out)
        same = F.filter(keys, lambda k: F.lower(k) == part.lower())
        out = of_key(out, F.when(F.array_contains(keys, part), F.lit(part)).otherwise(F.get(same, 0)))
    return out


def property_or(doc: Column, path: str, default: str) -> Column:
    """A property; missing, empty and ``0`` give the default."""
    v = value(doc, path)
    return F.when(v.isNull() | v.isin("", "0", "false", "null"), F.lit(default)).otherwise(v)


def field(doc: Column, rule: str | list | dict) -> Column:
    """A path, a list of paths (the first that isn't blank), ``{join, separator, skip_tokens}`` or ``{key, default}``."""
    if isinstance(rule, str):
        return present(value(doc, rule))
    if isinstance(rule, list):
        return F.coalesce(*[field(doc, r) for r in rule]) if rule else F.lit(None).cast("string")
    if "join" in rule:
        parts = F.array_compact(F.array(*[present(value(doc, p)) for p in rule["join"]]))
        skipped = [s.lower() for s in rule.get("skip_tokens", [])]
        kept = F.filter(parts, lambda p: ~F.lower(p).isin(*skipped)) if skipped else parts
        once = F.aggregate(kept, F.array().cast("array<string>"), lambda acc, p: F.when(F.exists(acc, lambda x: F.contains(F.lower(x), F.lower(p))), acc).otherwise(F.array_append(acc, p)))
        return F.nullif(F.array_join(once, rule.get("separator", " ")), F.lit(""))
    found = field(doc, rule["key"])
    return F.coalesce(found, F.lit(rule["default"])) if rule.get("default") is not None else found


def mapped(doc: Column, mapping: dict[str, str | list | dict]) -> list[Column]:
    """Columns of a record by a mapping; names that begin with ``_`` are notes."""
    return [field(doc, rule).alias(name) for name, rule in mapping.items() if not name.startswith("_")]


def row_filter(doc: Column, rules: list[dict[str, Any]]) -> Column:
    """All rules ``{field, op, value|values}`` hold; ops eq, in, not_in, contains compare texts, others pass."""
    out = F.lit(True)
    for rule in rules:
        v = F.coalesce(value(doc, rule["field"]), F.lit(""))
        want = [str(x) for x in rule.get("values", [rule.get("value", "")])]
        test = {"eq": v == want[0] if want else F.lit(True), "in": v.isin(*want), "not_in": ~v.isin(*want), "contains": F.contains(v, F.lit(want[0] if want else ""))}
        out = out & test.get(rule.get("op", "eq"), F.lit(True))
    return out


#: Places where an array of records is looked for, in this order.
ARRAY_PATHS = ("data.stores", "data.locations", "data.results", "response.entities", "results", "items", "stores", "locations", "data", "features", "dealers", "retailers")


def record_array(doc: Column, data_path: str | None = None, paths: tuple[str, ...] = ARRAY_PATHS) -> Column:
    """The records of an answer as an array of JSON texts: at the configured path, at a usual one, or the answer itself."""
    parse = lambda text: F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), lambda v: F.to_json(v))
    found = [parse(value(doc, p)) for p in ([data_path] if data_path else []) + list(paths)]
    return F.coalesce(*found, parse(doc))


#: Pieces of a text of which brackets and quotes stand alone, and a backslash with what it escapes.
PIECES = r"""(?s)\\.|["'()]|[^"'()\\]+|\\"""


def jsonp_body(text: Column) -> Column:
    """What stands between the first bracket of ``callback(...)`` and the one that closes it, if that is JSON; else the text.

    Brackets within strings don't count, nor does what follows the closing one. A fold over brackets, quotes and the pieces
    between them; plain JSON isn't searched.
    """
    trimmed = F.trim(text)
    start = F.instr(trimmed, "(")
    rest = F.substring(trimmed, start + 1, F.length(trimmed))
    state = lambda depth, quote, size, done: F.struct(depth.alias("depth"), quote.alias("quote"), size.alias("size"), done.alias("done"))

    def step(s: Column, piece: Column) -> Column:
        inside = s["quote"] != ""
        mark = F.when(~inside & piece.startswith("\\"), F.right(piece, F.lit(1))).otherwise(piece)  # a backslash escapes within strings only
        depth = s["depth"] + F.when(inside, 0).when(mark == "(", 1).when(mark == ")", -1).otherwise(0)
        quote = F.when(inside, F.when(mark == s["quote"], "").otherwise(s["quote"])).when(mark.isin('"', "'"), mark).otherwise("")
        return F.when(s["done"], s).otherwise(state(depth, quote, s["size"] + F.length(piece), depth == 0))

    first = state(F.lit(1), F.lit(""), F.lit(0), F.lit(False))
    end = F.aggregate(F.regexp_extract_all(rest, F.lit(PIECES), F.lit(0)), first, step)
    body = let(end, lambda e: F.when(e["done"], F.left(rest, e["size"] - 1)))
    wrapped = ~trimmed.rlike(r'^[\[{"]') & (start > 0)
    return F.when(wrapped, let(body, lambda b: F.when(F.try_parse_json(b).isNotNull(), b).otherwise(text))).otherwise(text)


def flattened(record: Any, prefix: str = "") -> dict[str, Any]:
    """A nested sample as dotted keys; lists of objects by place."""
    if isinstance(record, dict):
        return {k: v for name, x in record.items() for k, v in flattened(x, f"{prefix}.{name}" if prefix else str(name)).items()}
    if isinstance(record, list) and record and isinstance(record[0], dict):
        return {k: v for n, x in enumerate(record) for k, v in flattened(x, f"{prefix}.{n}").items()}
    return {prefix: record}
