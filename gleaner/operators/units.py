"""Text units: lines, JSON lines and JSON leaves with their paths; which of them are scanned."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Characters of a text looked at to tell its format.
SNIFF = 65_536
#: Nesting allowed in JSON.
DEPTH = 128


def route(path: Column) -> Column:
    """The format by extension: json, jsonl, text; sniff where there is none."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return F.when(ext == "json", "json").when(ext.isin("jsonl", "ndjson"), "jsonl").when(ext == "", "sniff").otherwise("text")


def sniff(text: Column) -> Column:
    """S3: json, jsonl or text by the first SNIFF characters."""
    head = F.ltrim(F.regexp_replace(F.substring(text, 1, SNIFF), "^\ufeff", ""))
    looks = head.rlike(r"^[\[{]")
    first = F.regexp_extract(head, r"^([^\n]*)", 1)
    more = F.trim(F.regexp_replace(F.substring(head, F.length(first) + 1, F.length(head)), r"\s", "")) != ""
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(looks & valid(first) & more, "jsonl").when(looks, "json").otherwise("text")


def records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, record): lines of JSON lines, from 1; blank lines are skipped, a byte order mark on line 1 is dropped."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "^\ufeff", ""), "\r?\n")).alias("_i", "record"))
    return lines.filter(F.trim("record") != "").select(key, (F.col("_i") + 1).alias("line_no"), "record")


def checked(recs: DataFrame) -> DataFrame:
    """The same records; a record that is no JSON ends the query, without showing its text."""
    bad = F.concat(F.lit("record "), F.col("line_no"), F.lit(" is not valid JSON"))
    return recs.filter(F.assert_true(F.try_parse_json("record").isNotNull(), bad).isNull())


_LEAVES = T.ArrayType(T.StructType([T.StructField(c, t) for c, t in (("ordinal", T.IntegerType()), ("path", T.StringType()), ("key", T.StringType()), ("kind", T.StringType()), ("value", T.StringType()), ("parent_type", T.StringType()), ("parent_has_mime", T.BooleanType()))]))


def _walk(x, path: str, key: str | None, parent: dict | None, out: list, depth: int = 0) -> None:
    if depth > DEPTH:
        raise ValueError("JSON is nested too deeply")
    if isinstance(x, dict) and x:
        for k, v in x.items():
            _walk(v, f"{path}.{k}" if path else k, k, x, out, depth + 1)
    elif isinstance(x, list) and x:
        for i, v in enumerate(x):
            _walk(v, f"{path}[{i}]", key, parent, out, depth + 1)
    else:
        kind = "empty_object" if isinstance(x, dict) else "empty_array" if isinstance(x, list) else "string" if isinstance(x, str) else "boolean" if isinstance(x, bool) else "null" if x is None else "number"
        p = parent or {}
        kind_of = p.get("type") if isinstance(p.get("type"), str) else None
        value = x if isinstance(x, str) else None if x is None else str(x).lower() if isinstance(x, bool) else x.lexeme if isinstance(x, _Number) else None
        out.append((len(out), path or "(root)", key, kind, value, kind_of, "mimeType" in p))


class _Number:
    """A JSON number as it was written."""

    def __init__(self, lexeme: str):
        self.lexeme = lexeme


def leaves_of(record: str | None) -> list[tuple]:
    """Every leaf of a JSON record in order, numbers as written; nothing where it is no JSON."""
    if record is None:
        return []
    try:
        x = json.loads(record, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except ValueError:
        return []
    out: list[tuple] = []
    _walk(x, "", None, None, out)
    return out


def leaves(recs: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """(keys..., ordinal, path, key, kind, value, parent_type, parent_has_mime) of every leaf, by an Arrow UDF."""
    names = [f.name for f in _LEAVES.elementType.fields]
    walk = F.pandas_udf(lambda s: pd.Series([[dict(zip(names, r)) for r in leaves_of(x)] for x in s], dtype=object), _LEAVES)
    return recs.select(*keys, F.explode(walk(record)).alias("l")).select(*keys, "l.*")


def string_values(record: str | None) -> list[str] | None:
    """The string values of a JSON record in order, without its keys; null where it is no JSON."""
    if record is None:
        return None
    try:
        x = json.loads(record)
    except ValueError:
        return None
    out: list[str] = []
    stack = [x]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, (dict, list)):
            stack += reversed(list(v.values() if isinstance(v, dict) else v))
    return out


def string_leaves(record: Column) -> Column:
    """Column form of :func:`string_values`."""

    def run(records: pa.Array) -> pa.Array:
        return pa.array(map(string_values, records.to_pylist()), pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(record)


def _put(x, values: iter):
    if isinstance(x, str):
        return next(values)
    if isinstance(x, dict):
        return {k: _put(v, values) for k, v in x.items()}
    return [_put(v, values) for v in x] if isinstance(x, list) else x


def _written(x, indent: int | None, level: int = 0) -> str:
    """JSON with numbers as they were read."""
    if isinstance(x, _Number):
        return x.lexeme
    if not isinstance(x, (dict, list)) or not x:
        return json.dumps(x, ensure_ascii=False)
    gap = "" if indent is None else "\n" + " " * indent * (level + 1)
    colon = ":" if indent is None else ": "
    items = [(json.dumps(k, ensure_ascii=False) + colon + _written(v, indent, level + 1)) for k, v in x.items()] if isinstance(x, dict) else [_written(v, indent, level + 1) for v in x]
    end = "" if indent is None else "\n" + " " * indent * level
    open_, close = "{}" if isinstance(x, dict) else "[]"
    return open_ + gap + ("," + gap).join(items) + end + close


def spliced(text: str, spans: list[dict]) -> str:
    """``text`` with ordered, non-overlapping spans replaced."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s["start_cp"]], s["replacement"]]
        at = s["end_cp"]
    return "".join([*out, text[at:]])


def with_string_values(record: str | None, replaced: list[list[dict]] | None, compact: bool) -> str | None:
    """A JSON record with spans of its string values, in order, replaced; a compact one in which nothing is replaced stays as it was written."""
    old = string_values(record)
    if old is None:
        return None
    replaced = replaced or [[] for _ in old]
    if compact and not any(replaced):
        return record
    x = json.loads(record, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    return _written(_put(x, iter([spliced(v, s) for v, s in zip(old, replaced)])), None if compact else 2)


def with_leaves(record: Column, replaced: Column, compact: bool) -> Column:
    """Column form of :func:`with_string_values`; ``replaced`` has (start_cp, end_cp, replacement) for each string value."""

    def run(records: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([with_string_values(a, b, compact) for a, b in zip(records.to_pylist(), lists.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(record, replaced)


_STEP = {"key": r"[^.\[\]]+", "any": r"(?:\.?[^.\[\]]+|\[[0-9]+\])"}


def selector(pattern: str) -> str:
    """A path selector as an anchored form over paths like ``a.b[0].c``; ``*`` is one step, ``**`` any number."""
    pattern = pattern.strip()
    if not pattern:
        raise ValueError("empty path selector")
    if pattern == "*":
        return "^.*$"
    if pattern.count("[") != pattern.count("]"):
        raise ValueError("unterminated '[' in selector")
    out = []
    for m in re.finditer(r"\*\*|\*|\[([^\]]*)\]|[^.\[\]*]+", pattern):
        t = m.group()
        if t == "**":
            out.append(f"(?:{_STEP['any']})*")
        elif t == "*" or t[0] == "[" and m.group(1).strip() in ("", "*"):
            out.append(_STEP["any"])
        elif t[0] == "[":
            if not m.group(1).strip().isdigit():
                raise ValueError("invalid array index in selector")
            out.append(rf"\[{int(m.group(1))}\]")
        else:
            out.append(rf"\.?{re.escape(t)}")
    return "^" + "".join(out) + "$"


def should_scan(path: Column, include: list[str], exclude: list[str]) -> Column:
    """P5: included exactly, and neither it nor an ancestor excluded."""
    inc = F.lit(not include)
    for p in include:
        inc = inc | path.rlike(selector(p))
    exc = F.lit(False)
    for p in exclude:
        exc = exc | path.rlike(selector(p)[:-1] + r"(?:$|[.\[])")
    return inc & ~exc


def coverage(found: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """U4: (scanned, paths): the paths on either side, sorted."""
    d = found.select("path").distinct().withColumn("scanned", should_scan(F.col("path"), include, exclude))
    return d.groupBy("scanned").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))


def repaired(line: Column) -> Column:
    """Unpaired surrogate escapes of a JSON line replaced by U+FFFD."""
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    alone = F.regexp_replace(line, rf"{high}(?!{low})", r"\\ufffd")
    return F.regexp_replace(alone, rf"(?<!\\u[dD][89abAB][0-9a-fA-F]{{2}}){low}", r"\\ufffd")
