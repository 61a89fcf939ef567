"""Slimming of raw session records before they are sent: every line stays, its weight goes.

What happens to a value depends on its place in the record alone, so ``RULES`` is a table from places
to what is done there, and one walk applies it. Lines that no rule can touch, most of
them, are told by length and marks in SQL and never reach Python; they stay as they came.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sizes, types of parts, and marks of what was left out.
LONG, END, ARGUMENT, RESULT, SKELETON = 50_000, 25_000, 300, 500, 500
LINE_CHARS, LEAST_LEAF = 2 << 20, 500
THOUGHTS, PICTURES = ("thinking", "reasoning", "redacted_thinking"), ("image", "input_image", "image_url")
CALLS, RESULTS = ("tool_use", "function_call"), ("tool_result", "function_call_output")
SNAPSHOT, KEPT_ARGUMENTS = "file-history-snapshot", ("file_path", "command")
CUT = "…[truncated]"
TOUCHED = (*THOUGHTS, *PICTURES, *CALLS, *RESULTS, SNAPSHOT, "toolUseResult")

Place = tuple[str, ...]


def stripped(kind: str) -> dict[str, Any]:
    return {"type": kind, "stripped": True}


def ends_only(text: str) -> str:
    """A long text's two ends, with how much is missing between them."""
    missing = len(text) - 2 * END
    return f"{text[:END]}\n…[{missing} chars dropped]…\n{text[-END:]}" if len(text) > LONG else text


def walk(value: Any, place: Place, change: Callable[[Place, Any], tuple[Any, bool]]) -> Any:
    """``value`` with ``change`` applied from the outside in. It gets a value and its place (list members
    are ``*``) and says what stands there, and whether to go on inside."""
    value, deeper = change(place, value)
    if deeper and isinstance(value, dict):
        return {k: walk(v, (*place, k), change) for k, v in value.items()}
    if deeper and isinstance(value, list):
        return [walk(v, (*place, "*"), change) for v in value]
    return value


def limited(value: Any, most: int) -> Any:
    """``value`` with all texts in it cut to ``most`` characters."""
    return walk(value, (), lambda _, v: (v[:most], False) if isinstance(v, str) else (v, True))


def _call(part: dict) -> dict:
    given = part.get("input") or part.get("arguments") or {}
    if isinstance(given, str):
        given = {"args": given}
    told = {}
    if isinstance(given, dict):  # the path of a file is worth its length
        told = {k: v if k == "file_path" else v[:ARGUMENT] for k in KEPT_ARGUMENTS if isinstance(v := given.get(k), str)}
    return {"type": "tool_use", "name": part.get("name") or "", "input": told or limited(given, ARGUMENT)}


def _result(part: dict) -> dict:
    body = part.get("content") or part.get("output") or ""
    if isinstance(body, list):
        texts = [p.get("text") if isinstance(p, dict) else None for p in body]
        body = "\n".join(t if isinstance(t, str) else "" for t in texts)
    elif not isinstance(body, str):
        body = json.dumps(body, ensure_ascii=False)
    return {"type": "tool_result", "content": body[:RESULT], "truncated": len(body) > RESULT}


#: What becomes of a part, by its type.
PARTS: dict[str, Callable[[dict], dict]] = (
    {kind: lambda _: stripped("thinking") for kind in THOUGHTS}
    | {kind: lambda _: stripped("image") for kind in PICTURES}
    | dict.fromkeys(CALLS, _call)
    | dict.fromkeys(RESULTS, _result)
)


def _part(value: Any) -> tuple[Any, bool]:
    if isinstance(value, dict):
        if rule := PARTS.get(value.get("type") if isinstance(value.get("type"), str) else ""):
            return rule(value), False
        if isinstance(value.get("text"), str):
            return value | {"text": ends_only(value["text"])}, False
    return value, False


def _tool_result(value: Any) -> tuple[Any, bool]:
    if not isinstance(value, dict):
        return value, False
    data = [v.get("base64") for k in ("file", "image") if isinstance(v := value.get(k), dict)]
    return (stripped("image") if value.get("type") == "image" or any(data) else limited(value, SKELETON)), False


def _text(value: Any) -> tuple[Any, bool]:
    return (ends_only(value) if isinstance(value, str) else value), False


#: What is done by place in a node, which is the record (or, of one agent, its payload) and each message
#: in a node; ``?`` is any other name.
RULES: dict[Place, Callable[[Any], tuple[Any, bool]]] = {
    (): lambda v: (v, True) if isinstance(v, dict) else _text(v),
    ("content",): lambda v: (v, True) if isinstance(v, list) else _text(v),
    ("content", "*"): _part,
    ("?",): _text,
}


def rule_at(place: Place, inside: Place) -> Callable[[Any], tuple[Any, bool]]:
    """The rule for a place; ``inside`` is where the outermost node lies."""
    if place == ("toolUseResult",):
        return _tool_result
    if len(place) < len(inside):
        return lambda v: (v, True)
    if place[: len(inside)] != inside:
        return lambda v: (v, False)
    place = place[len(inside) :]
    while place[:1] == ("message",):
        place = place[1:]
    return RULES.get(place) or RULES[("?",)]


def fitted(record: Any, most: int) -> str:
    """The record as JSON of at most ``most`` characters. All texts are cut to one length, the largest for
    which it fits; if that would be under ``LEAST_LEAF``, the JSON itself is cut."""
    shown = json.dumps(record, ensure_ascii=False, separators=(",", ":"))
    if len(shown) <= most:
        return shown

    def leaves(value: Any) -> Iterator[str]:
        if isinstance(value, str):
            yield value
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            yield from leaves(v)

    # sizes are those in JSON, where some characters take more than one
    size = lambda text: len(json.dumps(text, ensure_ascii=False)) - 2
    sizes = [(v, size(v)) for v in leaves(record) if len(v) > LEAST_LEAF + len(CUT)]

    def lost(level: int) -> int:
        return sum(n - size(v[:level]) - len(CUT) for v, n in sizes if len(v) > level + len(CUT))

    low, high = LEAST_LEAF - 1, max((len(v) for v, _ in sizes), default=0)
    while low < high:
        level = (low + high + 1) // 2
        low, high = (level, high) if lost(level) >= len(shown) - most else (low, level - 1)
    if low >= LEAST_LEAF:
        cut = walk(record, (), lambda _, v: (v if len(v) <= low + len(CUT) else v[:low] + CUT, False) if isinstance(v, str) else (v, True))
        return json.dumps(cut, ensure_ascii=False, separators=(",", ":"))
    return shown[: most - len(CUT)] + CUT


def slim_record(line: str | None, agent: str | None, most: int = LINE_CHARS) -> str | None:
    """One raw line, slimmed; a line that is no JSON object stays as it is, up to ``most`` characters."""
    if line is None:
        return None
    try:
        record = json.loads(line)
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return line if len(line) <= most else line[: most - len(CUT)] + CUT
    if record.get("type") == SNAPSHOT:
        return json.dumps(stripped(SNAPSHOT), separators=(",", ":"))
    inside = ("payload",) if agent == "codex" and isinstance(record.get("payload"), dict) else ()
    return fitted(walk(record, (), lambda place, v: rule_at(place, inside)(v)), most)


def slimmed_record(line: Column, agent: Column, most: int = LINE_CHARS) -> Column:
    """The lines that a rule may touch go through Python, as a record's shape is free; others stay."""
    touched = F.length(line) > min(LONG, most)
    for mark in TOUCHED:
        touched |= line.contains(f'"{mark}"')

    @F.pandas_udf(StringType())
    def slimmed(lines: pd.Series, agents: pd.Series) -> pd.Series:
        return pd.Series([slim_record(line, agent, most) for line, agent in zip(lines, agents)], dtype=object)

    return F.coalesce(slimmed(F.when(touched, line), F.when(touched, agent)), line)
