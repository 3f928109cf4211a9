"""Default filling: the only operator that changes data.  It never validates.

Own defaults, or those along a chain of references, fill properties that are missing; defaults
from ``anyOf`` branches also replace null.  Objects and items of arrays are filled inside;
``allOf``, ``oneOf`` and conditions are not followed.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable
from typing import Any

from pactlake.plans.schema import Schema

_CALL = re.compile(r"([A-Za-z_]\w*)\((.*)\)", re.DOTALL)
#: References that a default's own chain follows at most.
_CHAIN = 64


class DefaultLoop(ValueError):
    """A default that expands itself without end."""


def resolve_default(node: Schema) -> Any:
    """The node's own default, else the first along its references; None if there is none."""
    for _ in range(_CHAIN):
        if node.get("default") is not None:
            return copy.deepcopy(node.get("default"))
        target = node.target("$ref") if isinstance(node.get("$ref"), str) else None
        if target is None:
            return None
        node = target
    return None


def evaluate_default(node: Schema, value: Any) -> Any:
    """A text ``name(args)`` calls the registered function; unknown or failing ones stay text."""
    call = call_of(node, value)
    return value if call is None else call()


def call_of(node: Schema, value: Any) -> Callable[[], Any] | None:
    """What a text ``name(args)`` calls, if such a function is registered; a failing call gives the text."""
    if not isinstance(value, str) or not (m := _CALL.fullmatch(value.strip())) or m[1] not in node.catalog.default_functions:
        return None
    make, args = node.catalog.default_functions[m[1]], [a.strip() for a in m[2].split(",") if a.strip()]

    def call() -> Any:
        try:
            return make(*args)
        except Exception:  # a default function is foreign code
            return value

    return call


def fill(node: Schema, value: Any, depth: int = 0, trail: tuple[int, ...] = ()) -> Any:
    """A copy of a decoded value with its defaults."""
    if depth > 200:
        raise DefaultLoop(node.location)
    if isinstance(node.get("$ref"), str) and (target := node.target("$ref")) is not None and target is not node:
        value = fill(target, value, depth + 1, trail)
    if isinstance(value, dict):
        value = dict(value)
        for name, s in node.get("properties", {}).items():
            _fill_property(value, name, s, depth, trail)
    elif isinstance(value, list) and "items" in node:
        value = [fill(node.get("items"), x, depth + 1, trail) if isinstance(x, dict) else x for x in value]
    return value


def _fill_property(value: dict, name: str, s: Schema, depth: int, trail: tuple[int, ...]) -> None:
    made = False
    for branch in s.get("anyOf", []):
        if value.get(name) is None and (d := resolve_default(branch)) is not None:
            value[name], made = evaluate_default(branch, d), True
            break
    if name not in value and (d := resolve_default(s)) is not None:
        value[name], made = evaluate_default(s, d), True
    if made:
        if id(s) in trail:
            raise DefaultLoop(f"{name}: {s.location}")
        trail = (*trail, id(s))
    if isinstance(value.get(name), (dict, list)):
        value[name] = fill(s, value[name], depth + 1, trail if made else ())
        for branch in s.get("anyOf", []):
            value[name] = fill(branch, value[name], depth + 1, trail if made else ())


def fill_json(node: Schema, text: str) -> str | None:
    """JSON text with defaults; None for text that is no JSON."""
    try:
        value = node.catalog.decode(text)
    except ValueError:
        return None
    return node.catalog.encode(fill(node, value) if isinstance(value, dict) else value)
