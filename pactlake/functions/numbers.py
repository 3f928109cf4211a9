"""Exact JSON values: parsing that keeps numbers, JSON equality, canonical text."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation
from fractions import Fraction
from typing import Any

#: Numbers with a larger decimal exponent, up or down, are refused: their fractions would not fit.
MAX_EXPONENT = 20_000


class InvalidJson(ValueError):
    """Text that is not one JSON value, or repeats a key."""


class Malformed:
    """A number that JSON text holds but that cannot be represented."""

    def __init__(self, text: str):
        self.text = text


def _integer(text: str) -> int | Decimal | Malformed:
    return int(text) if len(text) <= 4000 else _decimal(text)


def _decimal(text: str) -> Decimal | Malformed:
    try:
        value = Decimal(text)
    except InvalidOperation:
        return Malformed(text)
    return value if not value or abs(value.adjusted()) <= MAX_EXPONENT else Malformed(text)


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise InvalidJson("a key is repeated")
    return out


def _refuse(name: str) -> None:
    raise InvalidJson(f"{name} is no JSON value")


_DECODER = json.JSONDecoder(object_pairs_hook=_unique, parse_int=_integer, parse_float=_decimal, parse_constant=_refuse)


def parse(text: str | bytes) -> Any:
    """One JSON value; integers as int, other numbers as Decimal."""
    try:
        if isinstance(text, (bytes, bytearray, memoryview)):
            text = bytes(text).decode()
        return _DECODER.decode(text)
    except InvalidJson:
        raise
    except (ValueError, RecursionError) as e:
        raise InvalidJson(str(e)) from None


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def exact(value: Any) -> Fraction | int | Decimal:
    """A number for exact comparison; floats by their shortest text."""
    return Decimal(repr(value)) if isinstance(value, float) else value


def is_whole(value: Any) -> bool:
    value = exact(value)
    return isinstance(value, int) or value == value.to_integral_value()


def is_multiple(value: Any, divisor: Any) -> bool:
    return (Fraction(exact(value)) / Fraction(exact(divisor))).denominator == 1


def number_text(value: Any) -> str:
    """Plain decimal text without trailing zeros."""
    value = exact(value)
    if isinstance(value, Fraction):
        return str(value)
    text = f"{value:f}" if isinstance(value, Decimal) else str(value)
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def canonical(value: Any) -> Any:
    """A hashable key; two values have one key exactly if they are equal as JSON."""
    if value is None or isinstance(value, (bool, str)):
        return type(value).__name__, value
    if is_number(value):
        sign, digits, exponent = Decimal(exact(value)).as_tuple()
        text = "".join(map(str, digits)).lstrip("0")
        short = text.rstrip("0")
        return ("number", sign, short, exponent + len(text) - len(short)) if short else ("number", 0, "", 0)
    if isinstance(value, list):
        return "array", tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return "object", tuple((k, canonical(value[k])) for k in sorted(value))
    return "unknown", id(value)


def equal(a: Any, b: Any) -> bool:
    return canonical(a) == canonical(b)


def json_type(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if is_number(value):
        return "integer" if is_whole(value) else "number"
    return {str: "string", list: "array", dict: "object"}.get(type(value), "unknown")


def dumps(value: Any) -> str:
    """Deterministic JSON text: sorted keys, numbers as they were read."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(dumps, value)) + "]"
    if isinstance(value, Malformed):
        return value.text
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    return json.dumps(value, ensure_ascii=False)
