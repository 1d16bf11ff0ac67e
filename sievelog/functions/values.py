"""Values of facts: tags, text encodings, canonical JSON, keys, and the Columns that mirror them."""

from __future__ import annotations

import json
import math
import re
import struct
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTS = "subject string, predicate string, tag string, s string, n double, b boolean"
FACT = ["subject", "predicate", "tag", "s", "n", "b"]


@dataclass(frozen=True)
class Ref:
    id: str


def canonical_json(value: Any) -> str:
    """Members sorted at every level, so that their order makes no second identity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def is_ref(value: Any) -> bool:
    return isinstance(value, Ref) or (isinstance(value, dict) and set(value) == {"id"} and isinstance(value["id"], str))


def ref_id(value: Any) -> Any:
    return value.id if isinstance(value, Ref) else value["id"] if is_ref(value) else value


def encode_number(number: float) -> str:
    """16 hex digits whose text order is the numeric order."""
    if not math.isfinite(number):
        raise ValueError("numbers must be finite")
    (bits,) = struct.unpack(">Q", struct.pack(">d", float(number)))
    return f"{bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63):016x}"


def decode_number(text: str) -> float:
    if not re.fullmatch(r"[0-9a-f]{16}", text):
        return float(text)
    bits = int(text, 16)
    return struct.unpack(">d", struct.pack(">Q", bits ^ (1 << 63 if bits >> 63 else 0xFFFFFFFFFFFFFFFF)))[0]


def fact_value(value: Any) -> tuple[str, str | None, float | None, bool | None]:
    """(tag, s, n, b) of a value; the text "42" and the number 42 differ."""
    if isinstance(value, bool):
        return "b", None, None, value
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ValueError("numbers must be finite")
        return "n", None, float(value), None
    if isinstance(value, str):
        return "s", value, None, None
    if is_ref(value):
        return "r", ref_id(value), None, None
    if isinstance(value, dict):
        return "o", canonical_json(value), None, None
    raise TypeError(f"no value of a fact: {value!r}")


def plain_value(tag: str, s: str | None, n: float | None, b: bool | None) -> Any:
    return {"s": s, "n": n, "b": b, "r": Ref(s) if s is not None else None, "o": json.loads(s) if tag == "o" and s else None}[tag]


def encode_value(value: Any) -> str:
    tag, s, n, b = fact_value(value)
    return f"{tag}:{encode_number(n) if tag == 'n' else str(b).lower() if tag == 'b' else s}"


def decode_value(text: str) -> Any:
    tag, _, rest = text.partition(":")
    if tag == "n":
        return decode_number(rest)
    if tag == "b":
        return rest == "true"
    return {"s": rest, "r": Ref(rest)}.get(tag) if tag in "sr" else json.loads(rest)


def triple_key(subject: str, predicate: str, value: Any) -> str:
    return f"{subject}|{predicate}|{encode_value(value)}"


def entity_of_id(subject: str) -> str:
    return subject.split("_", 1)[0]


def entity_column(subject: Column) -> Column:
    return F.substring_index(subject, "_", 1)


def predicate_of(entity: str, field: str) -> str:
    return f"{entity}/{field}"


def result_key(predicate: str) -> str:
    return predicate.split("/", 1)[-1]


def fact_key(prefix: str = "") -> Column:
    """The identity of a fact as one comparable column."""
    return F.struct(*[F.col(prefix + c) for c in FACT])


def order_of(value: Any) -> tuple:
    """Sort key across kinds: booleans, numbers, references and objects, texts."""
    tag, s, n, b = fact_value(value)
    return ({"b": 0, "n": 1, "o": 2, "r": 2, "s": 3}[tag], s if s is not None else n if n is not None else b)


# Media types by file extension.
MEDIA = {
    "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "text/javascript; charset=utf-8", "mjs": "text/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8", "svg": "image/svg+xml", "txt": "text/plain; charset=utf-8", "md": "text/markdown; charset=utf-8",
}


def content_type(path: str) -> str:
    return MEDIA.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "text/plain; charset=utf-8")


def literal(text: str) -> Any:
    """A command line's value: true, false, a number or a text."""
    if text in ("true", "false"):
        return text == "true"
    try:
        number = float(text)
        return number if math.isfinite(number) and text.strip() else text
    except ValueError:
        return text
