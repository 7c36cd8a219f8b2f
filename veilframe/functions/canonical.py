"""Canonical JSON to the letter: keys in order of their UTF-16 units and numbers as JavaScript prints them.

Most documents hold neither characters beyond ASCII nor fractions, exponents or very long numbers; for these the built-in
form (``text.canonical_json``) is the same and is used. Only the others go through Python, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import canonical_json

# What the built-in form may write in another way: other characters or escapes, and numbers that are not short integers.
UNUSUAL = r"[^\x00-\x7F]|\\|[0-9][.eE]|-0|[0-9]{15}"
SURROGATE = re.compile("[\ud800-\udfff]")


def number_text(x: float) -> str:
    """The shortest digits that give the number again, plain between 1e-6 and 1e21."""
    if x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign, figures, exponent = Decimal(repr(x)).normalize().as_tuple()
    digits, minus = "".join(map(str, figures)), "-" if sign else ""
    point = len(digits) + exponent  # digits before the decimal point
    if 0 < point <= 21:
        whole, rest = digits[:point].ljust(point, "0"), digits[point:]
        return f"{minus}{whole}{'.' if rest else ''}{rest}"
    if -6 < point <= 0:
        return f"{minus}0.{'0' * -point}{digits}"
    mantissa = digits[0] + (f".{digits[1:]}" if digits[1:] else "")
    return f"{minus}{mantissa}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def string_text(s: str) -> str:
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def written(value: object) -> str:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{string_text(k)}:{written(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    if isinstance(value, str):
        return string_text(value)
    return number_text(value) if isinstance(value, float) else json.dumps(value)


def _refuse(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


def canonical_text(document: str | None) -> str | None:
    """The canonical form of a document; NULL for what is no JSON, or nested too deeply to be read."""
    if document is None:
        return None
    try:
        return written(json.loads(document, parse_int=float, parse_constant=_refuse))
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(T.StringType())
def _exact(documents: pa.Array) -> pa.Array:
    return pa.array([canonical_text(d) for d in documents.to_pylist()], pa.string())


def canonical_json_exact(c: Column) -> Column:
    """``canonical_json`` as JavaScript would write it; a key that comes twice counts with its last value."""
    plain = canonical_json(c)
    unusual = c.rlike(UNUSUAL) | plain.isNull()
    return F.when(unusual, _exact(F.when(unusual, c))).otherwise(plain)
