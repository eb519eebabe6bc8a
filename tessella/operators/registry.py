"""Named operations with checked arguments, and their results as rows; safe arithmetic; string similarity."""

from __future__ import annotations

import ast
import difflib
import inspect
import math
import operator
import typing
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Operators and functions that arithmetic may use.
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.BitXor: operator.xor}
_NAMES = {"pi": math.pi, "e": math.e}
_CALLS = {"abs": abs, "round": round, "max": max, "min": min, "sum": lambda *a: sum(a), "sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "exp": math.exp}

# The codes of errors, and names of types.
CODES = [
    "NOT_FOUND", "ACCESS_DENIED", "PERMISSION_DENIED", "IS_DIRECTORY", "BINARY_FILE", "INVALID_PARAM", "INVALID_FORMAT", "EXECUTION_ERROR",
    "TIMEOUT", "INTERNAL_ERROR", "CONFLICT", "CIRCUIT_OPEN", "NETWORK_ERROR", "API_ERROR", "RATE_LIMIT",
]
TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def type_name(annotation: Any) -> str:
    """Name of a Python type in a tool's schema; lists and dicts of anything too, and string for what is unknown."""
    return TYPES.get(typing.get_origin(annotation) or annotation, "string")


def envelope(data: Column, code: Column, partial: Column) -> Column:
    """Struct (status, code, data): error where there is a code, else partial or success.

    An error carries no data, and a code that is not known counts as an internal error.
    """
    failed = code.isNotNull()
    status = F.when(failed, "error").when(partial, "partial").otherwise("success")
    return F.struct(status.alias("status"), F.when(failed, F.when(code.isin(CODES), code).otherwise("INTERNAL_ERROR")).alias("code"), F.when(~failed, data).alias("data"))


def arithmetic(text: str) -> float:
    """Value of an expression of numbers, + - * / ** ^, and a few functions and constants."""

    def value(n: ast.AST) -> Any:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return n.value
        if isinstance(n, ast.Name) and n.id in _NAMES:
            return _NAMES[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            a, b = value(n.left), value(n.right)
            if isinstance(n.op, ast.Pow) and abs(b) > 1000:
                raise ValueError("exponent too large")
            return _BINARY[type(n.op)](a, b)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -value(n.operand) if isinstance(n.op, ast.USub) else value(n.operand)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            return _CALLS[n.func.id](*map(value, n.args))
        raise ValueError(f"not allowed: {ast.dump(n)[:60]}")

    return float(value(ast.parse(text, mode="eval").body))


@F.pandas_udf(DoubleType())
def calculate(texts: pd.Series) -> pd.Series:
    """:func:`arithmetic` of each text, null where it fails."""

    def safe(t: str) -> float | None:
        try:
            return arithmetic(t)
        except Exception:
            return None

    return texts.map(safe).astype(float)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def weighted_order(weight: Column, key: Column, seed: int = 42) -> Column:
    """Sort key that draws rows without replacement in proportion to their weights, by the hash of ``key``."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double")
    return -F.log((place + 0.5) / float(1 << 48)) / weight


class Registry:
    """Operations by name; wrong names and missing arguments come back as rows, not as exceptions."""

    def __init__(self):
        self.found: dict[str, Callable] = {}

    def add(self, f: Callable, name: str | None = None) -> Callable:
        self.found[name or f.__name__] = f
        return f

    def schema(self) -> list[dict]:
        return [{"name": n, "about": inspect.getdoc(f) or "", "arguments": list(inspect.signature(f).parameters), "types": {n: type_name(t) for n, t in typing.get_type_hints(f).items() if n != "return"}} for n, f in sorted(self.found.items())]

    def call(self, name: str, **arguments: Any) -> dict:
        f = self.found.get(name)
        if f is None:
            return {"status": "error", "code": "NOT_FOUND", "text": name}
        wanted = inspect.signature(f).parameters
        missing = [p for p, s in wanted.items() if s.default is inspect.Parameter.empty and p not in arguments]
        if missing:
            return {"status": "error", "code": "INVALID_PARAM", "text": ", ".join(missing)}
        try:
            return {"status": "success", "data": f(**{k: v for k, v in arguments.items() if k in wanted})}
        except Exception as e:
            return {"status": "error", "code": "EXECUTION_ERROR", "text": str(e)}
