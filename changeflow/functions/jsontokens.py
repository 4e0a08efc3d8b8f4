"""Numbers of JSON text with their paths, for a batch of rows."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa

_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]|[^\s\[\]{},:"]++', re.ASCII)
# As the engine reads a number: blanks around it are dropped, one line end after it is looked past.
_NUMBER = re.compile(r"([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)(?:\r\n|\r|\n)?")
_WORDS = frozenset(("true", "false", "null"))


def _plain(token: str) -> str:
    """The text that a quoted token stands for; a half of a character pair becomes a question mark."""
    if "\\" not in token:
        return token[1:-1]
    return json.loads(token).encode("utf-8", "replace").decode()


def _number(token: str) -> float | None:
    """The number of a leaf: a number, or text that holds one."""
    if token[0] == '"':
        held = _NUMBER.fullmatch(_plain(token).strip(" "))
        return float(held[1]) if held else None
    if token in _WORDS or not _NUMBER.fullmatch(token):
        return None
    number = float(token)
    if math.isinf(number):
        return None
    # Whole numbers and decimals have no negative zero.
    return number if "e" in token or "E" in token else number + 0.0


def _joined(path: str | None, last: str) -> str:
    return f"{path}.{last}" if path else last


def leaves(text: str) -> list[tuple[str, str, float]]:
    """``(path, last, number)`` of every number of valid JSON text, in order.

    A stack automaton: a bracket pushes or pops a frame ``[kind, path, name, place]``, a key or a comma names
    the frame's next value, any other token is a leaf.
    """
    out, stack = [], []
    for token in _TOKEN.findall(text):
        if token == ":":
            continue
        if token in ("}", "]"):
            if stack:
                stack.pop()
            continue
        if token == ",":
            if stack:
                top = stack[-1]
                top[2], top[3] = None, top[3] + 1
            continue
        if stack:
            kind, above, name, place = stack[-1]
            last = str(place) if kind == "[" else name or ""
        else:
            kind, above, name, last = None, None, None, ""
        if token in ("{", "["):
            stack.append([token, _joined(above, last) if stack else "", None, 0])
        elif kind == "{" and name is None and token[0] == '"':
            stack[-1][2] = _plain(token)
        else:
            number = _number(token)
            if number is not None:
                out.append((_joined(above, last) if stack else "", last, number))
    return out


def number_lists(texts: pa.Array) -> pa.Array:
    """The leaves of every text of a batch; none of a null."""
    found = [leaves(text) if text else [] for text in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = [leaf for row in found for leaf in row]
    paths, lasts, numbers = zip(*flat, strict=True) if flat else ((), (), ())
    fields = [pa.array(paths, pa.string()), pa.array(lasts, pa.string()), pa.array(numbers, pa.float64())]
    items = pa.StructArray.from_arrays(fields, ["path", "last", "number"])
    return pa.ListArray.from_arrays(pa.array(ends), items)
