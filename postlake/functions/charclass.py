"""Regex character classes built from rules over Unicode code points."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache


def java_class(belongs: Callable[[str], bool]) -> str:
    """Body of a Java regex class of every code point for which `belongs` holds."""
    ranges: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or not belongs(chr(point)):
            continue
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(
        rf"\x{{{lo:x}}}" if lo == hi else rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges
    )


@lru_cache(maxsize=None)
def other_category() -> str:
    """Code points of category C*: control, format, private use, unassigned."""
    return java_class(lambda ch: unicodedata.category(ch)[0] == "C")


@lru_cache(maxsize=None)
def digits() -> str:
    return java_class(str.isdigit)


@lru_cache(maxsize=None)
def decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit, and the ASCII digit each stands for."""
    found = [ch for ch in map(chr, range(128, sys.maxunicode + 1)) if ch.isdecimal()]
    return "".join(found), "".join(str(unicodedata.decimal(ch)) for ch in found)
