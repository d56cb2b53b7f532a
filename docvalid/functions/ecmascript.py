"""Numbers, lengths and patterns as the ECMAScript language has them, for Python values and for Columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema.tree import SPACES

_INT = re.compile(r"\s*([+-]?\d+)")
_FLOAT = re.compile(r"\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))")


def parse_int(text: str | None) -> float:
    m = _INT.match(text or "")
    return float(int(m[1])) if m else math.nan


def parse_float(text: str | None) -> float:
    m = _FLOAT.match(text or "")
    return float(m[1].replace("Infinity", "inf")) if m else math.nan


def number_text(x: float) -> str:
    """A number as its language prints it: no trailing .0, exponents from 1e+21 up and below 1e-6."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits, point = whole + ("" if part == "0" else part), len(whole) + int(power or 0)
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0") if "." in mantissa or power else digits.lstrip("0")
    bare = digits.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if 0 < point <= 21:
        return sign + (bare.ljust(point, "0") if len(bare) <= point else f"{bare[:point]}.{bare[point:]}")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{bare}"
    e = point - 1
    return f"{sign}{bare[0]}{'.' + bare[1:] if len(bare) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def number_column(x: Column) -> Column:
    """number_text for a double Column."""
    text = x.cast("string")  # the shortest digits, as 12.5 or 1.25E21
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(F.abs(x).cast("string"), "E", 1), r"\.0$", ""), "^$", "0")
    power = F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1).cast("int")).otherwise(F.lit(0))
    sign = F.when(x < 0, "-").otherwise("")
    fixed = F.regexp_replace(F.regexp_replace(F.abs(x).cast("decimal(38,16)").cast("string"), r"0+$", ""), r"\.$", "")
    whole = F.abs(x).cast("decimal(38,0)").cast("string")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power > 0, "+").otherwise("-"), F.abs(power).cast("string"))
    out = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(x == 0, "0")
    out = out.when((F.abs(x) >= 1e21) | (F.abs(x) < 1e-6), F.concat(sign, exponent))
    return out.when(x == F.floor(x), F.concat(sign, whole)).otherwise(F.concat(sign, fixed))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


class BadPattern(ValueError):
    """The language rejects the pattern."""


def java_pattern(pattern: str) -> str:
    """The pattern for Java's engine; BadPattern where the language's own would reject it."""
    space = "".join(f"\\x{{{ord(c):x}}}" for c in SPACES)
    out, i, in_class, depth = [], 0, False, 0
    can_repeat = False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise BadPattern("\\ at end of pattern")
            d = pattern[i + 1]
            if d == "s":
                out.append(space if in_class else f"[{space}]")
            elif d == "S":
                out.append(f"[^{space}]")
            elif d in "dDwWbBtnrfv0123456789uxckpP" or not d.isalnum():
                hexed = {"u": 4, "x": 2}.get(d, 0)
                known = re.fullmatch(f"[0-9a-fA-F]{{{hexed}}}", pattern[i + 2 : i + 2 + hexed]) if hexed else None
                if hexed and not known or d in "pP" or d == "c":
                    out.append(d)  # without the u flag these are the letter itself
                elif d == "v":
                    out.append(r"\x0B")
                elif d == "b" and in_class:
                    out.append(r"\x08")
                elif d == "0":
                    out.append(r"\x00")
                else:
                    out.append(c + d)
            else:
                out.append(d)
            i, can_repeat = i + 2, True
            continue
        if in_class:
            if c == "]":
                in_class = False
                can_repeat = True
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            if pattern.startswith("[^]", i):
                out.append(r"[\s\S]")
                i, in_class, can_repeat = i + 3, False, True
                continue
            if pattern.startswith("[]", i):
                out.append("(?!)")
                i, in_class, can_repeat = i + 2, False, True
                continue
            out.append("[")
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
        elif c == "(":
            m = re.match(r"\(\?(?::|=|!|<=|<!|<[A-Za-z_$][\w$]*>)", pattern[i:])
            if pattern.startswith("(?", i) and not m:
                raise BadPattern("invalid group")
            out.append(m[0] if m else c)
            i, depth, can_repeat = i + len(m[0] if m else c), depth + 1, False
            continue
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise BadPattern("unmatched )")
            out.append(c)
            can_repeat = True
        elif c in "*+?" or (c == "{" and re.match(r"\{\d+(?:,\d*)?\}", pattern[i:])):
            if not can_repeat:
                raise BadPattern("nothing to repeat")
            m = re.match(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??", pattern[i:])
            bounds = re.match(r"\{(\d+),(\d+)\}", m[0])
            if bounds and int(bounds[1]) > int(bounds[2]):
                raise BadPattern("numbers out of order in quantifier")
            out.append(m[0])
            i, can_repeat = i + len(m[0]), False
            continue
        elif c in "{}":
            out.append("\\" + c)
            can_repeat = True
        elif c == "$":
            out.append(r"\z")
            can_repeat = False
        elif c == "]":
            out.append(r"\]")
            can_repeat = True
        elif c == ".":
            out.append(r"[^\n\r\x{2028}\x{2029}]")
            can_repeat = True
        else:
            out.append(c)
            can_repeat = c not in "|^"
        i += 1
    if in_class:
        raise BadPattern("unterminated character class")
    if depth:
        raise BadPattern("unterminated group")
    return "".join(out)
