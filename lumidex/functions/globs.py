"""Ignore globs as regular expressions of the JVM."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(patterns) -> list[str]:
    """Patterns trimmed and with forward slashes; blanks and what is no text are dropped."""
    return [p.strip().replace("\\", "/") for p in patterns or [] if isinstance(p, str) and p.strip()]


def to_regex(glob: str) -> str:
    """A shell pattern over the whole path, in which '*' crosses '/': regex text for Java."""
    out, k = "", 0
    while k < len(glob):
        c, k = glob[k], k + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := _class_end(glob, k)) >= 0:
            out += _class(glob[k:end])
            k = end + 1
        else:
            out += re.sub(r"([^\w\s])", r"\\\1", c) if c.isascii() else c
    return rf"(?s)\A{out}\z"


def _class_end(glob: str, k: int) -> int:
    at = k + (glob[k : k + 1] == "!")
    return glob.find("]", at + (glob[at : at + 1] == "]"))


def _class(body: str) -> str:
    negated, chars = body.startswith("!"), body.removeprefix("!")
    pieces, k = [], 0
    while k < len(chars):
        if k + 2 < len(chars) and chars[k + 1] == "-":
            if chars[k] <= chars[k + 2]:
                pieces.append(_literal(chars[k]) + "-" + _literal(chars[k + 2]))
            k += 3
        else:
            pieces.append(_literal(chars[k]))
            k += 1
    if not pieces:
        return "." if negated else "(?!)"
    return f"[{'^' * negated}{''.join(pieces)}]"


def _literal(c: str) -> str:
    return c if c.isalnum() or c.isspace() else "\\" + c


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether the path matches any of the patterns; null paths match none."""
    tests = [path.rlike(to_regex(p)) for p in clean(patterns)]
    return F.coalesce(functools.reduce(operator.or_, tests, F.lit(False)), F.lit(False))


def any_of(path: Column, patterns: list[str]) -> Column:
    """matches, by one pattern for all of them."""
    bodies = [to_regex(p).removeprefix(r"(?s)\A").removesuffix(r"\z") for p in clean(patterns)]
    return F.coalesce(path.rlike(rf"(?s)\A(?:{'|'.join(bodies)})\z"), F.lit(False)) if bodies else F.lit(False)


def tested(path: Column) -> Column:
    """What the globs are held against: the path, each folder it lies in, and each with a made-up child `_`, which prunes a folder whose content matches."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = F.when(F.size(parts) > 1, F.flatten(F.transform(folders, lambda f: F.array(f, F.concat(f, F.lit("/_"))))))
    return F.concat(F.array(path), F.coalesce(inside, F.array().cast("array<string>")))


def ignored(path: Column, patterns: list[str]) -> Column:
    """matches, or lies in a folder that is pruned: one that matches itself or with a made-up child `_`."""
    return F.coalesce(F.exists(tested(path), lambda t: matches(t, patterns)), F.lit(False))
