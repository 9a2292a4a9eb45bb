"""Settings from a docstring and the command line, aligned tables, and what trees and rules say as text."""

from __future__ import annotations

import re
from collections.abc import Iterable


def coerce(text: str):
    """An integer, a number, a truth value, or the text itself."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"True": True, "False": False}.get(text.strip(), text.strip())


class Knobs(dict):
    """Settings, also as attributes."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e


def settings(doc: str) -> Knobs:
    """Lines like `-name  what it does = value` of a docstring."""
    return Knobs((m[1], coerce(m[2])) for m in re.finditer(r"^\s+-{1,2}(\w+)[^=\n]*=\s*(\S+)\s*$", doc, re.M))


def merged(*parts: dict) -> Knobs:
    """All settings; a name that two parts have is an error."""
    out = Knobs()
    for p in parts:
        if both := sorted(set(out) & set(p)):
            raise ValueError(f"settings given twice: {both}")
        out.update(p)
    return out


def override(knobs: dict, args: list[str]) -> Knobs:
    """Settings with the command line's `-name value` (or --name=value); unknown names are an error, truth values flip."""
    out, at = Knobs(knobs), 0
    while at < len(args):
        name, eq, value = args[at].lstrip("-").partition("=")
        hit = [k for k in out if k == name] or [k for k in out if k.startswith(name)]
        if len(hit) != 1:
            raise ValueError(f"no setting {args[at]}")
        if not eq and isinstance(out[hit[0]], bool):
            out[hit[0]] = not out[hit[0]]
        else:
            if not eq:
                at += 1
                value = args[at]
            out[hit[0]] = coerce(value)
        at += 1
    return out


def tabulated(names: list[str], rows: Iterable[tuple], digits: int = 2) -> list[str]:
    """Aligned lines: numbers to the right, text to the left, a rule under the names."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    rows = list(rows)
    cells = [names, *[[show(v) for v in r] for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(names))]
    right = [all(isinstance(r[i], (int, float)) or r[i] is None for r in rows) for i in range(len(names))]
    lines = ["  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(row, wide, right, strict=True)).rstrip() for row in cells]
    return [lines[0], "  ".join("-" * w for w in wide), *lines[1:]]


def condition(at: str, op: str, value, yes: bool = True) -> str:
    """A cut as text; the far side of <= is >, of == is !=."""
    sign = op if yes else {"<=": ">", "==": "!="}[op]
    return f"{at} {sign} {value:g}" if isinstance(value, float) else f"{at} {sign} {value}"


def tree_lines(cuts: dict[int, tuple], stats: dict[int, tuple[int, float]], wins: dict[int, float] | None = None, goals: dict[int, dict[str, float]] | None = None) -> list[str]:
    """A tree, better kid first: win (if given), n, mean, goal means (if given), condition; the leaf of best mean has a +,
    that of worst a -."""
    leaves = [i for i in stats if i not in cuts]
    best, worst = min(leaves, key=lambda i: (stats[i][1], i)), max(leaves, key=lambda i: (stats[i][1], -i))
    out: list[str] = []

    def walk(i: int, depth: int) -> None:
        mark = "+" if i == best else "-" if i == worst else " "
        text = "" if i == 1 else condition(*cuts[i // 2], yes=i % 2 == 0)
        more = "".join(f" {k}={v:.2f}" for k, v in (goals or {}).get(i, {}).items())
        win = f"{wins[i]:5.0f} " if wins and i in wins else ""
        out.append(f"{mark} {win}{stats[i][0]:6d} {stats[i][1]:6.3f}{more}  {'|  ' * max(0, depth - 1)}{text}".rstrip())
        if i in cuts:
            for k in sorted((2 * i, 2 * i + 1), key=lambda k: (stats[k][1], k) if k in stats else (float("inf"), k)):
                if k in stats:
                    walk(k, depth + 1)

    walk(1, 0)
    return out


def frugal_lines(exits: list[tuple], rest: float) -> list[str]:
    """A fast-and-frugal tree as rules, in the order in which rows leave."""
    out = [f"{'if' if i == 0 else 'elif'} {at} = {v} then {m:.2f}" for i, (at, v, m) in enumerate(exits)]
    return [*out, f"else {rest:.2f}"]
