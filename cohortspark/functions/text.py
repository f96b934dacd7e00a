"""Building blocks for expression text (``selectExpr`` and ``F.expr``).

Wide projections are written as SQL expression text: one parse per column instead of one driver
call per operator, with the same plan as the Column API.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quoted(value: str | int | float | None) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return str(value)


def map_literal(pairs: Mapping) -> str:
    """A constant map, folded once per task rather than joined."""
    return f"map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in pairs.items())})"


def struct(**parts: str) -> str:
    return f"named_struct({', '.join(f'{quoted(name)}, {text}' for name, text in parts.items())})"


def array(items: Iterable[str]) -> str:
    """An array to explode. Entries that do not apply are NULL and are filtered after the explode:
    compacting the array would make the optimizer evaluate it a second time in a filter below."""
    return f"array({', '.join(items)})"


def known_true(condition: str) -> str:
    """True only when the condition is known and true."""
    return f"coalesce({condition}, false)"


def cases(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    tests = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"CASE {tests} ELSE {otherwise} END"
