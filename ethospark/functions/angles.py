"""Angle and vector expressions (degrees), as SQL text.

Feature tables have hundreds of such columns; text keeps the formulas readable and the plan quick
to build.
"""

from __future__ import annotations


def wrap(degrees: str, low: float = -180.0) -> str:
    """Shift by whole turns into [low, low + 360)."""
    if low == 0:
        return f"pmod({degrees}, 360D)"
    return f"(pmod({degrees} - ({low}D), 360D) + ({low}D))"


def direction(dx: str, dy: str) -> str:
    return f"degrees(atan2({dy}, {dx}))"


def corner_angle(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """Turn from b→a to b→c, unwrapped."""
    return f"degrees(atan2({cy} - {by}, {cx} - {bx}) - atan2({ay} - {by}, {ax} - {bx}))"


def length(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


def distance(ax: str, ay: str, bx: str, by: str) -> str:
    return length(f"{ax} - {bx}", f"{ay} - {by}")


def sine_cosine(name: str, angle: str) -> dict[str, str]:
    """An angle column with its sine and cosine, which are written in terms of that column."""
    return {name: angle, f"{name} sine": f"sin(radians(`{name}`))", f"{name} cosine": f"cos(radians(`{name}`))"}
