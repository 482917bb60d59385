"""Short SQL text builders used by the oracle statements."""

from __future__ import annotations


def over(n: int, end: int = 0, part: str = "symbol", order: str = "date") -> str:
    """Frame of ``n`` rows ending ``-end`` rows before (positive ``end``: after) the current one."""

    def edge(k: int) -> str:
        return f"{-k} PRECEDING" if k <= 0 else f"{k} FOLLOWING"

    p = f"PARTITION BY {part} " if part else ""
    return f"({p}ORDER BY {order} ROWS BETWEEN {edge(end - n + 1)} AND {edge(end)})"


def roll(fn: str, x: str, n: int, end: int = 0, need: int | None = None, part="symbol", order="date"):
    """``fn`` over the frame once it holds ``need`` values; ``fn`` may contain ``{}``."""
    f = over(n, end, part, order)
    call = fn.format(x) if "{}" in fn else f"{fn}({x})"
    return f"CASE WHEN count({x}) OVER {f} >= {need or n} THEN {call} OVER {f} END"


def lag(x: str, n: int = 1, part="symbol", order="date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"lag({x}, {n}) OVER ({p}ORDER BY {order})"


def lead(x: str, n: int = 1, part="symbol", order="date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"lead({x}, {n}) OVER ({p}ORDER BY {order})"


def chg(x: str, n: int = 1, part="symbol", order="date") -> str:
    return f"({x} / nullif({lag(x, n, part, order)}, 0) - 1)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, FALSE) AS DOUBLE)"


def rsi(gain: str, loss: str) -> str:
    return (
        f"CASE WHEN {loss} = 0 AND {gain} > 0 THEN 100.0 WHEN {loss} = 0 AND {gain} = 0 THEN 50.0 "
        f"ELSE 100.0 - 100.0 / (1.0 + {gain} / nullif({loss}, 0)) END"
    )
