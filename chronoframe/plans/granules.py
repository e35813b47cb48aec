"""The number of granules of a granule-pair join, from a cost model.

For an inner relation of n rows over k granules the model weighs the partitions that are read
against the false hits; k is the fixpoint of the optimum for a tightening factor that itself
depends on k.
"""

from __future__ import annotations

import math


def tightening(k: float, longest: int, span: int) -> float:
    """Share of the (k * k + k) / 2 cells that rows of at most `longest` points can reach."""
    if k < 1:
        return 1.0
    c = min(k, math.ceil(longest / max(1, math.ceil(span / k))))
    return (2 * k * c + 2 * k - c * c - c) / (k * k + k)


def independent_granules(n: int, longest: int, span: int, k: float) -> int:
    """The count that leaves the other relation out of account."""
    return max(1, math.ceil((1.5 * n) ** (1 / 3) / tightening(k, longest, span) ** (1 / 3)))


def granule_count(n_outer: int, longest_outer: int, span_outer: int, n_inner: int, longest_inner: int, span_inner: int, rows_per_page: int = 64, io_cost: float = 1.0, cpu_cost: float = 0.0025, rounds: int = 50) -> int:
    """Granules for the inner relation: at most `rounds` steps of the fixpoint, capped by the span."""
    if min(n_outer, n_inner, span_inner) < 1:
        return 1
    k = 1.0
    for _ in range(rounds):
        cells = max(1.0, min((k * k + k) / 2 * tightening(k, longest_outer, span_outer), n_outer))
        share = max(1e-9, tightening(k, longest_inner, span_inner))
        new = (3 * n_inner / (2 * share) * (io_cost / rows_per_page + 2 * n_outer * cpu_cost / cells)) ** (1 / 3)
        new = min(max(1.0, new), float(span_inner))
        if abs(new - k) < 0.5:
            break
        k = new
    return max(1, round(new))
