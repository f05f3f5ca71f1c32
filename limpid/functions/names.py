"""Columns of one table for those of another, by the similarity of their names."""

from __future__ import annotations


def _distance(a: str, b: str) -> int:
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    a, b = a.strip().lower(), b.strip().lower()
    return 1.0 if a == b else 1 - _distance(a, b) / max(len(a), len(b))


def suggest(expected: tuple[str, ...], available: tuple[str, ...], least: float = 0.6) -> dict[str, str | None]:
    """For each expected column the one of its name, or else the most similar, the first of equals, or None."""
    out: dict[str, str | None] = {}
    for e in expected:
        best = max(available, key=lambda c: similarity(e, c), default=None)
        out[e] = e if e in available else best if best is not None and similarity(e, best) >= least else None
    return out
