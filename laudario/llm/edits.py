"""Symmetric-delete neighbourhoods and weighted Damerau-Levenshtein distance."""

from __future__ import annotations

import unicodedata


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def deletes(token: str, distance: int) -> set[str]:
    """The token and all strings that up to `distance` deletions make of it."""
    out = level = {token}
    for _ in range(min(distance, len(token) - 1)):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


# Rows of a keyboard; letters beside each other are mistaken more easily.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR: set[tuple[str, str]] = set()
for _r, _row in enumerate(_ROWS):
    for _i, _c in enumerate(_row):
        for _rr in (_r, _r + 1):
            if _rr < len(_ROWS):
                for _j in (_i - 1, _i, _i + 1):
                    if 0 <= _j < len(_ROWS[_rr]) and (_rr, _j) != (_r, _i):
                        _NEAR |= {(_c, _ROWS[_rr][_j]), (_ROWS[_rr][_j], _c)}

SWAP, DOUBLED, NEAR, OTHER = 0.7, 0.5, 0.8, 1.0


def distance(a: str, b: str, most: float = 3.0) -> float:
    """Weighted restricted Damerau-Levenshtein distance; `most` + 1 once it must exceed `most`.

    Swapped neighbours, a letter doubled or undoubled, and neighbours on the keyboard cost less than
    other edits. Only the cells that a distance of `most` can reach are computed, so that long texts
    cost in proportion to their length.
    """
    if a == b:
        return 0.0
    over = most + 1
    n, m = len(a), len(b)
    band = int(most / DOUBLED)
    if abs(n - m) > band:
        return over
    before2: list[float] = []
    before = [0.0] + [over] * m
    for j in range(min(m, band)):
        before[j + 1] = before[j] + (DOUBLED if j and b[j - 1] == b[j] else OTHER)
    for i in range(n):
        x = a[i]
        drop = DOUBLED if i and a[i - 1] == x else OTHER
        row = [over] * (m + 1)
        if i < band:
            row[0] = before[0] + drop
        low = row[0]
        for j in range(max(0, i - band), min(m, i + band + 1)):
            y = b[j]
            if x == y:
                best = before[j]
            else:
                best = before[j] + (NEAR if (x, y) in _NEAR else OTHER)
            if (c := before[j + 1] + drop) < best:
                best = c
            if (c := row[j] + (DOUBLED if j and b[j - 1] == y else OTHER)) < best:
                best = c
            if i and j and x != y and x == b[j - 1] and a[i - 1] == y and (c := before2[j - 1] + SWAP) < best:
                best = c
            row[j + 1] = best
            if best < low:
                low = best
        if low > most and (not before2 or min(before) > most):
            return over
        before2, before = before, row
    return before[-1] if before[-1] <= most else over


def assign(cost: list[list[float]]) -> tuple[float, list[int]]:
    """Optimal assignment (Hungarian method, shortest augmenting paths); rows at most as many as columns.

    Returns the total and, for each row, its column.
    """
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < low[j]:
                        low[j], way[j] = now, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    where = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            where[match[j] - 1] = j - 1
    return sum(cost[i][where[i]] for i in range(n)), where
