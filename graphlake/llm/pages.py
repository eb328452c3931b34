"""Reading order of scanned pages: columns from boxes and gaps, and advert lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa

#: Two columns run together into one line: two or more blanks, or a bar between blanks.
_GAP = re.compile(r"\s*\|\s*|\s{2,}")
#: Left edges of one column differ by a few units; those of two columns by hundreds.
COLUMN_GAP = 60


def pieces(line: str) -> list[str]:
    """The parts of a line that stand in different columns."""
    line = line.strip()
    if "  " not in line and " | " not in line:
        return [line] if line else []
    return [p for p in _GAP.split(line) if p]


def placed_pieces(number: int, line: str) -> list[tuple[int, int, str]]:
    """``pieces`` with the number of the line and the place of the first letter in it."""
    out, at = [], 0
    for p in pieces(line):
        at = line.index(p, at)
        out.append((number, at, p))
        at += len(p)
    return out


def columns(lines: Sequence, x0: Sequence[int] | None, y0: Sequence[int] | None, split: Callable = pieces) -> list[list]:
    """The lines of each column, top down, columns from left to right; ``split`` gives the pieces of a line.

    Without boxes all lines are one column in the order of the text, so the
    reader must allow for lines of other columns in between.
    """
    if x0 is None or len(x0) != len(lines):
        parted = [split(x) for x in lines]
        width = max(map(len, parted), default=1)
        out: list[list[str]] = [[] for _ in range(max(width, 1))]
        for line in parted:
            for k, p in enumerate(line):
                out[k].append(p)
        return [c for c in out if c]
    edges: list[int] = []
    for x in sorted(set(x0)):
        if not edges or x - edges[-1] > COLUMN_GAP:
            edges.append(x)
        else:
            edges[-1] = x  # the right end of the cluster
    parts = []
    for i, line in enumerate(lines):
        first = 0
        while x0[i] > edges[first]:
            first += 1
        parts.append((first, i, split(line)))
    # rows of several columns only show the left edge of their first column
    width = max((f + len(p) for f, _, p in parts), default=1)
    if width > len(edges) and len(edges) > 1:
        shift = _places(parts, edges, lines, x0, width)
        parts = [(shift[f], i, p) for f, i, p in parts]
        width = max(width, max(f + len(p) for f, _, p in parts))
    out = [[] for _ in range(width)]
    for f, i, p in sorted(parts, key=lambda t: (y0[t[1]] if y0 is not None else t[1], t[1])):
        for k, q in enumerate(p):
            out[f + k].append(q)
    return [c for c in out if c]


def _places(parts: list, edges: list[int], lines: Sequence[str], x0: Sequence[int], width: int) -> list[int]:
    """The column of each cluster of left edges, when some columns never start a row: by even spacing."""
    span = max(edges[-1] - edges[0], 1)
    best, cost = list(range(len(edges))), None
    for last in range(len(edges) - 1, width):
        step = span / max(last, 1)
        at = [round((e - edges[0]) / step) for e in edges]
        if len(set(at)) < len(at):
            continue
        off = sum(abs((e - edges[0]) / step - a) for e, a in zip(edges, at, strict=True))
        fits = all(at[f] + len(p) <= width for f, _, p in parts)
        c = (not fits, off)
        if cost is None or c < cost:
            best, cost = at, c
    return best


def lists(col: pa.Array) -> Callable[[int], list[int] | None]:
    """Access to the list of a row; None for a null list or one with nulls inside."""
    flat, offs = col.values, col.offsets.to_pylist()
    if flat.null_count:
        rows = col.to_pylist()
        return lambda k: None if rows[k] is None or None in rows[k] else rows[k]
    null = col.is_null().to_pylist() if col.null_count else None
    values = flat.to_pylist()
    return lambda k: None if null and null[k] else values[offs[k] : offs[k + 1]]
