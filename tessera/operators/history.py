"""Commit graphs: ancestors, merge bases and independent commits. Metadata only, on the driver."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

Edges = dict[str, list[str]]


def ancestors(edges: Edges, start: str) -> list[str]:
    """The commit and all before it, breadth first, parents in order."""
    seen, queue, out = {start}, deque([start]), []
    while queue:
        now = queue.popleft()
        out.append(now)
        for parent in edges.get(now, ()):
            if parent not in seen:
                seen.add(parent)
                queue.append(parent)
    return out


def independents(edges: Edges, hashes: Iterable[str]) -> list[str]:
    """Those that are no ancestor of another of them, sorted."""
    every = sorted(set(hashes))
    below = {h: set(ancestors(edges, h)) - {h} for h in every}
    return [h for h in every if not any(h in below[o] for o in every if o != h)]


def merge_bases(edges: Edges, ours: str, theirs: str) -> list[str]:
    """Best common ancestors, sorted; a base is not searched beyond."""
    if ours == theirs:
        return [ours]
    if ours in edges.get(theirs, ()):  # the usual commit on the head
        return [ours]
    known, seen, queue, common = set(ancestors(edges, theirs)), {ours}, deque([ours]), []
    while queue:
        now = queue.popleft()
        if now in known:
            common.append(now)
            continue
        for parent in edges.get(now, ()):
            if parent not in seen:
                seen.add(parent)
                queue.append(parent)
    return independents(edges, common)
