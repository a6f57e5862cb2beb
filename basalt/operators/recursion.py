"""Recursion to a fixpoint with the driver in charge of the rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.store import stored


def iterate(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool, limit: int | None = None, most: int = 100_000) -> DataFrame:
    """All rows of the base and of steps over each round's new rows, until a round brings none.

    With `distinct` a row counts once in all rounds. Each round's rows are written, so plans do not
    grow and a lost executor costs no more than a round; the driver sees counts only. A recursion that
    still brings rows after `most` rounds is an error, never a cut result.
    """
    delta = stored(base.distinct() if distinct else base, "round")
    parts, total = [delta], delta.count()
    for _ in range(most):
        if limit is not None and total >= limit:
            break
        fresh = step(delta)
        if distinct:
            seen = parts[0]
            for p in parts[1:]:
                seen = seen.union(p)
            fresh = fresh.subtract(seen)
        delta = stored(fresh, "round")
        n = delta.count()
        if not n:
            break
        total += n
        parts.append(delta)
        if len(parts) > 32:  # keeps the union short
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.union(p)
            parts = [stored(whole, "rounds")]
    else:
        raise RecursionError(f"the recursion brings new rows after {most} rounds")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out if limit is None else out.limit(limit)
