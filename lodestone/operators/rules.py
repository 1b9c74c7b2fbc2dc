"""Predicates from policies, and the three-valued decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: share of resolved checks, in hundredths, that must hold.
READY_PERCENT = 85


def predicate(condition: dict) -> Column:
    """A condition tree as a column: all keys hold; `_or` holds a list of trees (or a tree whose keys count each alone);
    `name_gte` compares; a list is membership; true and false test for a value; None for its absence."""

    def one(key: str, want) -> Column:
        if key == "_or":
            some = want if isinstance(want, list) else [{k: v} for k, v in want.items()]
            return reduce(lambda a, b: a | b, [predicate(x) for x in some], F.lit(False))
        if key.endswith("_gte"):
            return F.coalesce(F.col(key[:-4]), F.lit(0)) >= want
        if isinstance(want, list):
            return F.coalesce(F.col(key).isin(want), F.lit(False))
        if isinstance(want, bool):
            return F.coalesce(F.col(key).cast("boolean"), F.lit(False)) == want
        return F.col(key).isNull() if want is None else F.coalesce(F.col(key) == want, F.lit(False))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in condition.items()], F.lit(True))


def applicable(section: dict) -> Column:
    """Whether a section applies to an item: always, where a condition of the item's own names it (a column of flags), or by its
    predicate."""
    flag = F.coalesce(F.col(section["conditional"]).cast("boolean"), F.lit(False)) if section.get("conditional") else F.lit(False)
    return F.lit(bool(section.get("always_applicable"))) | flag | (predicate(section["applies"]) if section.get("applies") else F.lit(False))


def decision(ok: Column, defect: Column, unknown: Column, blocking: Column) -> Column:
    """ready: nothing blocks, something applies, all of it is resolved, and the share of ok is large enough (in whole
    numbers); blocked: something blocks for want of evidence; else revise."""
    resolved = ok + defect
    ready = (blocking == 0) & (resolved > 0) & (unknown == 0) & (ok * 100 >= resolved * READY_PERCENT)
    return F.when(ready, "ready").when((blocking > 0) & (unknown > 0), "blocked").otherwise("revise")
