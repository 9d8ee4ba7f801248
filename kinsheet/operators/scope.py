"""Which pairs a run may form, and the checks on the options that say so."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsheet.schemas import LEVELS, MODES


@dataclass(frozen=True)
class Scope:
    """Comparison mode, and for directed runs the anchor and target groups."""

    mode: str
    anchor: str | None = None
    targets: tuple[str, ...] = ()

    @property
    def directed(self) -> bool:
        return self.anchor is not None


def unique_in_order(values: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(v for v in (str(v).strip() for v in values) if v))


def make_scope(
    mode: str,
    anchor_group: str | None = None,
    target_groups: Sequence[str] | None = None,
) -> Scope:
    if mode not in MODES:
        raise ValueError(f"unknown comparison mode: {mode}")
    if anchor_group is None and target_groups is None:
        return Scope(mode)
    if mode != "cross":
        raise ValueError("anchor_group and target_groups only apply to cross mode")
    if anchor_group is None or target_groups is None:
        raise ValueError("anchor_group and target_groups must be given together")
    anchor, targets = anchor_group.strip(), unique_in_order(target_groups)
    if not anchor:
        raise ValueError("anchor_group must not be blank")
    if not targets:
        raise ValueError("target_groups is empty after parsing")
    if anchor in targets:
        raise ValueError("target_groups must not contain anchor_group")
    return Scope(mode, anchor, tuple(targets))


def require_groups(scope: Scope, groups: DataFrame) -> None:
    """``groups`` has ``group_id``; only the named groups, or two of any, reach the driver."""
    distinct = groups.select("group_id").distinct()
    if scope.mode == "cross" and distinct.limit(2).count() < 2:
        raise ValueError("cross mode needs at least two groups")
    if not scope.directed:
        return
    named = [scope.anchor, *scope.targets]
    known = {r["group_id"] for r in distinct.where(F.col("group_id").isin(named)).collect()}
    if scope.anchor not in known:
        raise ValueError(f"anchor_group is not in the input: {scope.anchor}")
    unknown = [g for g in scope.targets if g not in known]
    if unknown:
        raise ValueError(f"target_groups not in the input: {','.join(unknown)}")


def parse_levels(levels: Sequence[str]) -> list[str]:
    parsed = unique_in_order([v.lower() for v in levels])
    if not parsed or any(v not in LEVELS for v in parsed):
        raise ValueError("levels must be software, module or both")
    return parsed
