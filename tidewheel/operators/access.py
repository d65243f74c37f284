"""Access rules: who may read or aggregate which columns, and what happens to others."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum, IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import zero


class Access(Enum):
    READ = "read"
    AGGREGATION = "aggregation"
    WRITE = "write"


class Action(IntEnum):
    """From weak to strong; of several rules the strongest action holds."""

    PASS = 0
    MASK = 1
    DENY = 2


@dataclass(frozen=True)
class Rule:
    access: Access
    groups: frozenset[str]
    action: Action


@dataclass(frozen=True)
class QueryContext:
    """Who asks. ``auth_required``: a context without groups is refused."""

    user: str = ""
    groups: frozenset[str] = field(default_factory=frozenset)
    auth_required: bool = False

    @staticmethod
    def of(user: str = "", groups: Iterable[str] = (), auth_required: bool = False) -> QueryContext:
        return QueryContext(user, frozenset(groups), auth_required)


def read_rules(node: dict | None) -> tuple[Rule, ...]:
    """Rules of a config section ``{read: {groups: [...], action: mask}}``; unknown actions let pass."""
    out = []
    for name, settings in (node or {}).items():
        access = {"read": Access.READ, "aggregation": Access.AGGREGATION, "aggregate": Access.AGGREGATION, "write": Access.WRITE}.get(str(name).lower())
        if access:
            action = {"deny": Action.DENY, "mask": Action.MASK}.get(str((settings or {}).get("action", "")).lower(), Action.PASS)
            out.append(Rule(access, frozenset(map(str, (settings or {}).get("groups") or ())), action))
    return tuple(out)


def check(access: Access, groups: Iterable[str], rules: Iterable[Rule]) -> Action:
    """What the rules for an access do to someone in ``groups``: nothing to members of a rule's groups."""
    mine = frozenset(groups)
    return max((r.action for r in rules if r.access == access and not (r.groups & mine)), default=Action.PASS)


def masked(kind: T.DataType) -> Column:
    """What stands for a column that its reader may not see."""
    if isinstance(kind, T.StringType):
        return F.lit("***")
    value = zero(kind)
    return F.lit(value).cast(kind)
