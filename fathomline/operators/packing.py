"""Budgeted selection: whole units are taken one after the other by diminishing gain.

Each query's candidates (a few hundred at most, see the recall lanes) are one group; the choice
depends on what was chosen before, so it runs in ``applyInPandas``. One greedy core serves all
presets, which differ in what an item is and how its gain is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Policy:
    """``items``: unit, family (all parts of a symbol as one choice) or entity (a symbol or its parts)."""

    items: str = "unit"
    min_gain: float = 0.015
    bundle_share: float = 1.0
    bundle_bonus: float = 1.0
    overall_share: float = 0.3
    diminishing: bool = False


PRESETS = {
    "serial": Policy(),
    "cascade": Policy(items="family", bundle_share=0.45, bundle_bonus=1.25),
    "entity": Policy(items="entity", bundle_share=0.65),
    "batched": Policy(items="bundle", min_gain=0.015),
    "routed": Policy(items="bundle", min_gain=0.005),
    "plain_evidence": Policy(diminishing=True, min_gain=0.0),
}

SCHEMA = "qid long, position int, uid long, cost int, gain double, spent int"


def _items(units: list[tuple], policy: Policy, budget: int) -> list[list[int]]:
    """Choices as lists of places in ``units``, whose rows are (uid, symbol, cost, ...)."""
    singles = [[i] for i in range(len(units))]
    if policy.items == "unit":
        return singles
    families: dict[object, list[int]] = {}
    for i, u in enumerate(units):
        families.setdefault(u[1], []).append(i)
    cost = lambda ids: sum(units[i][2] for i in ids)
    whole = [ids for ids in families.values() if len(ids) > 1 and cost(ids) <= policy.bundle_share * budget]
    if policy.items == "family":
        return singles + whole
    if policy.items == "entity":
        taken = {i for ids in whole for i in ids}
        return [s for s in singles if s[0] not in taken] + whole
    return [[i, *(j for j in families[units[i][1]] if j != i)] if cost(families[units[i][1]]) <= 768 else [i] for i in range(len(units))]


def select(units: list[tuple], budget: int, policy: Policy) -> list[tuple[int, float, int]]:
    """(place in ``units``, gain, spent) in the order of choice; rows are (uid, symbol, cost, path, overall, facet scores)."""
    choices = _items(units, policy, budget)
    facets = np.array([u[5] for u in units], dtype=np.float64).reshape(len(units), -1)
    covered = np.zeros(facets.shape[1])
    paths: dict[object, int] = {}
    symbols: dict[object, int] = {}
    done: set[int] = set()
    spent, out = 0, []
    while True:
        best = None
        for ids in choices:
            left = [i for i in ids if i not in done]
            if not left or (policy.items == "bundle" and ids[0] in done):
                continue
            cost = sum(units[i][2] for i in left)
            if spent + cost > budget:
                if not policy.diminishing or len(left) == 1:
                    continue
            values = facets[left].max(axis=0) if policy.items != "bundle" else facets[ids[0]]
            top = max(units[i][4] for i in left) if policy.items != "bundle" else units[ids[0]][4]
            if policy.diminishing:
                gain = float((values / (1 + covered)).max()) / (1 + 0.1 * paths.get(units[left[0]][3], 0) + 0.8 * symbols.get(units[left[0]][1], 0))
            else:
                mean = float((values / (1 + covered)).sum()) / len(values)
                gain = ((1 - policy.overall_share) * mean + policy.overall_share * top) * (policy.bundle_bonus if len(ids) > 1 else 1.0) / (max(120, cost) / 300) ** 0.35
            key = (round(gain, 12), -units[ids[0]][0], -len(ids))
            if best is None or key > best[0]:
                best = (key, left, values, cost, gain)
        if best is None or best[4] < policy.min_gain or best[4] <= 0:
            return out
        _, left, values, cost, gain = best
        spent += cost
        covered = covered + values
        paths[units[left[0]][3]] = paths.get(units[left[0]][3], 0) + 1
        symbols[units[left[0]][1]] = symbols.get(units[left[0]][1], 0) + 1
        for i in left:
            done.add(i)
            out.append((i, gain, spent))


def pack(candidates: DataFrame, budget: int, preset: str) -> DataFrame:
    """Choose per query among (qid, uid, symbol, cost, path, overall, facets array<double>); never over budget."""
    policy = PRESETS[preset]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.drop_duplicates("uid").sort_values("uid")
        units = list(zip(rows.uid, rows.symbol, rows.cost, rows.path, rows.overall, rows.facets, strict=True))
        chosen = select(units, budget, policy)
        if chosen and chosen[-1][2] > budget:
            raise ValueError("a selection exceeds its budget")
        qid = int(group.qid.iloc[0])
        return pd.DataFrame([(qid, k, units[i][0], units[i][2], round(gain, 6), spent) for k, (i, gain, spent) in enumerate(chosen)], columns=["qid", "position", "uid", "cost", "gain", "spent"])

    return candidates.groupBy("qid").applyInPandas(run, SCHEMA)


#: fixed values of the evidence policy: stage size, shares of a stage, limits of helpers and families
STAGE, CORE_SHARE, NEAR_SHARE = 8000, 0.82, 0.85
HELPERS, HELPER_COST, HELPERS_COST, HELPER_SYMBOLS, HELPER_SCORE, FAMILY_COST = 3, 1000, 1600, 8, 0.5, 3200
#: least substance of entry points, of what they call and of helpers
SUBSTANCE = 0.5


@dataclass(frozen=True)
class Unit:
    """A candidate; ``worth`` has the intent's value first and then a value for each facet.

    ``notes`` are units its documentation names; ``bundled`` says whether its symbol's other parts follow it.
    """

    uid: int
    symbol: str
    path: str
    cost: int
    role: str
    intent: float
    worth: tuple[float, ...]
    callees: frozenset[int] = frozenset()
    substance: float = 1.0
    notes: frozenset[int] = frozenset()
    bundled: bool = True


class Evidence:
    """Selection in phases: entry points for each facet, what they call, their other parts, tests, then the rest."""

    def __init__(self, units: list[Unit], budget: int, primary: str = "implementation", tests: bool = False):
        self.units = {u.uid: u for u in units}
        self.budget, self.primary, self.tests = budget, primary, tests
        self.columns = max((len(u.worth) for u in units), default=0)
        self.families: dict[str, list[int]] = {}
        for u in units:
            self.families.setdefault(u.symbol, []).append(u.uid)
        self.covered = [0.0] * self.columns
        self.paths: dict[str, int] = {}
        self.symbols: dict[str, int] = {}
        self.taken: dict[int, str] = {}
        self.spent = 0

    def tells(self, u: Unit) -> bool:
        return u.role == self.primary and u.substance >= SUBSTANCE

    def helpers(self, u: Unit) -> list[int]:
        if not u.role == self.primary == "implementation":
            return []
        near = {x for c in u.callees if (x := self.units.get(c)) and x.path == u.path}
        if len({x.symbol for x in near}) > HELPER_SYMBOLS:
            near = set()
        named = {x for c in u.notes if (x := self.units.get(c))}
        fit = [x for x in near | named if x.uid != u.uid and x.uid not in self.taken and self.tells(x) and x.cost <= HELPER_COST and x.intent >= HELPER_SCORE]
        out, room = [], HELPERS_COST
        for x in sorted(fit, key=lambda x: (-x.intent, x.uid))[:HELPERS]:
            if x.cost <= room:
                out.append(x.uid)
                room -= x.cost
        return out

    def merit(self, u: Unit, column: int | None) -> float:
        top = u.worth[column] if column is not None else max(w / (1 + c) for w, c in zip(u.worth, self.covered, strict=True))
        return top / (1 + 0.1 * self.paths.get(u.path, 0) + 0.8 * self.symbols.get(u.symbol, 0))

    def take(self, ids, phase: str, limit: float, column: int | None = None) -> bool:
        """Take the best unit of ``ids`` that fits, with its helpers if they fit too."""
        for _, _, u in sorted(((-self.merit(u, column), u.uid, u) for i in ids if i not in self.taken for u in [self.units[i]]), key=lambda x: x[:2]):
            if self.merit(u, column) <= 0:
                return False
            group = [u.uid, *self.helpers(u)]
            if self.spent + sum(self.units[i].cost for i in group) > limit:
                group = [u.uid]
            if self.spent + sum(self.units[i].cost for i in group) > limit:
                continue
            for i in group:
                self.taken[i] = phase
                self.spent += self.units[i].cost
            self.covered = [c + w for c, w in zip(self.covered, u.worth, strict=True)]
            self.paths[u.path] = self.paths.get(u.path, 0) + 1
            self.symbols[u.symbol] = self.symbols.get(u.symbol, 0) + 1
            return True
        return False

    def callees(self) -> list[int]:
        return sorted({c for i in self.taken for c in self.units[i].callees if c in self.units and self.tells(self.units[c])})

    def continuations(self) -> list[int]:
        kept = {self.units[i].symbol for i in self.taken if self.units[i].bundled}
        return [i for s in sorted(kept) for i in self.families[s] if sum(self.units[j].cost for j in self.families[s]) <= FAMILY_COST]

    def run(self) -> list[tuple[int, str]]:
        """(uid, phase) in the order of choice."""
        entries = [u.uid for u in self.units.values() if self.tells(u)]
        facets = list(range(1, self.columns)) or [0]
        stage = 0
        while self.units and stage < self.budget:
            stage = min(stage + STAGE, self.budget)
            for q in facets * 3:
                self.take(entries, "primary", stage * CORE_SHARE, q)
            for _ in range(2):
                self.take(self.callees(), "dependency", stage * CORE_SHARE)
            while self.take(self.continuations(), "continuation", stage * NEAR_SHARE):
                pass
            for q in facets:
                self.take(entries, "primary", stage * NEAR_SHARE, q)
            if self.tests and self.primary == "implementation":
                known = [u.uid for u in self.units.values() if u.role == "test"]
                near = [i for i in known if self.units[i].callees & self.taken.keys()]
                for q in facets:
                    self.take(near or known, "support", stage, q)
            while self.take(self.units, "fill", stage):
                pass
        if self.spent > self.budget:
            raise ValueError("a selection exceeds its budget")
        return list(self.taken.items())


def pack_evidence(candidates: DataFrame, budget: int) -> DataFrame:
    """Choose per query among (qid, uid, symbol, path, cost, role, intent, worth array<double>, callees array<bigint>, tests).

    Optional columns: ``primary`` (the role asked for), ``substance``, ``notes`` array<bigint> and ``bundled``, as in ``Unit``.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.drop_duplicates("uid").sort_values("uid")
        units = [
            Unit(int(r.uid), r.symbol, r.path, int(r.cost), r.role, float(r.intent), tuple(map(float, r.worth)), frozenset(map(int, r.callees)), float(getattr(r, "substance", 1.0)), frozenset(map(int, getattr(r, "notes", ()))), bool(getattr(r, "bundled", True)))
            for r in rows.itertuples()
        ]
        primary = group.primary.iloc[0] if "primary" in group else "implementation"
        chosen = Evidence(units, budget, primary, bool(group.tests.iloc[0])).run()
        costs = {u.uid: u.cost for u in units}
        spent = np.cumsum([costs[i] for i, _ in chosen]).tolist()
        return pd.DataFrame([(int(group.qid.iloc[0]), k, i, phase, costs[i], spent[k]) for k, (i, phase) in enumerate(chosen)], columns=["qid", "position", "uid", "phase", "cost", "spent"])

    return candidates.groupBy("qid").applyInPandas(run, "qid long, position int, uid long, phase string, cost int, spent int")
