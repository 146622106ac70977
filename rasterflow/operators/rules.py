"""Split rules: a tree of filters compiled to one column expression."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = ("year", "tile", "patch_x", "patch_y", "path")
OUTCOMES = ("target", "rules", "assert_none")


def filter_expr(column: Column, spec: Any) -> Column:
    """A scalar must be equal, a list contain the value, an object hold all its conditions (``in``, ``min``, ``max``, inclusive)."""
    if isinstance(spec, dict):
        unknown = set(spec) - {"in", "min", "max"}
        if unknown:
            raise ValueError(f"unknown filter: {sorted(unknown)}")
        conditions = [column.isin(spec["in"])] if "in" in spec else []
        conditions += [column >= spec["min"]] if "min" in spec else []
        conditions += [column <= spec["max"]] if "max" in spec else []
        out = F.lit(True)
        for c in conditions:
            out = out & c
        return F.coalesce(out, F.lit(False))
    return F.coalesce(column.isin(spec if isinstance(spec, list) else [spec]), F.lit(False))


def outcome_of(rule: dict) -> str:
    given = [k for k in OUTCOMES if k in rule and not (k == "assert_none" and rule[k] is False)]
    unknown = set(rule) - {*FILTERS, *OUTCOMES, "stratify_on"}
    if len(given) != 1 or unknown:
        raise ValueError(f"a rule needs exactly one of {OUTCOMES} and nothing unknown: {sorted(rule)}")
    return given[0]


def compile_rules(rules: list[dict], columns: dict[str, str] | None = None, at: tuple[int, ...] = ()) -> Column:
    """The struct ``(target, rule_loc)`` of the first rule that holds, or null.

    A text target is definite; a list of targets leaves ``target`` null and names the rule,
    for a random split. Nested rules decide alone once their rule holds: if none of them
    does, the outcome is null and later siblings are not tried. ``assert_none`` raises an
    error that names the path. All filters of a rule are tested before its outcome.
    """
    columns = columns or {f: f for f in FILTERS}
    nothing = F.lit(None).cast("struct<target:string,rule_loc:array<int>>")
    out = None
    for i, rule in enumerate(rules):
        kind, here = outcome_of(rule), (*at, i)
        holds = F.lit(True)
        for f in FILTERS:
            if f in rule:
                holds = holds & filter_expr(F.col(columns[f]), rule[f])
        place = F.array(*[F.lit(k) for k in here]).cast("array<int>")
        if kind == "rules":
            result = compile_rules(rule["rules"], columns, here)
        elif kind == "assert_none":
            result = F.raise_error(F.concat(F.lit(f"no patch may reach rule {list(here)}: "), F.col(columns["path"]))).cast("struct<target:string,rule_loc:array<int>>")
        else:
            name = F.lit(rule["target"] if isinstance(rule["target"], str) else None).cast("string")
            result = F.struct(name.alias("target"), place.alias("rule_loc"))
        out = F.when(holds, result) if out is None else out.when(holds, result)
    return nothing if out is None else out.otherwise(nothing)


def random_rules(rules: list[dict], at: tuple[int, ...] = ()) -> dict[tuple[int, ...], dict]:
    """Rules that split at random, by location."""
    found = {}
    for i, rule in enumerate(rules):
        kind = outcome_of(rule)
        if kind == "rules":
            found |= random_rules(rule["rules"], (*at, i))
        elif kind == "target" and not isinstance(rule["target"], str):
            found[(*at, i)] = rule
    return found


def apply_rules(patches: DataFrame, rules: list[dict], columns: dict[str, str] | None = None) -> DataFrame:
    """``patches`` with ``target`` and ``rule_loc``; patches that no rule takes are left out."""
    return patches.withColumn("_rule", compile_rules(rules, columns)).where("_rule is not null").select(*patches.columns, "_rule.target", "_rule.rule_loc")
