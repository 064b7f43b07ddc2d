"""Include and exclude filters as one column: the reason a row is skipped, null where it stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expr.conditions import compile_condition
from ..expr.scope import CompileError, Scope, error

NOT_INCLUDED, EXCLUDED = "No include condition matched", "Excluded by filter"


def skip_reason(filters, scope: Scope) -> tuple[Column, list[Column]]:
    """(reason, errors). A row must meet any include rule; then the first exclude rule that it meets gives the reason."""
    errors: list[Column] = []

    def holds(rule) -> Column:
        try:
            met, failed = compile_condition(rule.if_, scope)
        except CompileError as e:
            errors.append(error("filters", "filter", str(e)))
            return F.lit(False)
        if failed is not None:
            errors.append(F.when(failed, error("filters", "filter", f"Unsupported condition expression: {rule.if_}")))
        return met

    reason = F.lit(None).cast("string")
    if filters.include:
        any_met = F.lit(False)
        for rule in filters.include:
            any_met = any_met | holds(rule)
        reason = F.when(~any_met, NOT_INCLUDED)
    excluded: Column | None = None
    for rule in filters.exclude:
        met, why = holds(rule), rule.reason or EXCLUDED
        excluded = F.when(met, why) if excluded is None else excluded.when(met, why)
    return reason if excluded is None else F.coalesce(reason, excluded), errors
