"""Trading rules of the market as columns, known before any order is.

Only the rule that shares bought today can't be sold today depends on positions; it is part of
the execution step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import lag

# Price limits by board.
BOARD_LIMITS = {"STAR": 0.20, "CHINEXT": 0.20, "BSE": 0.30}
DEFAULT_LIMIT, TOLERANCE = 0.10, 1e-6


def board_limit(board: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in BOARD_LIMITS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(board)), F.lit(DEFAULT_LIMIT))


@dataclass(frozen=True)
class Rule:
    """A reason, and when it forbids to buy and to sell."""

    reason: str
    no_buy: Column
    no_sell: Column


def limit_rule() -> Rule:
    """No buying at the upper limit, no selling at the lower one; the flag counts, else the bar's high or low."""
    before, limit = F.col("_before"), board_limit(F.col("board"))
    checked = before > 0
    return Rule("price limit", F.col("limit_up") | (checked & (F.col("high") >= before * (1 + limit) - TOLERANCE)), F.col("limit_down") | (checked & (F.col("low") <= before * (1 - limit) + TOLERANCE)))


def suspension_rule() -> Rule:
    return Rule("suspended", F.col("is_suspended"), F.col("is_suspended"))


@dataclass
class RuleChain:
    """Rules in order; the first that forbids gives the reason."""

    rules: list[Rule] = field(default_factory=lambda: [limit_rule(), suspension_rule()])

    def add(self, rule: Rule) -> "RuleChain":
        return RuleChain([*self.rules, rule])

    def insert(self, at: int, rule: Rule) -> "RuleChain":
        return RuleChain([*self.rules[:at], rule, *self.rules[at:]])

    def remove(self, reason: str) -> "RuleChain":
        return RuleChain([r for r in self.rules if r.reason != reason])

    def apply(self, bars: DataFrame) -> DataFrame:
        """Bars with can_buy, can_sell, no_buy_reason, no_sell_reason."""
        given = set(bars.columns)
        flags = {c: F.lit(False) for c in ("limit_up", "limit_down", "is_suspended") if c not in given} | ({} if "board" in given else {"board": F.lit("MAIN")})
        previous = F.coalesce(*([F.col("prev_close")] if "prev_close" in given else []), lag(F.col("close")), F.col("close"))
        staged = bars.withColumns(flags | {"_before": previous})

        def first(which: str) -> Column:
            return F.coalesce(*(F.when(F.coalesce(getattr(r, which), F.lit(False)), F.lit(r.reason)) for r in self.rules), F.lit(None).cast("string"))

        reasons = staged.withColumns({"no_buy_reason": first("no_buy"), "no_sell_reason": first("no_sell")}).drop("_before", *flags)
        return reasons.withColumns({"can_buy": F.col("no_buy_reason").isNull(), "can_sell": F.col("no_sell_reason").isNull()})
