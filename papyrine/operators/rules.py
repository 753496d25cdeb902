"""Row rules as data: each rule is a row of a table, compiled to a predicate; one pass tells which rows break which rules.

As in SQL, a rule is broken only where it is false: what cannot be decided for a null passes, unless the rule asks for a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """kind names a test of TESTS, columns what it looks at, values what it compares with; when (column, values) limits it to rows with such a value."""

    table: str
    name: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    when: tuple[str, tuple] | None = None


def every(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests)


#: What holds for a good row.
TESTS: dict[str, Callable[[list[Column], tuple], Column]] = {
    "exactly one": lambda cs, _: sum((c.isNotNull().cast("int") for c in cs), F.lit(0)) == 1,
    "differ": lambda cs, _: cs[0] != cs[1],
    "one of": lambda cs, vs: cs[0].isin(*vs),
    "between": lambda cs, vs: every([c.isNull() | c.between(*vs) for c in cs]),
    "at least": lambda cs, vs: every([c.isNull() | (c >= vs[0]) for c in cs]),
    "known and at least": lambda cs, vs: every([c.isNotNull() & (c >= vs[0]) for c in cs]),
    "required": lambda cs, _: every([c.isNotNull() for c in cs]),
    "any of": lambda cs, _: reduce(Column.__or__, [c.isNotNull() for c in cs]),
    "holds keys": lambda cs, vs: F.size(F.array_except(F.array(*map(F.lit, vs)), cs[0])) == 0,
}

#: The words that columns may hold.
METHODS = ("mechanical", "adversarial", "debate_recheck", "collision_watch")
VERDICTS = ("scooped", "incremental", "adjacent", "no_prior_art")
SECTIONS = ("title", "background", "method", "references", "novelty", "feasibility", "objections", "prework")

#: The rules of the stored tables.
RULES = (
    Rule("match", "left is one side", "exactly one", ("left_idea", "left_anchor")),
    Rule("match", "right is one side", "exactly one", ("right_idea", "right_anchor")),
    Rule("ranking", "ranked is one side", "exactly one", ("idea_id", "anchor_id")),
    Rule("reduction", "reason is allowed", "one of", ("reason",), ("already_published", "not_feasible")),
    Rule("idea", "not merged into itself", "differ", ("merged_into", "id")),
    Rule("anchor", "cutoff is a year", "between", ("cutoff",), (1800, 2100)),
    Rule("anchor", "terms need a cutoff", "required", ("cutoff",), (), ("term_groups", ())),
    Rule("feasibility", "tier is a letter", "one of", ("tier",), ("A", "B", "C", "D")),
    Rule("feasibility", "B and C need a route", "required", ("missing", "route"), (), ("tier", ("B", "C"))),
    Rule("novelty", "method is allowed", "one of", ("method",), METHODS),
    Rule("novelty", "verdict is allowed", "one of", ("verdict",), VERDICTS),
    Rule("novelty", "a negative needs bounds", "required", ("coverage_limits",), (), ("verdict", ("no_prior_art",))),
    Rule("objection", "severity is allowed", "one of", ("severity",), ("major", "minor")),
    Rule("objection", "axis is allowed", "one of", ("axis",), ("contribution", "novelty", "soundness", "feasibility")),
    Rule("objection", "support is allowed", "one of", ("citation_support",), ("strong", "weak", "irrelevant")),
    Rule("objection", "strong needs a paper", "any of", ("cited_paper_id", "cited"), (), ("citation_support", ("strong",))),
    Rule("objection", "score is in range", "between", ("rebuttal_score",), (1, 5)),
    Rule("objection", "status is allowed", "one of", ("status",), ("resolved_by_evidence", "resolved_by_revision", "unresolved")),
    Rule("objection", "conceding needs four", "known and at least", ("rebuttal_score",), (4,), ("status", ("resolved_by_evidence",))),
    Rule("debate", "models differ", "differ", ("proposer_model", "critic_model")),
    Rule("debate", "ratios are in range", "between", ("drift", "distance"), (0, 1)),
    Rule("debate", "rounds count from one", "at least", ("round_no",), (1,)),
    Rule("report", "sections are whole", "holds keys", ("sections",), SECTIONS),
    Rule("run", "budget is no debt", "at least", ("usd_budget", "usd_spent"), (0,)),
    Rule("run", "next stage is allowed", "one of", ("auto_advance_to",), ("dedup", "tournament", "feasibility", "novelty", "debate", "report")),
)


def broken(rule: Rule) -> Column:
    """Whether a row breaks the rule; never null."""
    holds = TESTS[rule.kind]([F.col(c) for c in rule.columns], rule.values)
    if rule.when:
        column, values = rule.when
        holds = F.when(F.col(column).isin(*values) if values else F.col(column).isNotNull(), holds)
    return F.coalesce(~holds, F.lit(False))


def of(*tables: str) -> tuple[Rule, ...]:
    return tuple(r for r in RULES if r.table in tables)


def judged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """df with why, the names of the rules that each row breaks, in their order."""
    return df.withColumn("why", F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()))


def split(df: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the rows that break no rule, and the others with why."""
    rows = judged(df, rules)
    return rows.where(F.size("why") == 0).drop("why"), rows.where(F.size("why") > 0)


def counts(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(table, rule, n_bad) of all rules in one pass over df."""
    sums = df.agg(*[F.count_if(broken(r)).alias(f"r{k}") for k, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.table).alias("table"), F.lit(r.name).alias("rule"), F.col(f"r{k}").alias("n_bad")) for k, r in enumerate(rules)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def one_active(df: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """Keys of which more than one row is active, with how many."""
    return df.where(active).groupBy(*keys).agg(F.count("*").alias("n_active")).where("n_active > 1")
