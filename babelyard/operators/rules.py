"""Rules of the style audits as a table: what a property must satisfy, its code, its points and what it becomes.

A rule is a row. Its test and its fix are SQL expressions over a declaration (prop, value, parts) or over a property of an object literal
(prop, value, style), so that rules compile to predicates of one projection, whoever wrote them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelyard.functions import lookups as L

FIXED = "array<struct<prop:string,value:string>>"


@dataclass(frozen=True)
class Rule:
    """analyzer: css or jsx. prop: the property it looks at, or null for any. test: SQL, true where the rule fits. fix: SQL, an
    array of struct(prop, value) that take the declaration's place; null leaves it."""

    analyzer: str
    prop: str | None
    test: str
    code: str
    points: int = 5
    severity: str = "warning"
    fix: str | None = None

    def fits(self) -> Column:
        own = F.coalesce(F.expr(self.test), F.lit(False))
        return own if self.prop is None else (F.col("prop") == self.prop) & own

    def fixed(self) -> Column:
        return F.expr(self.fix).cast(FIXED) if self.fix else F.lit(None).cast(FIXED)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: Sequence[str]) -> str:
    return ", ".join(map(_text, values))


def _becomes(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct({prop} as prop, {value} as value)" for prop, value in pairs) + ")"


SIDE = "value in ('left', 'right')"
CSS_RULES = (
    Rule("css", "text-align", SIDE, "FIX_TEXT_ALIGN", fix=_becomes(("prop", "if(value = 'left', 'start', 'end')"))),
    Rule("css", "float", SIDE, "FIX_FLOAT", fix=_becomes(("prop", "if(value = 'left', 'inline-start', 'inline-end')"))),
    *(Rule("css", physical, "true", code, fix=_becomes((_text(logical), "value"))) for physical, logical, code in L.CSS_PROPS),
    *(
        # a slash in a radius divides two lists of corners
        Rule("css", name, "size(parts) = 4" + (" and not array_contains(parts, '/')" if name == "border-radius" else ""), f"FIX_{name.upper().replace('-', '_')}_SHORTHAND",
             fix=_becomes(*((_text(p), f"parts[{k}]") for k, p in enumerate(logical))))
        for name, logical in L.CSS_SHORTHANDS.items()
    ),
)
JSX_RULES = (
    Rule("jsx", None, f"prop in ({_listed(L.JSX_STRICT)}) and coalesce(value, '') not in ({_listed(L.JSX_LOGICAL)})", "AVOID_PHYSICAL_PROP"),
    Rule("jsx", None, f"style and prop in ({_listed(L.JSX_AMBIGUOUS)})", "AVOID_PHYSICAL_PROP"),
    Rule("jsx", None, f"prop in ('textAlign', 'text-align') and {SIDE}", "AVOID_TEXT_ALIGN"),
    Rule("jsx", "float", SIDE, "AVOID_FLOAT"),
    Rule("jsx", "borderRadius", r"size(split(trim(value), '[ \\t\\n\\r]+')) = 4", "AVOID_BORDER_RADIUS_SHORTHAND"),
)
DEFAULT_RULES = (*CSS_RULES, *JSX_RULES)


def of(rules: Sequence[Rule], analyzer: str) -> list[Rule]:
    return [r for r in rules if r.analyzer == analyzer]


def first_fit(declarations: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds code (or null) and fixed of the first CSS rule that fits each declaration."""
    code, fixed = F.lit(None).cast("string"), F.lit(None).cast(FIXED)
    for rule in reversed(of(rules, "css")):
        code, fixed = F.when(rule.fits(), F.lit(rule.code)).otherwise(code), F.when(rule.fits(), rule.fixed()).otherwise(fixed)
    return declarations.withColumn("code", code).withColumn("fixed", fixed)


def all_fits(rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """The codes of all JSX rules that fit a property (prop, value, style)."""
    own = [F.when(r.fits(), F.lit(r.code)) for r in of(rules, "jsx")]
    return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")


def points(rules: Sequence[Rule]) -> list[tuple[str, str, int, str]]:
    """(analyzer, code, points, severity) of the rules, and of the fixed findings that no rule has; of rules with one code the last counts."""
    table = {(analyzer, code): (n, severity) for analyzer, code, n, severity in L.PENALTIES}
    if rules is not DEFAULT_RULES:
        table |= {(r.analyzer, r.code): (r.points, r.severity) for r in rules if r not in DEFAULT_RULES}
    return [(*key, *value) for key, value in table.items()]
