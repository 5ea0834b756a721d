"""Class tokens of physical directions and their logical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from babelyard.functions import lookups as L

VARIANTS = "^((?:(?:" + "|".join(L.CLASS_VARIANTS) + "):)*)(.*)$"


def variants(token: Column) -> Column:
    """The leading variants that may be peeled off, with their colons."""
    return F.regexp_extract(token, VARIANTS, 1)


def utility(token: Column) -> Column:
    return F.regexp_extract(token, VARIANTS, 2)


def prefixes(v2: bool) -> list[tuple[str, str]]:
    return [(a, L.CLASS_PREFIXES_V2.get(a, b) if v2 else b) for a, b in L.CLASS_PREFIXES]


def rewrite_token(token: Column, v2: bool = False) -> Column:
    """The token with its logical utility: an exact name first, else the first prefix that fits."""
    own = utility(token)
    out = None
    for physical, logical in L.CLASS_EXACT:
        out = F.when(own == physical, logical) if out is None else out.when(own == physical, logical)
    for physical, logical in prefixes(v2):
        out = out.when(own.startswith(physical), F.concat(F.lit(logical), F.substr(own, F.lit(len(physical) + 1))))
    return F.concat(variants(token), out.otherwise(own))


def rewrite_value(value: Column, v2: bool = False, mirror_class: str | None = "rtl-mirror") -> Column:
    """struct(value, replacements, needs_mirror) of a class attribute's text.

    Tokens are rewritten one by one and the space between them stays. `absolute` without an inset
    gets the logical start and the top. An inset that was rewritten beside a translation along x needs a
    mirror: mirror_class is added, if there is one.
    """
    tokens = F.regexp_extract_all(value, F.lit(r"(\s+|\S+)"), F.lit(1))
    pairs = F.transform(tokens, lambda x: F.struct(x.alias("old"), rewrite_token(x, v2).alias("new")))
    changed = F.filter(pairs, lambda p: p["old"] != p["new"])
    joined = F.array_join(F.transform(pairs, lambda p: p["new"]), "")
    inset = F.exists(changed, lambda p: utility(p["new"]).rlike("^-?(?:inline-end-|inline-start-|inset-inline-|start-|end-)"))
    shifted = F.exists(pairs, lambda p: (p["old"] == p["new"]) & utility(p["old"]).rlike("^-?translate-x-"))
    listed = F.filter(F.transform(pairs, lambda p: p["new"]), lambda x: x.rlike(r"\S"))
    placed = F.exists(listed, lambda x: x.rlike("^-?(?:start-|end-|left-|right-|inset-|inline-start-|inline-end-)"))
    anchor = F.array_contains(listed, "absolute") & ~placed
    start = "inline-start-0" if v2 else "start-0"
    anchored = F.when(anchor, F.concat(F.regexp_replace(joined, r"\s+$", ""), F.lit(f" {start} top-0"))).otherwise(joined)
    needs = inset & shifted
    final = F.when(needs, F.concat(anchored, F.lit(f" {mirror_class}"))).otherwise(anchored) if mirror_class else anchored
    return F.struct(
        final.alias("value"), (F.size(changed) + F.when(anchor, 2).otherwise(0)).alias("replacements"), needs.alias("needs_mirror")
    )


def directional_findings(value: Column) -> Column:
    """Codes that a class attribute gives: one for text-, one for float-, one for margins and paddings."""
    found = F.array(
        F.when(value.rlike(r"\b(?:text-left|text-right)\b"), "DETECTED_DIRECTIONAL_CLASS_NAME"),
        F.when(value.rlike(r"\b(?:float-left|float-right)\b"), "DETECTED_DIRECTIONAL_CLASS_NAME"),
        F.when(value.rlike(r"\b(?:ml-|mr-|pl-|pr-)[0-9]+"), "AVOID_PHYSICAL_MARGIN_PADDING_CLASS"),
    )
    return F.filter(found, lambda x: x.isNotNull())
