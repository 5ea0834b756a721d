"""Variables of messages as tags that a translation keeps, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIABLE = r"\{\{\{.*?\}\}\}|\{\{.*?\}\}"
TAG = r"""<v id=(?:"([^"]*)"|'([^']*)')[^>]*?(?:/>|>(?:</v>)?)"""


def variables(text: Column) -> Column:
    """array of struct(full, inner) in the order of the text; a variable's place is its id."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)({VARIABLE})"), F.lit(1))
    inner = lambda x: F.regexp_replace(x, r"(?s)^\{\{\{?\s*|\s*\}?\}\}$", "")
    return F.transform(found, lambda x: F.struct(x.alias("full"), inner(x).alias("inner")))


def tokenize(text: Column) -> Column:
    """The text with <v id="n" /> for its n-th variable; what is not closed stays."""
    start = F.struct(F.lit("").alias("done"), text.alias("rest"), F.lit(0).alias("n"))

    def step(state: Column, variable: Column) -> Column:
        at = F.position(variable["full"], state["rest"])
        tag = F.concat(F.lit('<v id="'), state["n"].cast("string"), F.lit('" />'))
        return F.struct(
            F.concat(state["done"], F.substr(state["rest"], F.lit(1), at - 1), tag).alias("done"),
            F.substr(state["rest"], at + F.length(variable["full"])).alias("rest"),
            (state["n"] + 1).alias("n"),
        )

    return F.aggregate(variables(text), start, step, lambda s: F.concat(s["done"], s["rest"]))


def detokenize(text: Column, held: Column) -> Column:
    """Tags replaced by the variables whose number they carry, in any order; unknown numbers stay.

    The text is walked once, so a variable that looks like a tag is not replaced again.
    """
    tags = F.regexp_extract_all(text, F.lit(f"({TAG})"), F.lit(1))
    start = F.struct(F.lit("").alias("done"), text.alias("rest"))

    def step(state: Column, tag: Column) -> Column:
        at = F.position(tag, state["rest"])
        number = F.regexp_extract(tag, r"""id=["']\s*([0-9]+)""", 1).cast("int")
        value = F.coalesce(F.get(held, number)["full"], tag)
        return F.struct(
            F.concat(state["done"], F.substr(state["rest"], F.lit(1), at - 1), value).alias("done"),
            F.substr(state["rest"], at + F.length(tag)).alias("rest"),
        )

    return F.aggregate(tags, start, step, lambda s: F.concat(s["done"], s["rest"]))
