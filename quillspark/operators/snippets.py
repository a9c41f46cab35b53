"""Snippets as markdown, and the cut to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SEPARATOR = "\n---\n\n"
BUDGET = 8000


def markdown(entity: Column, method: Column, signature: Column, description: Column, parameters: Column, return_type: Column, return_desc: Column, source: Column, wrapped_method: Column, wrapped_source: Column, url: Column) -> Column:
    """A snippet's text: title, signature, description, parameters, return, source, wrapped method, url; empty parts are left out. Nulls are empty."""
    e, m, s, d, rt, rd, src, wm, ws, u = (F.coalesce(c, F.lit("")) for c in (entity, method, signature, description, return_type, return_desc, source, wrapped_method, wrapped_source, url))
    part = lambda on, *pieces: F.when(on, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))).otherwise("")
    line = lambda p: F.concat(F.lit("- `"), F.coalesce(p["name"], F.lit("")), F.lit("` ("), F.coalesce(p["type"], F.lit("")), F.lit(", "), F.when(p["required"], "required").otherwise("optional"), F.lit("): "), F.coalesce(p["description"], F.lit("")), F.lit("\n"))
    return F.concat(
        F.when(m != "", F.concat(F.lit("# "), e, F.lit("::"), m, F.lit("()\n\n"))).otherwise(F.concat(F.lit("# "), e, F.lit("\n\n"))),
        part(s != "", "**Signature:** `", s, "`\n\n"),
        part(d != "", "## Description\n\n", d, "\n\n"),
        part(F.coalesce(F.size(parameters), F.lit(0)) > 0, "## Parameters\n\n", F.array_join(F.transform(parameters, line), ""), "\n"),
        part(rt != "", "## Return\n\n`", rt, F.when(rd != "", F.concat(F.lit("` — "), rd)).otherwise("`"), "\n\n"),
        part(src != "", "## Source Code\n\n```php\n", src, "\n```\n\n"),
        part((wm != "") & (ws != ""), "## Wrapped Method: ", wm, "\n\n```php\n", ws, "\n```\n\n"),
        part(u != "", "Source: ", u, "\n\n"),
    )


def within_budget(ranked: DataFrame, block: str = "block", budget: int = BUDGET, order: tuple[str, ...] = ("rank", "row_id")) -> DataFrame:
    """The first rows (with rn and tokens) whose tokens add up to the budget; the first row always stays.

    For a top-k result: its window has no key, as the order is of all rows.
    """
    by = Window.partitionBy(F.lit(0)).orderBy(*order)
    rows = ranked.withColumn("tokens", text.approx_tokens(F.col(block))).withColumn("rn", F.row_number().over(by))
    return rows.withColumn("_sum", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("rn") == 1) | (F.col("_sum") <= budget)).drop("_sum")


def joined(cut: DataFrame, block: str = "block") -> DataFrame:
    """One row: the blocks in order as one text."""
    return cut.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", block))), lambda x: x[block]), SEPARATOR).alias("text"))
