"""The crawl as batch steps: pages to rows, delegation chains, progress, and the order of work. Errors are columns."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..sources import wordpress
from ..sources.base import Source
from . import tables

HOPS = 3
PROPERTY = "struct<name: string, description: string>"
ENTITY = f"slug string, name string, kind string, description string, source_file string, source_code string, url string, properties array<{PROPERTY}>, method_urls array<string>, error string"
METHOD = f"slug string, name string, signature string, description string, parameters array<{schema.PARAMETER}>, return_type string, return_desc string, source_code string, url string, since string, relations array<{schema.RELATION}>, error string"


def _mapped(pages: DataFrame, make: Callable[[str, str], dict], spec: str) -> DataFrame:
    """make(url, html) for each fetched page, as rows of spec; what fails has its url and error only."""
    names = schema.names(spec)

    def run(batches):
        for pdf in batches:
            rows = []
            for url, html, error in zip(pdf["url"], pdf["html"], pdf["error"], strict=True):
                row: dict = {"url": url, "error": error}
                if error is None:
                    try:
                        row |= make(url, html)
                    except ValueError as e:
                        row["error"] = str(e)
                rows.append([row.get(n) for n in names])
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.select("url", "html", "error").mapInPandas(run, spec)


def parse_entities(pages: DataFrame, source: Source) -> DataFrame:
    """Entities of pages (url, html, error), with their properties and methods' urls."""

    def make(url: str, html: str) -> dict:
        row, urls = source.entity(url, html)
        return row | {"method_urls": urls}

    return _mapped(pages, make, ENTITY)


def parse_methods(pages: DataFrame, source: Source) -> DataFrame:
    """Methods of pages (url, html, error), with parameters and relations."""
    return _mapped(pages, source.method, METHOD)


def discovered(listing: DataFrame, source: Source) -> DataFrame:
    """(url, slug, tier) of all entities on listing pages (url, html), in the order of work: tier, then slug. A page that fails is passed over."""

    def run(batches):
        for pdf in batches:
            out = []
            for html in pdf["html"]:
                try:
                    out += source.listing(html)[0]
                except ValueError:
                    continue
            yield pd.DataFrame({"url": out}, dtype=object)

    urls = listing.select("html").mapInPandas(run, "url string")
    slug = wordpress.slug_of_url(F.col("url"))
    return urls.select("url", slug.alias("slug"), wordpress.class_priority(slug).alias("tier")).orderBy("tier", "slug", "url")


def detected(methods: DataFrame, source: Source, code: str = "source_code") -> DataFrame:
    """methods with wrapper struct<is_wrapper, target, kind>."""

    @F.pandas_udf("is_wrapper boolean, target string, kind string")
    def detect(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([source.wrapper(c or "") for c in codes], columns=["is_wrapper", "target", "kind"])

    return methods.withColumn("wrapper", detect(F.col(code)))


def target_url(target: str, kind: str, slug: str) -> Column:
    """The delegation target's url as a column expression of three columns' names."""
    base, classes = F.lit(wordpress.BASE), wordpress.CLASSES
    parts = F.split(F.col(target), "::")
    return (
        F.when(F.col(kind) == "function", F.concat(base, F.lit("/reference/functions/"), F.lower(target), F.lit("/")))
        .when(F.col(kind) == "self_method", F.concat(base, F.lit(classes), F.col(slug), F.lit("/"), F.lower(target), F.lit("/")))
        .when((F.col(kind) == "static_method") & F.contains(F.col(target), F.lit("::")), F.concat(base, F.lit(classes), F.lower(F.get(parts, 0)), F.lit("/"), F.lower(F.get(parts, 1)), F.lit("/")))
        .otherwise("")
    )


def page_codes(pages: DataFrame, source: Source) -> DataFrame:
    """(_url, _found) of pages (url, html) that have source code."""

    @F.pandas_udf("string")
    def code_of(htmls: pd.Series) -> pd.Series:
        def one(html):
            try:
                return source.source_code(html or "")
            except ValueError:
                return None

        return htmls.map(one)

    return pages.select(F.col("url").alias("_url"), code_of("html").alias("_found")).where("_found is not null").dropDuplicates(["_url"])


def with_targets(methods: DataFrame, pages: DataFrame, fetch: Callable[[DataFrame], DataFrame], source: Source, hops: int = HOPS) -> DataFrame:
    """pages (url, html, error) with those that the delegation of methods (entity_slug, source_code) leads to, each fetched once: one round for each hop.

    A target that can't be fetched ends its chain.
    """
    front = methods.select("entity_slug", "source_code")
    for _ in range(hops):
        to = detected(front, source).select("entity_slug", F.col("wrapper.target").alias("_target"), F.col("wrapper.kind").alias("_kind"))
        to = to.select("entity_slug", target_url("_target", "_kind", "entity_slug").alias("_to")).where("_to <> ''").distinct()
        wanted = to.select(F.col("_to").alias("url")).distinct().join(pages.select("url"), "url", "left_anti")
        if not wanted.isEmpty():
            pages = pages.unionByName(fetch(wanted))
        front = to.join(page_codes(pages, source), F.col("_to") == F.col("_url")).select("entity_slug", F.col("_found").alias("source_code"))
    return pages


def resolved(methods: DataFrame, pages: DataFrame, source: Source, hops: int = HOPS) -> DataFrame:
    """methods (url, entity_slug, source_code) with wrapped_method and wrapped_source: delegation followed for at most hops pages.

    Each hop is a left join of the targets' urls with the pages' source code, parsed once for each page. The class stays the first
    method's. A missing page or one without code ends the chain. Always the full chain, whatever the order of work.
    """

    codes = page_codes(pages, source)
    out = methods.withColumn("_code", F.col("source_code")).withColumn("wrapped_method", F.lit(None).cast("string")).withColumn("wrapped_source", F.lit(None).cast("string"))
    for _ in range(hops):
        out = detected(out, source, "_code").select("*", F.col("wrapper.target").alias("_target"), F.col("wrapper.kind").alias("_kind")).drop("wrapper")
        out = out.withColumn("_to", target_url("_target", "_kind", "entity_slug")).join(codes, F.col("_to") == F.col("_url"), "left")
        hit = F.col("_found").isNotNull()
        name = F.when(F.col("wrapped_method").isNull(), F.col("_target")).otherwise(F.concat("wrapped_method", F.lit(" → "), "_target"))
        code = F.when(F.col("wrapped_source").isNull(), F.col("_found")).otherwise(F.concat("wrapped_source", F.lit("\n\n// --- Delegates to: "), "_target", F.lit(" ---\n\n"), "_found"))
        out = out.withColumn("wrapped_method", F.when(hit, name).otherwise(F.col("wrapped_method"))).withColumn("wrapped_source", F.when(hit, code).otherwise(F.col("wrapped_source")))
        out = out.withColumn("_code", F.when(hit, F.col("_found")).otherwise("")).drop("_target", "_kind", "_to", "_url", "_found")
    return out.drop("_code")


def progress_rows(parsed: DataFrame, session: int, item_type: str, parent: str | None = None) -> DataFrame:
    """Progress of parsed items: success, or failed with the error's class and message."""
    failed = F.col("error").isNotNull()
    return parsed.select(F.lit(session).cast("long").alias("session_id"), "url", F.lit(item_type).alias("item_type"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, tables.error_type(F.col("error"))).alias("error_type"), F.col("error").alias("error_message"), (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent_entity"), F.current_timestamp().alias("processed_at"))


def summary(progress: DataFrame, session: int) -> str:
    """A session's report: counts, failures by type and the failed urls."""
    mine = progress.where(F.col("session_id") == session)
    stats = tables.crawl_stats(mine).first()
    lines = [f"Session {session}"]
    lines.append(f"Total: {stats.total} | Success: {stats.success} | Failed: {stats.failed}" if stats else "Total: 0 | Success: 0 | Failed: 0")
    lines += [f"  {r.error_type}: {r.n}" for r in tables.failures_by_type(mine).orderBy("error_type").toLocalIterator()]
    lines += [f"  [{r.error_type}] {r.url}: {r.error_message}" for r in tables.failures(mine).orderBy("url").toLocalIterator()]
    return "\n".join(lines)


def parameters_from_json(text: str | None) -> list[dict]:
    """Foreign parameters: keys in any case; empty, '[]' and bad JSON give none."""
    try:
        rows = json.loads(text or "[]")
    except ValueError:
        return []
    out = []
    for r in rows if isinstance(rows, list) else []:
        if not isinstance(r, dict):
            return []
        low = {k.lower(): v for k, v in r.items()}
        out.append({"name": str(low.get("name", "")), "type": str(low.get("type", "")), "required": bool(low.get("required", False)), "description": str(low.get("description", ""))})
    return out
