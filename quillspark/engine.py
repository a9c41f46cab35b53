"""The engine: a store of Parquet tables, library resolution, documentation search, index maintenance."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import crawl, search, snippets, tables
from .plans import phrases as plan
from .sources.base import pages_fetch
from .streaming.ingest import Refresher

RESOLVED = 5
#: Search results that an engine keeps in memory.
KEPT = 8


class NotFound(Exception):
    pass


@dataclass
class DocResult:
    """A search's answer: snippets in order, all of them, and their text cut to the budget."""

    library: str
    query: str
    snippets: DataFrame
    text: str


class Store:
    """Tables as folders below root. A table's folder holds versions; a pointer file, replaced as a whole, names the current one.

    A table may be in parts (one for each library, say), each with versions and a pointer of its own, so that one is written without the others.
    Readers keep the version they began with: the current one and the one before stay, older ones are deleted. Writers are one at a
    time, as with any single-writer store. File access goes through Hadoop's file systems, so root may be any of their URIs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        probe = self._path(f"{self.root}/_probe")
        self._fs.create(probe, True).close()
        self._fs.delete(probe, False)
        self._put("_schema_version", schema.VERSION)

    def _put(self, name: str, value: str) -> None:
        """Write beside, then rename over: never a half-written pointer."""
        new = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(value.encode()))
        out.close()
        old = self._path(f"{self.root}/{name}")
        if not self._fs.rename(new, old):
            self._fs.delete(old, False)
            self._fs.rename(new, old)

    def _get(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _pointers(self, name: str) -> list[str]:
        """The pointer files of a table's parts, or of itself."""
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)) if f.isFile()]
        return sorted(f for f in found if f.endswith(".current") and f.split("@")[0].removesuffix(".current") == name)

    def read(self, name: str) -> DataFrame:
        """A table, all its parts; empty if it was never written."""
        pointers = self._pointers(name)
        if not pointers:
            return self.spark.createDataFrame([], schema.TABLES.get(name) or getattr(schema, name.upper()))
        return self.spark.read.parquet(*(f"{self.root}/{p.removesuffix('.current')}/{self._get(p)}" for p in pointers))

    def write(self, name: str, df: DataFrame, part: str | None = None) -> None:
        """A new version of a table or, with part, of that part alone."""
        folder = name if part is None else f"{name}@{hashlib.sha256(part.encode()).hexdigest()[:24]}"
        version = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{folder}/{version}")
        self._put(f"{folder}.current", version)
        for old in sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")))[:-2]:
            self._fs.delete(self._path(f"{self.root}/{folder}/{old}"), True)

    def upsert(self, name: str, new: DataFrame, order: str = "updated_at", keep_first: tuple[str, ...] = ()) -> None:
        self.write(name, tables.upsert(self.read(name), new, schema.KEYS[name], order, keep_first))


class Engine:
    """Resolves libraries and answers documentation queries over a store."""

    def __init__(self, spark: SparkSession, root: str, token_budget: int = snippets.BUDGET):
        self.spark, self.budget, self.store = spark, token_budget, Store(spark, root)
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        """df, kept in memory until close(); of earlier ones the last few stay."""
        self._kept.append(df.cache())
        for old in self._kept[:-KEPT]:
            old.unpersist()
        self._kept = self._kept[-KEPT:]
        return df

    def close(self) -> None:
        """The store stays; what this engine keeps in memory goes."""
        for df in self._kept:
            df.unpersist()
        self._kept = []

    # Libraries

    def upsert_library(self, meta: dict) -> None:
        """A library's row: a new one, or its description brought up to date; its count and creation time stay."""
        columns = "id string, name string, description string, source_url string, version string, trust_score double"
        new = self.spark.createDataFrame([{"trust_score": 0.8} | meta], columns)
        now = F.current_timestamp()
        new = new.select("*", F.lit(0).alias("snippet_count"), now.alias("crawled_at"), now.alias("created_at"), now.alias("updated_at"))
        self.store.upsert("libraries", new, keep_first=("snippet_count", "created_at"))

    def update_snippet_count(self, library_id: str) -> None:
        """A library's stored count: its entities and methods."""
        mine = F.col("id") == library_id
        found = tables.snippet_counts(self.store.read("entities").where(F.col("library_id") == library_id), self.store.read("methods")).first()
        count = F.lit(found.snippets if found else 0).cast("int")
        self.store.write("libraries", self.store.read("libraries").withColumn("snippet_count", F.when(mine, count).otherwise(F.col("snippet_count"))))

    def libraries(self) -> DataFrame:
        """All libraries by name, their counts filled in."""
        counts = tables.snippet_counts(self.store.read("entities"), self.store.read("methods"))
        return tables.fill_snippet_count(self.store.read("libraries"), counts).orderBy("name", "id")

    def resolve(self, query: str, library_name: str) -> DataFrame:
        """The five best libraries for query among those that library_name finds; counts are filled in after ranking."""
        found = tables.rank_libraries(tables.search_libraries(self.store.read("libraries"), library_name), query).limit(RESOLVED)
        counts = tables.snippet_counts(self.store.read("entities"), self.store.read("methods"))
        filled = tables.fill_snippet_count(found.drop("score"), counts)
        return filled.join(found.select(F.col("id").alias("_id"), "score"), F.col("id") == F.col("_id")).drop("_id").orderBy(F.col("score").desc(), F.col("trust_score").desc(), "id")

    def entities(self, library_id: str) -> DataFrame:
        """A library's entities by name, with their method counts."""
        own = self.store.read("entities").where(F.col("library_id") == library_id)
        return tables.method_counts(own, self.store.read("methods")).select("name", "slug", "kind", "description", "method_count", "url").orderBy("name", "slug")

    # Search

    def entity(self, library_id: str, slug: str) -> DataFrame:
        """A library's entity by slug: one row, or none."""
        return self.store.read("entities").where((F.col("library_id") == library_id) & (F.col("slug") == slug))

    def method(self, entity_id: int, slug: str) -> DataFrame:
        """An entity's method by slug: one row, or none."""
        return self.store.read("methods").where((F.col("entity_id") == entity_id) & (F.col("slug") == slug))

    def rebuild_index(self, library_id: str | None = None) -> None:
        """The index anew: of one library, whose parts alone are written, or of each. Tokens are made once; postings, documents, their lengths and the statistics are written."""
        if library_id is None:
            for r in self.store.read("libraries").select("id").toLocalIterator():  # as many as sources that were crawled
                self.rebuild_index(r["id"])
            return
        entities = self.store.read("entities").where(F.col("library_id") == library_id)
        docs = search.index_documents(entities, self.store.read("methods").join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"))
        self.store.write("search_docs", docs, library_id)
        docs = self.store.read("search_docs").where(F.col("library_id") == library_id)
        self.store.write("search_tokens", search.tokenised(docs), library_id)
        tokens = self.store.read("search_tokens").where(F.col("library_id") == library_id)
        # Sorted by term within files, so that a query's terms prune row groups; by row too, so that a common term is in many files.
        self.store.write("postings", search.postings(tokens).repartitionByRange("term", "row_id").sortWithinPartitions("term", "row_id"), library_id)
        self.store.write("doc_lengths", search.document_lengths(tokens, ("library_id",)), library_id)
        self.store.write("search_stats", search.corpus_stats(self.store.read("doc_lengths")))

    def search(self, library_id: str, query: str, mode: str = "all", k: int = search.TOP) -> DataFrame:
        """The best k rows of a library (search_docs' columns and rank); statistics are of all libraries."""
        docs, post = self.store.read("search_docs"), self.store.read("postings")
        ranked = search.bm25(post, self.store.read("doc_lengths").select("row_id", "dl"), plan.phrases(query), mode, stats=self.store.read("search_stats"))
        mine = docs.where(F.col("library_id") == library_id)
        return search.top(ranked.join(mine, "row_id"), k)

    def snippets(self, hits: DataFrame) -> DataFrame:
        """hits with the fields of a snippet: a class's own, or its method's; hits without their entity are dropped."""
        e, m = self.store.read("entities"), self.store.read("methods")
        r = self.store.read("relations")
        e = e.select(F.col("id").alias("entity_id"), *(F.col(c).alias(f"e_{c}") for c in ("name", "description", "source_code", "url")))
        own = ("name", "signature", "description", "parameters", "return_type", "return_desc", "source_code", "wrapped_source", "wrapped_method", "url")
        related = r.groupBy("method_id").agg(F.sort_array(F.collect_list(F.struct("kind", "target_name", "target_url", "description"))).alias("relations"))
        m = m.select(F.col("id").alias("method_id"), *(F.col(c).alias(f"m_{c}") for c in own), F.lit(True).alias("there"))
        out = hits.drop("entity_name", "method_name").join(e, "entity_id").join(m, "method_id", "left").join(related, "method_id", "left")
        pick = lambda a, b: F.when(F.col("there"), F.col(a)).otherwise(F.col(b) if b else None)
        return out.select("row_id", "rank", F.col("rank").alias("relevance"), F.col("e_name").alias("entity_name"), pick("m_name", None).alias("method_name"), pick("m_signature", None).alias("signature"), pick("m_description", "e_description").alias("description"), pick("m_parameters", None).alias("parameters"), pick("m_return_type", None).alias("return_type"), pick("m_return_desc", None).alias("return_desc"), pick("m_source_code", "e_source_code").alias("source_code"), pick("m_wrapped_method", None).alias("wrapped_method"), pick("m_wrapped_source", None).alias("wrapped_source"), pick("m_url", "e_url").alias("url"), F.coalesce("relations", F.array().cast(f"array<{schema.RELATION}>")).alias("relations"))

    def query_docs(self, library_id: str, query: str, mode: str = "all") -> DocResult:
        """Snippets for a query and their text within the budget; NotFound for an unknown library."""
        if self.store.read("libraries").where(F.col("id") == library_id).isEmpty():
            raise NotFound(f'library "{library_id}" not found')
        found = self.snippets(self.search(library_id, query, mode)).orderBy("rank", "row_id")
        found = self._keep(found)  # at most TOP rows
        c = F.col
        block = snippets.markdown(c("entity_name"), c("method_name"), c("signature"), c("description"), c("parameters"), c("return_type"), c("return_desc"), c("source_code"), c("wrapped_method"), c("wrapped_source"), c("url"))
        row = snippets.joined(snippets.within_budget(found.withColumn("block", block), budget=self.budget)).first()
        return DocResult(library_id, query, found, row["text"] or "")

    # Crawls

    def ingest(self, source, listing: DataFrame, pages: DataFrame) -> int:
        """One crawl over fetched tables: listing (url, html) and pages (url, html and, if there is one, error)."""
        return self.crawl(source, crawl.discovered(listing, source), lambda urls: pages_fetch(pages, urls))

    def crawl(self, source, found: DataFrame, fetch: Callable[[DataFrame], DataFrame], session: int | None = None, again: DataFrame | None = None) -> int:
        """One crawl of found (url), with fetch from urls to (url, html, error). Entities, methods, relations and progress are
        upserted, wrappers resolved, the index rebuilt; the session's id comes back. A method counts as done by itself.

        A given session is gone on with; again (url, entity_slug) are methods to fetch besides those of found. What stops the
        crawl leaves its session 'interrupted', with the progress of the stages that were finished.
        """
        self.upsert_library(source.meta())
        sessions = self.store.read("sessions")
        found = found.select("url").dropDuplicates(["url"])
        if session is None:
            session = sessions.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
            start = self.spark.range(1).select(F.lit(session).cast("long").alias("id"), F.lit(source.id).alias("library_id"), F.lit("in_progress").alias("status"), F.lit(found.count()).cast("int").alias("total_urls"), F.lit(0).alias("success_count"), F.lit(0).alias("fail_count"), F.lit(0).alias("skip_count"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
            self.store.upsert("sessions", start, "started_at")
        else:
            self.store.write("sessions", tables.close_session(sessions, session, "in_progress").withColumn("completed_at", F.when(F.col("id") != session, F.col("completed_at"))))
        try:
            self._stages(source, found, fetch, session, again)
        except BaseException:
            self._end(session, "interrupted")
            self.rebuild_index(source.id)
            raise
        self._end(session, "completed")
        self.rebuild_index(source.id)
        self.update_snippet_count(source.id)
        return session

    def _end(self, session: int, status: str) -> None:
        """A session's status, and the counts of its progress."""
        stats = tables.crawl_stats(self.store.read("progress").where(F.col("session_id") == session)).first()
        ended = tables.close_session(self.store.read("sessions"), session, status)
        mine = F.col("id") == session
        if stats:
            ended = ended.withColumn("success_count", F.when(mine, F.lit(stats.success).cast("int")).otherwise(F.col("success_count"))).withColumn("fail_count", F.when(mine, F.lit(stats.failed).cast("int")).otherwise(F.col("fail_count")))
        self.store.write("sessions", ended)

    def _stages(self, source, found: DataFrame, fetch: Callable[[DataFrame], DataFrame], session: int, again: DataFrame | None) -> None:
        """A crawl's entities, then its methods. Between the two the methods stand in progress as failed for an interruption."""
        lib, now = source.id, F.current_timestamp()
        parsed = crawl.parse_entities(fetch(found), source)
        hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
        key = lambda *c: hashed(F.lit(lib), *c)
        good = parsed.where("error is null")
        entities = good.select(key(F.col("slug")).alias("id"), F.lit(lib).alias("library_id"), "slug", "name", "kind", "description", "source_file", "source_code", "url", now.alias("created_at"), now.alias("updated_at"))
        self.store.upsert("entities", entities, keep_first=("id", "created_at"))
        properties = good.select(key(F.col("slug")).alias("entity_id"), F.posexplode("properties").alias("at", "p"))
        # Of equal names the last one stays.
        properties = properties.groupBy("entity_id", F.col("p.name").alias("name")).agg(F.max_by("p.description", "at").alias("description"))
        properties = properties.select(hashed("entity_id", "name").alias("id"), "entity_id", "name", F.lit("").alias("type"), "description", F.lit("public").alias("visibility"), F.lit("").alias("since"))
        self.store.write("properties", tables.replace_children(self.store.read("properties"), properties, "entity_id"))
        owners = good.select(F.col("slug").alias("entity_slug"), F.explode("method_urls").alias("url"))
        if again is not None:
            owners = owners.unionByName(again.select("entity_slug", "url"))
        owners = owners.withColumn("entity_id", key(F.col("entity_slug"))).dropDuplicates(["url"])
        waiting = crawl.progress_rows(owners.withColumn("error", F.lit("canceled: not fetched yet")), session, "method", "entity_slug")

        def note(rows: DataFrame) -> None:
            rows = rows.withColumn("id", hashed("session_id", "url")).select(*schema.names(schema.PROGRESS))
            self.store.upsert("progress", rows, "processed_at", ("id", "item_type", "parent_entity"))

        note(crawl.progress_rows(parsed, session, "entity").unionByName(waiting))
        # Once there are enough of them, classes can be searched for while methods are fetched.
        Refresher(lambda: self.rebuild_index(lib)).add(self.store.read("progress").where((F.col("session_id") == session) & (F.col("status") == "success")).count())
        pages = fetch(owners)
        methods = crawl.parse_methods(pages, source)
        owned = methods.where("error is null").join(owners, "url")
        full = crawl.resolved(owned, crawl.with_targets(owned, pages, fetch, source), source)
        rows = full.select(hashed("entity_id", "slug").alias("id"), "entity_id", "slug", "name", "signature", "description", "parameters", "return_type", "return_desc", "source_code", "wrapped_source", "wrapped_method", "url", "since", now.alias("created_at"), now.alias("updated_at"))
        rows, orphans = tables.with_parents(rows, self.store.read("entities"), "entity_id", "id")
        orphans = orphans.select("url", F.lit("FOREIGN KEY constraint failed").alias("_broken"))
        self.store.upsert("methods", rows.select(*schema.names(schema.METHODS)), keep_first=("id", "created_at"))
        relations = owned.select(hashed("entity_id", "slug").alias("method_id"), F.explode("relations").alias("r")).select("method_id", "r.*")
        relations = relations.select(hashed("method_id", "kind", "target_name", "target_url").alias("id"), "method_id", "kind", "target_name", "target_url", "description")
        self.store.write("relations", tables.replace_children(self.store.read("relations"), relations, "method_id"))
        done = methods.join(owners.select("url", "entity_slug"), "url").join(orphans, "url", "left").withColumn("error", F.coalesce("error", "_broken"))
        note(crawl.progress_rows(done, session, "method", "entity_slug"))
