"""Relational queries of the store over the driver's tables: libraries are sources of documents, sessions orders, progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tables
from .registry import query, table


#: Files, and so micro-batches, of the stream.
STREAM_FILES = 4


def _libraries(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # Sums before the join would lose rows without labels; labels has one row for each document at most.
    joined = docs.select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id", "left")
    lib = joined.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("snippet_count"), F.coalesce(F.round(F.avg("quality"), 6), F.lit(0.8)).alias("trust_score"))
    return lib.select("id", F.concat(F.lit("Library "), "id").alias("name"), F.concat(F.lit("Documents of "), "id").alias("description"), "snippet_count", "trust_score")


_LIB = """lib as (select source as id, 'Library ' || source as name, 'Documents of ' || source as description, count(*)::int as snippet_count, coalesce(round(avg(quality), 6), 0.8) as trust_score
from documents left join labels using (doc_id) group by source)"""


@query(f"with {_LIB} select id, name, snippet_count, trust_score from lib order by name")
def list_libraries(spark, sf_dir):
    return _libraries(spark, sf_dir).select("id", "name", "snippet_count", "trust_score").orderBy("name")


@query(f"with {_LIB} select id, name, snippet_count, trust_score from lib where id = 'src1'")
def get_library(spark, sf_dir):
    return _libraries(spark, sf_dir).where("id = 'src1'").select("id", "name", "snippet_count", "trust_score")


@query(f"""
with {_LIB},
hit as (select *, case when lower(name) = 'library src1' then 100.0 when starts_with(lower(name), 'library src1') then 80.0 when contains(lower(name), 'library src1') then 60.0 when contains(lower(id), 'library src1') then 40.0 else 0.0 end::double
   + snippet_count * 0.01::double + trust_score * 10.0::double as score from lib where contains(lower(name), 'src1') or contains(lower(description), 'src1') or contains(lower(id), 'src1'))
select id, snippet_count, round(score, 6) as score from hit order by hit.score desc, trust_score desc, id limit 5
""")
def resolve_library(spark, sf_dir):
    found = tables.search_libraries(_libraries(spark, sf_dir), "SRC1")
    return tables.rank_libraries(found, "Library src1").limit(5).select("id", "snippet_count", F.round("score", 6).alias("score"))


@query("""
select n_nationkey, round(case when lower(n_name) = 'nation_1' then 100.0 when starts_with(lower(n_name), 'nation_1') then 80.0 when contains(lower(n_name), 'nation_1') then 60.0 when contains(lower('r' || n_regionkey), 'nation_1') then 40.0 else 0.0 end::double
  + n_regionkey * 0.01::double + n_nationkey * 10.0::double, 6) as score from nation
""")
def rank_libraries_score(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id"), F.col("n_regionkey").alias("snippet_count"), F.col("n_nationkey").cast("double").alias("trust_score"))
    return tables.rank_libraries(n, "nation_1").select("n_nationkey", F.round("score", 6).alias("score"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_type), 'red')")
def search_libraries_like(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(text.contains_ignoring_case(F.col("p_name"), "ReD") | text.contains_ignoring_case(F.col("p_type"), "ReD")).select("p_partkey", "p_name")


@query("select s_suppkey, s_name, s_name like '%!_1%' escape '!' as has_underscore, lower(s_name) like '%#0000%' as has_hash from supplier")
def search_like_escape(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", "s_name", text.contains_ignoring_case(F.col("s_name"), "_1").alias("has_underscore"), text.contains_ignoring_case(F.col("s_name"), "#0000").alias("has_hash"))


@query("select conv_id, 'conv-' || conv_id as name, count(*) as method_count from conversations group by 1 union all select -1 - s_suppkey, s_name, count(l_orderkey) from supplier left join lineitem on l_suppkey = s_suppkey group by 1, 2")
def list_entities_method_count(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    convs = c.select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"))
    supp = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    methods = c.select(F.col("conv_id").alias("entity_id")).unionByName(table(spark, sf_dir, "lineitem").select((-1 - F.col("l_suppkey")).alias("entity_id")))
    return tables.method_counts(convs.unionByName(supp), methods).select(F.col("id").alias("conv_id"), "name", "method_count")


@query("select s_nationkey as library_id, count(*) + sum(m) as snippets from (select s_nationkey, (select count(*) from lineitem where l_suppkey = s_suppkey) as m from supplier) group by 1")
def snippet_count(spark, sf_dir):
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("library_id"))
    return tables.snippet_counts(entities, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id")))


@query("select n_nationkey as id, case when n_regionkey > 0 then n_regionkey else coalesce(snippets, 0) end::int as snippet_count from nation left join (select s_nationkey, count(*) as snippets from supplier group by 1) on s_nationkey = n_nationkey")
def fill_snippet_count(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("snippet_count"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("library_id")).agg(F.count(F.lit(1)).alias("snippets"))
    return tables.fill_snippet_count(n, s)


@query("select turn, role, text from conversations where conv_id = 7 order by turn")
def list_methods(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id = 7").select("turn", "role", "text").orderBy("turn")


@query("select doc_id, source, text from documents where source = 'src1' and doc_id = (select min(doc_id) from documents where source = 'src1')")
def get_entity(spark, sf_dir):
    mine = table(spark, sf_dir, "documents").where("source = 'src1'")
    return mine.groupBy().agg(F.min_by(F.struct("doc_id", "source", "text"), "doc_id").alias("d")).select("d.*")


@query("select conv_id, turn, role, text from conversations where conv_id = 3 and turn = 1")
def get_method(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id = 3 and turn = 1").select("conv_id", "turn", "role", "text")


@query("""
select o_orderkey, kind, target, pos::int as pos from (
  select o_orderkey, l_returnflag as kind, l_partkey as target, row_number() over (partition by o_orderkey order by l_returnflag, l_partkey, l_linenumber) - 1 as pos from orders join lineitem on l_orderkey = o_orderkey)
""")
def list_relations_nested(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    kids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("target"), "l_linenumber")
    lists = tables.nested(o, kids, "o_orderkey", ("kind", "target", "l_linenumber"), "relations")
    return lists.select("o_orderkey", F.posexplode("relations").alias("pos", "r")).select("o_orderkey", "r.kind", "r.target", "pos")


@query("select o_custkey as library_id, max(o_orderkey) as id, arg_max(case o_orderstatus when 'F' then 'completed' when 'O' then 'in_progress' else 'interrupted' end, o_orderkey) as status from orders group by 1")
def last_session(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("interrupted")
    sessions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("library_id"), F.col("o_orderkey").alias("id"), status.alias("status"))
    return tables.latest(sessions, "library_id", "id").select("library_id", "id", "status")


def _progress(spark, sf_dir: str) -> DataFrame:
    """Events as crawl items; the error's class is read off a message."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("pending")
    message = F.when(k % 7 == 0, "HTTP 404: u").when(k % 7 == 1, "HTTP 429: u").when(k % 7 == 2, "server error 503").when(k % 7 == 3, "context deadline exceeded").when(k % 7 == 4, "FOREIGN KEY constraint failed").when(k % 7 == 5, "context canceled")
    e = table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("session_id"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.lit("entity").alias("item_type"), status.alias("status"), message.alias("error_message"), F.lit(None).cast("string").alias("parent_entity"))
    return e.withColumn("error_type", F.when(F.col("error_message").isNotNull(), tables.error_type(F.col("error_message"))))


_EV = """ev as (select event_id, user_id as session_id, 'u' || event_id as url, case event_type when 'purchase' then 'success' when 'error' then 'failed' when 'signup' then 'skipped' else 'pending' end as status,
  case (props->>'$.k')::int % 7 when 0 then 'HTTP 404: u' when 1 then 'HTTP 429: u' when 2 then 'server error 503' when 3 then 'context deadline exceeded' when 4 then 'FOREIGN KEY constraint failed' when 5 then 'context canceled' end as error_message from events),
pr as (select *, case when error_message is null then null when contains(error_message, '404') then 'http_404' when contains(error_message, '429') then 'http_429' when contains(error_message, 'server error') then 'http_5xx'
  when contains(error_message, 'timeout') or contains(error_message, 'deadline') then 'timeout' when contains(error_message, 'FOREIGN KEY') then 'fk_error' when contains(error_message, 'canceled') then 'interrupted' else 'other' end as error_type from ev)"""


@query(f"with {_EV} select session_id, count(*) as total, count(*) filter (status = 'success') as success, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped from pr group by 1")
def crawl_stats(spark, sf_dir):
    return tables.crawl_stats(_progress(spark, sf_dir))


@query(f"with {_EV} select session_id, coalesce(error_type, 'unknown') as error_type, count(*) as n from pr where status = 'failed' group by 1, 2")
def failures_by_type(spark, sf_dir):
    return tables.failures_by_type(_progress(spark, sf_dir))


@query(f"with {_EV} select session_id, url, 'entity' as item_type, coalesce(error_type, '') as error_type, coalesce(error_message, '') as error_message, '' as parent_entity from pr where status = 'failed'")
def failures(spark, sf_dir):
    return tables.failures(_progress(spark, sf_dir))


@query(f"with {_EV} select event_id, coalesce(error_type, '') as error_type from pr")
def classify_error(spark, sf_dir):
    return _progress(spark, sf_dir).select("event_id", F.coalesce("error_type", F.lit("")).alias("error_type"))


@query(f"with {_EV} select 'u' || o_orderkey as url from orders where 'u' || o_orderkey not in (select url from pr where status = 'success')")
def resume_remaining(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"))
    return tables.remaining(found, _progress(spark, sf_dir))


@query(f"with {_EV} select session_id, url, coalesce(error_type, '') as error_type from pr where status = 'failed' and coalesce(error_type, '') not in ('http_404', 'parse_error', 'fk_error')")
def retry_transient(spark, sf_dir):
    return tables.retryable(_progress(spark, sf_dir)).select("session_id", "url", "error_type")


@query("select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id, min(event_id) as first_id from events group by 1, 2")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", F.col("event_id").alias("first_id"))
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return tables.upsert(old, new, ["user_id", "event_type"], "event_id", ("first_id",))


@query("""
with mine as (select distinct l_orderkey from lineitem where l_linenumber = 1 and l_orderkey % 3 = 0)
select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select l_orderkey from mine)
union all select l_orderkey, l_linenumber, l_quantity + 1 from lineitem where l_orderkey in (select l_orderkey from mine) and l_linenumber = 1
""")
def replace_children(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.where("l_linenumber = 1 and l_orderkey % 3 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    return tables.replace_children(old, new, "l_orderkey")


@query("select user_id as session_id, 'u' || (event_id % 50) as url, arg_max(event_type, event_id) as status, arg_min(event_type, event_id) as item_type from events group by 1, 2")
def record_progress_keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")).alias("url"), F.col("event_type").alias("status"), F.col("event_type").alias("item_type"), "event_id")
    out = tables.upsert(e.limit(0), e, ["session_id", "url"], "event_id", ("item_type",))
    return out.drop("event_id")


@query("select o_orderkey, true as parent_found from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') union all select o_orderkey, false from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def fk_check_semi(spark, sf_dir):
    good, bad = tables.with_parents(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey")
    return good.select("o_orderkey", F.lit(True).alias("parent_found")).unionByName(bad.select("o_orderkey", F.lit(False).alias("parent_found")))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders from customer")
def exists_flag(spark, sf_dir):
    some = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("_k")).distinct()
    c = table(spark, sf_dir, "customer")
    return c.join(some, F.col("c_custkey") == F.col("_k"), "left").select("c_custkey", F.col("_k").isNotNull().alias("has_orders"))


@query("select event_id, (props->>'$.k')::int as k, ('[{\"name\": \"k\", \"type\": \"' || event_type || '\"}]')::json->>'$[0].type' as type from events")
def param_json_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k: int>").alias("p"), F.array(F.struct(F.lit("k").alias("name"), F.col("event_type").alias("type"))).alias("params"))
    back = F.from_json(F.to_json("params"), "array<struct<name: string, type: string>>")
    return e.select("event_id", "p.k", F.get(back, 0)["type"].alias("type"))


@query(r"select doc_id, regexp_matches(coalesce(text, ''), '[\p{L}\p{Nd}]') as ok, strlen(coalesce(text, '')) <= 500 as short from documents")
def alnum_validate(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.has_alphanumeric(t).alias("ok"), (F.octet_length(t) <= 500).alias("short"))


@query("select o_orderkey as id, case when o_orderkey % 10 = 3 then 'interrupted' else 'in_progress' end as status, o_orderkey % 10 = 3 as completed from orders")
def update_session(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10).alias("group"), F.lit("in_progress").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"))
    out = tables.close_session(o.withColumnRenamed("id", "_id").withColumnRenamed("group", "id"), 3, "interrupted")
    return out.select(F.col("_id").alias("id"), "status", F.col("completed_at").isNotNull().alias("completed"))


@query("""
with recursive e as (select p_partkey as src, (p_partkey * 7 + 3) % (select count(*) from part) as dst from part where p_partkey % 5 <> 0),
r as (select p_partkey as root, p_partkey as at, p_partkey::varchar as path, 0 as depth from part union all
      select root, dst, path || ' > ' || dst, depth + 1 from r join e on e.src = r.at where depth < 3)
select root, arg_max(path, depth) as path, max(depth)::int as depth from r group by 1
""")
def wrapper_chain(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    n = p.count()
    edges = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % n).alias("dst"))
    return tables.chains(p.select(F.col("p_partkey").alias("root")), edges)


@query("select user_id as session_id, 'u' || (event_id % 50) as url, arg_max(event_type, event_id) as status, max(event_id) as event_id from events group by 1, 2")
def stream_incremental_ingest(spark, sf_dir):
    """Events as a stream of several files, upserted by micro-batches into a table in the shared folder."""
    from ..streaming.ingest import Versions, shared_folder, upsert_stream

    root = shared_folder(spark, "stream")
    versions = Versions(spark, f"{root}/table")
    table(spark, sf_dir, "events").repartitionByRange(STREAM_FILES, "event_id").write.parquet(f"{root}/source")

    def apply(batch: DataFrame, number: int) -> None:
        new = batch.select(F.col("user_id").alias("session_id"), F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")).alias("url"), F.col("event_type").alias("status"), "event_id")
        old = versions.before(number)
        versions.write(number, tables.upsert(new.limit(0) if old is None else old, new, ["session_id", "url"], "event_id"))

    source = spark.read.parquet(f"{root}/source")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
    upsert_stream(stream, apply, f"{root}/checkpoint").awaitTermination()
    return versions.last()
