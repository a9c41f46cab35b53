"""The engine end to end over a small site, its service, and the cases of an empty store."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quillspark import cli, server
from quillspark.engine import Engine, NotFound
from quillspark.operators import tables
from quillspark.sources.wordpress import BASE, CLASSES, WordPress
from quillspark.streaming.ingest import Refresher, Versions, upsert_stream
from tests.test_sources import CLASS, METHOD


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}")
    listing = spark.createDataFrame([(BASE + CLASSES, f'<div class="wp-block-wporg-code-short-title"><a href="{CLASSES}wp_query/">q</a><a href="{CLASSES}gone/">g</a></div>')], "url string, html string")
    pages = spark.createDataFrame([(f"{BASE}{CLASSES}wp_query/", CLASS), (f"{BASE}{CLASSES}wp_query/query/", METHOD), (f"{BASE}{CLASSES}wp_query/get_posts/", "<section><h2 id=source>S</h2><pre><code>function get_posts() { $x; }</code></pre></section>")], "url string, html string")
    e.ingest(WordPress(), listing, pages)
    e.ingest(WordPress(), listing, pages)
    return e


def test_empty_store(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    assert e.libraries().count() == 0
    assert e.resolve("test query", "wordpress").count() == 0
    with pytest.raises(NotFound):
        e.query_docs("/nonexistent/lib", "test")
    e.close()
    assert (tmp_path / "s" / "_schema_version").exists()


def test_twice_ingested_is_once_stored(engine):
    assert engine.store.read("entities").count() == engine.store.read("methods").count() == 1
    assert engine.store.read("relations").count() == 1 and engine.store.read("properties").count() == 2
    sessions = engine.store.read("sessions").orderBy("id").collect()
    assert [(s.id, s.status, s.success_count, s.fail_count) for s in sessions] == [(1, "completed", 2, 1), (2, "completed", 2, 1)]
    failed = tables.failures(engine.store.read("progress")).collect()
    assert {(f.url, f.error_type) for f in failed} == {(f"{BASE}{CLASSES}gone/", "http_404")}


LISTING = f'<div class="wp-block-wporg-code-short-title"><a href="{CLASSES}wp_query/">q</a><a href="{CLASSES}busy/">b</a><a href="{CLASSES}gone/">g</a></div>'
QUERY = f"{BASE}{CLASSES}wp_query/"


@pytest.fixture
def site(spark, monkeypatch):
    """A site of pages (html, or an error) for the command line; the urls that were asked for, in order of stages. A page that is an exception stops the crawl."""
    pages, asked = {BASE + CLASSES: LISTING, QUERY: CLASS, f"{QUERY}query/": METHOD, f"{BASE}{CLASSES}busy/": CLASS.replace("WP_Query", "Busy").replace("wp_query", "busy"), f"{BASE}{CLASSES}busy/query/": METHOD}, []

    def fetch(urls, *_):
        want = sorted(r.url for r in urls.select("url").collect())
        asked.append(want)
        rows = []
        for url in want:
            page = pages.get(url, ValueError(f"HTTP 404: {url}"))
            if isinstance(page, KeyboardInterrupt):
                raise page
            rows.append((url, None, str(page)) if isinstance(page, Exception) else (url, page, None))
        return spark.createDataFrame(rows, "url string, html string, error string")

    monkeypatch.setattr(cli, "fetched", fetch)
    monkeypatch.setattr(cli, "Fetcher", lambda rps: pages.__getitem__)
    return pages, asked


def run(engine, *flags):
    cli.run_crawl(engine, cli.parser().parse_args(["crawl", *flags]))
    return {r.url.removeprefix(BASE + CLASSES): (r.status, r.error_type) for r in engine.store.read("progress").collect()}


def test_transient_failures_are_retried(spark, tmp_path, site):
    pages, asked = site
    e = Engine(spark, f"file://{tmp_path}/s")
    busy, method = pages[f"{BASE}{CLASSES}busy/"], pages[f"{QUERY}query/"]
    pages[f"{BASE}{CLASSES}busy/"], pages[f"{QUERY}query/"] = ValueError("server error 503: u"), ValueError("HTTP 429: u")
    first = {"wp_query/": ("success", None), "busy/": ("failed", "http_5xx"), "gone/": ("failed", "http_404"), "wp_query/query/": ("failed", "http_429")}
    assert run(e) == first
    pages[f"{BASE}{CLASSES}busy/"], pages[f"{QUERY}query/"] = busy, method
    asked.clear()
    assert run(e, "--retry-failed") == dict.fromkeys(["wp_query/", "busy/", "busy/query/", "wp_query/query/"], ("success", None)) | {"gone/": ("failed", "http_404")}
    assert asked[0] == [f"{BASE}{CLASSES}busy/"] and QUERY not in sum(asked, []) and f"{QUERY}query/" in asked[1]
    assert [(s.id, s.status, s.total_urls, s.success_count, s.fail_count) for s in e.store.read("sessions").collect()] == [(1, "completed", 3, 4, 1)]
    assert e.store.read("methods").count() == e.store.read("entities").count() == 2


def test_a_stopped_crawl_is_resumed(spark, tmp_path, site):
    pages, asked = site
    e = Engine(spark, f"file://{tmp_path}/s")
    method, pages[f"{QUERY}query/"] = pages[f"{QUERY}query/"], KeyboardInterrupt()
    with pytest.raises(KeyboardInterrupt):
        run(e)
    assert [(s.status, s.success_count, s.fail_count) for s in e.store.read("sessions").collect()] == [("interrupted", 2, 3)]
    assert {r.error_type for r in tables.retryable(e.store.read("progress")).collect()} == {"interrupted"}
    pages[f"{QUERY}query/"] = method
    asked.clear()
    assert run(e, "--resume")["wp_query/query/"] == ("success", None)
    assert QUERY not in sum(asked, [])
    assert [(s.id, s.status, s.success_count, s.fail_count) for s in e.store.read("sessions").collect()] == [(1, "completed", 4, 1)]
    assert e.store.read("methods").count() == 2 and e.query_docs("/wordpress/classes", "runs query").text


def test_delegation_targets_are_fetched(spark, tmp_path, site):
    pages, asked = site
    e = Engine(spark, f"file://{tmp_path}/s")
    code = "<h1>f</h1><section><h2 id=source>S</h2><pre><code>function {}() {{\n\treturn {}();\n}}</code></pre></section>"
    pages[f"{QUERY}query/"] = METHOD.replace("$this->get_posts", "f1")
    pages |= {f"{BASE}/reference/functions/{a}/": code.format(a, b) for a, b in (("f1", "f2"), ("f2", "f3"))}
    run(e)
    rows = {r.url: r for r in e.store.read("methods").collect()}
    assert rows[f"{QUERY}query/"].wrapped_method == "f1 → f2" and "return f3();" in rows[f"{QUERY}query/"].wrapped_source
    assert sum(asked, []).count(f"{BASE}/reference/functions/f1/") == 1


def test_search(engine):
    result = engine.query_docs("/wordpress/classes", "runs query")
    hit = result.snippets.first()
    assert (hit.entity_name, hit.method_name, hit.wrapped_method) == ("WP_Query", "query", "get_posts") and hit.relevance < 0
    assert hit.parameters[0].name == "$q" and hit.relations[0].kind == "used_by"
    assert result.text.startswith("# WP_Query::query()\n\n**Signature:** `WP_Query::query( string $q ): array`\n\n## Description\n\nRuns it.\n\n## Parameters\n\n- `$q` (string, required): The query.\n")
    assert engine.query_docs("/wordpress/classes", "$$$ absent").text == ""
    row = engine.resolve("WordPress", "class").first()
    assert (row.id, row.snippet_count, row.score) == ("/wordpress/classes", 2, 109.02)
    assert engine.entities("/wordpress/classes").first().method_count == 1


def test_rebuild_of_all_is_the_same(engine):
    before = sorted(map(tuple, engine.search("/wordpress/classes", "query", "any").collect()))
    engine.rebuild_index()
    assert sorted(map(tuple, engine.search("/wordpress/classes", "query", "any").collect())) == before


def test_service(engine):
    web = server.serve(engine, "127.0.0.1", 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_port}"

    def get(path):
        try:
            with urllib.request.urlopen(at + path) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert get("/health") == (200, '{"status": "ok"}')
        assert get("/nowhere")[0] == 404
        assert json.loads(get("/api/v1/libraries")[1])["libraries"][0]["id"] == "/wordpress/classes"
        assert get("/api/v1/libraries/search?libraryName=wordpress&query=word")[0] == 200
        assert get("/api/v1/libraries/search?libraryName=zzz&query=word")[0] == 404
        assert get("/api/v1/docs?libraryId=/wordpress/classes&query=run")[1].startswith("# WP_Query")
        assert get("/api/v1/docs?libraryId=/wordpress/classes&query=absent")[1].startswith("No results found")
        for bad in ("query=run", "libraryId=x&query=%24", "libraryId=x&query=a&mode=x", f"libraryId=x&query={'a' * 501}", "libraryId=x&query=a%00"):
            assert get(f"/api/v1/docs?{bad}")[0] == 400
        assert get("/api/v1/docs?libraryId=none&query=run")[0] == 404
        assert json.loads(get("/api/v1/entities?libraryId=/wordpress/classes")[1])["entities"][0]["name"] == "WP_Query"
    finally:
        web.shutdown()


def test_draining_waits_for_requests(engine, monkeypatch):
    web = server.serve(engine, "127.0.0.1", 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    begun, told = threading.Event(), []

    def slow(*_):
        begun.set()
        time.sleep(0.5)
        return 200, "text/plain", "late"

    monkeypatch.setattr(server, "respond", slow)
    ask = threading.Thread(target=lambda: told.append(urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/health").read()))
    ask.start()
    begun.wait(5)
    assert web.drain(5)
    ask.join(5)
    assert told == [b"late"]


def test_ticker_reports(engine):
    said = []
    with cli.Ticker(lambda: said.append(cli.progress_line(engine, "/wordpress/classes")), 0.05):
        time.sleep(3)
    assert said and said[0].startswith("session 2: 2 done, 1 failed")


def test_lookups_and_counts(engine):
    row = engine.entity("/wordpress/classes", "wp_query").first()
    assert row.name == "WP_Query" and engine.method(row.id, "query").first().name == "query"
    assert engine.entity("/other", "wp_query").isEmpty() and engine.method(row.id, "none").isEmpty()
    assert engine.store.read("libraries").first().snippet_count == 2


def test_parts_of_a_table_are_written_alone(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/s").store
    rows = lambda lib, n: spark.range(n).selectExpr(f"'{lib}' as library_id", "id as row_id", "id as dl")
    for k in range(4):
        store.write("doc_lengths", rows("a", k + 1), "a")
    store.write("doc_lengths", rows("b", 2), "b")
    assert sorted((r.library_id, r.row_id) for r in store.read("doc_lengths").collect()) == [("a", k) for k in range(4)] + [("b", 0), ("b", 1)]
    parts = [p for p in (tmp_path / "s").iterdir() if p.is_dir()]
    assert sorted(len(list(p.iterdir())) for p in parts) == [1, 2]


def test_stream_state_is_in_storage(spark, tmp_path):
    first = Versions(spark, f"file://{tmp_path}/t")
    assert first.before(0) is None
    first.write(0, spark.range(3))
    first.write(1, spark.range(5))
    again = Versions(spark, f"file://{tmp_path}/t")
    assert again.before(2).count() == 5 and again.before(1).count() == 3 and again.last().count() == 5
    again.write(1, spark.range(6))
    assert again.last().count() == 6


def test_settings(monkeypatch):
    assert [cli.seconds(t) for t in ("30", "1m30s", "500ms", "2h", "1.5s")] == [30, 90, 0.5, 7200, 1.5]
    monkeypatch.setenv("QS_T", "1 minute")
    assert cli.setting("QS_T", 30, cli.seconds) == 30
    monkeypatch.setenv("QS_N", "x")
    assert cli.setting("QS_N", 3, int) == 3 and cli.setting("QS_NONE", "d") == "d"
    assert cli.parser().parse_args(["crawl", "--resume"]).workers == 10


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, "y")], "k int, v string, at int, first string")
    new = spark.createDataFrame([(1, "c", 2, "z"), (3, None, 2, "w"), (2, "older", 0, "q")], old.schema)
    once = tables.upsert(old, new, ["k"], "at", ("first",))
    assert sorted(map(tuple, once.collect())) == [(1, "c", 2, "x"), (2, "b", 1, "q"), (3, None, 2, "w")]
    assert sorted(map(tuple, tables.upsert(once, new, ["k"], "at", ("first",)).collect())) == sorted(map(tuple, once.collect()))
    stats = tables.crawl_stats(spark.createDataFrame([(1, "success"), (1, "failed")], "session_id int, status string")).first()
    assert tuple(stats) == (1, 2, 1, 1, 0)


def test_error_types(spark):
    said = ["HTTP 404: /429", "HTTP 429", "server error 500", "timeout", "deadline exceeded", "FOREIGN KEY", "canceled", "else"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, m string")
    assert [r[0] for r in df.orderBy("k").select(tables.error_type(F.col("m"))).collect()] == ["http_404", "http_429", "http_5xx", "timeout", "timeout", "fk_error", "interrupted", "other"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    seen = []
    refresh = Refresher(lambda: seen.append("refresh"), 3)

    def apply(batch, number):
        n = batch.count()
        seen.append(n)
        refresh.add(n)

    spark.range(3).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    upsert_stream(read(), apply, str(tmp_path / "cp")).awaitTermination()
    spark.range(2).write.mode("append").parquet(str(tmp_path / "in"))
    upsert_stream(read(), apply, str(tmp_path / "cp")).awaitTermination()
    assert sum(x for x in seen if x != "refresh") == 5 and "refresh" in seen
