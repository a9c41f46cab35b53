"""Parsing pages, delegation and fetching."""

import io
import urllib.error

import pytest

from quillspark.operators import crawl
from quillspark.sources.base import Fetcher, HttpError
from quillspark.sources.html import parse
from quillspark.sources.wordpress import BASE, WordPress, body_lines

W = WordPress()
METHOD = """<html><head><meta name=description content="Runs it."></head><body><main><article><h1>WP_Query::query( string $q ): array</h1>
<section><h2 id=parameters>Parameters</h2><dl><dt><code>$q</code> string required<dd>The query.<dt><code>$n</code> int optional<dd>How many.</dl></section>
<section><h2 id=return>Return</h2><p><code>array</code> The posts.</p></section>
<section><h2 id=source>Source</h2><pre><code>short</code></pre><pre><code>function query( $q ) {
	return $this->get_posts( $q );
}</code></pre></section>
<section><h2 id=changelog>Changelog</h2><table><tr><td>2.0<td>Introduced again.<tr><td>1.5.0<td>Introduced.</table></section>
<section><h2 id=related>Related</h2><table><thead><tr><th>Used by<th>What</thead><tr><td><a href="/reference/functions/f/">f()</a><td>Calls it.</table></section></article></main></body></html>"""
CLASS = """<main><article><h1>class WP_Query {}</h1><div class="wp-block-post-content"><p>First.</p><p>View on Trac</p><h2>x</h2><p>Second.</p></div>
<section><h2 id=methods>Methods</h2><table><tr><td><a href="/reference/classes/wp_query/query/">query</a><td><a href="/reference/classes/wp_query/query/">again</a></table></section>
<section><h2 id=source>Source</h2><code>wp-includes/q.php</code><pre><code>class WP_Query {
	public $vars = array();
	protected static $n;
}</code></pre></section></article></main>"""


def test_method_page():
    m = W.method("u", METHOD)
    assert (m["name"], m["slug"], m["description"], m["since"]) == ("query", "query", "Runs it.", "1.5.0")
    assert m["parameters"] == [{"name": "$q", "type": "string", "required": True, "description": "The query."}, {"name": "$n", "type": "int", "required": False, "description": "How many."}]
    assert (m["return_type"], m["return_desc"]) == ("array", "The posts.")
    assert m["relations"] == [{"kind": "used_by", "target_name": "f()", "target_url": f"{BASE}/reference/functions/f/", "description": "Calls it."}]
    assert m["source_code"].startswith("function query")


def test_class_page():
    e, urls = W.entity(f"{BASE}/reference/classes/wp_query/", CLASS)
    assert (e["name"], e["slug"], e["description"], e["source_file"]) == ("WP_Query", "wp_query", "First. Second.", "wp-includes/q.php")
    assert [p["name"] for p in e["properties"]] == ["$vars", "$n"]
    assert urls == [f"{BASE}/reference/classes/wp_query/query/"]
    with pytest.raises(ValueError, match="no h1"):
        W.entity("u", "<p>x</p>")


def test_listing_page():
    html = '<div class="wp-block-wporg-code-short-title"><a href="/reference/classes/wpdb/">x</a></div><nav class="wp-block-query-pagination"><a href="/reference/classes/page/12/">12</a><a href="/x/">n</a></nav>'
    assert W.listing(html) == ([f"{BASE}/reference/classes/wpdb/"], 12)
    with pytest.raises(ValueError):
        W.listing("")


def test_implied_tags():
    doc = parse("<p>a<p>b<table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul>")
    assert [n.text() for n in doc.find("tbody > tr")] == ["12", "3"]
    assert [n.text() for n in doc.find("li, p")] == ["a", "b", "x", "y"]


@pytest.mark.parametrize(
    "body, found",
    [
        ("return $this->run( $a );", (True, "run", "self_method")),
        ("return self::run();", (True, "run", "self_method")),
        ("return static::run();", (True, "run", "self_method")),
        ("return Other::run();", (True, "Other::run", "static_method")),
        ("return parent::run();", (False, "", "")),
        ("return get_posts( $a );", (True, "get_posts", "function")),
        ("return count( $a );", (False, "", "")),
        ("do_it();", (True, "do_it", "function")),
        ("header( 'x' );", (False, "", "")),
        ("if ( $a ) { b(); }", (True, "if", "function")),
        ("\n".join(f"$a{k} = 1;" for k in range(5)) + "\nreturn f();", (False, "", "")),
        ("// return f();\n/* x */ return g();\n", (False, "", "")),
    ],
)
def test_wrappers(body, found):
    assert W.wrapper("function x( $a ) {\n" + body + "\n}") == found


def test_body_on_one_line():
    assert body_lines("function a() { return b(); }") == ["return b(); }"]
    assert W.wrapper("function a() { return b(); }") == (True, "b", "function")


def test_chain_stops_after_three(spark):
    def page(n, to):
        return (f"{BASE}/reference/functions/{n}/", f"<section><h2 id=source>S</h2><pre><code>function {n}() {{\n\treturn {to}();\n}}</code></pre></section>")

    pages = spark.createDataFrame([page("f1", "f2"), page("f2", "f3"), page("f3", "f4"), page("f4", "f5")], "url string, html string")
    methods = spark.createDataFrame([("m", "own", "function m() {\n\treturn f1();\n}"), ("n", "own", "function n() { $x = 1; }")], "url string, entity_slug string, source_code string")
    rows = {r.url: r for r in crawl.resolved(methods, pages, W).collect()}
    assert rows["m"].wrapped_method == "f1 → f2 → f3" and rows["m"].wrapped_source.count("// --- Delegates to: ") == 2
    assert rows["n"].wrapped_method is None


def test_fetcher_tries_again():
    waits, codes = [], [503, 429, 200]

    def answer(request, timeout):
        code = codes.pop(0)
        if code != 200:
            raise urllib.error.HTTPError("u", code, "x", {}, None)
        return io.BytesIO(b"body")

    assert Fetcher(1000, 3, sleep=waits.append, open=answer)("http://u") == "body"
    assert [w for w in waits if w >= 1] == [1, 2]
    codes[:] = [404, 200]
    with pytest.raises(HttpError, match="404"):
        Fetcher(1000, 3, sleep=waits.append, open=answer)("http://u")


def test_foreign_parameters():
    assert crawl.parameters_from_json('[{"Name": "$a", "Type": "int", "Required": true, "Description": "x"}]') == [{"name": "$a", "type": "int", "required": True, "description": "x"}]
    assert crawl.parameters_from_json("") == crawl.parameters_from_json("[]") == crawl.parameters_from_json("{bad") == []
