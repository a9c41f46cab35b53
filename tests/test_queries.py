"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compared(spark, run, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = run(spark, SF), db.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    said = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert said(df.select(*columns).collect()) == said(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    compared(spark, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


TITLES = ["a&amp", "a&&am&quot", "a&ampx &amp; &AMP; &amp;lt; &amp;amp;", "&lt;b&gt; &quot;x&#39;&#x27;&nbsp;y&nbsp;", "&copy; &eacute; &#8217; &#x2019;", "\u2003 a b\u3000", "\n\ta\n", "a <b>b</b><!-- c --> d", "1 < 2 & 3 > 2", "é\U0001f600$1\\1", ""]
ODD_PAGES = {
    "references": [f"<title>t</title><article class='x'><p>p</p><h1 id='y'>{t}</h1><h1>2</h1></article>" for t in TITLES],
    "parts": [None, "", "<p>x</p>", "<main><h1>m</h1></main>", "<article><h1>open", "<article", "<article><h1", "<h1>0</h1><article></article><h1>after</h1>"],
    "large": ["<article>" * 3000 + "<h1>" * 3000, "<article>" + "<p>x\n</p>" * 50_000 + "<h1>far</h1>"],
}


@pytest.mark.parametrize("kind", ODD_PAGES)
def test_titles_of_odd_pages(spark, tmp_path, kind):
    """As the SQL has them: cut and unknown references, marks and spaces; null pages and missing parts; many tags."""
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, html varchar)")
    db.executemany("insert into pages values (?, ?)", list(enumerate(ODD_PAGES[kind])))
    db.execute(f"copy pages to '{tmp_path}/pages.parquet'")
    got = catalog.queries()["html_h1_title"](spark, str(tmp_path)).select("page_id", "h1").collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(catalog.oracle_sql()["html_h1_title"]).select("page_id, h1").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
