"""Matching and ranking against SQLite's full-text index."""

import itertools
import random
import sqlite3

import pytest

from quillspark.functions import text
from quillspark.operators import search, snippets
from quillspark.plans import phrases


def sqlite_index(rows):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(library_id, entity_name, method_name, content, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite lacks fts5")
    db.executemany("insert into t(rowid, library_id, entity_name, method_name, content) values (?, ?, ?, ?, ?)", rows)
    return db


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    words = "query queries post_type café the NOT meta wp loop class $ build".split()
    said = lambda n: " ".join(random.choice(words) for _ in range(n))
    out = [(k, f"/lib/{k % 2}", said(1), said(2), said(random.randint(0, 12))) for k in range(1, 80)]
    return [*out, (100, "/lib/0", "same", "same", "same text"), (101, "/lib/0", "same", "same", "same text")]


@pytest.mark.parametrize("mode", ["all", "any", "odd"])
@pytest.mark.parametrize("query", ["query", "post_type", "the query", "NOT $", "query query", "lib meta-build", "same", "absent query", "$"])
def test_ranks(spark, rows, query, mode):
    docs = spark.createDataFrame(rows, "row_id long, library_id string, entity_name string, method_name string, content string")
    tokens = search.tokenised(docs, keep=())
    got = search.bm25(search.postings(tokens, ()), search.document_lengths(tokens), phrases.phrases(query), mode).orderBy("rank", "row_id").collect()
    found = sqlite_index(rows).execute("select rowid, bm25(t, 1, 5, 10, 15) from t where t match ? order by 2, 1", (phrases.expression(query, mode),)).fetchall() if phrases.phrases(query) else []
    assert [r.row_id for r in got] == [i for i, _ in found]
    assert all(abs(r.rank - x) < 1e-9 for r, (_, x) in zip(got, found, strict=True))


def test_equal_scores_have_equal_ranks(spark):
    """Each group's rows hold three words equally often in all, but each word another time: the scores are the same, and so must be their sums."""
    rows = [(group, " ".join(["a"] * i + ["b"] * j + ["c"] * k)) for group in range(1, 9) for i, j, k in itertools.permutations((group, 2 * group + 1, 5 * group + 3))]
    rows += [(0, "none of them")] * 100
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "row_id long, text string")
    tokens = search.tokenised(docs, ("text",), text.plain_tokens, ())
    got = search.bm25(search.postings(tokens, ()), search.document_lengths(tokens), phrases.phrases("a b c"), "any", (1.0,)).collect()
    assert len(got) == 48
    assert len({(rows[r.row_id][0], r.rank) for r in got}) == 8


def test_top_breaks_ties_by_row(spark):
    df = spark.createDataFrame([(3, -1.0), (1, -1.0), (2, -2.0)], "row_id long, rank double")
    assert [r.row_id for r in search.top(df, 2).collect()] == [2, 1]
    assert search.top(df, 0).count() == 3


@pytest.mark.parametrize("seed", range(5))
def test_budget_is_a_prefix(spark, seed):
    random.seed(seed)
    blocks = [" ".join("w" * random.choice([0, 1, 5, 30])) for _ in range(12)]
    df = spark.createDataFrame([(k, float(k), b) for k, b in enumerate(blocks)], "row_id long, rank double, block string")
    kept, total = [], 0
    for k, b in enumerate(blocks):
        n = int(len(b.split()) * 1.5)
        if k and total + n > 60:
            break
        kept.append(k)
        total += n
    cut = snippets.within_budget(df, budget=60)
    assert sorted(r.row_id for r in cut.collect()) == kept
    assert snippets.joined(cut).first()["text"] == snippets.SEPARATOR.join(blocks[k] for k in kept)
    assert snippets.joined(df.limit(0).withColumn("rn", df.row_id)).first()["text"] == ""
