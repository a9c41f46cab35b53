"""The index's tokens against SQLite's own full-text tokenizer, and the small text functions."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.plans import phrases


def fts5(words):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite lacks fts5")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(words, 1))
    out = [[] for _ in words]
    for term, doc, _, _ in db.execute("select term, doc, col, offset from v order by doc, offset"):
        out[doc - 1].append(term)
    return out


def test_stems_as_sqlite():
    random.seed(4)
    endings = ["s", "ies", "sses", "ed", "ing", "eed", "y", "ational", "izer", "ousli", "icate", "ful", "ness", "ement", "ion", "tion", "ll", "e", "able", "iviti", "alism", "logi", "bli", "ize"]
    words = ["".join(random.choice("abcdeilnorstuvwxyz") for _ in range(random.randint(1, 6))) + random.choice(endings) for _ in range(4000)]
    words += "query queries classes relational conditional hopping hoping falling failing filing sky happy agreed plastered motoring".split()
    assert [text.fts_tokens(w) for w in words] == fts5(words)


def test_folds_as_sqlite():
    some = ["Étude café naïve", "Ångström ñandú Übermaß", "wp_query::run( $a )", "данные й ё", "ộ ệ tiếng", "日本語 テスト", "x² ①", "café", "ǅ ß ẞ", "don't stop-me 12.5", "", "  ", "$ % &"]
    assert [text.fts_tokens(w) for w in some] == fts5(some)


@pytest.mark.parametrize("query, said", [("", ""), ('"', '""""'), ("-foo", '"foo"'), ("--", ""), ("a*b", '"a" "b"'), ("col:x", '"col" "x"'), ("(a OR b)", '"a" "OR" "b"'), ('foo"bar', '"foo""bar"'), ("  ", "")])
def test_expressions(query, said):
    assert phrases.expression(query) == said
    assert phrases.expression(query, "any") == said.replace('" "', '" OR "')


def test_phrases_pass_over_words_without_tokens():
    assert phrases.phrases("wp_query $ run") == [["wp", "queri"], ["run"]]


def test_columns(spark):
    df = spark.createDataFrame([("ReD ring x", 1), ("", 2), ("É 1", 3)], "t string, k int")
    rows = df.select(text.approx_tokens(F.col("t")), text.has_alphanumeric(F.col("t")), text.contains_ignoring_case(F.col("t"), "rEd"), text.contains_ignoring_case(F.col("t"), "é")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(4, True, True, False), (0, False, False, False), (3, True, False, False)]
