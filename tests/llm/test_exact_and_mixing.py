"""Exact dedup, mixing and host rules on edge cases, and all queries with SQL against DuckDB."""

import random

import pytest

from quillspark.llm import exact_dedup, host_rules, mixing, queries
from tests.llm.conftest import got
from tests.test_queries import compared


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    compared(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_duplicates(docs):
    rows = [(5, "a b"), (2, "ab"), (3, "a  b"), (9, "a\tb "), (7, None), (8, ""), (6, " \n"), (None, "ab"), (4, "x" * 200_000), (1, "a b"), (2, "ab")]
    out = exact_dedup.duplicate_groups(docs(rows))
    assert out.count() == len(rows)
    g = got(out, "doc_id", "keep_id", "group_size", "kept")
    assert g[3] == (3, 6, True) and g[9] == (3, 6, False) and g[5] == g[2] == g[None] == (3, 6, False)
    assert g[6] == (6, 3, True) and g[7] == g[8] == (6, 3, False) and g[1] == (1, 1, True)
    kept = exact_dedup.deduplicate(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6] and kept.columns == docs(rows).columns
    assert exact_dedup.duplicate_groups(docs([])).count() == exact_dedup.deduplicate(docs([])).count() == 0


def test_large_groups_are_whole(docs):
    rows = [(k, "same text") for k in range(3000)] + [(k, f"own {k}") for k in range(3000, 3500)]
    g = got(exact_dedup.duplicate_groups(docs(rows), salts=4), "doc_id", "keep_id", "group_size")
    assert all(g[k] == (0, 3000) for k in range(3000)) and all(g[k] == (k, 1) for k in range(3000, 3500))


def brute_targets(sizes):
    """Shares by weight; what is above the cap is fixed there and the rest shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, left = {}, set(names)
    total = sum(sizes.values())
    while left:
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}
        left -= over
    return full


@pytest.mark.parametrize("seed", range(4))
def test_mix(docs, seed):
    random.seed(seed)
    names = ["b", "a", "Z", None, "é", "tiny"][: 2 + seed]
    picked = [random.choice(names) for _ in range(300)]
    rows = [(k, None if k % 17 == 0 else " ".join("w" * (1 if s == "tiny" else random.randint(0, 40))), "en", s) for k, s in enumerate(picked)]
    out = mixing.mix(docs(rows)).collect()
    assert len(out) == len(rows)
    sizes: dict = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    taken: dict = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) < 1.001 for s in want)
    assert sorted(map(str, mixing.mix(docs(rows)).collect())) == sorted(map(str, out))


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0
    assert got(mixing.mix(docs([(1, None), (2, "")])), "doc_id", "size", "target", "taken") == {1: (0, 0.0, 0), 2: (0, 0.0, 0)}


def brute_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {p for at in windows.values() if len(at) > 1 for k in at for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


def test_word_counts(docs):
    random.seed(3)
    rows = [(k, " ".join(random.choice("abcd") for _ in range(random.randint(0, 60)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (103, "a b\na b\n\na b"), (104, "x y z " * 9000), (105, "# é  & x"), (106, "one"), (107, "p q"), (108, "a a a a")]
    out = got(host_rules.word_counts(docs(rows).select("doc_id", "text")), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert out == {k: brute_counts(t) for k, t in rows}


def test_very_long_texts_sort_pairs(docs, monkeypatch):
    monkeypatch.setattr(host_rules, "POSITION_BITS", 4)
    test_word_counts(docs)


def test_hosts_out_of_line_go(docs):
    """Of 30 hosts that fail in a tenth of their documents one fails in half: its good documents go too, and the others' stay."""
    good, bad = " ".join(f"w{k}" for k in range(60)), "short"
    rows = [(h * 100 + k, bad if k < (20 if h == 7 else 3 + h % 3) else good, "en", f"host{h}") for h in range(30) for k in range(40)]
    out = host_rules.host_verdicts(docs(rows)).collect()
    for r in out:
        assert r.kept == (r.doc_id // 100 != 7 and r.doc_id % 100 >= 3 + (r.doc_id // 100) % 3)
    # Where all hosts are alike, none goes.
    rows = [(h * 100 + k, bad if k < 20 else good, "en", f"host{h}") for h in range(5) for k in range(40)] + [(None, good, "en", None)] * 40 + [(None, bad, "en", None)] * 40
    assert all(r.kept == (not r.base_failed) for r in host_rules.host_verdicts(docs(rows)).collect())


def test_hosts(docs):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(k, good, "en", "fine") for k in range(30)] + [(100 + k, "short", "en", "bad") for k in range(30)] + [(200, good, "en", "bad"), (300, good, "en", None)]
    out = got(host_rules.host_verdicts(docs(rows)), "doc_id", "base_failed", "kept")
    assert out[0] == (False, True) and out[100] == (True, False) and out[200] == (False, False) and out[300] == (False, True)
    assert host_rules.host_verdicts(docs([])).count() == 0


def test_windows_of_equal_hash_bits_are_compared(docs, monkeypatch):
    """With eight bits of the hashes many windows agree, but only equal ones count."""
    monkeypatch.setattr(host_rules, "POSITION_BITS", 56)
    text = " ".join(f"w{k}" for k in range(2000))
    out = got(host_rules.word_counts(docs([(1, text), (2, f"{text} w5 w6 w7"), (3, None), (4, "a b")]).select("doc_id", "text")), "doc_id", "n_repeat_words")
    assert out == {1: (0,), 2: (6,), 3: (0,), 4: (0,)}
