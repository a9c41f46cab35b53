"""Language ID and secret scans against brute force and on held-out rows."""

import itertools
import random
import re

import numpy as np
import pytest

from quillspark.llm import language_id, secret_crf
from tests.llm.conftest import got

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_forward_sums_all_segmentations():
    lattice = language_id.lattice(language_id.public_tokenizers.path(language_id.VOCABULARY))
    rng = np.random.default_rng(0)
    p = rng.random((lattice.n, 2)) / 1000
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language_id.public_tokenizers.path(language_id.VOCABULARY))
    pieces = {sp.id_to_piece(i): i for i in range(lattice.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    units = ["▁the", "▁action", "é", "▁x中", "▁aaa"]
    for unit, row in zip(units, lattice.scores(units, p), strict=True):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
            parts, part = [], unit[0]
            for c, cut in zip(unit[1:], cuts, strict=True):
                if cut:
                    parts.append(part)
                    part = c
                else:
                    part += c
            parts.append(part)
            if all(x in pieces or len(x) == 1 for x in parts):
                total += np.prod([p[pieces.get(x, lattice.unknown)] for x in parts], axis=0)
        assert np.allclose(np.exp(row), total)


def in_logs(lattice, pieces, word, p):
    """Forward, all in logs: the log probability of a word of any length."""
    out = [np.zeros(p.shape[1])]
    for end in range(1, len(word) + 1):
        ways = [(end - n, pieces.get(word[end - n : end], lattice.unknown if n == 1 else None)) for n in range(1, min(end, lattice.longest) + 1)]
        out.append(np.logaddexp.reduce([out[k] + np.log(p[i]) for k, i in ways if i is not None]))
    return out


def test_long_words_are_whole():
    """A word of thousands of letters is the sum over all its segmentations, cut or not, and so are expected counts."""
    import sentencepiece

    path = language_id.public_tokenizers.path(language_id.VOCABULARY)
    lattice, sp = language_id.lattice(path), sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i): i for i in range(lattice.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    rng = np.random.default_rng(1)
    p = rng.random((lattice.n, 2)) / 1000
    words = ["a" * 5000, "theaction" * 300, "x" * 31, "x" * 32, "x" * 33, "a" * 63, "a" * 64, "a" * 65, "中文" * 50, "ab1cd" * 100, "", "internationalisation" * 7]
    for word, units in zip(words, lattice.units(words), strict=True):
        assert "".join(units) == "▁" + word
        want = in_logs(lattice, pieces, "▁" + word, p)[-1]
        assert np.allclose(lattice.scores(units, p).sum(0), want) and np.allclose(lattice.scores(["▁" + word], p)[0], want)
    # One round of the fit: expected counts by forward and backward in logs.
    counts = {"a": {"▁" + "a" * 70: 2, "▁the": 3, "▁" + "other" * 9: 1}, "b": {"▁the": 1, "▁" + "a" * 64: 1}}
    fitted, flat = lattice.fit(counts, rounds=1), np.full((lattice.n, 1), 1 / lattice.n)
    for column, own in enumerate(counts.values()):
        expected = np.zeros(lattice.n)
        for word, n in own.items():
            ahead = [x[0] for x in in_logs(lattice, pieces, word, flat)]
            behind = [in_logs(lattice, pieces, word[k:], flat)[-1][0] for k in range(len(word) + 1)]
            for a in range(len(word)):
                for z in range(a + 1, min(len(word), a + lattice.longest) + 1):
                    i = pieces.get(word[a:z], lattice.unknown if z == a + 1 else None)
                    if i is not None:
                        expected[i] += n * np.exp(ahead[a] + np.log(1 / lattice.n) + behind[z] - ahead[-1])
        expected += language_id.SMOOTHING
        assert np.allclose(fitted[:, column], expected / expected.sum())


def test_texts_of_no_known_language_are_rejected(docs, documents):
    good = [r.text for r in documents.where("doc_id < 30").collect()]
    bad = ["dGhpcyBpcyBh IHRlc3Qgb2Yg YmFzZTY0aGVs bG8gd29ybGQg Zm9vYmFy", "Привет мир это русский текст о погоде и о городе", "12 %", "", None]
    df = docs([(k, t) for k, t in enumerate(good + bad)])
    out = language_id.known(df, language_id.train(documents))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == list(range(len(good)))


def test_repeated_rows_are_one_sample(docs):
    rows = [(1, "the cat and the dog", "en")] * 3000 + [(2, "der Hund", "de")] * 3 + [(None, "und die Katze", "de")] * 3
    df = docs(rows)
    model = language_id.train(df, docs=5)
    assert set(model.languages) <= {"en", "de"} and language_id.identify(df).count() == len(rows)


def test_fit_raises_likelihood():
    lattice = language_id.lattice(language_id.public_tokenizers.path(language_id.VOCABULARY))
    counts = {"a": {"▁the": 5, "▁then": 2, "▁other": 1}}
    fits = [lattice.fit(counts, rounds=k) for k in (1, 2, 4, 8)]
    score = [sum(n * s for n, s in zip(counts["a"].values(), lattice.scores(list(counts["a"]), p)[:, 0], strict=True)) for p in fits]
    assert score == sorted(score) and np.allclose(fits[-1].sum(0), 1)


def test_held_out_accuracy(documents):
    rows = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(docs):
    rows = [(k, "the cat and the dog", "en") for k in range(20)] + [(100 + k, "der Hund und die Katze", "de") for k in range(20)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 %", "en"), (203, "der und die", None), (204, "x" * 100_000, None), (None, "the and", "en")]
    out = got(language_id.identify(docs(rows)), "doc_id", "lang_pred", "score")
    assert out[200] == out[201] == out[202] == ("und", 0.0)
    assert out[203][0] == "de" and out[None][0] == "en" and out[204][0] in ("de", "en")
    assert language_id.identify(docs([])).count() == 0
    assert got(language_id.identify(docs([(1, "abc", None)])), "doc_id", "lang_pred") == {1: ("und",)}


def test_languages_of_long_texts(docs):
    """Languages are learnt from long texts as from short ones, and of one long text units from all of it are taken."""
    long = "der Hund und die Katze " * 1000
    rows = [(k, "the cat and the dog", "en") for k in range(20)] + [(100 + k, long, "de") for k in range(20)] + [(200, "die Katze und der Hund", None), (201, "the dog", None)]
    assert language_id.train(docs(rows)).languages == ["de", "en"]
    out = got(language_id.identify(docs(rows)), "doc_id", "lang_pred")
    assert all(out[k] == ("en" if k < 100 or k == 201 else "de",) for k in out)
    only = [(k, long, "de") for k in range(20)]
    assert set(got(language_id.identify(docs(only)), "doc_id", "lang_pred").values()) == {("de",)}
    text = " ".join(f"w{k}" for k in range(50_000))
    lattice = language_id.lattice(language_id.public_tokenizers.path(language_id.VOCABULARY))
    units = language_id.sampled(text, -5, lattice)
    at = [int(u[2:]) for u in units]
    assert units == language_id.sampled(text, -5, lattice) and at == sorted(set(at))
    assert 0.9 < sum(map(len, units)) / language_id.SAMPLE_CHARS < 1.1
    assert min(np.histogram(at, 10, (0, 50_000))[0]) > 200
    assert sum(map(len, language_id.sampled("中" * 1_000_000, 1, lattice))) < 1.5 * language_id.SAMPLE_CHARS


def test_languages_of_mostly_empty_rows(docs):
    rows = [(k, "der Hund" if k % 500 == 0 else "", "de") for k in range(5000)] + [(9000 + k, "the cat", "en") for k in range(20)]
    assert language_id.train(docs(rows)).languages == ["de", "en"]


def test_no_labels_keep_all_with_a_letter(docs):
    df = docs([(1, "abc", None), (2, None, None), (3, "12 %", None), (4, "and more", None)])
    model = language_id.train(df)
    assert model.languages == [] and sorted(r.doc_id for r in language_id.known(df, model).collect()) == [1, 4]


def brute_spans(text):
    """The contract's three patterns as they stand."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", m.start(), m.end())] if len(m[2]) >= 8 else []
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans(docs):
    random.seed(8)
    parts = ["token", "ToKen", "api_key", "APIKEY", "secret", " ", "  ", ":", "=", "'", '"', "abc12345", "AKIA", "ABCDEF123456", "0f" * 16, "é😀", "\n", "x", "passwd", "ſecret", "toKen"]
    texts = ["".join(random.choice(parts) for _ in range(25)) for _ in range(400)] + [None, "", "0a" * 50_000]
    out = secret_crf.find_secrets(docs(list(enumerate(texts)))).collect()
    assert len(out) == len(texts)
    for r in out:
        base = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == secret_crf.sha256_of(base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        told = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in told if k != "crf"] == base
        assert all(int(b) <= s or e <= int(a) for k, a, b in told if k == "crf" for _, s, e in base)
    assert secret_crf.find_secrets(docs([])).count() == 0


@pytest.fixture(scope="module")
def crf(documents):
    return secret_crf.train(documents)


def test_pruned_tags_are_viterbis(crf, documents):
    """Tagging only unsure runs gives the best path over whole texts."""
    texts = [r.text.split() for r in documents.select("text").limit(60).collect()] + [["key", "=", "9f8a7b6c5d4e3f2a1b0c9d8e"], ["token"], [], ["secret:", "Zx81kq0PPqa7Lm"]]
    for words, runs in zip(texts, crf.tag(texts), strict=True):
        n = len(words)
        if not n:
            assert runs == []
            continue
        k = np.array([crf.known[w] for w in words])
        share = float(crf.odd[k].mean())
        e = crf.table[k, 0] + crf.text[secret_crf.file_features(np.array([share]), np.array([n]))[0]]
        e[1:] += crf.table[k[:-1], 1]
        e[:-1] += crf.table[k[1:], 2]
        tags, found, start = crf._viterbi(e, True, True), [], None
        for j, t in enumerate([*tags, secret_crf.O]):
            if start is not None and t != secret_crf.I:
                found.append((start, j - 1))
                start = None
            if t == secret_crf.B or t == secret_crf.I and start is None:
                start = j
        assert runs == found


def test_the_crf_finds_what_it_learnt(crf, documents):
    texts = [r.text for r in documents.where("text rlike 'password=|token = |AKIA'").collect()]
    hit = total = 0
    for text, runs in zip(texts, crf.tag([t.split() for t in texts]), strict=True):
        places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        for _, s, e in secret_crf.base_spans(text):
            total += 1
            hit += any(places[a][0] < e and s < places[z][1] for a, z in runs)
    assert total > 10 and hit / total > 0.9


def test_the_crf_finds_secrets_that_the_patterns_miss(crf, documents):
    """Held-out texts with secrets under names that the patterns don't know: most are found, and hardly anything else is tagged."""
    rng = random.Random(5)
    forms = ["pwd: \"{}\"", "auth={}", "bearer {}", "private_key = {}", "login: {}", "access_key '{}'"]
    texts = [r.text.split() for r in documents.where("doc_id >= 400").orderBy("doc_id").limit(300).collect()]
    planted, hit = [], 0
    for words in texts:
        value = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=25)) + "7"
        at = rng.randrange(len(words) + 1)
        planted.append((" ".join(words[:at]) + " " + rng.choice(forms).format(value) + " " + " ".join(words[at:])).split())
        assert not secret_crf.base_spans(rng.choice(forms).format(value))
        hit += any(value in " ".join(planted[-1][a : z + 1]) for a, z in crf.tag([planted[-1]])[0])
    alarms = 0
    for words, runs in zip(texts, crf.tag(texts), strict=True):
        alarms += sum(not secret_crf.base_spans(" ".join(words[max(0, a - 2) : z + 1])) for a, z in runs)
    assert hit / len(texts) > 0.85 and alarms <= 0.02 * len(texts)


def test_found_secrets_are_spans(docs):
    rng = random.Random(3)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(300)]
    rows = [(k, f"some words stand here and then token = \"{h}\" and more of them follow") for k, h in enumerate(hexes)]
    text = "some words stand here and then pwd: \"Zk3v9QxT7bLm2RsW8yPd\" and more of them follow"
    rows += [(1000, text), (1000, text), (None, text), (1001, "word " * 40_000 + text), (1002, None)]
    out = [(r.doc_id, r.spans, r.n_assign) for r in secret_crf.find_secrets(docs(rows)).collect() if r.doc_id is None or r.doc_id >= 1000]
    start = text.index("Zk3v")
    want = f"crf:{start}:{start + 20}"
    assert sorted(out, key=str) == sorted([(1000, want, 0), (1000, want, 0), (None, want, 0), (1001, f"crf:{start + 200_000}:{start + 200_020}", 0), (1002, "", 0)], key=str)


def test_windows_are_bounded():
    text = " ".join(f'token = "{k:040x}" and some words' for k in range(10_000))
    found = secret_crf.windows(text, 3)
    assert len(found) <= (1 + secret_crf.DISGUISES) * secret_crf.SAMPLE_WINDOWS and found == secret_crf.windows(text, 3)
