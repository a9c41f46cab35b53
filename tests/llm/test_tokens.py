"""Token shards and the BPE automaton against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe_automaton, common, pretokens, repair_tokens
from tests.llm.conftest import got

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "the", "tion", "\n", "  ", "\n\n", "-", "=", "aaa", "é", "中", "don't", "'s", "123", "<|endoftext|>", " ", "\x1c", "\x85", "😀", "_", "....", "        ", "AB", "\t", "ß", "İ", "\r\n", "क", "ि"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    out = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    out += ["".join(random.choice("etaoinshr") for _ in range(40)) for _ in range(500)]
    return out + [c * k for c in "a- \n" for k in (1, 2, 3, 5, 8, 63, 64, 65, 200)] + ["", " ", "word " * 20_000]


def listed(arrays):
    return [x for a in arrays for x in a.to_pylist()]


def test_encoders_agree(library, texts):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert listed(bpe_automaton.coder(PATH).ids(texts)) == want
    flat, at = repair_tokens._Encoder(PATH).chunks.ids(texts)
    assert [flat[a:z].tolist() for a, z in zip(at, at[1:])] == want
    for (n, ids, text), w in zip(bpe_automaton.coder(PATH).digests(texts), want, strict=True):
        assert n == len(w) and ids == hashlib.sha256(",".join(map(str, w)).encode()).hexdigest()
        assert text == hashlib.sha256(library.decode(w, skip_special_tokens=False).encode()).hexdigest()


def test_a_full_cache_starts_anew(library, texts):
    c = bpe_automaton.Coder(PATH)
    c.chunks.limit = 5
    some = texts[:200]
    assert [x for k in range(0, 200, 20) for x in listed(c.ids(some[k : k + 20]))] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_decoding_bytes_that_are_no_text(library):
    ids = [library.token_to_id(c) for c in pretokens.byte_letters()]
    some = [ids[200:210], ids[97:100] + [ids[0xC3]], []]
    assert [bpe_automaton.automaton(PATH).decode(x) for x in some] == [library.decode(x, skip_special_tokens=False) for x in some]


def test_round_trip_query(docs, library):
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|> world"), (None, "x"), (3, "again"), (4, "é" * 100_000)]
    df = docs(rows)
    out = bpe_automaton.round_trip(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    back = bpe_automaton.decode(bpe_automaton.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe_automaton.round_trip(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_grammars_expand_to_what_they_compressed(seed):
    random.seed(seed)
    first = (50257, 1 << 17, 10)[seed % 3]
    docs = [np.array([random.choice([7, 8, 9, first - 1]) if seed % 2 else 7 for _ in range(random.randint(0, 400))] + [2], np.uint32) for _ in range(60)]
    shard = repair_tokens.Shard.of(data := repair_tokens.write_shard([None, *range(1, 60)], docs, first))
    assert [(i, x.tolist()) for i, x in shard.all()] == [(i, x.tolist()) for i, x in zip([None, *range(1, 60)], docs, strict=True)]
    for k in (0, 33, 59):
        assert shard.document(k).tolist() == docs[k].tolist()
        for a, z in ((0, 1), (5, 90), (len(docs[k]) - 1, len(docs[k])), (10, 10_000), (3, 3)):
            assert shard.document(k, a, z).tolist() == docs[k][a:z].tolist()
    assert len(shard.left) and len(data) < 4 * sum(map(len, docs))
    assert (shard.size == repair_tokens.lengths(shard.left, shard.right, first)).all()
    with pytest.raises(ValueError):
        repair_tokens.Shard.of(data[:-1])
    with pytest.raises(ValueError):
        repair_tokens.write_shard([1], [np.array([first], np.uint32)], first)


def pairs_left(symbols, ends):
    """How often the most frequent pair of a document's neighbours occurs without overlap."""
    count, previous = {}, {}
    for k in range(len(symbols) - 1):
        pair = symbols[k], symbols[k + 1]
        if not ends[k] and previous.get(pair) != k - 1:
            count[pair], previous[pair] = count.get(pair, 0) + 1, k
    return max(count.values(), default=0)


@pytest.mark.parametrize("seed", range(12))
def test_no_frequent_pair_is_left(seed):
    random.seed(seed)
    least = (2, 4)[seed % 2]
    docs = [[random.choice("abcdefgh"[: 2 + seed % 7]) for _ in range(random.randint(1, 300))] for _ in range(20)]
    flat = np.array([ord(c) - 97 for d in docs for c in d], np.uint32)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, left, right = repair_tokens.compress(flat, ends, 8, least)
    rules = list(zip(left.tolist(), right.tolist(), strict=True))
    grown = lambda x: [x] if x < 8 else [y for s in rules[x - 8] for y in grown(s)]
    assert [y for x in symbols.tolist() for y in grown(x)] == flat.tolist()
    own = np.cumsum([len(grown(x)) for x in symbols.tolist()])
    assert pairs_left(symbols.tolist(), np.isin(own, np.cumsum([len(d) for d in docs]))) < least


def test_shards(docs, library, spark, monkeypatch):
    monkeypatch.setattr(repair_tokens, "SHARD_IDS", 50)
    random.seed(5)
    rows = [(k * 3, " ".join(random.choice(["one", "two", "three"]) for _ in range(random.randint(0, 30)))) for k in random.sample(range(200), 200)] + [(1, None), (2, "")]
    out = got(repair_tokens.round_trip(docs(rows)), "doc_id", "start", "n_tokens", "ids_crc32")
    at = 0
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert out[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert repair_tokens.round_trip(docs([])).count() == 0
    again = repair_tokens.read(repair_tokens.write(docs([(5, "a"), (5, "b"), (None, "c")]), common.work_dir(spark, "t")))
    assert sorted((r.start, r.doc_id or 0) for r in again.collect()) == [(0, 0), (2, 5), (4, 5)]


def test_gadgets_accept_what_merging_gives(tmp_path):
    """The automaton written out, the one on spines and the library agree on short lists of merges."""
    import json

    letters = dict(zip("abc", (pretokens.byte_letters()[ord(c)] for c in "abc"), strict=True))
    assert list(letters.values()) == list("abc")
    full = json.load(open(PATH, encoding="utf-8"))
    random.seed(8)
    for _ in range(40):
        tokens, merges = list("abc"), []
        for _ in range(random.randint(1, 9)):
            a, b = random.choice(tokens), random.choice(tokens)
            if len(a + b) < 9 and a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        rest = [x for x in pretokens.byte_letters() if x not in "abc"]
        spec = full | {"model": full["model"] | {"vocab": {t: k for k, t in enumerate([*rest, *tokens])}, "merges": [list(m) for m in merges]}}
        spec["added_tokens"] = [spec["added_tokens"][0] | {"id": 300}]
        path = tmp_path / "spec.json"
        path.write_text(json.dumps(spec))
        states = bpe_automaton.gadgets([b"a", b"b", b"c"], [(a.encode(), b.encode()) for a, b in merges])
        auto, lib = bpe_automaton.Automaton(str(path)), Tokenizer.from_str(json.dumps(spec)).model
        words = ["".join(random.choice("abc"[: random.randint(1, 3)]) for _ in range(random.randint(1, 12))) for _ in range(40)]
        ids, count = auto.encode_words([w.encode() for w in words])
        at = np.concatenate([[0], np.cumsum(count)])
        for w, a, z in zip(words, at, at[1:]):
            want = [t.id for t in lib.tokenize(w)]
            assert ids[a:z].tolist() == want
            accepted = [(0, b"", ())]
            for _ in range(len(w)):
                accepted = [x for s, done, path_ in accepted for x in ([(s, done, path_)] if len(done) == len(w) else [(to, done + t, (*path_, t)) for t, to in states[s].items() if w.encode().startswith(done + t)])]
            assert [[auto.labels.index(t) for t in path_] for _, done, path_ in accepted if len(done) == len(w)] == [want], (w, merges)
