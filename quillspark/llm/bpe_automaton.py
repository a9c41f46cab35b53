"""BPE encoding and decoding by a token automaton that is built merge by merge.

The automaton's states are "after token x" (and the start), its arcs tokens. At first the arcs are the 256 bytes, all
allowed after each other. The gadget of merge r, (a, b) to w, adds w's arcs and removes every arc y after x for which,
at that time, x ends in an exposed a and y begins with an exposed b: merge r would join them. A token's right spine
(itself, its right part, that one's right part, ...) with the merges that hide each entry says when it ends in what; its
left spine says how it begins. So gadgets add one entry to the spines, and an arc's fate is read off two spines. What
remains is deterministic, and accepts of each text exactly one token sequence: that of BPE. An arc once read off is kept
in a table of transitions.

Encoding fills, for all words of a batch at once, the state after each prefix: from a state, a trie of the tokens' bytes
gives the arcs whose labels match the text, and those that the table allows lead on. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common, pretokens

VOCABULARY = "byte_bpe_50k.json"
ALWAYS = np.int64(1) << 40
#: Ids whose names or labels are joined at once.
JOINED = 1 << 24


class Table:
    """From whole numbers to whole numbers of 0 and up, by open addressing; -1 where there is none. Whole arrays are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], probe)
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            at = slot[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            left, probe = np.setdiff1d(left, put, assume_unique=True), probe + 1
        self.probes = probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        probe = 1
        while len(left) and probe < self.probes:
            slot = self._slot(keys[left], probe)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left, probe = left[~hit & (there >= 0)], probe + 1
        return out


class Automaton:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        letters = pretokens.byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * n
        for t, i in vocab.items():
            if t not in self.special:
                self.labels[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        self.size = np.array([len(x) for x in self.labels], np.int64)
        # The gadgets, one after another: only spines are kept, each with the merge that hides the entry.
        right: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        left: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for c in letters:
            right[vocab[c]], left[vocab[c]] = [(vocab[c], ALWAYS)], [(vocab[c], ALWAYS)]
        pair, rank = [], []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            w, a, b = vocab[a + b], vocab[a], vocab[b]
            if not right[a] or not right[b]:
                continue
            pair.append(a << 20 | b)
            rank.append(r)
            if not right[w]:
                right[w] = [(w, ALWAYS), (b, r), *right[b][1:]]
                left[w] = [(w, ALWAYS), (a, r), *left[a][1:]]
        self.merges = Table(np.array(pair, np.int64), np.array(rank, np.int64))
        self.right, self.right_hidden, self.right_depth = self._padded(right)
        self.left, self.left_hidden, self.left_depth = self._padded(left)
        # A token whose own parts are not neighbours at its merge's time has no arc.
        own = np.array([w for w in range(n) if len(right[w]) > 1], np.int64)
        a, b, r = (np.array(x, np.int64) for x in zip(*((left[w][1][0], right[w][1][0], right[w][1][1]) for w in own), strict=True))
        lost = set(own[self._joined(a, b, r)].tolist())
        self._build_trie([(w, self.labels[w]) for w in range(n) if right[w] and w not in lost])
        self.known_key, self.known = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    @staticmethod
    def _padded(spines: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        deep = max(map(len, spines))
        token, hidden = np.zeros((len(spines), deep), np.int32), np.full((len(spines), deep), ALWAYS, np.int64)
        for k, s in enumerate(spines):
            if s:
                token[k, : len(s)], hidden[k, : len(s)] = zip(*s, strict=True)
        return token, hidden, np.array([max(0, len(s) - 1) for s in spines], np.int64)

    def _build_trie(self, tokens: list[tuple[int, bytes]]) -> None:
        nodes: dict[int, int] = {}
        token_at = [-1]
        for i, label in tokens:
            node = 0
            for b in label:
                nxt = nodes.get(node << 8 | b)
                if nxt is None:
                    nxt = nodes[node << 8 | b] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = i
        self.trie = Table(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.token_at = np.array(token_at, np.int64)

    def _joined(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge (before until) joins across the border of x and y, when both are built up from bytes."""
        i, j = self.right_depth[x], self.left_depth[y]
        out = np.zeros(len(x), bool)
        at = np.arange(len(x))
        while len(at):
            u, v = x[at], y[at]
            hide_u, hide_v = self.right_hidden[u, i[at]], self.left_hidden[v, j[at]]
            r = self.merges.get(self.right[u, i[at]].astype(np.int64) << 20 | self.left[v, j[at]])
            # Equal merges are done from the left: x's own goes before this one, this one before y's.
            joined = (r >= 0) & (r < hide_u) & (r <= hide_v)
            if until is not None:
                joined &= r < until[at]
            out[at[joined]] = True
            more = ~joined & (np.minimum(hide_u, hide_v) < ALWAYS)
            first = hide_u <= hide_v
            i[at[more & first]] -= 1
            j[at[more & ~first]] -= 1
            at = at[more]
        return out

    def allowed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The table of transitions: whether arc y leads on from the state after x."""
        key = x << 20 | y
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self.known_key[slot] != key)
        out = self.known[slot]
        if len(miss):
            new = ~self._joined(x[miss], y[miss])
            out[miss] = new
            # Equal slots: key and answer must come from the same row.
            _, one = np.unique(slot[miss], return_index=True)
            self.known_key[slot[miss][one]], self.known[slot[miss][one]] = key[miss][one], new[one]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each word has)."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        at = np.cumsum(size) - size
        state_at = at + np.arange(len(words))
        state = np.full(int(size.sum()) + len(words), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        by_size = -size[order]
        for i in range(int(size.max(initial=0))):
            on = order[: np.searchsorted(by_size, -i)]  # words longer than i
            node, step = np.zeros(len(on), np.int64), 0
            here = state[state_at[on] + i]
            while len(on):
                node = self.trie.get(node << 8 | flat[at[on] + i + step])
                step += 1
                token = self.token_at[node]
                arc = np.flatnonzero((node >= 0) & (token >= 0))
                if len(arc):
                    if i:
                        arc = arc[self.allowed(here[arc], token[arc])]
                    state[state_at[on[arc]] + i + step] = token[arc]
                more = (node >= 0) & (size[on] > i + step)
                on, node, here = on[more], node[more], here[more]
        left, on, found = size.copy(), np.flatnonzero(size), []
        count = np.zeros(len(words), np.int64)
        while len(on):
            token = state[state_at[on] + left[on]]
            found.append((on, token))
            count[on] += 1
            left[on] -= self.size[token]
            on = on[left[on] > 0]
        ids = np.zeros(int(count.sum()), np.int64)
        end = np.cumsum(count)
        for k, (who, token) in enumerate(found):
            ids[end[who] - 1 - k] = token
        return ids, count

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def gadgets(letters: list[bytes], merges: list[tuple[bytes, bytes]]) -> list[dict[bytes, int]]:
    """The automaton written out: for each state its arcs, label to state; state 0 is the start and all states accept. For short lists of merges.

    The gadget of a merge (u, v): where an arc u is followed by an arc v, u leads to a copy of its state without v, and an arc uv leads
    where v led. Each state is copied once; copies have gadgets of their own. All refers to the arcs before the merge.
    """
    states: list[dict[bytes, int]] = [dict.fromkeys(letters, 0)]
    for u, v in merges:
        before: list[dict[bytes, int]] = [dict(x) for x in states]
        copies: dict[int, int] = {}
        for k, arcs in enumerate(before):  # copies are added on the way
            middle = arcs.get(u)
            if middle is not None and v in before[middle]:
                if middle not in copies:
                    copies[middle] = len(states)
                    before.append({label: to for label, to in before[middle].items() if label != v})
                    states.append(dict(before[-1]))
                states[k] |= {u: copies[middle], u + v: before[middle][v]}
    return states


@functools.lru_cache(1)
def automaton(path: str) -> Automaton:
    return Automaton(path)


@functools.lru_cache(1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str


class Coder:
    """Whole texts' ids by one process's automaton, and what their arcs emit."""

    def __init__(self, path: str):
        self.auto, self.library = automaton(path), _library(path)
        self.names = pa.array([str(i).encode() for i in range(len(self.auto.labels))], pa.binary())
        self.labels = pa.array(self.auto.labels, pa.binary())
        ((special, number),) = self.auto.special.items()
        self.chunks = pretokens.Chunks(self._encode, special, number)

    def _words(self, words: list[str]) -> pretokens.Ids:
        ids, count = self.auto.encode_words([w.encode() for w in words])
        return ids.astype(np.uint32), count

    def _encode(self, texts: list[str]) -> pretokens.Ids:
        return pretokens.by_words(texts, self.library, self._words)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(how many ids, SHA-256 of them joined by commas, SHA-256 of the text decoded from them) of each text."""
        for flat, at in self.chunks.batches(texts):
            if len(flat) > JOINED:
                yield from (self._digest(flat[a:z]) for a, z in zip(at, at[1:]))
                continue
            which, own = pa.array(flat), pa.array(at, pa.int32())
            for n, ids, emitted in zip(np.diff(at).tolist(), self._joined(self.names, which, own, b","), self._joined(self.labels, which, own, b""), strict=True):
                yield n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(emitted.decode("utf-8", "replace").encode()).hexdigest()

    @staticmethod
    def _joined(table: pa.Array, which: pa.Array, at: pa.Array, sep: bytes) -> list[bytes]:
        return pc.binary_join(pa.ListArray.from_arrays(at, table.take(which)), sep).to_pylist()

    def _digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        """A long text's, part by part."""
        named, emitted, decoder = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for k in range(0, len(ids), JOINED):
            which = pa.array(ids[k : k + JOINED])
            one = pa.array([0, len(which)], pa.int32())
            named.update((b"," if k else b"") + self._joined(self.names, which, one, b",")[0])
            emitted.update(decoder.decode(self._joined(self.labels, which, one, b"")[0]).encode())
        emitted.update(decoder.decode(b"", True).encode())
        return len(ids), named.hexdigest(), emitted.hexdigest()

    def coded(self, texts: list[str]) -> Iterator[tuple[pa.Array, list[str]]]:
        """(the texts' lists of ids, SHA-256 of the texts decoded from them), for runs of texts."""
        for flat, at in self.chunks.batches(texts):
            which, own = pa.array(flat.astype(np.int32)), pa.array(at, pa.int32())
            if len(flat) > JOINED:
                decoded = [self._digest(flat[a:z])[2] for a, z in zip(at, at[1:])]
            else:
                decoded = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in self._joined(self.labels, which, own, b"")]
            yield pa.ListArray.from_arrays(own, which), decoded

    def ids(self, texts: list[str]) -> Iterator[pa.Array]:
        """Arrays of the texts' lists of ids, for runs of texts."""
        for flat, at in self.chunks.batches(texts):
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))


@functools.lru_cache(1)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) for each row: its whole text's ids, special tokens in the text recognised; null and empty texts have none."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for b in pretokens.together(batches, text_col):
            at = 0
            for ids in coder(path).ids(common.texts(b, text_col)):
                yield pa.RecordBatch.from_arrays([b.column(id_col).slice(at, len(ids)), ids], [id_col, "ids"])
                at += len(ids)

    common.prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, text) for each row of ids: the arcs' labels in a row, read as UTF-8; bytes that aren't UTF-8 become U+FFFD. Null ids give ''."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for b in batches:
            out = pa.array([automaton(path).decode(x or []) for x in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col), out], [id_col, "text"])

    common.prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def coded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids array<int>, decoded_sha256) for each row: its whole text's ids, and the digest of the text decoded from them.

    Null and empty texts have no ids. Repeated rows and null ids are rows like any others, an empty table gives none. No shuffle.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for b in pretokens.together(batches, text_col):
            at = 0
            for ids, decoded in coder(path).coded(common.texts(b, text_col)):
                yield pa.RecordBatch.from_arrays([b.column(id_col).slice(at, len(ids)), pc.cast(pc.list_value_length(ids), pa.int64()), ids, pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids", "decoded_sha256"])
                at += len(ids)

    common.prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, decoded_sha256 string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for each row: ids joined by commas, and the text decoded from them.

    Null and empty texts have no tokens and the digests of ''. Texts of any length are whole; repeated rows and null ids are rows like
    any others, an empty table gives none. No shuffle: each task encodes its own rows in bounded batches.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for b in pretokens.together(batches, text_col):
            n, ids, text = zip(*coder(path).digests(common.texts(b, text_col)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    common.prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
