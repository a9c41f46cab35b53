"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags words as begin, inside or outside of a secret.

The field learns from the values that the patterns find. Beside the windows as they are it gets disguised ones: the key word is
another word, and the value is drawn anew from another alphabet, so that shape and context have to do what the patterns' words did. What it
tags beyond the patterns are secrets under names, or in forms, that these don't know.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns, their kinds' order and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Some of ASSIGN's words stand in a text if one of these does, in any case.
_ASSIGN_SIGNS = ("passw", "secret", "token", "key")

#: Words whose presence in a word is a feature.
LEXICON = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "akia")
#: Rows that the model is fitted on, about, and windows of a row, at most, picked by hash: the bound of the training sample.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2000, 12
#: Words on each side of a secret, or of another place, that are fitted; steps and strength of the fit.
WINDOW, STEPS, L2 = 12, 90, 1e-3
#: Disguises of a window: names, and alphabets and lengths of values.
NAMES = ("pwd", "pass", "auth", "bearer", "credential", "private_key", "access_key", "session", "signature", "client", "connection", "login")
ALPHABETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
VALUE_CHARS, DISGUISES = (12, 48), 6
O, B, I = range(3)  # noqa: E741
CACHE = 300_000
_EDGE = "\"'`.,;:!?()[]{}<>"
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_NAME = re.compile(r"(password|passwd|secret|token|api_?key)", re.IGNORECASE | re.ASCII)
_SHAPES = [(re.compile(p), c) for p, c in ((r"[A-Z]+", "A"), (r"[a-z]+", "a"), (r"[0-9]+", "9"), (r"[^\x00-\x7f]+", "u"))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the base patterns' matches: leftmost non-overlapping per kind, then too short ones dropped."""
    out = []
    low = text.lower()
    if any(s in low for s in _ASSIGN_SIGNS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if len(text) >= HEX_LEAST and max(map(len, text.split()), default=0) >= HEX_LEAST:
        out += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def features(word: str) -> tuple[str, ...]:
    """A word's features: shape, length, mix of characters, and the lexicon's words in it. Plain words have few, so that most words share theirs."""
    core = word.strip(_EDGE)
    low = core.lower()
    known = tuple(f"in:{k}" for k in LEXICON if k in low) if len(low) > 2 else ()
    edge = (f"end:{word[-1]}",) if word[-1] in ":=" else ()
    quote = ("quoted",) if word[0] in "\"'`" else ()
    if core.isalpha() or not core:
        case = "u" if core.isupper() else "l" if core.islower() else "t" if core.istitle() else "m"
        return (f"plain:{case if core else '-'}", f"long:{min(len(core), 32) // 4}", *known, *edge, *quote)
    shape = core
    for pattern, c in _SHAPES:
        shape = pattern.sub(c, shape)
    run = max(_RUN.findall(core), key=len, default="")
    digits = sum(c.isdigit() for c in run)
    mixed = "".join(c for c, t in (("A", any(c.isupper() for c in run)), ("a", any(c.islower() for c in run)), ("9", digits > 0)) if t)
    return (f"shape:{shape[:8]}", f"run:{min(len(run), 64) // 4}", f"mixed:{mixed}", f"digits:{10 * digits // max(1, len(run))}", f"kinds:{min(len(set(run)), 32) // 4}", "odd", *known, *edge, *quote)


def file_features(odd_share: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A text's features as a number from 0 to 15: its share of words with more than letters, and its length."""
    return np.minimum(3, (odd_share * 10).astype(np.int64)) * 4 + np.minimum(3, np.log10(np.maximum(size, 1)).astype(np.int64))


class Crf:
    """Weights by feature for a word, the word before and the word after; by text; and for transitions, all finite."""

    def __init__(self, names: dict[str, int], word: np.ndarray, before: np.ndarray, after: np.ndarray, text: np.ndarray, moves: np.ndarray):
        self.names, self.word, self.before, self.after, self.text, self.moves = names, word, before, after, text, moves
        # No choice of neighbours' tags can make up for more than this.
        self.most = float(2 * (moves.max() - moves.min()))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("classes", "known", "table", "odd")}

    def _start(self) -> None:
        self.classes, self.known = {}, {}
        self.table, self.odd = np.zeros((0, 3, 3)), np.zeros(0)

    def _learn(self, words: list[str]) -> None:
        rows = []
        for w in words:
            f = features(w)
            k = self.classes.get(f)
            if k is None:
                k = self.classes[f] = len(self.classes)
                at = [self.names[x] for x in f if x in self.names]
                rows.append((np.stack([m[at].sum(0) for m in (self.word, self.before, self.after)]), "odd" in f))
            self.known[w] = k
        if rows:
            self.table = np.concatenate([self.table, np.stack([r for r, _ in rows])])
            self.odd = np.concatenate([self.odd, [float(o) for _, o in rows]])

    def tag(self, texts: list[list[str]]) -> list[list[tuple[int, int]]]:
        """For each list of words, the runs [first, last] that the best tags (Viterbi's) call a secret.

        A word whose score as outside leads by more than transitions can make up is outside in any best path. So only runs of
        the others are decoded, between neighbours outside: the same result as over whole texts.
        """
        if not hasattr(self, "known") or len(self.known) > CACHE:
            self._start()
        need: set[str] = set()
        for t in texts:
            need.update(t)
        self._learn(list(need.difference(self.known)))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        size = np.array([len(t) for t in texts], np.int64)
        some = np.flatnonzero(size)
        if not len(some):
            return out
        k = np.concatenate([np.fromiter(map(self.known.__getitem__, texts[d]), np.int64, size[d]) for d in some])
        begin = np.cumsum(size[some]) - size[some]
        first = np.zeros(len(k), bool)
        first[begin] = True
        share = np.add.reduceat(self.odd[k], begin) / size[some]
        own = self.text[file_features(share, size[some])]
        # Scores against outside: only the two differences count at first.
        diff = (self.table[:, :, 1:] - self.table[:, :, :1]).astype(np.float32)
        e = diff[k, 0] + np.repeat((own[:, 1:] - own[:, :1]).astype(np.float32), size[some], axis=0)
        e[1:] += np.where(first[1:, None], 0, diff[k[:-1], 1])
        e[:-1] += np.where(first[1:, None], 0, diff[k[1:], 2])
        unsure = np.flatnonzero(e.max(1) > -self.most - 1e-3)
        if not len(unsure):
            return out
        cut = np.flatnonzero((np.diff(unsure) > 1) | first[unsure[1:]]) + 1
        doc = np.searchsorted(begin, unsure, side="right") - 1
        for run in np.split(unsure, cut):
            d = int(doc[np.searchsorted(unsure, run[0])])
            tags = self._viterbi(np.concatenate([np.zeros((len(run), 1)), e[run]], axis=1), bool(first[run[0]]), run[-1] + 1 == len(k) or bool(first[run[-1] + 1]))
            at, start = int(run[0] - begin[d]), None
            for j, tag in enumerate([*tags, O]):
                if start is not None and tag != I:
                    out[some[d]].append((at + start, at + j - 1))
                    start = None
                if tag == B or tag == I and start is None:
                    start = j
        return out

    def _viterbi(self, e: np.ndarray, at_start: bool, at_end: bool) -> list[int]:
        best, back = e[0] + (0 if at_start else self.moves[O]), []
        for row in e[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + row
        if not at_end:
            best = best + self.moves[:, O]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def values(text: str) -> list[tuple[int, int]]:
    """Where the base patterns' secrets themselves are: an assignment's value, or the whole match; overlapping ones are one."""
    found = sorted([(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] + [(s, e) for k, s, e in base_spans(text) if k])
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def disguised(words: list[str], tags: list[int], rng: random.Random) -> tuple[list[str], list[int]]:
    """A window with each secret, and the name before it, put in another form: a value drawn anew, under another name or a plain word, or under none."""
    plain = [w for w, t in zip(words, tags, strict=True) if t == O and w.isalpha()] or ["of"]
    out: list[str] = []
    own: list[int] = []
    for w, tag in zip(words, tags, strict=True):
        if tag == O:
            out.append(w)
            own.append(O)
        elif tag == B:
            while out and own[-1] == O and (out[-1].strip(_EDGE) in ("", "=") or _NAME.search(out[-1])):
                out.pop()
                own.pop()
            value = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(*VALUE_CHARS)))
            value = rng.choice(("{}", "{}", '"{}"', "'{}'", "{};", "{},", "{}.")).format(value)
            name = rng.choice(NAMES) if rng.random() < 0.7 else rng.choice(plain)
            form = rng.choice(([name, "=", value], [name + ":", value], [name + "=" + value], [name, value], [name, "is", value], [value]))
            out += form
            own += [B if x.endswith(value) else O for x in form]
    return out[: 2 * WINDOW + 1], own[: 2 * WINDOW + 1]


def windows(text: str, seed: int) -> list[tuple[list[str], list[int], int]]:
    """(words, tags, file feature) around the secrets that the patterns find in a text, as they are and disguised, and around one word and one
    odd word that are none, picked by seed. Tags say which words hold secrets. Of more than SAMPLE_WINDOWS some are picked."""
    places = [(m.start(), m.end()) for m in _words(text)]
    if not places:
        return []
    words, rng = [text[a:b] for a, b in places], random.Random(seed)
    tags, centres = [O] * len(words), []
    starts = [a for a, _ in places]
    for s, e in values(text):
        k = max(0, bisect.bisect_right(starts, s) - 1)
        centres.append(k)
        begun = False
        while k < len(words) and starts[k] < e:
            tags[k], begun = (I if begun else B), True
            k += 1
    odd = ["odd" in features(w) for w in words]
    own = int(file_features(np.array([sum(odd) / len(words)]), np.array([len(words)]))[0])
    other = [k for k, o in enumerate(odd) if o and tags[k] == O]
    centres = rng.sample(centres, min(len(centres), SAMPLE_WINDOWS // 3))
    out = []
    for c in dict.fromkeys([*centres, rng.randrange(len(words)), *rng.sample(other, min(1, len(other)))]):
        near = slice(max(0, c - WINDOW), c + WINDOW + 1)
        out.append((words[near], tags[near], own))
        if tags[c] != O:
            out += [(*disguised(words[near], tags[near], rng), own) for _ in range(DISGUISES)]
    return out


def fit(samples: list[tuple[list[str], list[int], int]]) -> Crf:
    """A CRF by maximum likelihood (gradient steps over all windows at once, with L2), the same for the same samples."""
    length = 2 * WINDOW + 1
    names: dict[str, int] = {}
    classes: dict[tuple, int] = {}
    for words, _, _ in samples:
        for w in words:
            f = features(w)
            classes.setdefault(f, len(classes))
            for x in f:
                names.setdefault(x, len(names))
    if not samples:
        names = {"odd": 0}
    n = len(samples)
    k, tag, mask = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length))
    for r, (words, tags, _) in enumerate(samples):
        k[r, : len(words)] = [classes[features(w)] for w in words]
        tag[r, : len(words)], mask[r, : len(words)] = tags, 1
    own = np.array([s[2] for s in samples], np.int64)
    has = np.zeros((max(1, len(classes)), len(names)))
    for f, c in classes.items():
        has[c, [names[x] for x in f]] = 1
    shapes = [(len(names), 3)] * 3 + [(16, 3), (3, 3)]
    theta = [np.zeros(s) for s in shapes]
    theta[0][:, O] = 0.1
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    eye = np.eye(3)
    pair = mask[:, 1:, None] * mask[:, :-1, None]
    for step in range(1, STEPS + 1 if n else 1):
        tables = [has @ w for w in theta[:3]]
        e = tables[0][k] + theta[3][own][:, None]
        e[:, 1:] += tables[1][k[:, :-1]] * pair
        e[:, :-1] += tables[2][k[:, 1:]] * pair
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + theta[4], axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = np.logaddexp.reduce(theta[4] + (e[:, t + 1] + beta[:, t + 1])[:, None], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        both = np.exp(alpha[:, :-1, :, None] + theta[4] + (e[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None]) * pair[..., None]
        d = (eye[tag] - p) * mask[..., None]
        seen = np.zeros((n, length - 1, 3, 3))
        seen[np.arange(n)[:, None], np.arange(length - 1), tag[:, :-1], tag[:, 1:]] = 1
        grads = []
        for source, g in ((k, d), (k[:, :-1], d[:, 1:] * pair), (k[:, 1:], d[:, :-1] * pair)):
            by = np.stack([np.bincount(source.ravel(), g[..., c].ravel(), len(has)) for c in range(3)], axis=1)
            grads.append(has.T @ by / n)
        grads.append(np.stack([np.bincount(own, d[..., c].sum(1), 16) for c in range(3)], axis=1) / n)
        grads.append((seen * pair[..., None] - both).sum((0, 1)) / n)
        for w, g, m, v in zip(theta, grads, first, second, strict=True):
            g = g - L2 * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(names, *theta)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = SAMPLE_DOCS) -> Crf:
    """A CRF fitted on windows of about docs rows, of any length, picked by a hash of id and text (repeated rows are one). The windows are cut out where the rows are."""
    common.prepare(df.sparkSession)
    rows = df.where(F.length(text_col) > 0).select(F.xxhash64(id_col, text_col, F.lit(29)).alias("pick"), F.col(text_col).alias("text"))
    n = rows.count()
    rows = rows.where(F.pmod("pick", F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, docs / max(n, 1)))).dropDuplicates(["pick"])

    def run(batches):
        for pick, text in common.rows(batches, "pick", "text"):
            found = windows(text, pick)
            yield pa.RecordBatch.from_arrays([pa.array([pick] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), *(pa.array([w[k] for w in found], kind) for k, kind in enumerate((pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32())))], ["pick", "k", "words", "tags", "own"])

    found = rows.mapInArrow(run, "pick long, k int, words array<string>, tags array<int>, own int").collect()
    return fit([(list(r["words"]), list(r["tags"]), r["own"]) for r in sorted(found, key=lambda r: (r["pick"], r["k"]))])


def scan(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, spans array<struct<kind, start, end>> in order of start, then kind; code points, end exclusive.

    The base patterns' spans, and of the CRF's ("crf"; a tagged run of words without the marks at its edges) those that touch none
    of them. Null texts are empty. No shuffle: each task scans its rows in bounded batches.
    """
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(crf)  # its size is features times tags

    def run(batches):
        own = shared.value
        for b in batches:
            texts = common.texts(b, text_col)
            found = []
            for text, tagged in zip(texts, own.tag([t.split() for t in texts]), strict=True):
                spans = base_spans(text)
                if tagged:
                    places = [(m.start(), m.end()) for m in _words(text)]
                    for a, z in tagged:
                        start, end = places[a][0], places[z][1]
                        piece = text[start:end]
                        start += len(piece) - len(piece.lstrip(_EDGE))
                        end -= len(piece) - len(piece.rstrip(_EDGE))
                        if start < end and not any(s < end and start < e for _, s, e in spans):
                            spans.append((len(KINDS), start, end))
                    spans.sort(key=lambda s: (s[1], s[0], s[2]))
                found.append([{"kind": (*KINDS, "crf")[x], "start": s, "end": e} for x, s, e in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(found, kind)], [id_col, "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _words(text: str) -> Iterator[re.Match]:
    """The words of str.split() with their places: \\S and isspace() agree but for code points 28 to 31, which both take as space."""
    return re.finditer(r"\S+", text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """scan()'s rows as counts of the base kinds, a digest of the base spans and all spans in one string."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = told(F.filter("spans", lambda s: s["kind"] != "crf"))
    return found.select(id_col, *map(of, KINDS), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digests(scan(df)) with a CRF trained on df. Null texts are empty, null ids and repeated rows are rows like any others, an empty table gives none; without a sample the CRF adds nothing."""
    return digests(scan(df, train(df, id_col, text_col), id_col, text_col), id_col)


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
