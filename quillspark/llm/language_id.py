"""Language identification by unigram pieces of a fixed public vocabulary, summed over all segmentations of each word."""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, pretokens
from .bpe_automaton import Table

VOCABULARY = "piece_bpe_32k.model"
#: Labelled rows that each language's model is fitted on, about, and what each gives in characters, about: the bound of the training sample.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 20_000
#: Rounds of expectation maximisation; what each piece's expected count gets added.
ROUNDS, SMOOTHING = 4, 0.02
#: Units of so many characters at most are taken whole; along longer ones probabilities are rescaled, so that they stay in range.
UNIT_CHARS = 32
#: Words that a process remembers; then it starts anew.
CACHE = 300_000
#: Bytes of texts that are looked up together, about.
TOGETHER = 1_500_000
UNDETERMINED = "und"
#: A text has no known language when its evidence is below this: each character is so much likelier (as a log) where all pieces are equally likely.
LEAST_EVIDENCE = -0.5
LETTER = regex.compile(r"\p{L}")


class Lattice:
    """All segmentations of words into the vocabulary's pieces. A character that is no piece stands for itself as the unknown piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = sp.get_piece_size()
        self.unknown, self.longest = sp.unk_id(), 1
        nodes: dict[int, int] = {}
        piece_at = [-1]
        for i in range(self.n):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            node = 0
            self.longest = max(self.longest, len(sp.id_to_piece(i)))
            for c in map(ord, sp.id_to_piece(i)):
                nxt = nodes.get(node << 21 | c)
                if nxt is None:
                    nxt = nodes[node << 21 | c] = len(piece_at)
                    piece_at.append(-1)
                node = nxt
            piece_at[node] = i
        self.trie = Table(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.piece_at = np.array(piece_at, np.int64)

    def units(self, words: list[str]) -> list[list[str]]:
        """Each word as units that its probability is a product of: words of up to UNIT_CHARS whole, longer ones cut at all places that no piece spans."""
        out = [["▁" + w] for w in words]
        far = [k for k, w in enumerate(words) if len(w) >= UNIT_CHARS]
        if far:
            base, size, order, groups = self.edges([out[k][0] for k in far])
            reach = np.zeros(int((size + 1).sum()), np.int64)
            for _, _, start, end, _ in groups:
                reach[start] = np.maximum(reach[start], end)
            reach = np.maximum.accumulate(reach)
            for k, at, n in zip(far, base.tolist(), size.tolist(), strict=True):
                # A place is free when nothing before it reaches beyond it.
                cuts = [0, *(np.flatnonzero(reach[at : at + n - 1] <= np.arange(at + 1, at + n)) + 1).tolist(), n]
                word = out[k][0]
                out[k] = [word[x:y] for x, y in zip(cuts, cuts[1:])]
        return out

    def edges(self, units: list[str]):
        """(where each unit's states begin, its length, units from long to short, groups): a group has (i, rows, from, to, piece) of edges from
        the units' state i with different targets, in order of i; rows are places in the order from long to short."""
        size = np.array([len(u) for u in units], np.int64)
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.cumsum(size) - size
        base = at + np.arange(len(units))
        order = np.argsort(-size, kind="stable")
        by_size = -size[order]

        def groups():
            for i in range(int(size.max(initial=0))):
                row = np.arange(np.searchsorted(by_size, -i))
                node, step = np.zeros(len(row), np.int64), 0
                while len(row):
                    on = order[row]
                    node = self.trie.get(node << 21 | flat[at[on] + i + step])
                    step += 1
                    piece = np.where(node >= 0, self.piece_at[node], -1)
                    if step == 1:
                        piece = np.where(piece < 0, self.unknown, piece)
                    hit = np.flatnonzero(piece >= 0)
                    if len(hit):
                        start = base[on[hit]] + i
                        yield i, row[hit], start, start + step, piece[hit]
                    more = (node >= 0) & (size[on] > i + step)
                    row, node = row[more], node[more]

        return base, size, order, groups()

    def _rescaled(self, alpha: np.ndarray, base: np.ndarray, size: np.ndarray, order: np.ndarray, i: int) -> np.ndarray:
        """Logs of alpha at state i of the units that go beyond it (a run of order); what may have been written around it is divided by these values."""
        on = order[: np.searchsorted(-size[order], -i)]
        c = alpha[base[on] + i].copy()
        for d in range(self.longest + 1):
            ok = i + d <= size[on]
            alpha[(base[on] + i + d)[ok]] /= c[ok]
        return np.log(c)

    def scores(self, units: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each unit under each column of p (pieces by languages): the forward algorithm over all segmentations, rescaled along long units."""
        base, size, order, groups = self.edges(units)
        alpha = np.zeros((int(size.sum()) + len(units), p.shape[1]))
        alpha[base] = 1
        log, block = np.zeros((len(units), p.shape[1])), 0
        for i, _, start, end, piece in groups:
            if i // UNIT_CHARS > block:
                block = i // UNIT_CHARS
                own = self._rescaled(alpha, base, size, order, i)
                log[order[: len(own)]] += own
            alpha[end] += alpha[start] * p[piece]
        return log + np.log(alpha[base + size])

    def fit(self, counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities by languages (in the order of counts) from their units' counts, by expectation maximisation over all segmentations.

        Both passes are rescaled along long units: forward[m] holds the logs of what was taken out before block m, back those after.
        """
        units = sorted({u for c in counts.values() for u in c})
        place = {u: k for k, u in enumerate(units)}
        weight = np.zeros((len(units), len(counts)))
        for k, c in enumerate(counts.values()):
            weight[[place[u] for u in c], k] = list(c.values())
        p = np.full((self.n, len(counts)), 1.0 / self.n)
        base, size, order, groups = self.edges(units)
        groups = [(i, *(x.astype(np.int32) for x in own)) for i, *own in groups]
        for _ in range(rounds):
            alpha, beta = np.zeros((int(size.sum()) + len(units), p.shape[1])), np.zeros((int(size.sum()) + len(units), p.shape[1]))
            alpha[base], beta[base + size] = 1, 1
            forward = [np.zeros((len(units), p.shape[1]))]
            for i, _, start, end, piece in groups:
                if i // UNIT_CHARS >= len(forward):
                    own = self._rescaled(alpha, base, size, order, i)
                    forward.append(forward[-1][: len(own)] + own)
                alpha[end] += alpha[start] * p[piece]
            whole = np.log(alpha[base + size])[order]
            for m, own in enumerate(forward):  # the last block's logs are a unit's own
                ended = slice(len(forward[m + 1]) if m + 1 < len(forward) else 0, len(own))
                whole[ended] += own[ended]
            expected, back, block = np.zeros_like(p), np.zeros((len(units), p.shape[1])), len(forward) - 1
            of = lambda m: weight[order[: len(forward[m])]] * np.exp(forward[m] + back[: len(forward[m])] - whole[: len(forward[m])])  # noqa: B023, E731
            share = of(block)
            for i, rows, start, end, piece in reversed(groups):
                if i // UNIT_CHARS < block:
                    own = self._rescaled(beta, base, size, order, block * UNIT_CHARS)
                    back[: len(own)] += own
                    block -= 1
                    share = of(block)
                arc = p[piece] * beta[end]
                np.add.at(expected, piece, alpha[start] * arc * share[rows])
                beta[start] += arc
            p = (expected + SMOOTHING) / (expected + SMOOTHING).sum(0)
        return p


def sampled(text: str, seed: int, lattice: Lattice) -> list[str]:
    """The units of a text's words; of one with more than SAMPLE_CHARS in them, units picked at random all over it, about so many characters."""
    units = [u for own in lattice.units(text.split()) for u in own]
    size = sum(map(len, units))
    if size <= SAMPLE_CHARS:
        return units
    pick = np.random.Generator(np.random.PCG64(seed % 2**64)).random(len(units)) < SAMPLE_CHARS / size
    return [units[k] for k in np.flatnonzero(pick)]


@functools.lru_cache(1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


class Model:
    """Languages, their priors and piece probabilities. predict() is what an executor's process does, with a memory of words.

    A last column stands for no language: all pieces are equally likely there.
    """

    def __init__(self, languages: list[str], prior: np.ndarray, p: np.ndarray, path: str):
        self.languages, self.prior, self.path = languages, np.log(prior), path
        self.p = np.concatenate([p, np.full((len(p), 1), 1 / max(1, len(p)))], axis=1).astype(np.float64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """(language, its posterior, evidence) of each text; evidence is how much likelier the text is in that language than in none, as a log for each character."""
        at = [k for k, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        found, score, evidence = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not at:
            return found, score, evidence
        # A batch's distinct words are looked up once; '' stands beside outer white space and says nothing.
        pieces = pc.utf8_split_whitespace(pa.array([texts[k] for k in at], pa.large_string()))
        words = pieces.flatten().dictionary_encode()
        which = self._rows(words.dictionary.to_pylist())[words.indices.to_numpy()]
        begin = pieces.offsets.to_numpy()[:-1]
        *of, none = (np.add.reduceat(column[which], begin) for column in self.table.T)
        total = np.stack(of, axis=1) + self.prior
        best = total.argmax(1)
        top = total[np.arange(len(at)), best]
        posterior = 1 / np.exp(total - top[:, None]).sum(1)
        for j, k in enumerate(at):
            found[k], score[k], evidence[k] = self.languages[best[j]], float(posterior[j]), float(of[best[j]][j] - none[j]) / len(texts[k])
        return found, score, evidence

    def _rows(self, words: list[str]) -> np.ndarray:
        """The words' rows in the table of log probabilities; new ones are scored."""
        if not hasattr(self, "known") or len(self.known) > CACHE:
            self.known, self.table = {"": 0}, np.zeros((1, len(self.languages) + 1))
        new = [w for w in words if w not in self.known]
        if new:
            units = lattice(self.path).units(new)
            own = lattice(self.path).scores([u for x in units for u in x], self.p)
            begin = np.cumsum([0] + [len(x) for x in units[:-1]])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.add.reduceat(own, begin)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id's digits leaves 2 when divided by 4 (a null id counts as '')."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, path: str | None = None) -> Model:
    """A model of the languages of rows that aren't held out and have a letter: about docs of each, picked by a hash of id and text, whatever their length.

    Repeated rows are one. The driver gets counts of the sample's units and the languages' names, which are taken to be few.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    common.prepare(df.sparkSession)
    rows = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.xxhash64(id_col, text_col, F.lit(17)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0), np.zeros((0, 0)), path)
    # Two languages of the same size have the same share, so the condition has one branch for each share.
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("l") == lang, F.lit(min(1.0, docs / n))).otherwise(share)

    def run(batches):
        for b in batches:
            found = Counter((lang, u) for h, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True) for u in sampled(t, h, lattice(path)))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["l", "u", "n"])

    counts: dict[str, Counter] = {k: Counter() for k in sorted(sizes)}
    picked = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["h"])
    for r in picked.mapInArrow(run, "l string, u string, n long").toLocalIterator():
        counts[r["l"]][r["u"]] += r["n"]
    counts = {k: c for k, c in counts.items() if c}
    if not counts:
        return Model([], np.zeros(0), np.zeros((0, 0)), path)
    prior = np.array([sizes[k] for k in counts], float)
    return Model(list(counts), prior / prior.sum(), lattice(path).fit(counts), path)


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with lang_pred, score (the posterior of the language) and evidence (its log likelihood over none's, for each character).

    Text that is null or has no letter is 'und', with score and evidence 0. Words of any length are whole. No shuffle.
    """
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is pieces times languages

    def run(batches):
        own = shared.value  # one object for each process: its memory of words lasts
        for b in pretokens.together(batches, text_col, TOGETHER):
            lang, score, evidence = own.predict(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(evidence, pa.float64())], [*keep, "lang_pred", "score", "evidence"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double", "evidence double"]))


def known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df's rows whose text has LEAST_EVIDENCE of a learned language, all columns as they are. Null texts and those without a letter go, whether the model has languages or none. No shuffle."""
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        own = shared.value
        for b in pretokens.together(batches, at, TOGETHER):
            texts = b.column(at).to_pylist()
            if own.languages:
                found, _, evidence = own.predict(texts)
                keep = [x != UNDETERMINED and e >= LEAST_EVIDENCE for x, e in zip(found, evidence, strict=True)]
            else:
                keep = [bool(t and LETTER.search(t)) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of df: id_col, held_out, lang_pred, score, evidence. Repeated rows and null ids are rows like any others. An empty table gives none; without labelled rows all are 'und'."""
    model = train(df, id_col, text_col, lang_col)
    return predict(df, model, text_col, (id_col,)).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "evidence")
