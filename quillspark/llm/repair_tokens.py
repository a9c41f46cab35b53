"""Token ids in binary shards, compressed by Re-Pair grammars, with random access.

A shard file: 8 bytes MAGIC, seven little-endian uint64 (documents, ids, symbols, rules, first symbol for a rule, bits of a symbol, bytes of
an expansion length), then arrays: document ids int64, 1 for a null id uint8, ids of each document uint32, symbols of each document
uint32, rules' left and right symbols, rules' expansion lengths, the documents' symbols. Symbols are stored as their low 16 bits, uint16, then
a plane for each further bit, eight symbols a byte. A document's symbols are its own, so it is decoded alone.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, pretokens

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"QSREPAI2"
END_ID = 2
#: Ids of a shard, about; it ends with a document.
SHARD_IDS = 2_000_000
#: A pair becomes a rule when it occurs so often without overlap: at four the symbols saved take more bits than the rule.
LEAST_PAIRS = 4
#: Places are closed up while more than one in so many may change, and after so many rounds.
SPARSE, OPEN = 16, 4
_NONE, _END, _DEAD = np.int32((1 << 31) - 1), np.uint32(1 << 31), np.uint32((1 << 32) - 1)
_HEAD = struct.Struct("<7Q")
#: Letters of Europe, and marks that often end a word: a run of either is one pre-token.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ʯ", ".,;:!?"


def _next(s: np.ndarray, p: np.ndarray, step: int, closed: bool) -> np.ndarray:
    """The nearest places after (step 1) or before (-1) p that aren't dead. closed: none is dead."""
    q = p + step
    while not closed and (dead := s.take(q) == _DEAD).any():
        q = np.where(dead, q + step, q)
    return q


def _chosen(rank: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, closed: bool) -> np.ndarray:
    """Which pairs at these places are replaced: of overlapping ones the better rank goes first, until none is left. Overlapping pairs have different ranks."""
    if closed:
        taken = (rank[1:-1] < np.minimum(rank[:-2], rank[2:])).take(at - 1)
    else:
        taken = rank.take(at) < np.minimum(rank.take(before), rank.take(after))
    go, left = taken, np.arange(len(at))
    while len(left):
        rank[before[left[go]]] = rank[after[left[go]]] = _NONE
        left = left[~go]
        left = left[rank.take(at[left]) != _NONE]
        go = rank.take(at[left]) < np.minimum(rank.take(before[left]), rank.take(after[left]))
        taken[left[go]] = True
    return taken


def compress(symbols: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): frequent pairs replaced by new symbols from first on, until no pair occurs least times; ends marks documents' last symbols.

    A round counts all pairs exactly, by sorting (pair, place), and replaces all with least occurrences at once, the more
    frequent where they overlap, runs of one symbol from the left. A pair that keeps fewer waits for the next round, which counts anew. After the
    first round only pairs with a new symbol, and those that wait, can be frequent, so only their places are sorted. While these are
    many the places of replaced second symbols are closed up after a round; later they stay as dead ones for some rounds.
    """
    s = np.concatenate([[_END], symbols.astype(np.uint32) | np.where(ends, _END, np.uint32(0)), [_END]]).astype(np.uint32)
    rank = np.full(len(s), _NONE, np.int32)
    p, left, right, rules, since = np.flatnonzero(~ends) + 1, [], [], 0, 0
    while len(p):
        bits, wide = np.uint64(len(s).bit_length()), np.uint64((first + rules).bit_length())
        z, second = s.take(p).astype(np.uint64), s.take(_next(s, p, 1, not since)) & ~_END
        if 2 * int(wide) + int(bits) <= 64:
            z = z << wide | second
        else:
            z = np.unique(z << np.uint64(32) | second, return_inverse=True)[1].astype(np.uint64)
        z = z << bits | p.astype(np.uint64)
        z.sort()
        key = z >> bits
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        count = np.diff(edge)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]
        count = count[often]
        place = (pretokens.gathered(z, edge[often], count) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        some = place[np.cumsum(count) - 1]
        a, b = s[some], s[_next(s, some, 1, not since)] & ~_END
        group = np.repeat(np.arange(len(often), dtype=np.int32), count)
        rank[place] = group
        # Runs of one symbol: every other place, from the run's start.
        if (a == b).any():
            twin = np.sort(place[(a == b)[group]])
            k = np.arange(len(twin))
            begin = np.concatenate([[True], _next(s, twin[:-1], 1, not since) != twin[1:]])
            rank[twin[(k - np.maximum.accumulate(np.where(begin, k, 0))) % 2 == 1]] = _NONE
        at = np.flatnonzero(rank != _NONE) if len(place) * SPARSE > len(s) else np.sort(place[rank.take(place) != _NONE])
        of, before, after = rank.take(at), _next(s, at, -1, not since), _next(s, at, 1, not since)
        taken = _chosen(rank, at, before, after, not since)
        good = np.bincount(of[taken], minlength=len(often)) >= least
        waits = at[:0]
        if not good.all():
            # The most frequent pair meets no better one: if it is too rare without overlap, it is for good.
            wait = ~good
            wait[0] = False
            waits, stays = at[wait[of]], good[of]
            # Where such a pair stood in another's way, that one may go still.
            taken &= stays
            rank[at] = _NONE
            rank[at[taken]] = -1
            rest = np.flatnonzero(stays & ~taken & (rank.take(before) != -1) & (rank.take(after) != -1))
            rank[at[taken]] = _NONE
            rank[at[rest]] = of[rest]
            taken[rest] = _chosen(rank, at[rest], before[rest], after[rest], False)
        rank[at] = _NONE
        used = np.flatnonzero(good)
        number = np.zeros(len(often), np.uint32)
        number[used] = first + rules + np.arange(len(used))
        go, gone = at[taken], after[taken]
        s[go] = number[of[taken]] | s.take(gone) & _END
        s[gone] = _DEAD
        left.append(a[used])
        right.append(b[used])
        rules += len(used)
        p = np.concatenate([go, _next(s, go, -1, False), waits])
        p = p[s.take(p) < _END]
        since += 1
        if len(p) * SPARSE > len(s) or since == OPEN:
            active = np.zeros(len(s), bool)
            active[p] = True
            keep = np.flatnonzero(s != _DEAD)
            s, p = s.take(keep), np.flatnonzero(active.take(keep))
            rank, since = np.full(len(s), _NONE, np.int32), 0
        else:
            p = np.unique(p)
    return s[1:-1][s[1:-1] != _DEAD] & ~_END, *(np.concatenate(x).astype(np.uint32) if x else np.zeros(0, np.uint32) for x in (left, right))


def levels(left: np.ndarray, right: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that refer to earlier runs and to ids only."""
    highest = np.maximum.accumulate(np.maximum(left, right).astype(np.int64) - first) if len(left) else left
    start = 0
    while start < len(left):
        end = int(np.searchsorted(highest, start, side="left"))
        yield start, end
        start = end


def lengths(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.zeros(len(left), np.int64)
    size = lambda x: np.where(x >= first, out[np.maximum(x.astype(np.int64) - first, 0)], 1)
    for a, z in levels(left, right, first):
        out[a:z] = size(left[a:z]) + size(right[a:z])
    return out


def _packed(x: np.ndarray, bits: int) -> bytes:
    planes = [np.packbits((x >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(16, bits)]
    return b"".join([(x & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes])


def _packed_bytes(n: int, bits: int) -> int:
    return 2 * n + max(0, bits - 16) * ((n + 7) // 8)


def write_shard(docs: list, ids: list[np.ndarray], first: int) -> bytes:
    """A shard of documents' ids (none of them empty)."""
    flat = np.concatenate(ids)
    if int(flat.max()) >= first:
        raise ValueError(f"an id of {first} or more")
    n = np.array([len(x) for x in ids], np.uint32)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(n, dtype=np.int64) - 1] = True
    symbols, left, right = compress(flat, ends, first)
    size = lengths(left, right, first)
    each = np.ones(len(symbols), np.int64)
    big = symbols >= first
    each[big] = size[symbols[big] - first]
    at = np.searchsorted(np.cumsum(each), np.cumsum(n, dtype=np.int64)) + 1
    bits = (first + len(left)).bit_length()
    wide = next(k for k in (1, 2, 4, 8) if int(size.max(initial=0)) < 1 << 8 * k)
    head = MAGIC + _HEAD.pack(len(n), len(flat), len(symbols), len(left), first, bits, wide)
    nulls = np.array([d is None for d in docs], np.uint8)
    arrays = [np.array([d or 0 for d in docs], "<i8"), nulls, n.astype("<u4"), np.diff(at, prepend=0).astype("<u4")]
    return head + b"".join([*(x.tobytes() for x in arrays), _packed(left, bits), _packed(right, bits), size.astype(f"<u{wide}").tobytes(), _packed(symbols, bits)])


class Shard:
    """A shard of which read(offset, bytes) gives parts. Its documents' table and rules are read at once, symbols as they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a shard")
        docs, self.n_ids, n_symbols, rules, self.first, self.bits, wide = _HEAD.unpack(read(8, _HEAD.size))
        self._at = 8 + _HEAD.size
        self.docs, self.nulls, self.counts, own = (self._array(kind, docs) for kind in ("<i8", "u1", "<u4", "<u4"))
        self.left, self.right = self._symbols(rules), self._symbols(rules)
        self.size = self._array(f"<u{wide}", rules).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        self._base, self._n = self._at, n_symbols
        if self._base + _packed_bytes(n_symbols, self.bits) != size or self.at[-1] != n_symbols:
            raise ValueError("a shard of the wrong length")

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _array(self, kind: str, n: int) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        out = np.frombuffer(self._read(self._at, size), kind, n)
        self._at += size
        return out

    def _symbols(self, n: int) -> np.ndarray:
        out = self._range(self._at, n, 0, n)
        self._at += _packed_bytes(n, self.bits)
        return out

    def _range(self, base: int, n: int, a: int, z: int) -> np.ndarray:
        """Symbols a to z of the n that are stored at base."""
        out = np.frombuffer(self._read(base + 2 * a, 2 * (z - a)), "<u2").astype(np.uint32)
        lead, span = a // 8, (z + 7) // 8 - a // 8
        for k in range(16, self.bits):
            plane = np.frombuffer(self._read(base + 2 * n + (k - 16) * ((n + 7) // 8) + lead, span), np.uint8)
            out |= np.unpackbits(plane)[a - 8 * lead : z - 8 * lead].astype(np.uint32) << np.uint32(k)
        return out

    def symbols(self, a: int, z: int) -> np.ndarray:
        return self._range(self._base, self._n, a, z)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.first
        out[big] = self.size[symbols[big] - self.first]
        return out

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document k, from the symbols that hold them: expansion lengths say which, and each is expanded on its own."""
        out = self.symbols(int(self.at[k]), int(self.at[k + 1]))
        stop = int(self.counts[k]) if stop is None else min(stop, int(self.counts[k]))
        while True:
            ends = np.cumsum(self._sizes(out))
            a, z = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
            skipped = int(ends[a - 1]) if a else 0
            out, start, stop = out[a:z], start - skipped, stop - skipped
            big = out >= self.first
            if not big.any():
                return out[start:stop]
            pair = np.stack([np.where(big, self.left[np.where(big, out - self.first, 0)], out), self.right[np.where(big, out - self.first, 0)]], axis=1)
            out = pair.ravel()[np.stack([np.ones(len(big), bool), big], axis=1).ravel()]

    @functools.cached_property
    def rules(self) -> tuple[np.ndarray, np.ndarray]:
        """(every rule's ids in a row, where each begins)."""
        ends = np.cumsum(self.size)
        begin = ends - self.size
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for a, z in levels(self.left, self.right, self.first):
            pair = np.stack([self.left[a:z], self.right[a:z]], axis=1).ravel()
            flat[begin[a] : ends[z - 1]] = self._expanded(pair, flat, begin)
        return flat, begin

    def _expanded(self, symbols: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        big = symbols >= self.first
        start = np.arange(len(symbols))
        start[big] = len(symbols) + begin[symbols[big] - self.first]
        return pretokens.gathered(np.concatenate([symbols, flat]), start, self._sizes(symbols))

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) of each document; a block of documents is expanded at a time."""
        step = 1024
        for k in range(0, len(self.docs), step):
            end = min(k + step, len(self.docs))
            some = self._expanded(self.symbols(int(self.at[k]), int(self.at[end])), *self.rules)
            at = 0
            for j in range(k, end):
                yield None if self.nulls[j] else int(self.docs[j]), some[at : at + int(self.counts[j])]
                at += int(self.counts[j])


class _Encoder:
    """Whole texts' ids by the tokenizers library, which encodes each distinct chunk that a process hasn't met lately."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.tokenize, self.batch = t.model.tokenize, t.encode_batch_fast
        self.first = t.get_vocab_size(with_added_tokens=True)
        self.letters = dict(enumerate(pretokens.byte_letters()))
        ((number, token),) = t.get_added_tokens_decoder().items()
        (self.line,) = t.encode("\n", add_special_tokens=False).ids
        self.chunks = pretokens.Chunks(self._encode, token.content, number)

    def _word(self, word: str) -> list[int]:
        """Ids of one pre-token, or of a line end and one."""
        if word[0] == "\n":
            return [self.line, *self._ids(word[1:])]
        return self._ids(word)

    def _ids(self, word: str) -> list[int]:
        mapped = word.replace(" ", self.letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(mapped)]

    def _encode(self, texts: list[str]) -> pretokens.Ids:
        """A space or line end, letters and closing marks are pre-tokens that need no pattern: the model encodes each distinct one. The library does all others."""
        every = pa.array(texts, pa.large_string())
        lead, core = pc.utf8_slice_codeunits(every, 0, 1), pc.utf8_slice_codeunits(every, 1)
        word = pc.binary_join_element_wise(lead, pc.utf8_rtrim(core, _MARKS), pretokens.EMPTY)
        plain = pc.match_substring_regex(word, f"^[ \n][{_LETTERS}]+$")
        # A text that isn't plain is a word of its own without marks after it.
        words = pc.if_else(plain, word, every).dictionary_encode()
        marks = pc.if_else(plain, pc.utf8_ltrim(core, pretokens.letters(_LETTERS)), pretokens.EMPTY).dictionary_encode()
        n = len(words.dictionary)
        far = np.zeros(n, bool)
        far[words.indices.to_numpy()[~plain.to_numpy(zero_copy_only=False)]] = True
        listed = words.dictionary.to_pylist()
        whole = iter(self.batch([w for w, f in zip(listed, far.tolist(), strict=True) if f], add_special_tokens=False))
        ids = [next(whole).ids if f else self._word(w) for w, f in zip(listed, far.tolist(), strict=True)]
        ids += [self._ids(m) if m else [] for m in marks.dictionary.to_pylist()]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        which = np.stack([words.indices.to_numpy(), n + marks.indices.to_numpy()], axis=1).ravel().astype(np.int64)
        return pretokens.joined(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count.sum())), count, which, np.full(len(texts), 2))


@functools.lru_cache(1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Shards of df's whole texts under folder, in ascending id (null first; equal ids by crc32, then text); their index, itself written there.

    Each text's ids, then END_ID. Rows are range-sorted by id; each task writes shards of about SHARD_IDS ids under names of its own, and
    the index, committed by Spark, names those of the attempts that count: (part, shard, file, docs, ids, start).
    """
    spark = df.sparkSession
    common.prepare(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    ordered = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The digest deals out equal ids, and keeps texts out of the ranges' samples.
    ordered = ordered.withColumn("crc", F.crc32(F.encode("text", "UTF-8"))).repartitionByRange(common.partitions(spark), "id", "crc").sortWithinPartitions("id", "crc", "text").select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        encoder, end = _encoder(path), np.array([END_ID], np.uint32)
        docs, ids, size, shard, part = [], [], 0, 0, None

        def flush():
            nonlocal docs, ids, size, shard
            name = f"{folder}/shards/{part}-{shard}-{uuid.uuid4().hex}.rpr"
            common.write_file(name, write_shard(docs, ids, encoder.first))
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, shard, name, len(docs), size)], ["part", "shard", "file", "docs", "ids"])
            docs, ids, size, shard = [], [], 0, shard + 1
            return row

        for b in pretokens.together(batches, "text"):
            if b.num_rows:
                part = b.column("part")[0].as_py()
            numbers = iter(b.column("id").to_pylist())
            for flat, at in encoder.chunks.batches(b.column("text").to_pylist()):
                for k in range(len(at) - 1):
                    docs.append(next(numbers))
                    ids.append(np.concatenate([flat[at[k] : at[k + 1]], end]))
                    size += len(ids[-1])
                    if size >= SHARD_IDS:
                        yield flush()
        if docs:
            yield flush()

    index = ordered.mapInArrow(run, "part long, shard long, file string, docs long, ids long")
    index.write.parquet(f"{folder}/parts")
    index = spark.read.schema(index.schema).parquet(f"{folder}/parts")
    # Two levels: the parts are as many as shuffle partitions, a part's shards are its own.
    part = index.groupBy("part").agg(F.sum("ids").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    base = part.select("part", F.coalesce(F.sum("n").over(before(F.lit(0)).orderBy("part")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(before("part").orderBy("shard")), F.lit(0))
    index = index.withColumn("inside", inside).join(base, "part").select("part", "shard", "file", "docs", "ids", (F.col("base") + F.col("inside")).alias("start"))
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def read(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards' files: start counts all ids before it, ids_crc32 is of its ids as uint32."""

    def run(batches):
        for file, start in common.rows(batches, "file", "start"):
            shard, out, at = Shard.of(common.read_file(file)), [], start
            for doc, ids in shard.all():
                out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = index.select("file", "start").repartition(common.partitions(index.sparkSession), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """read(write(df)) in a new shared folder: one row for each row of df. Null and empty texts have END_ID alone; an empty table gives none."""
    return read(write(df, common.work_dir(df.sparkSession, "tokens"), id_col, text_col)).withColumnRenamed("doc_id", id_col)
