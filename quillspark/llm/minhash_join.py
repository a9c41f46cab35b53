"""MinHash near-dedup by a multi-index Hamming join, links confirmed on full shingle sets.

1. Each document's set of word shingles gives a signature of HASHES symbols of 16 bits (minima under HASHES hash functions).
   Documents with equal sets are one class; its smallest id stands for it.
2. Two signatures that differ in at most t symbols differ, by the pigeonhole principle, in at most e symbols of some chunk
   (e = t // CHUNKS; in the last chunks only e - 1). So each signature is filed under every chunk with every choice of so many
   symbols left out, and all pairs within the distance meet in a bucket. t is set so that a pair at the similarity
   threshold goes beyond it with a chance under MISS.
3. In a bucket, signatures are compared in blocks. Pairs within t join their classes into candidate clusters; only a spanning
   forest leaves the task.
4. The forest's own pairs are confirmed on full sets first: as many comparisons as candidates. Confirmed pairs join documents to parts.
5. A cluster of one part is done. In others only members of different parts can add a link: blocks of whole texts meet, but for
   pairs of blocks of the largest part, and sets are intersected exactly for all pairs not yet connected. A spanning forest of
   the confirmed links gives the components. No link between two different texts of a cluster is passed over.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 5
HASHES, CHUNKS = 96, 24
WIDTH = HASHES // CHUNKS
#: The chance that a pair exactly at the threshold is further apart than the signature distance.
MISS = 1e-6
#: Signatures, and documents, of a block; a cluster has about BLOCKS blocks before they grow to BLOCK_MOST documents.
BUCKET_BLOCK, BLOCK_LEAST, BLOCK_MOST, BLOCKS = 1024, 128, 1024, 8
#: Shingles of a block, about.
BLOCK_SHINGLES = 1_000_000

_random = np.random.default_rng(20)
_A = _random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, np.uint64)
_P = _random.integers(0, 1 << 63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def distance(percent: int, miss: float = MISS) -> int:
    """The least t with P(more than t of HASHES symbols differ) < miss for a pair of that similarity."""
    p = 1 - percent / 100
    tail = 1.0
    for t in range(HASHES):
        tail -= math.comb(HASHES, t) * p**t * (1 - p) ** (HASHES - t)
        if tail < miss:
            return t
    return HASHES - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The text's set of shingles, sorted 64-bit hashes: A-Z in lower case, words between white space (space, code points 9 to 13)."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if len(w) < words:
        # The whole sequence, told from others by its length.
        return _mixed(np.array([(w * _P[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))]))
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h += w[k : k + n] * _P[k]
    return np.unique(_mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(least, (s[None, k : k + 2048] * _A[:, None] + _B[:, None]).min(1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def masks(t: int) -> list[tuple[int, tuple[int, ...]]]:
    """(chunk, symbols left out) of every key of a signature, for distance t."""
    e, rest = divmod(t, CHUNKS)
    out = []
    for c in range(CHUNKS):
        errors = min(WIDTH, e if c <= rest else e - 1)
        if errors >= 0:
            out += [(c, left) for left in itertools.combinations(range(WIDTH), errors)]
    return out


def keys(signatures: np.ndarray, t: int) -> Iterator[np.ndarray]:
    """For each mask, every signature's key."""
    s = signatures.astype(np.uint64)
    for k, (c, left) in enumerate(masks(t)):
        h = np.full(len(s), k * 2 + 1, np.uint64)
        for j in range(WIDTH):
            if j not in left:
                h = _mixed(h * _P[0] + s[:, c * WIDTH + j])
        yield h.view(np.int64)


class Forest:
    """Union-find over 0..n-1 with labels at hand as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == y] = x
        return bool(x != y)


def _runs(batches, by: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of sorted batches by equal values of by; a run may go over several batches."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_pylist() for c in by]
        start = 0
        for k in range(b.num_rows):
            here = tuple(c[k] for c in columns)
            if here != at:
                if k > start:
                    held.append(b.slice(start, k - start))
                if held:
                    yield at, pa.Table.from_batches(held)
                held, at, start = [], here, k
        held.append(b.slice(start))
    if held:
        yield at, pa.Table.from_batches(held)


def near_pairs(ids: np.ndarray, side: np.ndarray, s: np.ndarray, t: int, cross: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of signatures within t (of different sides only, if cross)."""
    forest, out = Forest(len(ids)), []
    for a in range(len(ids) - 1):
        other = np.flatnonzero(forest.label[a + 1 :] != forest.label[a]) + a + 1
        if cross:
            other = other[side[other] != side[a]]
        for b in other[(s[other] != s[a]).sum(1) <= t] if len(other) else ():
            if forest.join(a, int(b)):
                out.append((int(ids[a]), int(ids[b])))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union holds for two sets, as sorted arrays."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def confirmed(ids: list[int], side: np.ndarray, sets: list[np.ndarray], percent: int, cross: bool, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * intersection >= percent * union (of different sides only, if cross; of different parts only, if given)."""
    n = np.array([len(x) for x in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(n) - n
    mark = np.zeros(int(number.max()) + 1, np.int32)
    forest, out = Forest(len(ids)), []
    if parts is not None:
        forest.label = np.unique(parts, return_inverse=True)[1]
    for a in range(len(ids) - 1):
        fits = (forest.label != forest.label[a]) & (np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent)
        fits[: a + 1] = False
        if cross:
            fits &= side != side[a]
        other = np.flatnonzero(fits)
        if not len(other):
            continue
        mark[number[begin[a] : begin[a] + n[a]]] = 1
        if len(other) * 4 < len(ids) - a:
            both = np.array([mark[number[begin[b] : begin[b] + n[b]]].sum() for b in other], np.int64)
        else:
            both = np.add.reduceat(mark[number[begin[a + 1] :]], begin[a + 1 :] - begin[a + 1])[other - a - 1].astype(np.int64)
        mark[number[begin[a] : begin[a] + n[a]]] = 0
        for b in other[both * 100 >= percent * (n[a] + n[other] - both)]:
            if forest.join(a, int(b)):
                out.append((int(ids[a]), int(ids[b])))
    return out


class Spanning:
    """A spanning forest of the links seen in a task: of those that come, the ones that join two trees. Starts anew after so many nodes."""

    def __init__(self, most: int = 1_000_000):
        self.parent: dict[int, int] = {}
        self.most = most

    def _root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent.setdefault(up, up)
        return x

    def new(self, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if len(self.parent) > self.most:
            self.parent = {}
        out = []
        for a, b in links:
            x, y = self._root(a), self._root(b)
            if x != y:
                self.parent[y] = x
                out.append((a, b))
        return out


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_units(rows: DataFrame, by: str, blocks: str, block: str, inside: str | None = None) -> DataFrame:
    """rows dealt to units (by, i, j): each pair of blocks of a group meets once; side says whether a row is of the first.

    With inside, that column's rows have blocks from blocks on, which meet those below but not each other. Units are dealt by hash, so that one group's are spread.
    """
    n, own = F.col(blocks), F.col(block)
    others = F.sequence(F.lit(0), n - 1) if inside is None else F.when(F.col(inside), F.sequence(F.lit(0), n - 1)).otherwise(F.sequence(F.lit(0), 2 * n - 1))
    out = rows.withColumn("_other", F.explode(others))
    out = out.select("*", F.least(own, F.col("_other")).alias("i"), F.greatest(own, F.col("_other")).alias("j")).drop("_other")
    out = out.withColumn("side", (own == F.col("i")).cast("int"))
    return out.repartition(common.partitions(rows.sparkSession), by, "i", "j").sortWithinPartitions(by, "i", "j")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row for each row of df: id_col, n_shingles, component_id, kept.

    Documents with 100 * intersection >= percent * union of their sets are linked; component_id is the smallest id
    reachable, and kept says that it is the row's own. Texts without words, and null, have no shingles and no links. Rows with
    equal ids are one node; rows with null ids are compared with none and stay. Empty tables give none. A pair at the threshold
    is missed with a chance under MISS, one above it with less.

    Hot groups: equal sets are merged by partial aggregation before anything else; large buckets, and clusters that their candidate
    forest's confirmed pairs leave in parts, are dealt to pairs of blocks of bounded size by hash; joins leave hot keys to adaptive execution. All tables between
    the steps are written to the shared folder.
    """
    spark = df.sparkSession
    common.prepare(spark)
    t = distance(percent)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches):
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in b.column("text").to_pylist():
                s = shingles(text)
                out[0].append(len(s))
                out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out[2].append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["id", "n", "set_key", "sig"])

    signed = common.persisted(source.mapInArrow(sign, "id long, n long, set_key binary, sig binary"), "signatures")
    least = signed.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # Written, so that both sides of the joins are exchanged and adaptive execution can split a hot set.
    least = common.persisted(least, "least")
    ruled = signed.join(least, "set_key", "left").withColumn("rep", F.when(F.col("set_key").isNotNull() & F.col("id").isNotNull(), F.coalesce("rep", "id")))
    classed = common.persisted(ruled.select("id", "n", "set_key", "rep"), "classes")
    reps = common.persisted(ruled.where("id = rep").select("rep", "n", "set_key", "sig").distinct(), "representatives")

    def filed(batches):
        for b in batches:
            s = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            for key in keys(s, t):
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("rep")], ["key", "rep"])

    files = reps.select("rep", "sig").mapInArrow(filed, "key long, rep long")
    h = F.xxhash64("rep")
    buckets = files.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 33)).alias("s")).where("c > 1")
    # Of buckets with the same members one is enough.
    buckets = common.persisted(buckets.groupBy("c", "x", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / BUCKET_BLOCK).cast("int").alias("blocks")), "buckets")
    members = files.join(buckets, "key").select("key", "rep", "blocks", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int").alias("block"))
    members = members.join(reps.select("rep", "sig"), "rep")

    def compared(batches):
        # Buckets share members: what is connected already in this task is not told again.
        found: list[tuple[int, int]] = []
        forest = Spanning()
        for (_, i, j), rows in _runs(batches, ("key", "i", "j")):
            s = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            found += forest.new(near_pairs(rows.column("rep").to_numpy(), rows.column("side").to_numpy(), s, t, i != j))
            if len(found) >= 10_000:
                yield _links(found)
                found = []
        yield _links(found)

    candidates = common.persisted(_in_units(members, "key", "blocks", "block").mapInArrow(compared, "a long, b long").distinct(), "candidates")
    clusters = common.components(candidates, "a", "b")
    clusters = common.persisted(clusters.withColumnRenamed("node", "rep").withColumnRenamed("root", "cluster").join(reps.select("rep", "n", "set_key"), "rep"), "clusters")
    # Always merge joins: candidates grow with the input, so they are not broadcast at any size. Of rows with equal ids those with another set are another row's.
    own = clusters.select("rep", "set_key").join(source.select(F.col("id").alias("rep"), "text").hint("merge"), "rep")

    def whole(batches):
        for b in batches:
            sets = [shingles(x) for x in b.column("text").to_pylist()]
            good = [len(s) > 0 and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, b.column("set_key").to_pylist(), strict=True)]
            kept = [s.tobytes() for s, g in zip(sets, good, strict=True) if g]
            yield pa.RecordBatch.from_arrays([b.column("rep").filter(pa.array(good, pa.bool_())), pa.array(kept, pa.binary())], ["rep", "set"])

    sets = common.persisted(own.mapInArrow(whole, "rep long, set binary").dropDuplicates(["rep"]), "sets")

    def checked(batches):
        for b in batches:
            held = [np.frombuffer(x, np.uint64) for x in b.column("set").to_pylist()], [np.frombuffer(x, np.uint64) for x in b.column("other").to_pylist()]
            yield b.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in zip(*held, strict=True)], pa.bool_()))

    pairs = candidates.join(sets.withColumnRenamed("rep", "a").hint("merge"), "a").join(sets.toDF("b", "other").hint("merge"), "b")
    first = common.persisted(pairs.select("a", "b", "set", "other").mapInArrow(checked, "a long, b long"), "confirmed")
    parts = common.components(first, "a", "b")
    placed = clusters.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("cluster", "rep", "n", F.coalesce("root", "rep").alias("part"))
    placed = placed_parts = common.persisted(placed, "parts")
    size = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all"))
    size = size.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), F.sum("all").alias("all"), F.max(F.struct("c", "part"))["part"].alias("largest")).where("parts > 1")
    block = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), F.ceil(F.col("c") / BLOCKS)))
    size = size.select(F.col("cluster").alias("of"), "largest", F.greatest(F.ceil(F.col("c") / block), F.least(F.col("c"), F.ceil(F.col("all") / BLOCK_SHINGLES))).cast("int").alias("blocks"))
    size = common.persisted(size, "sizes")  # as with least: a hot cluster can be split in the join
    # The largest part's blocks come after the others', which are as many again: two of its blocks never meet.
    inside = F.col("part") == F.col("largest")
    placed = placed.join(size, F.col("cluster") == F.col("of")).select("cluster", "rep", "part", "blocks", inside.alias("inside"), (F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")) + F.when(inside, F.col("blocks")).otherwise(0)).cast("int").alias("block"))
    placed = placed.join(sets.hint("merge"), "rep")

    def linked(batches):
        for (_, i, j), rows in _runs(batches, ("cluster", "i", "j")):
            if rows.num_rows > 1:
                yield _links(confirmed(rows.column("rep").to_pylist(), rows.column("side").to_numpy(), [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()], percent, i != j, rows.column("part").to_numpy()))

    links = _in_units(placed, "cluster", "blocks", "block", "inside").mapInArrow(linked, "a long, b long")
    roots = common.components(first.unionByName(links), "a", "b")
    common.discard(signed, least, reps, buckets, candidates, clusters, sets, first, placed_parts, size)
    out = classed.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("root", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """df's rows whose document stays, one of each component; of rows with equal ids all stay."""
    kept = near_components(df, id_col, text_col, percent).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")
