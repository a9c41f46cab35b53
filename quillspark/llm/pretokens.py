"""Ids of whole texts from those of their chunks, which a process remembers.

A text may be cut before any single space or line end that stands between two characters which aren't white space: no
pre-token of a byte-level BPE spans such a place. Chunks repeat, so a batch's texts are split and its distinct chunks
found by Arrow; those not met yet are encoded, and the texts' ids are gathered from all chunks' ids by index.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Chunks that a process remembers, about 60 bytes each; then those that came once are forgotten, and of the others the rarest half.
CACHE = 600_000
#: Bytes of texts that are split together, about, and ids gathered at once.
TOGETHER, GATHERED = 6_000_000, 1_000_000
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
EMPTY = pa.scalar("", pa.large_string())
FAR = regex.compile("[԰-\U0010ffff]")

Ids = tuple[np.ndarray, np.ndarray]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


def letters(ranges: str) -> str:
    """All characters of a regex's ranges, as in "a-zA-Z"."""
    return "".join(chr(c) for a, z in regex.findall("(.)-(.)", ranges) for c in range(ord(a), ord(z) + 1))


def gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """The runs of flat that begin at begin and have count items, in a row. ends: the running sum of count."""
    ends = np.cumsum(count) if ends is None else ends
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    a = done = 0
    while a < len(ends):  # in blocks, as the index takes more room than what it gathers
        z = max(a + 1, int(np.searchsorted(ends, done + GATHERED, side="right")))
        upto = int(ends[z - 1])
        out[done:upto] = flat[np.repeat(begin[a:z] - (ends[a:z] - count[a:z]), count[a:z]) + np.arange(done, upto)]
        a, done = z, upto
    return out


class Chunks:
    """encode() takes texts and returns (their ids in a row, how many each has). special: a token's string that stands for itself, and its id."""

    def __init__(self, encode: Callable[[list[str]], Ids], special: str = "", special_id: int = 0, limit: int = CACHE):
        self.encode, self.special, self.special_id, self.limit = encode, special, special_id, limit
        self._start()

    def _start(self) -> None:
        #: Chunks in the order of their numbers; one that leads with a space is kept without it. edged: empty, or white space at an end.
        self.known = pa.array([], pa.large_string())
        self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.count, self.uses, self.edged = (np.zeros(1 << 14, t) for t in (np.int64, np.int64, np.int64, bool))

    def _forget(self) -> None:
        most = np.argsort(-self.uses[: len(self.known)], kind="stable")[: self.limit // 2]
        stay = np.sort(most[self.uses[most] > 1])
        begin, count, edged, uses = (x[stay] for x in (self.begin, self.count, self.edged, self.uses))
        flat, known = gathered(self.flat, begin, count), self.known.take(pa.array(stay))
        self._start()
        self._keep(known, flat, count, edged)
        self.uses[: len(known)] = uses // 2

    def _keep(self, known: pa.Array, flat: np.ndarray, count: np.ndarray, edged: np.ndarray) -> None:
        """known's last chunks, count of them, are new."""
        end, used = len(known), self.used + len(flat)
        n = end - len(count)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end > len(self.begin):
            self.begin, self.count, self.uses, self.edged = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.uses, self.edged))
        self.flat[self.used : used] = flat
        self.count[n:end], self.edged[n:end] = count, edged
        self.begin[n:end] = self.used + np.cumsum(count) - count
        self.known, self.used = known, used

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The pieces' numbers, new ones learnt: dictionary encoding after the known ones gives those their own numbers again."""
        if not len(pieces):
            return np.zeros(0, np.int64)
        every = pa.chunked_array([self.known, pieces]).dictionary_encode()
        found = every.chunk(every.num_chunks - 1)
        if len(found.dictionary) > len(self.known):
            keys = found.dictionary.slice(len(self.known))
            line = pc.starts_with(keys, "\n")
            flat, count = self.encode(pc.if_else(line, keys, pc.binary_join_element_wise(EMPTY, keys, pa.scalar(" ", pa.large_string()))).to_pylist())
            core = pc.if_else(line, pc.utf8_slice_codeunits(keys, 1), keys)
            edged = pc.or_(pc.equal(core, ""), pc.not_equal(core, pc.utf8_trim_whitespace(core)))
            self._keep(found.dictionary, flat, count, edged.to_numpy(zero_copy_only=False))
        which = found.indices.to_numpy().astype(np.int64)
        self.uses[: len(self.known)] += np.bincount(which, minlength=len(self.known))
        return which

    def _segments(self, texts: list[str]) -> Ids:
        """Ids of texts without the special token, and where each text's end."""
        if len(self.known) > self.limit:
            self._forget()
        # A line end gets a space before it, so that one split finds both; it stays with what follows.
        pieces = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        at = pieces.offsets.to_numpy()
        which = self._numbers(pieces.flatten())
        head = pc.list_element(pieces, 0).to_pylist()
        odd = np.flatnonzero(np.logical_or.reduceat(self.edged[which], at[:-1]) & (np.diff(at) > 1))
        if len(odd):
            # White space beside a space or line end: cut in Python, where there is a look behind.
            cuts = [_CUT.split(texts[r]) for r in odd]
            own = self._numbers(pa.array([p[1:] if p[0] == " " else p for x in cuts for p in x[1:]], pa.large_string()))
            ends = np.cumsum([len(x) - 1 for x in cuts])
            parts = [which[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
            for r, x, z in zip(odd.tolist(), cuts, ends.tolist(), strict=True):
                head[r] = x[0]
                parts[r] = np.concatenate([[0], own[z - len(x) + 1 : z]])
            which, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        heads, counts = self.encode(head)
        # The first piece of each text is one of its own, after the chunks.
        n = len(self.known)
        which[at[:-1]] = n + np.arange(len(texts))
        count = np.concatenate([self.count[:n], counts])[which]
        begin = np.concatenate([self.begin[:n], self.used + np.cumsum(counts) - counts])[which]
        ends = np.cumsum(count)
        return gathered(np.concatenate([self.flat[: self.used], heads]), begin, count, ends), ends[at[1:] - 1]

    def ids(self, texts: list[str]) -> Ids:
        """(ids of all texts in a row, where each text's begin, and the last one's end)."""
        if self.special and any(self.special in t for t in texts):
            split = [t.split(self.special) for t in texts]
            flat, ends = self._segments(list(itertools.chain.from_iterable(split)))
            sizes = np.array([len(x) for x in split], np.int64)
            last = np.cumsum(sizes)
            between = np.ones(len(ends), bool)
            between[last - 1] = False
            flat = np.insert(flat, ends[between], self.special_id)
            ends = (ends + np.cumsum(between))[last - 1]
        else:
            flat, ends = self._segments(texts) if texts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return flat, np.concatenate([[0], ends])

    def batches(self, texts: list[str]) -> Iterator[Ids]:
        """ids() of runs of texts of about TOGETHER bytes, so that memory is bounded by that or by one text."""
        start = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= TOGETHER:
                yield self.ids(texts[start : k + 1])
                start, size = k + 1, 0
        if start < len(texts):
            yield self.ids(texts[start:])


def together(batches: Iterable[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """batches put together until their texts have about most bytes, so that a distinct chunk is looked up once for many rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pretokens(text: str, library: Callable[[str], list] | None = None) -> list[str]:
    """text's pre-tokens. Beyond the letters of Europe the library cuts itself, as Unicode's versions may differ."""
    if library is None or text.isascii() or max(text) < "԰":
        return PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in library(text)]


def cut(texts: list[str], library: Callable[[str], list]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pre-tokens, their numbers for all texts in a row, how many each text has).

    Texts of one leading space and no other white space are cut together: joined by line ends, no pre-token goes over one.
    """
    near = [len(t) > 1 and t[0] == " " and t.isprintable() and " " not in t[1:] and not FAR.search(t) for t in texts]
    together = PATTERN.findall("\n".join(itertools.compress(texts, near)))
    rest = [pretokens(t, library) for t, n in zip(texts, near, strict=True) if not n]
    place = {w: k for k, w in enumerate(dict.fromkeys(itertools.chain(("\n",), together, itertools.chain.from_iterable(rest))))}
    which = np.fromiter(map(place.__getitem__, together), np.int64, len(together))
    far = np.array([place[w] for own in rest for w in own], np.int64)
    near = np.array(near, bool)
    counts = np.zeros(len(texts), np.int64)
    if near.any():
        counts[near] = np.diff(np.concatenate([[-1], np.flatnonzero(which == 0), [len(which)]])) - 1
    counts[~near] = [len(own) for own in rest]
    # Where each text's words begin in its own row, then all texts' words in order.
    which = np.concatenate([which[which != 0], far])
    begin = np.zeros(len(texts), np.int64)
    begin[near] = np.cumsum(counts[near]) - counts[near]
    begin[~near] = counts[near].sum() + np.cumsum(counts[~near]) - counts[~near]
    return list(place), gathered(which, begin, counts), counts


def joined(flat: np.ndarray, count: np.ndarray, which: np.ndarray, cuts: np.ndarray) -> Ids:
    """(ids of all texts in a row, how many each has): flat and count are the distinct words' ids, which the texts' words in a row, cuts how many each text has."""
    own = count[which]
    ends = np.concatenate([[0], np.cumsum(own)])
    at = np.concatenate([[0], np.cumsum(cuts)])
    return gathered(flat, (np.cumsum(count) - count)[which], own, ends[1:]), np.diff(ends[at])


def by_words(texts: list[str], library: Callable[[str], list], encode: Callable[[list[str]], Ids]) -> Ids:
    """(ids of all texts in a row, how many each has) from encode()'s of the texts' distinct pre-tokens."""
    words, which, cuts = cut(texts, library)
    return joined(*encode(words), which, cuts)
