"""Encoding with a public byte-level BPE vocabulary, in batched numpy merge rounds.

The symbols of all words of a batch that were not met before lie in one flat array. A
round finds each adjacent pair in the sorted pair keys by binary search, takes the lowest
rank of each word by one segmented minimum and merges all its occurrences at once; words
without a pair left drop out. Encoded words stay in a bounded memory of the worker. A word
of LONG bytes or more would need as many rounds as it has different merges; its pairs
wait in a heap by rank and place instead, which gives the same ids in n log n steps.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from prismgrid.session import spread

#: Fixed value: the vocabulary's own split of text into words, with white space spelled out.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words kept encoded per worker; beyond, the memory is emptied. Results don't depend on it.
MEMORY = 400_000
#: Rows encoded together.
SLICE = 512
#: Bytes from which a word is merged by a heap; ids are the same either way.
LONG = 300
_NONE = np.iinfo(np.int64).max


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Merge rounds over the ranks of one vocabulary file (one base64 token and rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = np.zeros(256, np.int64)
        pairs = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.bytes[token[0]] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.split = regex.compile(WORDS).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, leftmost first, until none is left."""
        symbols = self.bytes[np.frombuffer(word, np.uint8)]
        n, pairs = len(symbols), self.pairs
        keys = symbols[:-1] << 20 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == keys)
        # An entry is rank and place in one number; it is stale once its pair has changed.
        heap = (self.ranks[at[known]] << 32 | known).tolist()
        heapq.heapify(heap)
        symbols = symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if symbols[i] < 0 or j >= n or pairs.get(symbols[i] << 20 | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pairs.get(rank << 20 | symbols[k])
                if new is not None:
                    heapq.heappush(heap, new << 32 | i)
            h = before[i]
            if h >= 0:
                new = pairs.get(symbols[h] << 20 | rank)
                if new is not None:
                    heapq.heappush(heap, new << 32 | h)
        return [s for s in symbols if s >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            key = np.append(symbols[:-1] << 20 | symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            inside = np.append(owner[1:] == owner[:-1], False)
            rank = np.where((self.keys[at] == key) & inside, self.ranks[at], _NONE)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            width = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, first), width)
            live = best < _NONE
            hit = np.flatnonzero((rank == best) & live)
            if len(hit):
                # Of overlapping occurrences every second one counts, from the left.
                run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
                order = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[order % 2 == 0]
                symbols[hit] = rank[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                keep &= live
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        return symbols[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _codes(self, texts: list[str | None]) -> list[list[int]]:
        """Each text as numbers of known words; new words are encoded first, together."""
        if len(self.known) > MEMORY:
            self.forget()
        words = [self.split(t) if t else [] for t in texts]
        known = self.known
        fresh = [w for w in dict.fromkeys(w for doc in words for w in doc) if w not in known]
        if fresh:
            data = [w.encode() for w in fresh]
            ids, sizes = self.merge([w if len(w) < LONG else b"" for w in data])
            long = [k for k, w in enumerate(data) if len(w) >= LONG]
            if long:
                parts = np.split(ids, np.cumsum(sizes)[:-1])
                for k in long:
                    parts[k] = np.array(self.merge_long(data[k]), np.int32)
                    sizes[k] = len(parts[k])
                ids = np.concatenate(parts)
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.concatenate([self.starts, starts])
        return [[known[w] for w in doc] for doc in words]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and the offsets of each; null and '' have none."""
        codes = self._codes(texts)
        counts = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter((c for doc in codes for c in doc), np.int64, int(counts.sum()))
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.starts[flat] - (ends - sizes), sizes)
        word_ends = np.append(0, ends)[np.cumsum(counts)]
        return self.flat[take], np.append(0, word_ends)

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        return [int(self.sizes[c].sum()) if c else 0 for c in self._codes(texts)]


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder of a vocabulary file; without a path that of this machine's package."""
    return Encoder(path or vocabulary_path())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens.

    Null and empty texts give the empty list; strings of special tokens are ordinary
    text. Every row gives one row, repeated ids and null ids too; texts are encoded
    whole. Further columns are ignored. A ``path`` must be the same on all machines; without
    one each worker finds the vocabulary in its own installed package.
    """

    def encode(batches):
        for batch in _slices(batches):
            ids, offsets = encoder(path).encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(encode, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; null and empty texts count 0."""

    def count(batches):
        for batch in _slices(batches):
            n = encoder(path).count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"]
            )

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")
