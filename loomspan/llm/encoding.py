"""Encoding of texts by a byte-level BPE vocabulary with a hierarchical-bitmap rank queue.

Texts are cut into stretches that no pre-token crosses, of which a batch has far fewer distinct ones;
only those are cut into pre-tokens, and these are reduced to distinct ones in turn; those that are
vocabulary entries need no merging. The bytes of all others lie in one linked list of positions (neighbours don't reach
across pre-tokens), and each position with a mergeable pair waits in the bucket of the pair's rank.
A bitmap of three levels of 64-bit words marks the buckets in use; find-first-set gives the lowest
rank. Its bucket is merged in one array step over all pre-tokens; entries whose pair has changed
since are stale and skipped; pairs that arise go to the buckets of their ranks, lower ones too. Work
is in proportion to the merges made and does not grow faster with the length of a pre-token.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pre-token pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for ASCII characters only, for the faster matcher of the standard library.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Stretches that no pre-token of the pattern crosses: a run of other characters, with the space in front of
#: it if there is one, or a run of white space, cut as the pattern cuts it. Most stretches occur many times.
STRETCHES = rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Bytes of text that a task encodes at once; a longer single text is a batch of its own.
BATCH_BYTES = 1 << 25
NONE = np.int32(0x7FFFFFFF)


class RankQueue:
    """Buckets of positions by rank, with a hierarchical bitmap over the ranks in use."""

    def __init__(self, ranks: int):
        self.buckets: list[list[np.ndarray] | None] = [None] * ranks
        self.levels = [[0] * (-(-ranks // 64**k)) for k in (1, 2, 3)]

    def push(self, rank: int, at: np.ndarray) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = [at]
            for level in self.levels:
                word, bit = rank >> 6, rank & 63
                level[word] |= 1 << bit
                rank = word
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        """The lowest rank in use with its bucket, which leaves the queue."""
        low, mid, top = self.levels
        at = next((i for i, w in enumerate(top) if w), None)
        if at is None:
            return None
        for level in (top, mid, low):
            word = level[at]
            at = at << 6 | ((word & -word).bit_length() - 1)
        rank, bucket = at, self.buckets[at]
        self.buckets[rank] = None
        for level in self.levels:
            word, bit = at >> 6, at & 63
            level[word] ^= 1 << bit
            if level[word]:
                break
            at = word
        return rank, bucket


class PairRanks:
    """Rank of a pair of ids by array lookup: hash tables without probing, one for what the last left over."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        rank = rank.astype(np.int32)
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        factor = 0x9E3779B97F4A7C15
        while len(key):
            bits = max(4, int(4 * len(key)).bit_length())
            shift, mult = np.uint64(64 - bits), np.uint64(factor | 1)
            slot = (key * mult) >> shift
            keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
            ranks = np.full(1 << bits, NONE, dtype=np.int32)
            keys[slot], ranks[slot] = key, rank
            self.tables.append((mult, shift, keys, ranks))
            left_over = keys[slot] != key
            key, rank = key[left_over], rank[left_over]
            factor = (factor * 6364136223846793005 + 1442695040888963407) % (1 << 64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(key), NONE, dtype=np.int32)
        for mult, shift, keys, ranks in self.tables:
            slot = (key * mult) >> shift
            hit = keys[slot] == key
            out = np.where(hit, ranks[slot], out)
        return out


class Encoder:
    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        lines = (line.split() for line in Path(vocabulary).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else self.find
        self.stretches = re.compile(STRETCHES).findall
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pair_rank = PairRanks(np.array(left), np.array(right), np.array(rank))
        self.size = max(self.ranks.values()) + 1

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each piece); no piece may be empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(sym)
        ends = np.cumsum(sizes)
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - sizes] = -1
        pair = np.full(n, NONE, dtype=np.int32)
        has = np.flatnonzero(nxt >= 0)
        pair[has] = self.pair_rank(sym[has], sym[has + 1])
        queue = RankQueue(self.size)

        def wait(at: np.ndarray) -> None:
            """Put positions into the buckets of their pairs' ranks."""
            r = pair[at]
            keep = r != NONE
            at, r = at[keep], r[keep]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            begin = [0, *cut.tolist()]
            for rank, a, b in zip(r[begin].tolist(), begin, [*begin[1:], len(at)]):
                queue.push(rank, at[a:b])

        wait(has)
        while (found := queue.pop()) is not None:
            rank, bucket = found
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                # positions that follow one another share a symbol: every second one merges, from the left
                chained = np.append(False, nxt[at[:-1]] == at[1:])
                if chained.any():
                    i = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(chained, -1, i))
                    at = at[(i - head) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = rank
            pair[gone] = NONE
            sym[gone] = -1
            nxt[at] = after
            real = after >= 0
            prv[after[real]] = at[real]
            before = prv[at]
            led = before[before >= 0]
            pair[at] = NONE
            right = at[real]
            both = np.concatenate([right, led])
            # a position may be both the right neighbour's left and a merged one; one lookup each is enough
            if len(both) > 1:
                both = np.unique(both)
            if len(both):
                pair[both] = self.pair_rank(sym[both], sym[nxt[both]])
                wait(both)
        left = sym >= 0
        return sym[left], np.add.reduceat(left, ends - sizes) if n else sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        stretches: dict[str, int] = defaultdict(itertools.count().__next__)  # numbers them as they come
        per_text = np.zeros(len(texts), dtype=np.int64)
        seen: list[np.ndarray] = []
        number = stretches.__getitem__
        for i, text in enumerate(texts):
            if text:
                got = self.stretches(text)
                per_text[i] = len(got)
                seen.append(np.fromiter(map(number, got), np.int32, len(got)))
        if not stretches:
            return np.zeros(0, np.int32), per_text
        # pre-tokens of each distinct stretch, numbered in turn
        index: dict[str, int] = defaultdict(itertools.count().__next__)
        cut = [self.find_ascii(x) if x.isascii() else self.find(x) for x in stretches]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        of = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(cut)), np.int32, int(sizes.sum()))
        # lone surrogates can't be in a text from Arrow, which is valid UTF-8
        pieces = [p.encode() for p in index]
        single = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        todo = np.flatnonzero(single < 0)
        counts = np.ones(len(pieces), dtype=np.int64)
        flat = single
        if len(todo):
            ids, k = self.merge([pieces[i] for i in todo.tolist()])
            counts[todo] = k
            flat = np.empty(int(counts.sum()), dtype=np.int32)
            start = np.cumsum(counts) - counts
            flat[start[single >= 0]] = single[single >= 0]
            flat[np.repeat(start[todo] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        flat, counts = self._joined(flat, counts, of, sizes)
        return self._joined(flat, counts, np.concatenate(seen), per_text)

    @staticmethod
    def _joined(flat: np.ndarray, counts: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each whole) of wholes that have ``sizes`` parts, numbered ``of``; the ids of
        all parts lie one after another in ``flat``, ``counts`` each."""
        start = np.cumsum(counts) - counts
        k = counts[of]
        upto = np.cumsum(k)
        ids = flat[np.repeat(start[of] - (upto - k), k) + np.arange(int(upto[-1]))]
        totals = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(sizes)))]
        return ids, np.diff(totals)


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most about BATCH_BYTES."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_texts(df: DataFrame, text: str, keep: list[str], vocabulary: str, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids (array<int>) of column ``text``.

    No special tokens are made or recognised. Empty and null texts have the empty list. Texts are
    encoded whole, whatever their length; repeated rows stay. ``vocabulary`` is a path that every
    executor can read. A narrow transformation without shuffle.
    """
    types = dict(df.dtypes)
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{ids}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in _batches(batches):
            flat, k = enc.encode(batch.column(len(keep)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(k))).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, ids])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ddl)


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str, tokens: str = "tokens") -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of token ids (bigint); 0 for empty and null texts."""
    types = dict(df.dtypes)
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{tokens}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in _batches(batches):
            _, k = enc.encode(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(k, pa.int64())], names=[*keep, tokens])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ddl)
