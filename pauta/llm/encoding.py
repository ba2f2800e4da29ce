"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's pattern; each distinct word of a batch is
encoded once. The merges run in batched numpy rounds: the symbols of many words lie in one
flat array, the rank of every neighbouring pair is found by binary search over the sorted
pair keys, and in each round every word merges its lowest-ranked pair (all its places, from
the left, without overlap) until no word has a pair in the vocabulary. Words of ``LONG``
bytes and more (scripts without blanks, glued text) take their pairs from a heap, with the
same result in n log n steps.

Defined results: null and empty texts give an empty list; text that spells a special token
is ordinary text; texts are encoded whole; repeated rows stay repeated rows.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.llm.setjoin import _batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int64).max
CACHE = 200_000
LONG = 512  # bytes of a word from which it is merged along a heap, as a round for each rank would be quadratic


class Encoder:
    """The vocabulary as sorted pair keys; ``encode`` gives the ids of many texts at once."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_id = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r in pairs], np.int64)
        self._start()

    def _start(self) -> None:
        self.lookup: dict[int, int] | None = None  # pairs as a dictionary, made when the first long word comes
        self.pattern = regex.compile(PATTERN)
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}  # word -> its row in the flat table of encoded words
        self.table = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def __getstate__(self):
        return self.bytes_id, self.keys, self.ranks

    def __setstate__(self, state) -> None:
        self.bytes_id, self.keys, self.ranks = state
        self._start()

    def _pair_ranks(self, s: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The merged symbol's id for each symbol and its right neighbour in the word, else NONE."""
        rank = np.full(len(s), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        key = s[inner] << 32 | s[inner + 1]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        rank[inner[hit]] = self.ranks[at[hit]]
        return rank

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: pairs by rank, then from the left, on a heap over a linked list."""
        s = self.bytes_id[np.frombuffer(word, np.uint8)]
        rank = self._pair_ranks(s, np.zeros(len(s), np.int64))
        heap = [(int(rank[k]), int(k)) for k in np.flatnonzero(rank != NONE)]
        heapq.heapify(heap)
        s, rank = s.tolist(), rank.tolist()
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        if self.lookup is None:
            self.lookup = dict(zip(self.keys.tolist(), self.ranks.tolist()))

        def ranked(k: int) -> None:
            n = after[k]
            rank[k] = self.lookup.get(s[k] << 32 | s[n], NONE) if n < len(s) else NONE
            if rank[k] != NONE:
                heapq.heappush(heap, (rank[k], k))

        gone = bytearray(len(s))
        while heap:
            r, k = heapq.heappop(heap)
            if gone[k] or rank[k] != r:
                continue
            n = after[k]
            s[k], gone[n], after[k] = r, 1, after[n]
            if after[k] < len(s):
                before[after[k]] = k
            ranked(k)
            if before[k] >= 0:
                ranked(before[k])
        return np.array([x for x, g in zip(s, gone) if not g], np.int32)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and offsets."""
        long = [k for k, w in enumerate(words) if len(w) >= LONG]
        if long:
            done = {k: self.merge_long(words[k]) for k in long}
            flat, off = self.merge_words([w if len(w) < LONG else b"" for w in words])
            parts = [done[k] if k in done else flat[off[k] : off[k + 1]] for k in range(len(words))]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        size = np.fromiter(map(len, words), np.int64, len(words))
        s = self.bytes_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_s, done_w = [], []
        while len(s):
            rank = self._pair_ranks(s, word)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(s)))
            low = np.repeat(low, length)
            over = low == NONE
            if over.any():
                done_s.append(s[over])
                done_w.append(word[over])
                s, word, rank, low = s[~over], word[~over], rank[~over], low[~over]
                if not len(s):
                    break
            hit = rank == low
            # of hits next to each other every second one counts, from the left
            at = np.flatnonzero(hit)
            run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])))
            from_start = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[from_start % 2 == 0]
            s[at] = rank[at]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            s, word = s[keep], word[keep]
        s = np.concatenate(done_s) if done_s else np.zeros(0, np.int64)
        word = np.concatenate(done_w) if done_w else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return s[order].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and offsets by text; null and empty texts have none."""
        if len(self.place) > CACHE:
            self._reset()
        split = [self.pattern.findall(t) if t else [] for t in texts]
        place = self.place
        new = {w for ws in split for w in ws if w not in place}
        if new:
            fresh = list(new)
            for k, w in enumerate(fresh, len(place)):
                place[w] = k
            ids, off = self.merge_words([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.begin = np.concatenate((self.begin, self.begin[-1] + off[1:]))
            self.table = np.concatenate((self.table, ids))
        rows = np.fromiter((place[w] for ws in split for w in ws), np.int64)
        n = self.begin[rows + 1] - self.begin[rows]
        out_at = np.cumsum(n) - n
        flat = self.table[np.repeat(self.begin[rows] - out_at, n) + np.arange(n.sum())]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_text)))]
        return flat, ends


def encode(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of every row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(path))  # the vocabulary: a few MB

    def run(it):
        e = shared.value
        for b, texts in _batches(it, 4 << 20):
            flat, ends = e.encode(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per language as given: documents, tokens, and tokens per hundred characters."""
    n = encode(docs, path).select("doc_id", F.size("ids").alias("tokens"))
    base = docs.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return base.join(n, "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.round(100 * F.try_divide(F.sum("tokens"), F.sum("chars")), 4).alias("tokens_per_100_chars"))
