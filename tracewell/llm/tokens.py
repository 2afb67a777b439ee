"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary, by speculation and verification.

A word's tokens are proposed by greedy longest match. A sequence of tokens is the BPE encoding of
its bytes exactly if every adjacent pair of it is the encoding of the pair's bytes, so one
vectorised test over all adjacent pairs accepts most words; only the rest are merged exactly.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text into words before the merges of this vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered per vocabulary and Python worker; beyond it the memory starts anew, results don't change.
REMEMBERED = 400_000


class Vocabulary:
    """Ranks of a byte-level BPE and the tables for testing pairs of tokens."""

    def __init__(self, raw: bytes) -> None:
        pairs = [line.split() for line in raw.splitlines() if line.strip()]
        self.memory: dict[str, np.ndarray] = {}
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.longest = max(map(len, self.rank))
        n = max(self.rank.values()) + 1
        self.left = np.arange(n, dtype=np.int64)
        self.right = np.arange(n, dtype=np.int64)
        keys, made = [], []
        for token, r in self.rank.items():
            if len(token) > 1:
                parts = self.merge(token, below=r)
                if len(parts) == 2:  # else no merge makes it, and it stands only as a whole word
                    self.left[r], self.right[r] = parts
                    keys.append(parts[0] * n + parts[1])
                    made.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.made, self.n = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order], n

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """The exact encoding of ``word``: always merge the pair of least rank, the leftmost first.

        With ``below`` only merges of lower rank happen. A heap keeps it near linear for long words.
        """
        rank = self.rank
        at = list(range(len(word) + 1))  # bounds of the parts that are left, linked
        after, before = [i + 1 for i in at], [i - 1 for i in at]
        end = len(word)
        dead = bytearray(end + 1)
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < end:
                k = after[j]
                r = rank.get(word[i:k])
                if r is not None and (below is None or r < below):
                    heapq.heappush(heap, (r, i, k))

        for i in range(end):
            offer(i)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= end or after[j] != k:
                continue
            dead[j] = 1
            after[i] = k
            if k <= end:
                before[k] = i
            offer(i)
            if i > 0:
                offer(before[i])
        out, i = [], 0
        while i < end:
            out.append(rank[word[i : after[i]]])
            i = after[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, i, end, rank = [], 0, len(word), self.rank
        while i < end:
            for k in range(min(end, i + self.longest), i, -1):
                r = rank.get(word[i:k])
                if r is not None:
                    out.append(r)
                    i = k
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether no merge would cross the border between them.

        Merging is replayed backwards from the two tokens: whichever of the two was made last is
        undone to its part at the border, and a merge across the border is fatal if its rank is
        below that of the merge just undone.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.made[at] < limit[live])
            good[live[crossed]] = False
            whole_a, whole_b = self.right[x] == x, self.left[y] == y
            undo_a = ((x > y) & ~whole_a) | (whole_b & ~whole_a)
            undo_b = ~undo_a & ~whole_b
            go = live[undo_a]
            limit[go] = a[go]
            a[go] = self.right[a[go]]
            go = live[undo_b]
            limit[go] = b[go] + 1  # an equal rank further left is merged first
            b[go] = self.left[b[go]]
            live = live[(undo_a | undo_b) & ~crossed]
        return good

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The encodings of ``words``."""
        out: list = [None] * len(words)
        proposed: list[tuple[int, list[int]]] = []
        for i, w in enumerate(words):
            r = self.rank.get(w)
            if r is not None:
                out[i] = np.array([r], dtype=np.int32)
            else:
                proposed.append((i, self.propose(w)))
        if proposed:
            sizes = np.array([len(p) for _, p in proposed])
            flat = np.concatenate([np.array(p, dtype=np.int64) for _, p in proposed])
            inner = np.ones(len(flat), dtype=bool)
            inner[np.cumsum(sizes) - 1] = False  # no pair starts at the last token of a word
            here = np.flatnonzero(inner)
            pairs, back = np.unique(flat[here] * self.n + flat[here + 1], return_inverse=True)
            bad = np.zeros(len(flat), dtype=bool)
            bad[here] = ~self.compatible(pairs // self.n, pairs % self.n)[back]
            failed = np.add.reduceat(bad, np.concatenate([[0], np.cumsum(sizes)[:-1]])) > 0
            for (i, p), f in zip(proposed, failed, strict=True):
                out[i] = np.array(self.merge(words[i]) if f else p, dtype=np.int32)
        return out


_loaded: dict[bytes, Vocabulary] = {}  # by a hash of the whole file


def vocabulary(raw: bytes) -> Vocabulary:
    """The vocabulary of the rank file's bytes, made once per process."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


_split = regex.compile(WORDS)


def encode_batch(voc: Vocabulary, texts: list[str | None]) -> list[list[np.ndarray]]:
    """Word encodings of each text; none for an empty or null text."""
    words = [_split.findall(t) if t else [] for t in texts]
    memory = voc.memory
    if len(memory) > REMEMBERED:
        memory.clear()
    new = list({w for ws in words for w in ws if w not in memory})
    for w, ids in zip(new, voc.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
        memory[w] = ids
    return [[memory[w] for w in ws] for ws in words]


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, sizes_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``ids`` (list of integers) of every row, or ``tokens`` (their number) with ``sizes_only``.

    Empty and null texts have the empty list. Special tokens aren't recognised or added: their
    strings are ordinary text. Texts are encoded whole, whatever their length; repeated rows stay.
    The rank file is read on the driver and broadcast; it is a fixed file of about 1 MB.
    """
    raw = Path(path).read_bytes()
    if len(raw) > 64 << 20:
        raise ValueError("not a rank file of the expected size")
    shared = df.sparkSession.sparkContext.broadcast(raw)
    cols = list(dict.fromkeys([key, *keep]))
    src = df.select(*cols, F.col(text).alias("_text"))
    kept = [f for f in src.schema.fields if f.name != "_text"]
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    schema = StructType([*kept, StructField("tokens", LongType()) if sizes_only else StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows = encode_batch(voc, part.column(part.num_columns - 1).to_pylist())
                counts = [sum(map(len, ws)) for ws in rows]
                if sizes_only:
                    made = pa.array(counts, pa.int64())
                else:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    pieces = [a for ws in rows for a in ws]
                    flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*cols, "tokens" if sizes_only else "ids"])

    return src.mapInArrow(run, schema)
