"""Problem 7: encoding a corpus with a public byte-level BPE tokenizer.

Greedy longest matches propose the tokens of each word; a pair of neighbouring tokens is
compatible when the merges, run over both together, would leave the seam between them. All
seams of the proposals are tested at once in NumPy, and only the words with a seam that fails
are merged exactly, pair by pair.
"""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package

TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words remembered in a worker; beyond it the memory starts anew.
CACHE = 400_000
_ABSENT = np.int64(2**40)


class Encoder:
    """Ids of texts under a vocabulary of byte strings in merge order (lines of base64 and rank)."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.split_words = regex.compile(pattern)
        self.longest = max(map(len, self.rank))
        n = len(self.rank)
        # The two parts of each token: those that its last merge joined.
        self.left, self.right = np.arange(n), np.arange(n)
        pairs = []
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1:
                a, b = self._parts(token, r)
                self.left[r], self.right[r] = a, b
                pairs.append((a * n + b, r))
        self.n = n
        keys = np.array(pairs, dtype=np.int64)
        order = np.argsort(keys[:, 0])
        self.pair_keys, self.pair_ranks = keys[order, 0], keys[order, 1]
        self.single = np.array([len(t) == 1 for t, _ in sorted(self.rank.items(), key=lambda x: x[1])])
        self.cache: dict[str, list[int]] = {}

    def _parts(self, token: bytes, limit: int) -> tuple[int, int]:
        ids = self._merge(token, limit)
        if len(ids) != 2:
            raise ValueError(f"token {limit} isn't made by one merge")
        return ids[0], ids[1]

    def _merge(self, word: bytes, limit: int | None = None) -> list[int]:
        """Exact merging: the lowest-ranked pair first, from the left, while its rank is below ``limit``."""
        rank = self.rank
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            pair, out, i = parts[at] + parts[at + 1], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and len(parts[i]) + len(parts[i + 1]) == len(pair) and parts[i] + parts[i + 1] == pair and (parts[i], parts[i + 1]) == (parts[at], parts[at + 1]):
                    out.append(pair)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [rank[p] for p in parts]

    def _greedy(self, word: bytes) -> list[int]:
        rank, out, i, n = self.rank, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                r = rank.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, or a large number."""
        keys = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _ABSENT)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the seam between the tokens, for all pairs at once.

        The seam is undone merge by merge, the later merge of either side first. A merge over the
        seam would win if it came before what has been undone so far; equal ranks go to the left.
        """
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        before = np.full(len(a), _ABSENT)  # a crossing merge of a rank below this would have won
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], before[live]
            bad = self.joined(x, y) < lim
            good[live[bad]] = False
            live, x, y, lim = live[~bad], x[~bad], y[~bad], lim[~bad]
            # Undo the side made last; ties of rank cannot be across different merges but for equal tokens.
            rx, ry = np.where(self.single[x], -1, x), np.where(self.single[y], -1, y)
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            undo = rx > ry
            a[live] = np.where(undo, self.right[x], x)
            b[live] = np.where(undo, y, self.left[y])
            before[live] = np.where(undo, x, y + 1)
        return good

    def learn(self, new: list[str]) -> None:
        """Ids of words not met before into the cache."""
        rows, proposals = [], []
        for word in new:
            raw = word.encode("utf-8", "surrogatepass")
            if (r := self.rank.get(raw)) is not None:
                self.cache[word] = [r]
            else:
                rows.append((word, raw))
                proposals.append(self._greedy(raw))
        if not rows:
            return
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64)
        ends = np.cumsum([len(p) for p in proposals])
        seam = np.ones(len(flat) - 1, dtype=bool)
        seam[ends[:-1] - 1] = False
        at = np.flatnonzero(seam)
        good = np.ones(len(flat), dtype=bool)
        good[at] = self.compatible(flat[at], flat[at + 1])
        begin = np.concatenate([[0], ends[:-1]])
        fine = np.logical_and.reduceat(good, begin)
        for (word, raw), tokens, ok in zip(rows, proposals, fine):
            self.cache[word] = tokens if ok else self._merge_long(raw)

    def _merge_long(self, word: bytes) -> list[int]:
        """Exact merging of a failing word; long ones by a queue, so that time follows their length."""
        if len(word) <= 200:
            return self._merge(word)
        import heapq

        rank, n = self.rank, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, size = heapq.heappop(queue)
            j = nxt[i] if part[i] is not None else n
            if j >= n or part[j] is None or len(part[i]) + len(part[j]) != size or rank.get(part[i] + part[j]) != r:
                continue
            part[i], part[j] = part[i] + part[j], None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (s := rank.get(part[i] + part[nxt[i]])) is not None:
                    heapq.heappush(queue, (s, i, len(part[i]) + len(part[nxt[i]])))
            if (h := prev[i]) >= 0 and (s := rank.get(part[h] + part[i])) is not None:
                heapq.heappush(queue, (s, h, len(part[h]) + len(part[i])))
        return [rank[p] for p in part if p is not None]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for empty and null ones."""
        out, held, size = [], [], 0
        for text in texts:  # blocks of a bounded number of characters
            held.append(text)
            size += len(text or "")
            if size > 4_000_000:
                out += self._block(held)
                held, size = [], 0
        return out + self._block(held)

    def _block(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split_words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.learn(list({w for ws in split for w in ws if w not in self.cache}))
        get = self.cache
        return [[i for w in ws for i in get[w]] for ws in split]


def tokenizer_files(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[bytes, str]:
    """The vocabulary file as it is, and the pattern of words that comes with it."""
    with open(os.path.join(folder, vocabulary), "rb") as lines:
        data = lines.read()
    with open(os.path.join(folder, "__init__.py")) as code:
        body = ast.parse(code.read()).body
    pattern = next(ast.literal_eval(x.value) for x in body if isinstance(x, ast.Assign) and getattr(x.targets[0], "id", "") == "PATTERN")
    return data, pattern


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(files: tuple[bytes, str]) -> Encoder:
    """One encoder for each worker and vocabulary."""
    key = (hash(files[0]), files[1])
    if key not in _encoders:
        _encoders[key] = Encoder(*files)
    return _encoders[key]


def _broadcast_files(documents: DataFrame, folder: str, vocabulary: str):
    """The tokenizer's files for the workers: of the size of one vocabulary (about a megabyte), whatever the corpus."""
    ship_package(documents.sparkSession)
    return documents.sparkSession.sparkContext.broadcast(tokenizer_files(folder, vocabulary))


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): one row for each row; no shuffle.

    Null and empty texts have an empty list; blank ones are encoded like any other, strings that
    look like special tokens as ordinary text. Null keys and repeated rows are kept as they are;
    other columns are not read; an empty table gives no rows.
    """

    files = _broadcast_files(documents, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(files.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # lists of ids are wide in Python
                part = batch.slice(at, 500)
                ids = enc.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, keep..., n_tokens): the number of ids of each text, the ids themselves staying in the worker."""

    files = _broadcast_files(documents, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(files.value)
        for batch in batches:
            sizes: list[int] = []
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 500):
                sizes += map(len, enc.encode_batch(texts.slice(at, 500).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns - 1)), pa.array(sizes, pa.int64())], names=[key, *keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return documents.select(key, *keep, text).mapInArrow(run, f"{kinds}, n_tokens long")
