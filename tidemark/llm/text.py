"""Words and stable hashes, alike in all text operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: A word is a maximal run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")
_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_known: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of the words; a bounded cache spares the frequent ones."""
    if len(_known) > 500_000:
        _known.clear()
    out = list(map(_known.get, tokens))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = _known[tokens[i]] = xxhash.xxh64_intdigest(tokens[i])
    return np.array(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values (each bit depends on all)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_hashes(tokens: list[str], size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` successive words, as signed longs in rising order."""
    return np.unique(run_hashes(tokens, size))


def shingles(tokens: list[str], size: int) -> set[tuple[str, ...]]:
    """The distinct runs themselves, for exact checks."""
    return set(zip(*(tokens[k:] for k in range(size))))


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the greatest of those that repeat one.

    Only the keys are counted; rows whose key occurs once are passed on without a shuffle of
    their texts, where the few keys that repeat can be broadcast (the planner knows their size).
    """
    again = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*keys))
    rest = [c for c in rows.columns if c not in keys]
    best = rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_b")).select(*keys, "_b.*")
    return rows.join(again, keys, "left_anti").select(*rows.columns).unionByName(best.select(*rows.columns))


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Distinct fingerprints of hashes in text order: the least of each ``window`` successive ones, so that a stretch of so many that two texts share gives a shared fingerprint."""
    if len(hashes) <= window:
        return hashes.min(keepdims=True) if len(hashes) else hashes
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1))


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_powers = np.ones((2, 1), dtype=np.uint64)


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """Sums of the word hashes before each place, each hash times a power of an odd base."""
    global _powers
    if len(h) >= _powers.shape[1]:
        n = 2 * len(h) + 64
        _powers = np.array([np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)])) for b in (_BASE, _UNBASE)])
    out = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _powers[0, : len(h)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash, as signed long, of the words of each stretch, wherever it stands."""
    return mixed((sums[end] - sums[begin]) * _powers[1, begin]).view(np.int64)


def run_hashes(tokens: list[str], size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` successive words, in text order."""
    if len(tokens) < size:
        return np.empty(0, dtype=np.int64)
    begin = np.arange(len(tokens) - size + 1)
    return stretch_hashes(prefix_sums(word_hashes(tokens)), begin, begin + size)
