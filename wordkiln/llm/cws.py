"""Consistent weighted sampling: signatures of weighted term sets that collide with their generalised Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import EMPTY_HASH, flat, mix, record_key, word_hashes

SAMPLES = 64
#: Term weights taken at a time, and distinct terms of them whose parameters are held: both bound the worker's memory whatever the batch.
CHUNK = 300_000
TERMS = 60_000


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """float32 in (0, 1)."""
    return ((mix(h, salt) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def parameters(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and log c with r, c ~ Gamma(2, 1), and beta ~ U(0, 1), each [terms, samples], from the terms' hashes alone."""
    r, c, beta = (np.empty((len(terms), samples), dtype=np.float32) for _ in range(3))
    for k in range(samples):
        a, b = mix(terms, 5 * k), mix(terms, 5 * k + 1)
        u = [((x >> np.uint64(s) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24) for x, s in ((a, 0), (a, 40), (b, 0), (b, 40))]
        r[:, k] = -np.log(u[0] * u[1])
        c[:, k] = np.log(-np.log(u[2] * u[3]))
        beta[:, k] = _uniform(terms, 5 * k + 2)
    return r, c, beta


def signatures(values: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """[rows, samples] int64; weights are the counts of equal values in a row; -1 for rows without values.

    Of term t with weight w: q = floor(log w / r + beta), log y = r (q - beta), log a = log c - log y - r. The sample is
    (t, q) of the least a. A text longer than a chunk is taken in pieces whose minima are merged, so all of it counts.
    """
    n = len(offsets) - 1
    out = np.full((n, samples), -1, dtype=np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((values, row))
    row, v = row[order], values[order]
    if not len(v):
        return out
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (v[1:] != v[:-1])])
    weight = np.log(np.diff(np.r_[new, len(v)]).astype(np.float32))
    row, v = row[new], v[new]
    # parameters depend on the term alone: rows come in slices of few distinct terms, whose parameters are computed once
    least, at = np.full((n, samples), np.inf, dtype=np.float32), 0
    while at < len(v):
        end = min(len(v), at + CHUNK)
        terms, index = np.unique(v[at:end], return_inverse=True)
        for lo in range(0, len(terms), TERMS):
            own = np.flatnonzero((index >= lo) & (index < lo + TERMS)) if len(terms) > TERMS else np.arange(end - at)
            _least(terms[lo : lo + TERMS], index[own] - lo, weight[at:end][own], row[at:end][own], out, least)
        at = end
    return out


def _least(terms: np.ndarray, index: np.ndarray, w: np.ndarray, rows: np.ndarray, out: np.ndarray, least: np.ndarray) -> None:
    """Enter the samples of some (row, term, log weight) into out, where they lie below least. rows come sorted.

    Equal float values go to the term met first: of one call by hash, of several to the earlier call.
    """
    samples = out.shape[1]
    r, c, beta = parameters(terms.view(np.uint64), samples)
    q_hash = mix(terms.view(np.uint64), 901)
    a = c - r * (1 - beta)  # log a at weight 1, where q = 0
    a = a[index]
    q = None
    many = np.flatnonzero(w > 0)
    if len(many):
        rm, bm = r[index[many]], beta[index[many]]
        qm = np.floor(w[many][:, None] / rm + bm)
        a[many] = c[index[many]] - rm * (qm - bm + 1)
        q = np.zeros(len(index), dtype=np.int64)
        q[many] = np.arange(len(many))
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    got = np.minimum.reduceat(a, first, axis=0)
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rows)]))
    at, k = np.nonzero(a == got[owner])
    at, k = at[::-1], k[::-1]
    level = np.zeros(len(at), dtype=np.int64)
    if q is not None:
        heavy = w[at] > 0
        level[heavy] = qm[q[at[heavy]], k[heavy]].astype(np.int64)
    code = (mix(q_hash[index[at]] ^ level.astype(np.uint64), 902) >> np.uint64(32)).astype(np.int64)
    sample = np.empty(got.shape, dtype=np.int64)
    sample[owner[at], k] = code
    target = rows[first]
    better = got < least[target]
    out[target] = np.where(better, sample, out[target])
    least[target] = np.where(better, got, least[target])


def _sign(samples: int):
    def run(batches):
        for b in batches:
            values, offsets = flat(b.column("h"))
            keep = values != EMPTY_HASH
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            s = signatures(np.ascontiguousarray(values[keep]), offsets, samples)
            flat_s = pa.array(s.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(s) * samples + 1, samples, dtype=np.int32)), flat_s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), lists], ["doc_id", "n_terms", "signature"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_terms (words), signature: samples codes in 0..2^32-1; two texts' k-th codes are equal with the probability
    of their generalised Jaccard similarity, sum of least counts over sum of greatest counts of words in lower case.

    No shuffle. Texts without a word (null, empty) get -1 throughout; null keys stay null; rows alike get signatures
    alike; very long texts count whole; an empty table gives an empty one. Other columns are not read.
    """
    d = docs.select(record_key(docs, key).alias("doc_id"), word_hashes(docs[text]).alias("h"))
    return d.mapInArrow(_sign(samples), "doc_id long, n_terms long, signature array<long>")


def similarity(a: Column, b: Column) -> Column:
    """Estimated generalised Jaccard similarity of two signatures; null if either has no terms."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((F.get(a, F.lit(0)) >= 0) & (F.get(b, F.lit(0)) >= 0), same / F.size(a))
