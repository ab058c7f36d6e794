"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a normal distribution of transformed statistics of a text (lengths, shares of kinds of
characters, repetition, lines). A class' covariance is shrunk towards the covariance of both classes
together and towards a multiple of the identity, so that it can be inverted whatever the sample. A
text's score is the logistic function of the difference of the two log densities, from the
Mahalanobis distances by Cholesky factors that are worked out once and sent along.

Statistics are brought to mean 0 and deviation 1 and held within CLIP deviations, so that an
unusually long but clean text is not taken for one of the broader class.

The model is fitted on at most ``fit_rows`` labelled rows, those of the smallest hashed ids; scores
cover all rows and whole texts.

Edge cases: null is as an empty text, which has statistics and so a score; with no or one class
labelled, the score is the share of label 1, 0.5 without labels; other labels than 0 and 1 and null
ones teach nothing; repeated rows are scored each; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, store

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: Share of the pooled covariance and of the scaled identity in a class' covariance.
POOLED, ROUND = 0.5, 0.1
CLIP = 5.0

# Kinds of characters, by byte: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 common marks, 5 other marks, 6 non-ASCII.
_KIND = np.full(256, 5, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 4

NAMES = ["log_words", "word_length", "upper", "digits", "marks", "signs", "non_ascii", "distinct", "top_word", "bigrams", "repeats", "short_words", "log_line", "lines_alike", "stopped"]


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, len(NAMES)) transformed statistics of whole texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, out = len(texts), np.zeros((len(texts), len(NAMES)))
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    kind = _KIND[data[at[0] : at[-1]]]
    where = at - at[0]
    each = np.stack([np.diff(np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])[where]) for k in range(7)], axis=1).astype(float)
    size = np.maximum(each.sum(axis=1), 1)
    letters = np.maximum(each[:, 1] + each[:, 2] + each[:, 6], 1)
    words = pc.split_pattern(pc.replace_substring_regex(texts, r"\s+", " "), " ")
    coded = words.values.dictionary_encode()
    codes, cut = coded.indices.to_numpy().astype(np.int64), words.offsets.to_numpy()
    lens = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64)[codes]
    count = np.diff(cut)
    doc = np.repeat(np.arange(n), count)
    total = np.maximum(count, 1).astype(float)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[cut]).astype(float)

    width = max(1, len(coded.dictionary))
    same = np.sort(doc * width + codes)
    new = np.ones(len(same), bool)
    new[1:] = same[1:] != same[:-1]
    first = np.flatnonzero(new)
    often, owner = np.diff(np.concatenate([first, [len(same)]])), (same[first] // width)
    top, kinds = np.zeros(n), np.bincount(owner, minlength=n).astype(float)
    np.maximum.at(top, owner, often)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
    pair = np.sort(hash_pair(doc[inner], codes[inner], codes[inner + 1] if len(inner) else inner))
    pair_doc_total = np.bincount(doc[inner], minlength=n).astype(float)
    fresh = np.ones(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    pairs = np.bincount((pair[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)[:n].astype(float) if len(pair) else np.zeros(n)
    repeats = np.bincount(doc[inner][codes[inner] == codes[inner + 1]], minlength=n).astype(float) if len(inner) else np.zeros(n)
    lines = pc.split_pattern(texts, "\n")
    lcoded = lines.values.dictionary_encode()
    lcodes, lcut = lcoded.indices.to_numpy().astype(np.int64), lines.offsets.to_numpy()
    lcount = np.diff(lcut)
    ldoc = np.repeat(np.arange(n), lcount)
    lkinds = np.bincount(np.unique(ldoc * max(1, len(lcoded.dictionary)) + lcodes) // max(1, len(lcoded.dictionary)), minlength=n).astype(float)
    ends = pc.match_substring_regex(lcoded.dictionary, r"[.!?][\"')]*\s*$").to_numpy(zero_copy_only=False)[lcodes]
    stopped = np.bincount(ldoc, weights=ends, minlength=n)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.log1p(summed(lens) / total)
    out[:, 2] = np.sqrt(each[:, 2] / letters)
    out[:, 3] = np.sqrt(each[:, 3] / size)
    out[:, 4] = np.sqrt(each[:, 4] / size)
    out[:, 5] = np.sqrt(each[:, 5] / size)
    out[:, 6] = np.sqrt(each[:, 6] / size)
    out[:, 7] = np.log((kinds + 1) / (total + 1)) / np.log(total + 2)
    out[:, 8] = np.sqrt(top / total)
    out[:, 9] = np.sqrt(1 - pairs / np.maximum(pair_doc_total, 1)) * (pair_doc_total > 0)
    out[:, 10] = np.sqrt(repeats / total)
    out[:, 11] = np.sqrt(summed(lens <= 3) / total)
    out[:, 12] = np.log1p(count / np.maximum(lcount, 1))
    out[:, 13] = np.sqrt(1 - lkinds / np.maximum(lcount, 1))
    out[:, 14] = stopped / np.maximum(lcount, 1)
    return out


def hash_pair(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The text's number in the upper 24 bits, 40 bits of the two words' numbers below."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
    return doc.astype(np.uint64) << np.uint64(40) | (h ^ h >> np.uint64(29)) >> np.uint64(24)


@dataclass
class Model:
    center: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]  # of the covariances' lower Cholesky factors
    logs: list[float]  # log prior less half the log determinant
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.center) / self.spread, -CLIP, CLIP)
        d0, d1 = (c - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) for m, inv, c in zip(self.means, self.inverses, self.logs, strict=True))
        return 1 / (1 + np.exp(np.clip(d0 - d1, -500, 500)))


def fit_statistics(x: np.ndarray, y: np.ndarray) -> Model:
    prior = float(y.mean()) if len(y) else 0.5
    center = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
    spread = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(len(NAMES))
    groups = [x[y == k] for k in (0, 1)]
    if min(map(len, groups)) < 2:
        return Model(center, spread, [], [], [], prior)
    groups = [np.clip((g - center) / spread, -CLIP, CLIP) for g in groups]
    means = [g.mean(axis=0) for g in groups]
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * s for g, s in zip(groups, own, strict=True)) / len(x)
    inverses, logs = [], []
    for g, s in zip(groups, own, strict=True):
        s = (1 - POOLED) * s + POOLED * pooled
        s = (1 - ROUND) * s + ROUND * np.trace(s) / len(s) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(low))
        logs.append(float(np.log(len(g) / len(x)) - np.log(np.diag(low)).sum()))
    return Model(center, spread, means, inverses, logs, prior)


def _blocks(texts: pa.Array) -> np.ndarray:
    return np.concatenate([statistics(texts.slice(lo, 1000)) for lo in range(0, len(texts), 1000)]) if len(texts) else np.zeros((0, len(NAMES)))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the rows of ``labels``; a key with several labels teaches its largest."""
    known = labels.where(labels[label].isin(0, 1)).groupBy(labels[key].alias("key")).agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(known), "key").select("y", "text")

    def run(batches):
        bpe.forget_encoders()
        for b in bpe.parts(batches, 1, 1 << 20):
            x = _blocks(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # sums must not depend on the tasks' order
    return fit_statistics(x[order], y[order])


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, and the columns ``keep``) of each row. One narrow stage."""
    store.small_batches(docs.sparkSession)
    out = list(dict.fromkeys([key, *keep]))
    rows = docs.select(*[docs[c] for c in dict.fromkeys([*out, text])])
    kinds, at = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out), rows.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        bpe.forget_encoders()
        for b in bpe.parts(batches, at, 1 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(out)], pa.array(sent.value.scores(_blocks(b.column(at))))], names=[*out, "score"])

    return rows.mapInArrow(run, f"{kinds}, score double")
