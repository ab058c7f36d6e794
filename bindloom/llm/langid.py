"""Language identification by error-correcting output codes over n-gram classifiers.

Each language has a codeword of bits; for each bit a binary classifier over byte 3-grams tells the
languages with a one there from the others, by the mean log-odds of a text's 3-grams. The
classifiers come from the 3-gram counts of all labelled texts, summed over the cluster, one table
row a language and 3-gram. Decoding adds up, for each language, the loss of each classifier's answer
against that language's bit, weighted by how often the classifier is right on that language, and
takes the least. When the second language's loss is nearly as small, the answer is flagged.

Up to seven languages get the exhaustive code (every way to split them in two), more get random
codewords far from each other. The weights come from at most ``fit_rows`` labelled texts, those of
the smallest hashed ids; everything else covers all data.

Edge cases: null texts and texts without letters are ``und`` with score 0; without any labelled text
every text is ``und``; null languages teach nothing; ties go to the language first in order; other
columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe, store

UNKNOWN = "und"
#: Labelled texts that the weights of the decoding are fitted on, at most.
FIT_ROWS = 4000
#: Losses' relative distance below which two languages count as undecided.
MARGIN = 0.02

# Symbols of 6 bits: 0 what is no letter, 1-26 letters, from 27 on bytes of other letters.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 37
GRAMS = 1 << 18


def _texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, lower-cased, each between blanks; where each text begins and the last one ends)."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lower = pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("  ", lower, "  ", "")])
    lower = lower.combine_chunks() if isinstance(lower, pa.ChunkedArray) else lower
    at = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, lower.offset * 8)
    return np.frombuffer(lower.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _grams(data: np.ndarray) -> np.ndarray:
    """3-grams that end at each byte but the first two."""
    s = _SYMBOL[data]
    return s[:-2] << 12 | s[1:-1] << 6 | s[2:]


def _blocks(data: np.ndarray, at: np.ndarray, size: int = 1 << 19):
    """(first text, grams, where each text's grams begin in them) over at most ``size`` bytes or so.
    A text's first and last two bytes are blanks, so that its 3-grams with letters are its own."""
    for lo in range(0, len(data), size):
        hi = min(len(data), lo + size)
        g = _grams(data[max(0, lo - 2) : hi])
        if not len(g):
            continue
        start = max(0, lo - 2) + 2  # the byte at which the first 3-gram ends
        first = int(np.searchsorted(at, start, side="right")) - 1
        last = int(np.searchsorted(at, hi, side="left"))
        yield first, g, np.maximum(at[first:last] - start, 0)


def gram_sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the table's rows over each text's 3-grams, number of its 3-grams with a letter)."""
    data, at = _texts(texts)
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for first, g, starts in _blocks(data, at):
        rows = table[g]
        keep = np.concatenate([starts[1:] > starts[:-1], [len(g) > starts[-1]]])
        if not keep.any():
            continue
        at_, who = starts[keep], first + np.flatnonzero(keep)
        out[who] += np.add.reduceat(rows, at_, axis=0, dtype=np.float64)
        n[who] += np.add.reduceat((g > 0).astype(np.int64), at_)
    return out, n


def codewords(k: int) -> np.ndarray:
    """(k, bits) of -1 and 1; all bits differ from one another and from their complements."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 7:
        bits = np.array([[1 if (c >> i) & 1 else -1 for c in range(1, 2 ** (k - 1))] for i in range(k - 1)] + [[-1] * (2 ** (k - 1) - 1)])
        return bits.astype(float)
    rng, best, far = np.random.default_rng(7), None, -1
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (k, n))
        c = c[:, np.abs(c.sum(axis=0)) < k]
        d = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
        if d > far:
            best, far = c, d
    return best


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # 3-gram x bit: log-odds
    codes: np.ndarray  # language x bit
    scale: np.ndarray  # bit
    weights: np.ndarray  # language x bit, sum 1 for each language

    def answers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sums, n = gram_sums(texts, self.table)
        return sums / np.maximum(n, 1)[:, None] / self.scale, n

    def losses(self, answers: np.ndarray) -> np.ndarray:
        """(text, language): weighted logistic loss of the answers against the codeword."""
        return np.stack([np.logaddexp(0, -answers * c) @ w for c, w in zip(self.codes, self.weights, strict=True)], axis=1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text."""
        has = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), has
        loss = self.losses(self.answers(texts)[0])
        order = np.argsort(loss, axis=1, kind="stable")
        best = np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] if loss.shape[1] > 1 else best + 1
        odds = np.exp(-4 * (loss - best[:, None]))
        score = np.where(has, 1 / odds.sum(axis=1), 0.0)
        unsure = has & (second - best < MARGIN * (second + best))
        return [self.languages[i] if h else UNKNOWN for i, h in zip(order[:, 0], has, strict=True)], score, unsure


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from all rows of ``labelled`` whose language is not null."""
    rows = labelled.where(labelled[lang].isNotNull() & labelled[text].isNotNull()).select(labelled[lang].alias("lang"), labelled[text].alias("text"), labelled[key].alias("key"))

    def count(batches):
        bpe.forget_encoders()
        for b in bpe.parts(batches, 1):
            langs, out = np.array(b.column(0).to_pylist(), dtype=object), []
            for name in set(langs):
                data, at = _texts(b.column(1).filter(pa.array(langs == name)))
                n = np.zeros(GRAMS, np.int64)
                for _, g, _ in _blocks(data, at):
                    n += np.bincount(g, minlength=GRAMS)
                n[0] = 0  # blanks alone, some of them between texts
                seen = np.flatnonzero(n)
                out.append(pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["lang", "gram", "n"]))
            yield from out

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    codes = codewords(len(languages)) if languages else np.zeros((0, 1))
    if len(languages) < 2:
        bits = codes.shape[1]
        return Model(languages, np.zeros((GRAMS, bits), np.float32), codes, np.ones(bits), np.ones((len(languages), bits)))
    grams, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    share = np.full((len(languages), GRAMS), 0.5)
    for i, name in enumerate(languages):
        share[i, grams[names == name]] += n[names == name]
    share /= share.sum(axis=1, keepdims=True)
    table = np.empty((GRAMS, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        table[:, b] = np.log(share[codes[:, b] > 0].mean(axis=0)) - np.log(share[codes[:, b] < 0].mean(axis=0))
    table[0] = 0  # no letter at all
    # which rows is settled on keys alone, so that texts of no others are moved
    place = F.struct(F.xxhash64("key").alias("h"), F.col("key").alias("key"))
    last = rows.select(place.alias("p")).orderBy("p").limit(fit_rows).agg(F.max("p").alias("p"))
    near = rows.join(F.broadcast(last), place <= F.col("p"))
    sample = near.orderBy(place).limit(fit_rows).select("lang", "text").toArrow()
    model = Model(languages, table, codes, np.ones(codes.shape[1]), np.full(codes.shape, 1 / codes.shape[1]))
    got, who = [], np.array(sample.column("lang").to_pylist(), dtype=object)
    for lo in range(0, sample.num_rows, 500):
        got.append(model.answers(sample.column("text").slice(lo, 500).combine_chunks())[0])
    answers = np.concatenate(got)
    model.scale = np.maximum(np.abs(answers).mean(axis=0) / 2, 1e-6)
    right = np.array([[(np.sign(answers[who == name, b]) == codes[i, b]).mean() if (who == name).any() else 0.5 for b in range(codes.shape[1])] for i, name in enumerate(languages)])
    right = np.maximum(right - 0.5, 0.01)
    model.weights = right / right.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, ambiguous, and the columns ``keep``) of each row. One narrow stage."""
    store.small_batches(docs.sparkSession)
    out = list(dict.fromkeys([key, *keep]))
    rows = docs.select(*[docs[c] for c in dict.fromkeys([*out, text])])
    kinds, at = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out), rows.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language

    def run(batches):
        bpe.forget_encoders()
        for b in bpe.parts(batches, at, 1 << 20):
            lang, score, unsure = sent.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(out)], pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*out, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))
