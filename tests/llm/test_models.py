"""Language identification and the quality classifier: held-out accuracy, edges, independence."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindloom.llm import langid, quality, queries


def test_language_of_held_out_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    true = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert set(got) == set(true) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and r["lang_pred"] != "und" and true[i] is not None]
    assert np.mean([got[i]["lang_pred"] == true[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(messy, nothing):
    model = langid.fit(messy)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(messy, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (6, "und", 0.0)} <= got
    assert all(lang in ("en", "de", "fr", "und") for _, lang, _ in got)
    assert langid.predict(messy, langid.fit(nothing)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(nothing, model).count() == 0
    one = langid.fit(messy.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(messy, one).collect()} == {"en", "und"}


def test_codewords_differ_in_every_bit():
    for k in (2, 3, 4, 7, 9):
        c = langid.codewords(k)
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= 1
        assert all(abs(col.sum()) < k for col in c.T)


def test_wrong_bits_are_corrected():
    c = langid.codewords(4)
    m = langid.Model(list("abcd"), None, c, np.ones(c.shape[1]), np.full(c.shape, 1 / c.shape[1]))
    for i in range(4):
        for b in range(c.shape[1]):
            answer = c[i].copy()
            answer[b] *= -1
            assert m.losses(answer[None])[0].argmin() == i


def test_quality_of_held_out_labels(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, sf_dir).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    held = [(got[i]["score"], y) for i, y in labels if y is not None and i in got and got[i]["held_out"]]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) >= 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_edges(messy, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(messy, quality.fit(messy, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (12, 1), (13, 1), (6, 0), (8, 0), (7, 0), (7, None), (99, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(messy, labels)
    got = quality.score(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(nothing, model).count() == 0
    assert {r["score"] for r in quality.score(messy, quality.fit(messy, labels.where("quality = 1"))).collect()} == {1.0}


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, len(quality.NAMES))), rng.integers(0, 2, 400)
    x[y == 1] *= 1.5
    m = quality.fit_statistics(x, y)
    z = np.clip((x - m.center) / m.spread, -quality.CLIP, quality.CLIP)
    logs = []
    for k in (0, 1):
        inv = m.inverses[k]
        cov = np.linalg.inv(inv.T @ inv)
        d = z - m.means[k]
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


@pytest.mark.parametrize("of", ["langid", "quality"])
def test_models_do_not_depend_on_partitions(of, documents, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fit = (lambda d: langid.fit(d).table) if of == "langid" else (lambda d: np.concatenate(quality.fit(d, labels).means))
    assert np.array_equal(fit(documents), fit(documents.repartition(5, F.rand(1))))


def test_gram_sums_are_plain_sums(documents, messy):
    """Against 3-grams taken one by one from the lower-cased text between two blanks on either side."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    table = rng.normal(size=(langid.GRAMS, 2)).astype(np.float32)
    texts = [r["text"] for r in messy.collect()] + [r["text"] for r in documents.limit(60).collect()]

    def symbol(b):
        return b - 96 if 97 <= b <= 122 else 27 + (b - 128) % 37 if b >= 128 else 0

    sums, n = langid.gram_sums(pa.array(texts, pa.string()), table)
    for t, got, count in zip(texts, sums, n, strict=True):
        s = [symbol(b) for b in f"  {(t or '').lower()}  ".encode()]
        grams = [a << 12 | b << 6 | c for a, b, c in zip(s, s[1:], s[2:], strict=False)]
        # those of blanks alone count in the sums, not in the number
        assert count == sum(g > 0 for g in grams)
        letters = [g for g in grams if g > 0]
        blanks = got - table[letters].sum(axis=0, dtype=np.float64) if letters else got
        assert np.allclose(blanks / table[0], np.round(blanks / table[0]), atol=1e-2)


def plain_statistics(text):
    """The same fifteen numbers, from counting."""
    import re
    from collections import Counter

    raw = text.encode()
    kind = Counter("space" if b in b"\t\n\x0b\x0c\r " else "lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "other" if b >= 128 else "mark" if chr(b) in ".,;:'\"?-()" else "sign" for b in raw)
    size, letters = max(len(raw), 1), max(kind["lower"] + kind["upper"] + kind["other"], 1)
    words = re.sub(r"[\t\n\x0c\r ]+", " ", text).split(" ")
    lines = text.split("\n")
    total, lens = float(len(words)), [len(w.encode()) for w in words]
    pairs = list(zip(words, words[1:], strict=False))
    return [
        np.log1p(total), np.log1p(sum(lens) / total), np.sqrt(kind["upper"] / letters), np.sqrt(kind["digit"] / size), np.sqrt(kind["mark"] / size), np.sqrt(kind["sign"] / size), np.sqrt(kind["other"] / size),
        np.log((len(set(words)) + 1) / (total + 1)) / np.log(total + 2), np.sqrt(max(Counter(words).values()) / total), np.sqrt(1 - len(set(pairs)) / len(pairs)) if pairs else 0.0, np.sqrt(sum(a == b for a, b in pairs) / total),
        np.sqrt(sum(n <= 3 for n in lens) / total), np.log1p(total / len(lines)), np.sqrt(1 - len(set(lines)) / len(lines)), sum(bool(re.search(r"[.!?][\"')]*[\t\n\x0c\r ]*$", x)) for x in lines) / len(lines),
    ]


def test_statistics_are_what_counting_gives(documents, messy):
    import pyarrow as pa

    texts = [r["text"] for r in messy.collect() if len(r["text"] or "") < 5_000] + [r["text"] for r in documents.limit(80).collect()]
    got = quality.statistics(pa.array(texts, pa.string()))
    want = np.array([plain_statistics(t or "") for t in texts])
    for k, name in enumerate(quality.NAMES):
        assert np.allclose(got[:, k], want[:, k], atol=1e-9), name
