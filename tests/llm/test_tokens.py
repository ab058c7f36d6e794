"""Token counts, the token store and the codec against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from bindloom.llm import bpe_codec, store, token_counts, token_store


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def encoded(path, texts):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("which", ["messy", "documents", "nothing"])
def test_counts_are_the_librarys(which, request, word_bpe):
    df = request.getfixturevalue(which)
    rows = pairs(df)
    want = sorted(((i, len((t or "").encode()), len(ids), len(ids) > 20) for (i, t), ids in zip(rows, encoded(word_bpe, [t for _, t in rows]), strict=True)), key=repr)
    got = token_counts.token_counts(df, word_bpe, 20).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got), key=repr) == want
    if which == "messy":
        texts = dict(rows)
        for r in got:
            if r["doc_id"] in (4, 9, 12):
                t = texts[r["doc_id"]]
                fits = [k for k in range(len(t) + 1) if len(encoded(word_bpe, [t[:k]])[0]) <= 20]
                assert r["cut_chars"] == max(fits)


def test_every_prefix_is_counted(word_bpe):
    count = token_counts.counter(word_bpe)
    for text in ("The cat's unbelievable re-entry, we'll see. naïve", "don't they've 12.5% <|endoftext|> x", "日本 🙂 é!", ""):
        assert list(count.prefix(text)) == [len(x) for x in encoded(word_bpe, [text[:k] for k in range(len(text) + 1)])]


@pytest.mark.parametrize("which", ["messy", "documents", "nothing"])
def test_store_gives_back_what_went_in(which, request, spark, word_bpe):
    df = request.getfixturevalue(which)
    path = store.scratch(spark, "test-store")
    base = token_store.write(df, path, word_bpe, 2)
    got = sorted(token_store.read_stats(spark, path, base).collect(), key=lambda r: r["start"])
    rows = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for (i, _), ids in zip(rows, encoded(word_bpe, [t for _, t in rows]), strict=True):
        want.setdefault(i, []).append((len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
    have, at = {}, 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    assert sum(len(r["ids"]) for r in token_store.read_ids(spark, path).collect()) == at


def test_variable_length_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_store.pack(x)
        assert (token_store.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == x).all()


@pytest.mark.parametrize("which", ["messy", "documents", "nothing"])
def test_codec_is_the_librarys(which, request, byte_bpe):
    df = request.getfixturevalue(which)
    rows, t = pairs(df), Tokenizer.from_file(byte_bpe)
    want = []
    for (i, _), ids in zip(rows, encoded(byte_bpe, [t for _, t in rows]), strict=True):
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe_codec.round_trip(df, byte_bpe, words=500).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_codec_texts_come_back(messy, byte_bpe):
    ids = bpe_codec.encode(messy.where("doc_id in (4, 9, 10, 11)"), byte_bpe)
    assert sorted(pairs(bpe_codec.decode(ids, byte_bpe))) == sorted(pairs(messy.where("doc_id in (4, 9, 10, 11)")))


def test_automaton_finds_its_words_alone():
    words = {w.encode(): [i, i + 1] for i, w in enumerate("a ab abc b bc tap taps top tops".split())}
    a = bpe_codec.Automaton.build(words)
    got = a.find([*words, b"", b"t", b"tapss", b"c"])
    assert [a.outputs(n).tolist() for n in got[: len(words)]] == list(words.values()) and (got[len(words) :] == -1).all()
    assert len(a.final) < sum(map(len, words))  # suffixes are shared


ODD = "ab ABC  \t\n\r.,;'-01\u00e9\u00fc\u00a0\u2003\u3000\u200b\x1c\x85\u65e5\u672c"


def test_messy_white_space_is_the_librarys(word_bpe, byte_bpe):
    import random

    from bindloom.llm import bpe

    pick = random.Random(7)
    parts = [*ODD, "'s", "'re", " the ", "<|endoftext|>", "\n\n", "  ", ". ", ", ", "naive", " \n", "\x03"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 50))) for _ in range(3_000)] + ["", " ", "\n ", "a ", "a\n", None, "!,\t\tb", "x\u00a0 \n", "x" * 300]
    import pyarrow as pa

    for path, made in ((byte_bpe, bpe_codec.Codec(byte_bpe)), (word_bpe, bpe.WordChunks(word_bpe))):
        ids, at = made.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == encoded(path, texts)


def test_words_of_letters_are_counted_without_being_cut(monkeypatch):
    import random
    from collections import Counter

    import pyarrow as pa

    from bindloom.llm import bpe

    pick, cut = random.Random(5), []
    parts = [*ODD, "'s", " the ", "\nThe ", " \u00fcber ", "\n\u00c9t\u00e9 ", " na\u00efve", "\u0130 ", " \u01bb ", "<|endoftext|>", ". ", ", ", "\x03"]
    texts = pa.array(["".join(pick.choice(parts) for _ in range(pick.randint(0, 50))) for _ in range(500)] + ["", None, "a", "\nb", "The \u00fcber\nthe end"])
    split, odd = bpe.spaced_split(texts)
    want: Counter = Counter()
    for i in split.codes.tolist():
        want.update(bpe_codec.WORDS.findall(bpe.standing(split.distinct[i])))
    for k in np.flatnonzero(odd):
        want.update(bpe_codec.WORDS.findall(texts[int(k)].as_py()))

    class Cutting:
        def findall(self, text, words=bpe_codec.WORDS):
            cut.append(text)
            return words.findall(text)

    monkeypatch.setattr(bpe_codec, "WORDS", Cutting())
    got: Counter = Counter()
    for b in bpe_codec.counted_words(texts):
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[w] += n
    assert got == want and cut and not {" \u00fcber", "\nThe", " the", "\n\u00c9t\u00e9"} & set(cut)
    assert all(not b.num_rows for b in bpe_codec.counted_words(pa.array([], pa.string()))[:2])


def test_prefix_counts_and_cuts_of_long_chunks_without_blanks(word_bpe):
    import random

    count, pick = token_counts.counter(word_bpe), random.Random(3)
    parts = [*"abC.,!'-09\u00e9\u65e5\u672c\u8a9e\U0001f642\u1100\uac01\u0301\u093e\u0915\u0442\u0435\u00b2", "<|endoftext|>", "<|start", "'s", "'re", "'v", "\u0130", "\ufb01"]
    for _ in range(150):
        t = "".join(pick.choice(parts) for _ in range(pick.randint(1, 24)))
        assert count.chunk(t) == [len(x) for x in encoded(word_bpe, [t[:k] for k in range(len(t) + 1)])]
    for t in ("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 150, "\u0442\u0435\u043a\u0441\u0442" * 160, "a\u65e5" * 450, "\u0e01\u0e47" * 420, "<|endoftext|>" * 60):
        n = [len(x) for x in encoded(word_bpe, [t[:k] for k in range(len(t) + 1)])]
        for room in (1, 57, 200):
            assert count.cut_in(t, room) == max(k for k, x in enumerate(n) if x <= room)
