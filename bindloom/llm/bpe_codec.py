"""BPE encoding and decoding over a lexicon of frequent words.

The corpus' most frequent words are compiled, with their ids, into a minimal acyclic automaton
that shares prefixes and suffixes; each transition also carries how many words come before it, so
that a walk ends at the word's number and from there at its ids. The automaton is one flat file
that Spark ships to each node once, where workers map it into memory. Words that it lacks are
merged exactly. The lexicon decides speed alone, never ids.

Edge cases: null and empty texts have no ids and decode to ''; special strings inside texts become
what the library makes of them by default; repeated rows are encoded each; other columns of the
input are ignored; texts with one of five control characters, U+0001 to U+0005, go to the library whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, store

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space of the library's pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A chunk that is one word of letters, after its blank or, with LINE, after a line end.
_LETTERS = "[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]+$"
#: Words in the lexicon.
LEXICON_WORDS = 65_536
MAGIC = b"MAFSA1\0\0"


class Automaton:
    """Minimal acyclic automaton of byte strings, each with a list of ids, over flat arrays."""

    def __init__(self, edges, targets, skips, final, bounds, ids):
        self.edges, self.targets, self.skips, self.final, self.bounds, self.ids = edges, targets, skips, final, bounds, ids

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Automaton:
        """Add the words in ascending order; each state that no later word can reach is replaced by
        an equal one that was met before."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple]] = []  # state: final, ((byte, target), ...)

        def close(state: list) -> int:
            kind = (state[0], tuple(state[1]))
            if kind not in register:
                register[kind] = len(done)
                done.append(kind)
            return register[kind]

        path: list[list] = [[False, []]]
        last = b""
        for w in words:
            same = next((i for i, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
            while len(path) > same + 1:
                state = path.pop()
                path[-1][1].append((last[len(path) - 1], close(state)))
            path += [[False, []] for _ in range(len(w) - same)]
            path[-1][0] = True
            last = w
        while len(path) > 1:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], close(state)))
        root = len(done)
        done.append((path[0][0], tuple(path[0][1])))
        number = [root, *range(root)]  # state 0 is the root
        new = np.empty(len(done), np.int64)
        new[number] = np.arange(len(done))
        below, rows = [0] * len(done), []
        for s, (end, out) in enumerate(done):  # targets come before their sources
            n = int(end)
            for byte, t in out:
                rows.append((int(new[s]) << 8 | byte, int(new[t]), n))
                n += below[t]
            below[s] = n
        rows.sort()
        edges = np.array([r[0] for r in rows], "<i8")
        lists = [entries[w] for w in words]
        final = np.zeros(len(done), np.uint8)
        final[new] = [end for end, _ in done]
        return cls(edges, np.array([r[1] for r in rows], "<i4"), np.array([r[2] for r in rows], "<i4"), final, np.cumsum([0, *map(len, lists)]).astype("<i4"), np.array([i for x in lists for i in x], "<u4"))

    def dump(self) -> bytes:
        parts = [self.edges, self.targets, self.skips, self.final, self.bounds, self.ids]
        head = MAGIC + np.array([len(p) for p in parts], "<i8").tobytes()
        out = [head]
        for p in parts:
            out += [p.tobytes(), b"\0" * (-p.nbytes % 8)]
        return b"".join(out)

    @classmethod
    def load(cls, path: str) -> Automaton:
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not an automaton file")
        at, parts = 56, []
        for n, kind in zip(raw[8:56].view("<i8").tolist(), ("<i8", "<i4", "<i4", "u1", "<i4", "<u4"), strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(np.asarray(raw[at : at + size].view(kind)))
            at += size + -size % 8
        return cls(*parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if absent: all words walk the automaton together, a byte a step."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        starts, text = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(words) else lens, np.frombuffer(b"".join(words), np.uint8)
        out, live = np.full(len(words), -1, np.int64), np.arange(len(words))
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(int(lens.max(initial=0)) + 1):
            ended = lens[live] == k
            hit = ended & (self.final[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live) or not len(self.edges):
                break
            want = state << 8 | text[starts[live] + k]
            at = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
            ok = self.edges[at] == want
            live, number, state = live[ok], number[ok] + self.skips[at[ok]], self.targets[at[ok]].astype(np.int64)
        return out

    def outputs(self, number: int) -> np.ndarray:
        return self.ids[self.bounds[number] : self.bounds[number + 1]]


class Codec:
    """Encoder and decoder of one tokenizer file, with or without a lexicon."""

    def __init__(self, tokenizer: str, lexicon: str | None = None):
        self.library = bpe.shared_library(tokenizer)
        self.merges = bpe.merges(tokenizer)
        self.automaton = Automaton.load(lexicon) if lexicon else None
        self.dtype = "<u2" if self.library.get_vocab_size() <= 65_536 else "<u4"
        self.known = bpe.Cache(bpe.WORD_ENTRIES)
        back = {c: i for i, c in enumerate(bpe.SYMBOLS)}
        spelled = [b""] * self.library.get_vocab_size()
        for t, i in self.merges.vocab.items():
            spelled[i] = bytes(back[c] for c in t)
        for i, content in self.merges.added.items():
            spelled[i] = content.encode()
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def words(self, new: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct words: the lexicon's, or exactly merged."""
        out, raw = {}, [w.encode() for w in new]
        if self.automaton:
            a, numbers = self.automaton, self.automaton.find(raw)
            hits = np.flatnonzero(numbers >= 0)
            lo, hi = a.bounds[numbers[hits]].tolist(), a.bounds[numbers[hits] + 1].tolist()
            for k, i, j in zip(hits.tolist(), lo, hi, strict=True):
                out[new[k]] = a.ids[i:j].astype(self.dtype).tobytes()
            left = np.flatnonzero(numbers < 0).tolist()
        else:
            left = range(len(new))
        short = [k for k in left if len(raw[k]) <= 4 * bpe.TOGETHER]
        out |= zip([new[k] for k in short], self.merges.many([raw[k] for k in short], self.dtype), strict=True)
        for k in left:
            if len(raw[k]) > 4 * bpe.TOGETHER:
                out[new[k]] = np.array(self.library.encode(new[k], add_special_tokens=False).ids, self.dtype).tobytes()
        return out

    def learn(self, chunks: list[str]) -> list[bytes]:
        out: list = [None] * len(chunks)
        split: dict[int, list[str]] = {}
        other: list[int] = []
        for i, c in enumerate(chunks):
            if c.isalpha() and (c.isascii() or bpe.PLAIN.fullmatch(c)):  # one word, after one blank
                split[i] = [" " + c]
                continue
            text = bpe.standing(c)
            bare = text.lstrip(WHITE)
            if bare and not bpe.plain(bare):
                other.append(i)
            else:
                split[i] = WORDS.findall(text)
        found = self.words(list({w for ws in split.values() for w in ws}))
        for i, ws in split.items():
            out[i] = found[ws[0]] if len(ws) == 1 else b"".join([found[w] for w in ws])
        for i, e in zip(other, self.library.encode_batch_fast([bpe.standing(chunks[i]) for i in other], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins and the last one ends)."""
        split, odd = bpe.spaced_split(texts)
        ids, at = split.joined(self.known.packed(split.distinct, self.learn), self.dtype)
        if odd.any():
            parts = [ids[i:j] for i, j in zip(at, at[1:], strict=False)]
            for k in np.flatnonzero(odd):
                parts[k] = np.array(self.library.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, self.dtype)
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids; what is no UTF-8 becomes replacement characters."""
        n = self.size[ids]
        ends = np.cumsum(n)
        kind = np.int32 if len(ends) and ends[-1] < 2**31 else np.int64
        places = np.repeat((self.at[ids] - (ends - n)).astype(kind), n)
        places += np.arange(len(places), dtype=kind)
        raw = self.bytes[places].tobytes()
        cut = np.concatenate([[0], ends])[at].tolist()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(cut, cut[1:], strict=False)]


@bpe.kept_encoder(1)  # each run has a lexicon of its own
def codec(tokenizer: str, lexicon: str | None) -> Codec:
    return Codec(tokenizer, SparkFiles.get(lexicon) if lexicon else None)


def counted_words(texts: pa.Array) -> list[pa.RecordBatch]:
    """(word, n) of some texts, a word at most a few times. A chunk of letters is one word, after its blank; after a line
    end it is one beside the line end. The words of others are cut out."""
    split, odd = bpe.spaced_split(texts)
    n = np.bincount(split.codes, minlength=len(split.dictionary))
    chunks, times = split.dictionary, pa.array(n.astype(np.int64))
    letters, led = pc.match_substring_regex(chunks, f"^{_LETTERS}"), pc.match_substring_regex(chunks, f"^{bpe.LINE}{_LETTERS}")
    counts: Counter = Counter({"\n": pc.sum(pc.filter(times, led)).as_py() or 0})
    rest = pc.invert(pc.or_(letters, led))
    for c, k in zip(pc.filter(chunks, rest).to_pylist(), pc.filter(times, rest).to_pylist(), strict=True):
        for w in WORDS.findall(bpe.standing(c)):
            counts[w] += k
    for k in np.flatnonzero(odd):
        counts.update(WORDS.findall(texts[int(k)].as_py()))
    blank, nothing = (pa.scalar(x, chunks.type) for x in (" ", ""))
    whole = pc.binary_join_element_wise(nothing, pc.filter(chunks, letters), blank).cast(pa.string())
    after = pc.utf8_slice_codeunits(pc.filter(chunks, led), 1).cast(pa.string())
    some = {w: k for w, k in counts.items() if k}
    rows = [(whole, pc.filter(times, letters)), (after, pc.filter(times, led)), (pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64()))]
    return [pa.RecordBatch.from_arrays(list(r), names=["word", "n"]) for r in rows]


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n) over all documents; counts are summed within each batch before the shuffle."""

    def run(batches):
        for b in bpe.parts(batches, 0, 2 << 20):
            yield from counted_words(b.column(0))

    return docs.select(docs[text]).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, *, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compile the ``words`` most frequent words of all documents, or some fewer where counts tie, and
    ship the file to every node; returns its name there. Words rarer than that never reach the driver."""
    counts = store.written(word_counts(docs, text=text), "word-counts")
    distinct = counts.count()
    if distinct > words:
        least = counts.agg(F.percentile_approx("n", 1 - words / distinct, 100_000).alias("n")).first()["n"]
        counts = counts.where(F.col("n") > least)
    top = counts.collect()
    m = bpe.merges(tokenizer)
    plain = [r["word"] for r in top if bpe.SPECIAL not in r["word"] and bpe.PLAIN.fullmatch(r["word"].strip(" \n") or "x")]
    raw = [w.encode() for w in plain if len(w.encode()) <= 4 * bpe.TOGETHER]
    ids = [np.frombuffer(x, "<u4").tolist() for x in m.many(raw, "<u4")]
    data = Automaton.build(dict(zip(raw, ids, strict=True))).dump()
    spark = docs.sparkSession
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.mafsa"
    path = f"{store.shared_root(spark)}/{name}"
    store.write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return name


def round_trip(docs: DataFrame, tokenizer: str, *, words: int = LEXICON_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text."""
    store.small_batches(docs.sparkSession)
    lexicon = compile_lexicon(docs, tokenizer, words=words, text=text)
    rows = docs.select(docs[text].alias("text"), docs[key].alias(key))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches):
        c = codec(tokenizer, lexicon)

        def one(b):  # what it works with is gone when it returns
            ids, at = c.encode(b.column(0))
            wide, texts = memoryview(ids.astype("<u4").tobytes()), c.decode(ids, at)
            each = [hashlib.sha256(wide[4 * i : 4 * j]).hexdigest() for i, j in zip(at, at[1:], strict=False)]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.diff(at)), pa.array(each, pa.string()), pa.array(back, pa.string())], names=[*b.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256"])

        yield from map(one, bpe.parts(batches, 0, 2 << 20))
        c.known = bpe.Cache(bpe.WORD_ENTRIES)  # workers outlive their tasks
        bpe.released()

    return rows.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer: str, *, words: int = LEXICON_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each whole text."""
    lexicon = compile_lexicon(docs, tokenizer, words=words, text=text)
    rows = docs.select(docs[key].alias(key), docs[text].alias("text"))

    def run(batches):
        c = codec(tokenizer, lexicon)
        for b in bpe.parts(batches, 1):
            ids, at = c.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of each list of ids; null ids give ''."""
    rows = encoded.select(encoded[key].alias(key), encoded[ids].alias("ids"))

    def run(batches):
        c = codec(tokenizer, None)
        for b in batches:
            lists = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = c.decode(np.concatenate(lists), at) if len(lists) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
