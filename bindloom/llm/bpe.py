"""Byte-pair encoding shared by the token operators: reading a tokenizer file, exact merging,
and caches of what a chunk of text encodes to.

A text is cut into chunks at places where no token and no normalisation can reach across, so a
chunk's ids do not depend on its neighbours. Chunks repeat heavily in any corpus, so nearly all
work is a dictionary lookup; what a cache has not seen is encoded exactly.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks of these characters alone have one composed form, lower-case to as many characters and
#: hold no white space, in every Unicode version. Any other chunk goes to the tokenizers library.
PLAIN = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]+")
#: A chunk with this may hold a special string, which the library must find.
SPECIAL = "<|"
#: Entries in a task's cache of chunks: a young and an old half, each over by what one slice adds.
CACHE_ENTRIES = 160_000
#: The same where an encoder has a worker to itself.
WORD_ENTRIES = 800_000
#: Bytes of a word up to which words are merged many at a time.
TOGETHER = 32
#: Longer chunks are encoded each time, not cached.
CACHED_CHARS = 48


#: A comma or full stop before white space that may belong to a longer run of marks.
_RUN = r"[^A-Za-z0-9À-ÖØ-öø-įı-ɏ][.,][ \n]"
#: White space of the library's patterns: all of it, and what is other than one blank or line end.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = re.compile(rf"[{_WHITE}]{{2,}}|[^\S \n\x1c-\x1f]")
_WIDE_RE2 = r"[\t-\r \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|[\t\x0b-\r\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Chunks:
    """Whole texts as numbers of distinct chunks: ``distinct[codes[offsets[i]:offsets[i + 1]]]``
    are the chunks of text i. Split and numbered in native code."""

    def __init__(self, texts: pa.Array):
        texts = pc.split_pattern(texts, " ")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        coded = texts.values.dictionary_encode()
        self.offsets = texts.offsets.to_numpy()
        self.codes = coded.indices.to_numpy()
        self.dictionary = coded.dictionary

    @cached_property
    def distinct(self) -> list[str]:
        return self.dictionary.to_pylist()

    def sums(self, each: np.ndarray) -> np.ndarray:
        """For each text, the sum of a number of its chunks."""
        return np.diff(np.concatenate([[0], np.cumsum(each[self.codes], dtype=np.int64)])[self.offsets])

    def joined(self, packed: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins and the last one ends)."""
        size = np.dtype(dtype).itemsize
        lens = np.fromiter(map(len, packed), np.int64, len(packed)) // size
        starts, table = np.concatenate([[0], np.cumsum(lens)[:-1]]), np.frombuffer(b"".join(packed), dtype)
        n = lens[self.codes]
        ends = np.cumsum(n)
        at = np.repeat(starts[self.codes] - (ends - n), n)
        at += np.arange(len(at))
        return table[at], np.concatenate([[0], ends])[self.offsets]


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20):
    """Consecutive parts of a batch with about ``size`` bytes of text each, so that what is worked
    out for a part is bounded by that or by one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def released() -> None:
    """Give back to the system what nothing holds any more: workers outlive their tasks, and an executor's
    memory is theirs and the JVM's together."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def parts(batches, column: int, size: int = 4 << 20):
    """``slices`` of all batches; unused memory is given back before each batch and at a task's end."""
    for batch in batches:
        yield from slices(batch, column, size)
        del batch
        released()


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def word_split(texts: pa.Array) -> Chunks:
    """Chunks for tokenizers that drop white space and split words from marks. A comma or full
    stop that ends a word becomes a chunk of its own, where no longer run of marks is cut."""
    texts = filled(texts)
    plain = pc.invert(pc.match_substring_regex(texts, _RUN))
    lines = pc.replace_substring(texts, "\n", " ")
    return Chunks(pc.if_else(plain, pc.replace_substring(pc.replace_substring(lines, ", ", " , "), ". ", " . "), lines))


#: First characters of chunks of texts whose white space is kept: what stands before the rest. BLANK and BREAK
#: are a blank and a line end inside a longer run of white space.
LINE, HEAD, MARK, BLANK, BREAK = "\x01", "\x02", "\x03", "\x04", "\x05"


def _run_kept(m: re.Match) -> str:
    return " " + HEAD + m[0].replace(" ", BLANK).replace("\n", BREAK)


def spaced_split(texts: pa.Array) -> tuple[Chunks, np.ndarray]:
    """Chunks for byte-level tokenizers, and which texts are not split but empty there: those with the
    characters that chunks begin with.

    A chunk stands for itself after one blank; after its first character LINE for itself after a
    line end, after HEAD or MARK for itself. No token reaches from a character into white space after it, so
    a longer run of white space, or one of other kinds, begins a chunk."""
    texts = filled(texts)
    odd = pc.match_substring_regex(texts, f"[{LINE}-{BREAK}]")
    texts = pc.if_else(odd, "", texts)
    wide = pc.match_substring_regex(texts, _WIDE_RE2)
    if pc.any(wide).as_py():
        mended = [_WIDE.sub(_run_kept, t) for t in pc.filter(texts, wide).to_pylist()]
        texts = pc.replace_with_mask(texts, wide, pa.array(mended, texts.type))
    run = pc.match_substring_regex(texts, _RUN)
    lines = pc.binary_join_element_wise(*[pa.scalar(HEAD, pa.large_string()), pc.replace_substring(texts, "\n", " " + LINE), pa.scalar("", pa.large_string())])
    cut = pc.replace_substring(pc.replace_substring(lines, ", ", f" {MARK}, "), ". ", f" {MARK}. ")
    return Chunks(pc.if_else(run, lines, cut)), odd.to_numpy(zero_copy_only=False)


def standing(chunk: str) -> str:
    """The piece of text that a chunk of ``spaced_split`` stands for."""
    first = chunk[:1]
    if first in (HEAD, MARK) and first:
        return chunk[1:].replace(BLANK, " ").replace(BREAK, "\n")
    return "\n" + chunk[1:] if first == LINE else " " + chunk


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in kept}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


SYMBOLS = byte_symbols()


def spelled(text: str) -> str:
    """Text as symbols, one for each of its UTF-8 bytes."""
    return "".join(map(SYMBOLS.__getitem__, text.encode()))


def library(path: str):
    """The tokenizers library's tokenizer of a file, without truncation, padding or threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Caches of what encoders hold in a worker.
_encoders: list = []


def kept_encoder(size: int):
    """A cache of an encoder or a part of one, which ``forget_encoders`` empties."""

    def wrap(make):
        cached = lru_cache(maxsize=size)(make)
        _encoders.append(cached)
        return cached

    return wrap


def forget_encoders() -> None:
    """Workers outlive their stages: where a task encodes nothing, give up what encoders before it have left."""
    for cached in _encoders:
        cached.cache_clear()


@kept_encoder(2)
def shared_library(path: str):
    """One tokenizer of a file for all that a worker does."""
    return library(path)


class Merges:
    """Exact BPE of one word over a vocabulary file's merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.added = whole["model"], {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.suffix: str = model["end_of_word_suffix"] or ""

    def symbols(self, word: str) -> list[str]:
        """Single symbols of a spelled word; the last one carries the end-of-word mark."""
        return [*word[:-1], word[-1] + self.suffix] if word else []

    def merge(self, parts: list[str]) -> list[str]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left. Only the pairs beside
        a merge get new ranks."""
        rank, none = self.rank.get, len(self.rank)
        parts = list(parts)
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def ids(self, word: str) -> list[int]:
        return [self.vocab[p] for p in self.merge(self.symbols(word))]

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """(id of each byte inside a word, id at its end, pairs of ids in ascending order, rank of each, id that
        each rank makes, ranks of pairs of bytes inside a word)."""
        vocab, size = self.vocab, len(self.vocab)
        inner = np.array([vocab[c] for c in SYMBOLS], np.int64)
        last = np.array([vocab[c + self.suffix] for c in SYMBOLS], np.int64)
        known = [(vocab[x] * size + vocab[y], r, vocab[x + y]) for (x, y), r in self.rank.items()]
        made = np.empty(len(self.rank) + 1, np.int64)
        made[[r for _, r, _ in known]] = [i for _, _, i in known]
        known.sort()
        pairs = np.array([k for k, _, _ in known], np.int64)
        ranks = np.array([r for _, r, _ in known], np.int32)
        of_bytes = _found(inner[:, None] * size + inner, pairs, ranks)
        return inner, last, pairs, ranks, made, of_bytes

    def many(self, words: list[bytes], dtype: str) -> list[bytes]:
        """Packed ids of words: those of one length are merged together, each at its own lowest-ranked pair,
        leftmost first, so that after each step all that still merge have one symbol less."""
        inner, last, pairs, ranks, made, of_bytes = self.tables
        size, none = len(self.vocab), len(self.rank)
        out: list = [None] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lens).tolist():
            at = np.flatnonzero(lens == length)
            if length == 0 or length > TOGETHER:
                for i in at.tolist():
                    out[i] = np.array(self.ids(spelled(words[i].decode())), dtype).tobytes()
                continue
            raw = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, length)
            ids = inner[raw]
            ids[:, -1] = last[raw[:, -1]]
            rank = of_bytes[raw[:, :-1], raw[:, 1:]]
            if self.suffix and length > 1:
                rank[:, -1] = _found(ids[:, -2] * size + ids[:, -1], pairs, ranks)
            while len(at):
                width = ids.shape[1]
                best = rank.argmin(axis=1) if width > 1 else np.zeros(len(at), np.int64)
                low = rank[np.arange(len(at)), best] if width > 1 else np.full(len(at), none)
                done = low >= none
                if done.any():
                    packed, step = ids[done].astype(dtype).tobytes(), width * np.dtype(dtype).itemsize
                    for k, i in enumerate(at[done].tolist()):
                        out[i] = packed[k * step : (k + 1) * step]
                    at, ids, rank, best, low = at[~done], ids[~done], rank[~done], best[~done], low[~done]
                    if not len(at):
                        break
                ids = ids[np.arange(width) != best[:, None] + 1].reshape(len(at), width - 1)
                rank = rank[np.arange(width - 1) != best[:, None]].reshape(len(at), width - 2)
                ids[np.arange(len(at)), best] = made[low]
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
                rank[left, best[left] - 1] = _found(ids[left, best[left] - 1] * size + ids[left, best[left]], pairs, ranks)
                rank[right, best[right]] = _found(ids[right, best[right]] * size + ids[right, best[right] + 1], pairs, ranks)
        return out


def _found(wanted: np.ndarray, pairs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Rank of each wanted pair; one above all ranks if it is none."""
    place = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
    return np.where(pairs[place] == wanted, ranks[place], np.int32(len(pairs)))


class Cache:
    """Packed ids of chunks that were met lately: what half a cache of new ones has not asked for goes."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.half, self.young, self.old = entries // 2, {}, {}

    def packed(self, chunks: list[str], learn) -> list[bytes]:
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = list(map(young.get, chunks))
        new = [i for i, b in enumerate(out) if b is None]
        if old:
            asked, new = new, []
            for i, b in zip(asked, map(old.get, [chunks[i] for i in asked]), strict=True):
                if b is None:
                    new.append(i)
                else:
                    out[i] = young[chunks[i]] = b
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for i, b in zip(some, learn([chunks[i] for i in some]), strict=True):
                out[i] = b
                if len(chunks[i]) <= CACHED_CHARS:
                    young[chunks[i]] = b
        return out


@kept_encoder(2)
def merges(path: str) -> Merges:
    return Merges(path)


#: Words of a tokenizer that drops white space, and contractions that end a word of letters.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def plain(chunk: str) -> bool:
    """Whether the words of a chunk without white space are those of WORDS, one by one."""
    return SPECIAL not in chunk and PLAIN.fullmatch(chunk) is not None


class WordChunks:
    """Ids of texts under a tokenizer that drops white space between words."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.merges = merges(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.size <= 65_536 else "<u4"
        self.known = Cache(WORD_ENTRIES)

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of each chunk: of plain ones from their words, of all others from the library."""
        words, count, rest = [], [], []
        for c in chunks:
            if c.isalpha() and (c.isascii() or PLAIN.fullmatch(c)):
                words.append(c)
                count.append(1)
            elif plain(c):
                own = WORDS.findall(c.lower())
                words += own
                count.append(len(own))
            else:
                rest.append(c)
                count.append(-1)
        found = iter(self.merges.many("\n".join(words).lower().encode().split(b"\n"), self.dtype) if words else [])
        others = iter([np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
        return [next(others) if n < 0 else next(found) if n == 1 else b"".join([next(found) for _ in range(n)]) for n in count]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text begins and the last one ends)."""
        split = word_split(texts)
        return split.joined(self.known.packed(split.distinct, self.learn), self.dtype)


@kept_encoder(2)
def word_chunks(path: str) -> WordChunks:
    return WordChunks(path)
