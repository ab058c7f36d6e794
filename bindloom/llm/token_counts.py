"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The last token of a BPE encoding is the one vocabulary entry that ends the prefix and whose pair
with the last token before it survives merging unchanged; so the encoding of every prefix of a
word follows from those of its shorter prefixes, and one pass over a word yields the count at
each of them. Words share prefixes, so a worker keeps the state of each prefix it has met. With them come, with
no further encoding, the count of a whole text, that of any prefix of it, and the longest prefix
within a budget.

Counts are those of the tokenizers library for the prefix taken as a text of its own, without
added special tokens; special strings inside texts count as the library treats them by default.

A chunk of other than plain characters is cut where neither composition nor a word can reach across, and
at complete special strings; each piece of one kind of character is a word whose prefixes are counted the
same way. Only pieces with characters that compose, or around an apostrophe, go to the library, prefix by
prefix. So the cut for a budget is exact in every text.

Edge cases: null and empty texts have count 0 and cut 0; repeated rows are counted each; other
columns of the input are ignored.
"""

from __future__ import annotations

import array
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe

#: Contractions whose prefixes split otherwise.
CUT_SHORT = {"'re", "'ve", "'ll"}
#: Entries of a worker's tables of prefix states and of chunk totals; at these sizes they start anew.
STATES, TOTALS = 700_000, 1_000_000
#: Longer chunks are counted whole by the library; prefixes of longer words have states by place.
LADDER_CHARS = 400
#: Prefixes that the library counts at a time.
AT_ONCE = 512


@lru_cache(maxsize=65_536)
def kind(c: str) -> str:
    """L, N or P: which of the classes of WORDS a character is of, if it never composes with what stands before it
    and its lower case is one character of that class; '' for all others."""

    def of(x: str) -> str:
        k = unicodedata.category(x)[0]
        return k if k in "LN" else "P" if k in "PS" else ""

    low = c.lower()
    jamo = "\u1100" <= c <= "\u11ff" or "\ua960" <= c <= "\ua97f" or "\ud7b0" <= c <= "\ud7ff"
    alone = len(low) == 1 and unicodedata.is_normalized("NFC", c) and unicodedata.is_normalized("NFC", low) and not jamo
    return of(c) if alone and of(c) == of(low) else ""


def pieces(text: str) -> list[str]:
    """Parts of a text without white space whose prefixes do not depend on the parts before: cut where two
    characters of known and different kinds meet, and between numbers. An apostrophe may belong to what follows."""
    kinds = [kind(c) for c in text]
    out, last = [], 0
    for i in range(1, len(text)):
        a, b = kinds[i - 1], kinds[i]
        if a and b and (a != b or a == "N") and (text[i - 1] != "'" or not text[i].isascii()):
            out.append(text[last:i])
            last = i
    return [*out, text[last:]] if text else []


class PrefixCounts:
    """Counts for one tokenizer file of the kind that marks word ends and drops white space."""

    def __init__(self, path: str):
        self.merges = bpe.merges(path)
        self.library = bpe.library(path)
        mark = self.merges.suffix
        if not mark:
            raise ValueError("prefix counts need a vocabulary with end-of-word marks")
        self.inner = {t for t in self.merges.vocab if not t.endswith(mark)}
        self.final = {t[: -len(mark)] for t in self.merges.vocab if t.endswith(mark)}
        self.specials = list(self.merges.added.values())
        self.longest = max(map(len, [*self.inner, *self.final, *self.specials]))
        self.stable: dict[tuple[str, str, bool], bool] = {}
        self.states: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.totals: dict[str, int] = {}

    def fits(self, before: str, token: str, last: bool) -> bool:
        """Whether merging leaves ``before`` and ``token`` as they are ('' before: token alone)."""
        key = (before, token, last)
        if (found := self.stable.get(key)) is None:
            mark = self.merges.suffix if last else ""
            parts = [*before, *token[:-1], token[-1] + mark]
            found = self.merges.merge(parts) == ([before, token + mark] if before else [token + mark])
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            self.stable[key] = found
        return found

    def state(self, prefix: str) -> tuple[str, int]:
        """(last token, count) of a spelled word's prefix with more of the word to come. Words
        share prefixes, so each state is worked out once and kept."""
        if (found := self.states.get(prefix)) is not None:
            return found
        k = len(prefix) - 1
        while k and prefix[:k] not in self.states:
            k -= 1
        inner, longest, fits, states = self.inner, self.longest, self.fits, self.states
        if len(states) > STATES:
            states.clear()
            states[""], k = ("", 0), 0
        line = [states[prefix[:i]] if i <= k and prefix[:i] in states else None for i in range(len(prefix) + 1)]
        for j in range(1, len(prefix) + 1):
            if line[j] is not None:
                continue
            for i in range(max(0, j - longest), j):
                t = prefix[i:j]
                if t in inner and line[i] is not None and fits(line[i][0], t, False):
                    line[j] = states[prefix[:j]] = (t, line[i][1] + 1)
                    break
        return line[-1]

    def whole(self, word: str) -> int:
        """Count of a spelled word taken as a whole word."""
        final, fits, state = self.final, self.fits, self.state
        for i in range(max(0, len(word) - self.longest), len(word)):
            t = word[i:]
            if t in final:
                before, n = state(word[:i])
                if fits(before, t, True):
                    return n + 1
        raise ValueError(f"no encoding of {word!r}")

    def ladder(self, word: str) -> list[int]:
        """Count of each prefix of a spelled word, each prefix as a whole word. Long words keep their
        states by place, not by prefix."""
        if len(word) <= LADDER_CHARS:
            return [self.whole(word[:k]) for k in range(1, len(word) + 1)]
        inner, final, longest, fits = self.inner, self.final, self.longest, self.fits
        line: list[tuple[str, int] | None] = [("", 0)]
        out = []
        for j in range(1, len(word) + 1):
            places, state, n = range(max(0, j - longest), j), None, None
            for i in places:
                t = word[i:j]
                if state is None and t in inner and line[i] is not None and fits(line[i][0], t, False):
                    state = (t, line[i][1] + 1)
                if n is None and t in final and line[i] is not None and fits(line[i][0], t, True):
                    n = line[i][1] + 1
            line.append(state)
            out.append(n)
        return out

    def exact(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def chunk(self, chunk: str) -> list[int]:
        """Count at each code point prefix of a chunk, from 0 code points on. A special string is one token once
        it is complete; what stands before and after it is text of its own."""
        got = [0]
        while chunk:
            at, special = min(((i, s) for s in self.specials if (i := chunk.find(s)) >= 0), default=(len(chunk), ""))
            part, base = chunk[: at + len(special)], got[-1]
            steps = self.text(part)
            got += [base + n for n in steps[1:]]
            if special:
                got[-1] = base + steps[at] + 1
            chunk = chunk[len(part) :]
        return got

    def text(self, text: str) -> list[int]:
        """Count at each code point prefix of a text without white space, all of it taken as words."""
        if bpe.PLAIN.fullmatch(text):
            return self.plain_text(text)
        got = [0]
        for piece in pieces(text):
            base = got[-1]
            got += [base + n for n in self.piece(piece)[1:]]
        return got

    def plain_text(self, text: str) -> list[int]:
        got, base = [0], 0
        for word in bpe.WORDS.findall(text.lower()):
            if word in CUT_SHORT:  # cut short, the contraction is no word of its own
                first = self.whole("'")
                steps = [first, first + self.whole(word[1]), self.whole(word)]
            else:
                steps = self.word(word)
            got += [base + s for s in steps]
            base = got[-1]
        return got

    def word(self, word: str) -> list[int]:
        """Count of each code point prefix of a lower-case word."""
        steps = self.ladder(word if word.isascii() else bpe.spelled(word))
        return steps if word.isascii() else [steps[e - 1] for e in accumulate(len(c.encode()) for c in word)]

    def piece(self, piece: str) -> list[int]:
        if bpe.PLAIN.fullmatch(piece):
            return self.plain_text(piece)
        if "'" not in piece and all(map(kind, piece)):  # all of one kind: one word
            steps = self.word(piece.lower())
            if steps[-1] == self.exact(piece):
                return [0, *steps]
        out = [0]
        for lo in range(1, len(piece) + 1, AT_ONCE):
            some = [piece[:k] for k in range(lo, min(lo + AT_ONCE, len(piece) + 1))]
            out += [len(e.ids) for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def count(self, chunk: str) -> int:
        """Count of a whole chunk."""
        if len(chunk) > LADDER_CHARS or not bpe.plain(chunk):
            return self.exact(chunk)
        return sum([self.whole(w if w.isascii() else bpe.spelled(w)) for w in bpe.WORDS.findall(chunk.lower())])

    @staticmethod
    def chunks(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def totals_of(self, texts: pa.Array) -> np.ndarray:
        """Exact count of each whole text."""
        split, got = bpe.word_split(texts), self.totals
        if len(got) > TOTALS:
            got = self.totals = {}
        each = list(map(got.get, split.distinct))
        for i, n in enumerate(each):
            if n is None:
                c = split.distinct[i]
                each[i] = n = self.count(c)
                if len(c) <= bpe.CACHED_CHARS:
                    got[c] = n
        return split.sums(np.array(each, np.int64))

    def prefix(self, text: str | None) -> array.array:
        """Exact count at each code point prefix: n_chars + 1 numbers."""
        out, base = array.array("I", [0]), 0
        for i, c in enumerate(self.chunks(text or "")):
            steps = self.chunk(c)
            if i:
                out.append(base)  # the blank before the chunk adds nothing
            out.extend(base + s for s in steps[1:])
            base += steps[-1]
        return out

    def cut(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens, from the kept counts."""
        if not text:
            return 0
        chunks, total = self.chunks(text), self.totals
        before = [0, *accumulate(total[c] if c in total else self.count(c) for c in chunks)]
        last = bisect_right(before, budget, hi=len(chunks)) - 1
        return sum(map(len, chunks[:last])) + last + self.cut_in(chunks[last], budget - before[last])

    def cut_in(self, chunk: str, room: int) -> int:
        """Code points of a chunk's longest prefix of at most ``room`` tokens. No token is longer than
        ``longest``, so only as much of the chunk counts as ``room`` of them could hold."""
        return max(k for k, n in enumerate(self.chunk(chunk[: room * self.longest + 1])) if n <= room)


@bpe.kept_encoder(2)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, cut_chars) of each row: UTF-8 length, exact token
    count, whether that is above ``limit``, and the code points of the longest prefix within it.
    One narrow stage: nothing is shuffled."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = count.totals_of(b.column(1)).tolist()
            cut = [len(t or "") if k <= limit else count.cut(t, limit) for t, k in zip(texts, n, strict=True)]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(cut, pa.int64())], names=[key, "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts): the exact count at every code point prefix of each text, as an array."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], b.schema.field(0).type), pa.array([list(count.prefix(t))], pa.list_(pa.int32()))], names=[key, "counts"])

    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, counts array<int>")
