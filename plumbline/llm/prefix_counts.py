"""Exact token counts of every prefix of a text, by dynamic programming.

A sequence of tokens is what BPE gives for its bytes exactly when every two neighbours in it are what BPE gives for
theirs. So the encoding of a prefix is the encoding of a shorter prefix and one more token that goes with the last one
there, and

    count[i] = count[i - len(token)] + 1

where the token is the only one that ends at i and goes with the last token of the prefix before it. The table of a
text answers how many tokens any prefix has and where a budget of tokens ends, with no further encoding. Tables are
kept per part between two places where the split pattern always cuts, and repeated parts are looked up.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from plumbline.llm.base import by_bytes, with_rest
from plumbline.llm.bpe import CHUNK, KNOWN_LENGTH, KNOWN_PARTS, WHITE, WORDS, _schema, vocabulary

#: Known neighbours per Python worker.
KNOWN_PAIRS = 1_000_000
#: Known words per Python worker; parts that differ in punctuation share their words.
KNOWN_WORDS = 100_000
#: Lengths in bytes of the beginnings of words whose rows are kept.
BEGINNINGS = (8, 5)
#: Endings that the split pattern takes whole; cut short they split otherwise.
SHORT_ENDINGS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
BLANK = re.compile(f"[{WHITE}]*")
_last = itemgetter(-1)


class PrefixCounter:
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.goes: dict[int, bool] = {}
        self.begun: dict[bytes, tuple[list[int], list[int]]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        #: The lengths of the tokens that can end with the same four bytes, longest first.
        ends: dict[bytes, set[int]] = {}
        for token in self.vocab.ids:
            if len(token) > 3:
                ends.setdefault(token[-4:], {n for n in (1, 2, 3) if token[-n:] in self.vocab.ids}).add(len(token))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}

    def pair_goes(self, left: int, right: int) -> bool:
        key = left << 16 | right
        got = self.goes.get(key)
        if got is None:
            vocab = self.vocab
            got = vocab.merge(vocab.bytes_of[left] + vocab.bytes_of[right]) == (left, right)
            if len(self.goes) >= KNOWN_PAIRS:
                self.goes.clear()
            self.goes[key] = got
        return got

    def word(self, raw: bytes) -> list[int]:
        """Counts of the prefixes of 1, 2, ... bytes of one word of the split pattern."""
        ids, ends, goes, pair_goes = self.vocab.ids.get, self.ends.get, self.goes.get, self.pair_goes
        count, last = [0], [-1]
        # words that begin alike share the rows of their beginning
        for size in BEGINNINGS:
            if len(raw) > size and (begun := self.begun.get(raw[:size])):
                count, last = begun[0].copy(), begun[1].copy()
                break
        for i in range(len(count), len(raw) + 1):
            for size in ends(raw[i - 4 : i], (3, 2, 1)) if i > 3 else range(i, 0, -1):
                if size > i or (token := ids(raw[i - size : i])) is None:
                    continue
                before = last[i - size]
                if before >= 0 and (ok := goes(before << 16 | token)) is not True and (ok is False or not pair_goes(before, token)):
                    continue
                count.append(count[i - size] + 1)
                last.append(token)
                break
            else:
                raise ValueError("a byte has no token")
            if i in BEGINNINGS:
                if len(self.begun) >= KNOWN_PARTS:
                    self.begun.clear()
                self.begun[raw[:i]] = (count.copy(), last.copy())
        return count[1:]

    def _letters(self, text: str) -> tuple[int, ...]:
        """The same for the prefixes of 1, 2, ... code points."""
        if (known := self.words.get(text)) is not None:
            return known
        counts = self.word(text.encode())
        out = tuple(counts if text.isascii() else (counts[k - 1] for k in accumulate(len(c.encode()) for c in text)))
        if len(text) <= KNOWN_LENGTH:
            if len(self.words) >= KNOWN_WORDS:
                self.words.clear()
            self.words[text] = out
        return out

    def _cut_short(self, word: str) -> list[int]:
        return [sum(self.word(w.encode())[-1] for w in WORDS.findall(word[:k])) for k in range(1, len(word) + 1)]

    def part(self, text: str) -> tuple[int, ...]:
        """Counts of the prefixes of 1, 2, ... code points of white space and what follows it."""
        blank = BLANK.match(text).end()
        counts = list(self._letters(text[:blank])) if blank else []
        at = before = 0
        for word in WORDS.findall(text):
            at += len(word)
            own = self._cut_short(word) if word in SHORT_ENDINGS else self._letters(word)
            if at > blank:
                counts += [before + n for n in own[len(counts) - (at - len(word)) :]]
            before += own[-1]
        return tuple(counts)

    def _missing(self, part: str) -> tuple[int, ...]:
        counts = self.older.get(part) or self.part(part)
        if len(part) <= KNOWN_LENGTH:
            if len(self.known) >= KNOWN_PARTS // 2:
                self.older, self.known = self.known, {}
            self.known[part] = counts
        return counts

    def tables(self, text: str) -> list[tuple[int, ...]]:
        """The prefix counts of each part in turn, each beginning from nothing."""
        vocab = self.vocab
        if vocab.split_special and any(s in text for s in vocab.special):
            out, before = [], ""
            for piece in vocab.split_special.split(text):
                if piece in vocab.special:
                    # a special string that is cut short is ordinary text and joins the part before it
                    base = self.part(before)[-1] if before else 0
                    out.append((*(self.part(before + piece[:k])[-1] - base for k in range(1, len(piece))), 1))
                    before = ""
                elif piece:
                    parts = CHUNK.findall(piece)
                    out += [self.known.get(p) or self._missing(p) for p in parts]
                    before = parts[-1]
            return out
        get, missing = self.known.get, self._missing
        return [get(p) or missing(p) for p in CHUNK.findall(text)]

    def every_prefix(self, text: str) -> np.ndarray:
        """The count of each prefix of 1, 2, ... code points of a text."""
        tables = self.tables(text)
        before = np.cumsum([0] + [t[-1] for t in tables])
        return np.concatenate([np.asarray(t, np.int32) + b for t, b in zip(tables, before, strict=False)] or [np.empty(0, np.int32)])

    def budget(self, text: str, limit: int) -> tuple[int, int]:
        """The tokens of the text, and how many code points its longest prefix of at most ``limit`` tokens has."""
        tables = self.tables(text)
        total = sum(map(_last, tables))
        if total <= limit:
            return total, len(text)
        ends = list(accumulate(map(_last, tables)))
        k = bisect_left(ends, limit)  # whole parts before k stay below the limit
        if ends[k] == limit:
            k += 1
        before, chars = ends[k - 1] if k else 0, sum(map(len, tables[:k]))
        inside = max((n for n, c in enumerate(tables[k], 1) if before + c <= limit), default=0)
        return total, chars + inside


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, text: str = "text", keep_columns: tuple[str, ...] = (), out: str = "prefix_tokens") -> DataFrame:
    """``keep_columns`` and an array with the token count of every prefix of 1, 2, ... code points.

    A null or empty text gives an empty array. Repeated rows give a row each; an empty table gives no rows.
    """
    columns = list(keep_columns)

    def run(batches):
        table = counter(path)
        for batch in by_bytes(batches, text):
            counts = [table.every_prefix(t) if t else [] for t in batch.column(text).to_pylist()]
            yield with_rest(batch, columns, {out: pa.array(counts, pa.list_(pa.int32()))})

    return docs.select(*columns, *([text] if text not in columns else [])).mapInArrow(run, _schema([docs.schema[c] for c in columns], f"{out} array<int>"))


def token_budget(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` and ``fit_chars``.

    ``fit_chars`` is the length in code points of the longest prefix of at most ``limit`` tokens (the whole text when it
    fits). Null and empty texts have zeros and are not over the limit. Special strings inside a text count as one token.
    Repeated rows and null ids give a row each; other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        table = counter(path)
        for batch in by_bytes(batches, text):
            texts = batch.column(text).to_pylist()
            got = [table.budget(t, limit) if t else (0, 0) for t in texts]
            tokens = np.array([n for n, _ in got], np.int64)
            yield with_rest(
                batch,
                [id_column],
                {
                    "n_bytes": pa.compute.binary_length(batch.column(text)).fill_null(0).cast(pa.int64()),
                    "n_tokens": pa.array(tokens),
                    "over_limit": pa.array(tokens > limit),
                    "fit_chars": pa.array([c for _, c in got], pa.int64()),
                },
            )

    schema = _schema([docs.schema[id_column]], "n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return docs.select(id_column, text).mapInArrow(run, schema)
