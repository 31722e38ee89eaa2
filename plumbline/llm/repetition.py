"""Quality rules by repetition inside a text: suffix arrays over words find all repeated substrings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.base import by_bytes, with_rest
from plumbline.llm.bpe import _schema
from plumbline.llm.suffix_arrays import common_prefixes, longest_repeats, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: A longer word is compared code point by code point, so that text without spaces is examined too.
LONG_WORD = 64


@dataclass(frozen=True)
class RepetitionRules:
    """``min_chars``: shorter repeats (code points in words) do not count. ``max_covered``: the share of a text's word
    characters that repeats may cover. ``max_longest``: the share that the longest repeat may have.
    ``min_words`` and ``max_repeat_percent``: the base rules."""

    min_chars: int = 60
    max_covered: float = 0.45
    max_longest: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50


def repeats(ids: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each symbol of several texts laid end to end, the longest repeat inside its own text that begins there."""
    keys = text_of.astype(np.int64) << 32 | ids
    order, _ = suffix_array(keys)
    return longest_repeats(keys, order, common_prefixes(keys, order))


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _per_text(values: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text_of, weights=values, minlength=n).astype(np.int64)


def _spans(ids, sizes, text_of, n_texts, min_chars):
    """Repeat lengths, covered characters and the longest repeat in characters per text."""
    longest = repeats(ids, text_of)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(ids))
    chars = upto[at + longest] - upto[at]
    long = np.flatnonzero((longest > 0) & (chars >= min_chars))
    mask = covered(long, longest[long], len(ids))
    most = np.zeros(n_texts, np.int64)
    np.maximum.at(most, text_of[long], chars[long])
    return longest, _per_text(np.where(mask, sizes, 0), text_of, n_texts), most


def measure(texts: list[str | None], rules: RepetitionRules) -> dict[str, np.ndarray]:
    n = len(texts)
    words = [WORD.findall(t) if t else [] for t in texts]
    number = np.array([len(w) for w in words], np.int64)
    text_of = np.repeat(np.arange(n), number)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(words)), np.int64, len(text_of))
    sizes = np.fromiter(map(len, chain.from_iterable(words)), np.int64, len(text_of))
    longest, cover, most = _spans(ids, sizes, text_of, n, rules.min_chars)
    three = np.flatnonzero(longest >= 3)
    out = {
        "n_words": number,
        "word_chars": _per_text(sizes, text_of, n),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], np.int64),
        "n_dup_lines": np.array([_equal_lines(t) if t and "\n" in t else 0 for t in texts], np.int64),
        "n_repeat_words": _per_text(covered(three, np.full(len(three), 3), len(ids)), text_of, n),
    }
    # texts with words too long to be one symbol are measured again, those words code point by code point
    finer = np.unique(text_of[sizes > LONG_WORD])
    if finer.size:
        symbols, width, owner = [], [], []
        for k, t in enumerate(finer.tolist()):
            for w in words[t]:
                parts = [w] if len(w) <= LONG_WORD else list(w)
                symbols += parts
                width += map(len, parts)
                owner += [k] * len(parts)
        ids = np.fromiter((known.setdefault(w, len(known)) for w in symbols), np.int64, len(symbols))
        _, cover[finer], most[finer] = _spans(ids, np.array(width), np.array(owner), len(finer), rules.min_chars)
    total = np.maximum(out["word_chars"], 1)
    out["covered_fraction"], out["longest_fraction"] = cover / total, most / total
    failed = (number < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * number)
    out["base_failed"] = failed
    out["kept"] = ~failed & (out["covered_fraction"] <= rules.max_covered) & (out["longest_fraction"] <= rules.max_longest)
    return out


def _equal_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_fraction double, longest_fraction double, base_failed boolean, kept boolean"
)


def repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep_columns`` with counts, the share covered by repeats, the longest repeat's share and the verdict of each row.

    The new columns' names begin with ``prefix``.

    Words are runs without space, tab, line feed, vertical tab, form feed or carriage return. A repeat is a run of
    words (of code points inside words of more than 64) that begins at two places of the text, overlapping or not; all
    its places count. A null or empty text has no words, so the base rule on words rejects it. Texts of any length are
    measured whole. Repeated rows and null ids give a row each; an empty table gives no rows.
    """
    columns = list(keep_columns)

    def run(batches):
        for batch in by_bytes(batches, text):
            got = measure(batch.column(text).to_pylist(), rules)
            yield with_rest(batch, columns, {prefix + k: pa.array(v) for k, v in got.items()})

    source = docs.select(*columns, *([text] if text not in columns else []))
    return source.mapInArrow(run, _schema([docs.schema[c] for c in columns], ", ".join(prefix + f for f in FIELDS.split(", "))))
