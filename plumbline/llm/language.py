"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import by_bytes, with_rest
from plumbline.llm.bpe import _schema

OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: Short matches count: languages differ in syllables more than in phrases.
PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=16,
    strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False,
)


def letters(text: str) -> str:
    """Lower case, with one space for all that is not a letter."""
    return OTHER.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageSettings:
    """``bins``: training texts per language at most (the text of smallest hash in each bin of the text hash).
    ``sample_chars``: code points fetched from the middle of each. ``dictionary_bytes``: raw content per language, the last of what was sampled. ``window_bytes``: a text is compressed in windows of this size, so
    that a long text keeps drawing on the dictionary and not on itself. ``min_margin``: a text whose best size is not
    smaller than the second best by this share is rejected. ``max_languages``: more labels than this are refused.
    """

    bins: int = 64
    sample_chars: int = 8192
    dictionary_bytes: int = 32 << 10
    window_bytes: int = 2048
    min_margin: float = 0.01
    max_languages: int = 500


def bounded_sample(rows: DataFrame, label: str, text: str, bins: int, chars: int) -> DataFrame:
    """At most one text per label and bin of the text's hash: the middle ``chars`` code points of the one of the smallest hash. Needs no sort and no
    group in one task: the first pass aggregates numbers, the second fetches the texts of those few hashes."""
    hashed = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    hashed = hashed.where(F.length(F.trim("text")) > 0).withColumn("h", F.xxhash64("text"))
    chosen = hashed.groupBy("label", F.pmod("h", F.lit(bins)).alias("bin")).agg(F.min("h").alias("h")).select("label", "h")
    # at most bins rows of bounded length per label
    start = F.greatest(F.lit(0), F.floor((F.length("text") - chars) / 2)).cast("int") + 1
    part = F.substr("text", start, F.lit(chars)).alias("text")
    return hashed.join(F.broadcast(chosen), ["label", "h"]).select("label", "h", part).groupBy("label", "h").agg(F.first("text").alias("text")).orderBy("label", "h")


class CompressionClassifier:
    """Sizes of texts under one raw-content dictionary per label."""

    def __init__(self, contents: dict[str, bytes], settings: LanguageSettings):
        self.contents, self.settings, self.ready = contents, settings, None

    def __getstate__(self):
        return self.contents, self.settings

    def __setstate__(self, state):
        self.contents, self.settings = state
        self.ready = None

    def compressors(self):
        if self.ready is None:
            self.ready = []
            for content in self.contents.values():
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=PARAMETERS)
                self.ready.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=PARAMETERS))
        return self.ready

    def sizes(self, text: str) -> np.ndarray:
        raw, step = letters(text).encode(), self.settings.window_bytes
        windows = [raw[k : k + step] for k in range(0, len(raw), step)]
        return np.array([sum(len(c.compress(w)) for w in windows) for c in self.compressors()], np.int64)


def train(rows: DataFrame, label: str = "lang", text: str = "text", settings: LanguageSettings = LanguageSettings()) -> CompressionClassifier:
    """Dictionaries from a bounded sample of labelled rows: ``bins`` texts per language, ``dictionary_bytes`` of them.

    Each text gives an equal share, taken from its middle, so that one long text doesn't fill a dictionary. The labels
    are ordered by their count, the most frequent first, which decides ties.
    """
    counts = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(label).alias("label")).count()
    order = [r["label"] for r in counts.orderBy(F.desc("count"), "label").limit(settings.max_languages + 1).collect()]
    if len(order) > settings.max_languages:
        raise ValueError("more languages than max_languages")
    texts: dict[str, list[bytes]] = {}
    for row in bounded_sample(rows, label, text, settings.bins, settings.sample_chars).toLocalIterator():
        raw = letters(row["text"]).encode()
        share = max(settings.dictionary_bytes // settings.bins, 256) * 2
        start = max(0, len(raw) // 2 - share // 2)
        texts.setdefault(row["label"], []).append(raw[start : start + share])
    contents = {k: b" ".join(texts[k])[-settings.dictionary_bytes :] for k in order if texts.get(k)}
    return CompressionClassifier(contents, settings)


def identify(docs: DataFrame, model: CompressionClassifier, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_columns`` with ``nearest`` (the language of the smallest size), ``language``, ``margin`` and ``score``.

    ``language`` is ``und`` where the margin, the second size less the best as a share of it, is below ``min_margin``.
    A null text, or one without a letter, is ``und`` in both columns with margin and score 0. Equal sizes go to the
    language with more training rows. The whole text counts. The score is 1 over the number of languages when all sizes agree and
    nears 1 as the margin grows. Repeated rows and null ids give a row each; with no trained language every row is ``und``.
    """
    columns = list(keep_columns)
    least = model.settings.min_margin

    def one(value):
        if not value or not model.contents or not any(map(str.isalpha, value)):
            return UNKNOWN, UNKNOWN, 0.0, 0.0
        sizes = model.sizes(value)
        names = list(model.contents)
        best = int(sizes.argmin())
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / max(1, others.min())) if len(others) else 1.0
        score = 1.0 / float(np.exp(np.minimum(0.0, -100.0 * (sizes - sizes[best]) / sizes[best])).sum())
        return names[best], names[best] if margin >= least else UNKNOWN, margin, score

    def run(batches):
        for batch in by_bytes(batches, text):
            got = [one(t) for t in batch.column(text).to_pylist()]
            nearest, language, margin, score = zip(*got, strict=True) if got else ((),) * 4
            yield with_rest(
                batch,
                columns,
                {
                    "nearest": pa.array(nearest, pa.string()),
                    "language": pa.array(language, pa.string()),
                    "margin": pa.array(margin, pa.float64()),
                    "score": pa.array(score, pa.float64()),
                },
            )

    source = docs.select(*columns, *([text] if text not in columns else []))
    return source.mapInArrow(run, _schema([docs.schema[c] for c in columns], "nearest string, language string, margin double, score double"))
