"""Toxicity by compression distance: a text's windows, compressed with a toxic and with an ordinary dictionary.

Both dictionaries hold the same content trained on ordinary text, so that what ordinary text has in common costs the same in both; the
toxic one ends with the pieces that separate toxic training texts from ordinary ones, the ordinary one begins with as
much more ordinary content. The bytes saved per window are compared with a threshold; how many windows pass, and by how much, gives the
score through a logistic curve. Threshold and curve are calibrated on training texts the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import by_bytes, with_rest
from plumbline.llm.bpe import _schema
from plumbline.llm.language import letters

PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=17, chain_log=14, hash_log=14, search_log=3, min_match=6, target_length=16,
    strategy=zstandard.STRATEGY_GREEDY, write_checksum=False, write_content_size=False, write_dict_id=False,
)


@dataclass(frozen=True)
class ToxicitySettings:
    """``bins``: training texts per label at most (one per bin of the text's hash); ``sample_chars``: code points of each, from a place
    given by its hash. ``base_bytes``: shared ordinary content. ``toxic_bytes``: separating pieces. ``window`` bytes are
    compressed with ``overlap`` more. A piece must occur in ``min_share`` of toxic training texts with log odds of ``min_odds``."""

    bins: int = 2048
    sample_chars: int = 8192
    base_bytes: int = 16 << 10
    toxic_bytes: int = 2 << 10
    window: int = 32
    overlap: int = 12
    min_share: float = 0.025
    min_texts: int = 4
    min_odds: float = 3.0


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=PARAMETERS)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=PARAMETERS)


@dataclass
class ToxicityModel:
    settings: ToxicitySettings
    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 3
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "ready"}

    def savings(self, text: str | None) -> np.ndarray:
        """Per window of the whole text, the bytes that the toxic dictionary saves."""
        raw = f" {letters(text)} ".encode() if text else b""
        if not raw.strip() or not self.toxic:
            return np.zeros(0, np.int64)
        if "ready" not in self.__dict__:
            self.ready = _compressor(self.ordinary), _compressor(self.toxic)
        ordinary, toxic = (c.compress for c in self.ready)
        step, size = self.settings.window, self.settings.window + self.settings.overlap
        windows = [raw[k : k + size] for k in range(0, len(raw), step)]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], np.int64)

    def features(self, saved: np.ndarray) -> tuple[float, float, float]:
        if not len(saved):
            return 0.0, 0.0, 0.0
        passed = int((saved >= self.threshold).sum())
        return max(0, int(saved.max())) / 10, math.log1p(passed) / 4, math.sqrt(passed / len(saved))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(self.savings(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _pieces(text: str) -> set[str]:
    """Words with the space before them, and their beginnings of four letters or more."""
    out = set()
    for word in set(text.split()):
        out.update(" " + word[:k] for k in range(4, min(len(word), 8) + 1))
        out.add(f" {word} ")
    return out


def _separating(toxic: list[str], ordinary: list[str], settings: ToxicitySettings) -> bytes:
    among_toxic, among_ordinary = Counter(), Counter()
    for t in toxic:
        among_toxic.update(_pieces(t))
    least = max(settings.min_texts, settings.min_share * len(toxic))
    frequent = {p for p, n in among_toxic.items() if n >= least}
    for t in ordinary:
        among_ordinary.update(frequent & _pieces(t))
    odds = {p: math.log((among_toxic[p] + 0.5) / (len(toxic) + 1)) - math.log((among_ordinary[p] + 0.5) / (len(ordinary) + 1)) for p in frequent}
    passed = {p for p in frequent if odds[p] >= settings.min_odds}
    # along the beginnings of a word, the longest piece that keeps nearly all of a shorter one's texts stands for it, and
    # pieces that keep few of them add nothing to the shorter one
    kept = set(passed)
    for p in passed:
        for q in (p[:k] for k in range(5, len(p))):
            if q in passed:
                kept.discard(q if among_toxic[p] >= 0.8 * among_toxic[q] else p)
    chosen, content = [], ""
    for p in sorted(kept, key=lambda p: (-among_toxic[p] * odds[p], p)):
        if p not in content and len(content) + len(p) <= settings.toxic_bytes:
            chosen.append(p)
            content += p
    return "".join(reversed(chosen)).encode()


def train(rows: DataFrame, label: str = "toxic", text: str = "text", settings: ToxicitySettings = ToxicitySettings(), labels: DataFrame | None = None, id_column: str = "doc_id") -> ToxicityModel:
    """Learn from a bounded sample of labelled rows: ``bins`` texts per label, ``sample_chars`` code points of each.

    Labels in a table of their own (``labels``) are joined to the hashes of the texts, so that no text is shuffled.

    Two thirds of the sampled texts train the dictionaries; the last third calibrates threshold and curve. With fewer than two
    texts of a label every score is the smoothed share of the toxic rows.
    """
    own = [F.col(id_column)] if labels is not None else [F.col(label)]
    hashed = rows.where(F.col(text).isNotNull()).select(*own, F.xxhash64(text).alias("h"))
    if labels is not None:
        hashed = hashed.join(labels.select(id_column, label), id_column)
    hashed = hashed.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), "h")
    counts = {r["label"]: r["count"] for r in hashed.groupBy("label").count().collect()}
    chosen = hashed.groupBy("label", F.pmod("h", F.lit(settings.bins)).alias("bin")).agg(F.min("h").alias("h")).select("label", "h").distinct()
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    size = settings.sample_chars
    start = F.when(F.length("text") > size, F.pmod(F.shiftright("h", 8), F.length("text") - size + 1)).otherwise(F.lit(0)).cast("int") + 1
    # at most 2 * bins rows of bounded length
    sample = texts.join(F.broadcast(chosen), "h").groupBy("label", "h").agg(F.first(F.substr("text", start, F.lit(size))).alias("text"))
    got: dict[int, list[str]] = {0: [], 1: []}
    for r in sample.orderBy("h", "label").toLocalIterator():
        got[r["label"]].append(r["text"])
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = (counts.get(1, 0) + 1) / (total + 2)
    model = ToxicityModel(settings, weights=[math.log(prior / (1 - prior)), 0.0, 0.0, 0.0])
    if min(len(got[0]), len(got[1])) < 2:
        return model
    fit = {y: [f" {letters(t)} " for k, t in enumerate(ts) if k % 3 < 2] for y, ts in got.items()}
    rest = {y: [t for k, t in enumerate(ts) if k % 3 == 2] or got[y] for y, ts in got.items()}
    pieces = _separating(fit[1], fit[0], settings)
    base = _base(fit[0], settings.base_bytes + len(pieces))
    model.toxic, model.ordinary = base[len(pieces) :] + pieces, base
    saved = {y: [model.savings(t) for t in ts] for y, ts in rest.items()}
    # rows of a label stand for all rows of it
    weight = np.concatenate([np.full(len(saved[y]), counts[y] / max(1, len(saved[y]))) for y in (0, 1)])
    truth = np.concatenate([np.full(len(saved[y]), y) for y in (0, 1)])
    best = -math.inf
    for threshold in range(2, 8):
        trial = ToxicityModel(settings, threshold=threshold)
        x = np.array([(1.0, *trial.features(s)) for y in (0, 1) for s in saved[y]])
        w, fitness = _logistic(x, truth, weight)
        if fitness > best:
            best, model.threshold, model.weights = fitness, threshold, w.tolist()
    return model


def _base(texts: list[str], size: int) -> bytes:
    samples = [t[k : k + 200].encode() for t in texts for k in range(0, len(t), 200)][:20_000]
    try:
        content = zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        content = b""
    return (b"".join(samples) + content)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 50):
    """Newton steps; the gains of all features are held at zero or above, as more saved bytes never mean less toxic."""
    w, weight = np.zeros(x.shape[1]), weight / weight.mean()
    free = np.ones(len(w), bool)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.array([1e-6] + [ridge] * (len(w) - 1))
        gradient = x.T @ (weight * (y - p)) - penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.zeros(len(w))
        move[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        w = w + np.clip(move, -5, 5)
        if (w[1:] < 0).any():
            free[1:] &= w[1:] >= 0
            w[1:] = np.maximum(w[1:], 0)
        if np.abs(move).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float((weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum())


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_columns`` with ``score`` (0 to 1) and ``most_saved``, the largest number of bytes saved in a window.

    All windows of the whole text count. Null, empty and letterless texts get the score of no window saved. Repeated
    rows and null ids give a row each; an empty table gives no rows.
    """
    columns = list(keep_columns)

    def run(batches):
        for batch in by_bytes(batches, text):
            saved = [model.savings(t) for t in batch.column(text).to_pylist()]
            z = [model.weights[0] + float(np.dot(model.weights[1:], model.features(s))) for s in saved]
            yield with_rest(
                batch,
                columns,
                {
                    "score": pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))),
                    "most_saved": pa.array([int(s.max()) if len(s) else 0 for s in saved], pa.int64()),
                },
            )

    source = docs.select(*columns, *([text] if text not in columns else []))
    return source.mapInArrow(run, _schema([docs.schema[c] for c in columns], "score double, most_saved long"))
