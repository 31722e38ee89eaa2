"""Removal of repeated byte strings of a corpus by suffix arrays of bounded shards.

A string of ``min_bytes`` bytes that begins at two places of the corpus is removed at each of them. To bring equal
strings together without moving every suffix, each window of ``min_bytes`` bytes is assigned to one anchor inside it: the
fragment of ``anchor_bytes`` bytes with the smallest hash. The choice depends on the window's bytes alone, so equal windows have equal
anchors at equal offsets, and consecutive windows with one anchor form a piece of text.

1. Every piece is described by the hash of its anchor and a hash of its bytes, and these are counted.
2. Anchors seen once need nothing more; pieces seen twice or more are repeated as a whole.
3. Anchors with different pieces are compared by suffix arrays. The distinct pieces of an anchor go to a shard (several, by
   hash, if there are many); a task sorts the suffixes of a bounded run of pieces (Larsson-Sadakane), takes their
   common prefixes (Kasai) and marks windows whose neighbour shares ``min_bytes`` bytes.
4. Windows of anchors that were divided between runs are merged across them: every run hands on its windows in order, packed, as
   hashes of 128 bits. The hashes are cut into ranges, as many as the windows need, and a task finds each run's part of its range
   among those of the runs before by binary search.
5. The marked windows go back to the texts, which are cut.

Texts are known by a hash of their bytes here, so copies of a text share one description and no row needs an id.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import attach_by_size, by_bytes, keep, with_rest
from plumbline.llm.bpe import _schema
from plumbline.llm.suffix_arrays import common_prefixes, suffix_array

MIN_BYTES = 400
#: A longer anchor is shared by fewer windows that differ; a shorter one gives longer pieces.
ANCHOR_BYTES = 200
#: Pieces of one anchor in a shard.
SHARD_PIECES = 256
#: Bytes of pieces whose suffixes a task sorts at once.
RUN_BYTES = 512 << 10
#: Packed windows of a row, windows of a range of the merge (on average), and the least number of ranges.
PACKED_WINDOWS = 1 << 16
RANGE_WINDOWS = 1 << 19
LEAST_RANGES = 64
#: Odd multiplier of the rolling hash and of its finish (any odd numbers do).
ROLL = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` bytes in a row."""
    n = len(data)
    letters = (np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[data] * _powers(ROLL, n))))
    out = (sums[size:] - sums[:-size]) * _powers(pow(ROLL, -1, 1 << 64), n - size + 1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(MIX)
    return out


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    n = len(values)
    rows = np.concatenate((values, np.full(-n % size, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, size)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - size + 1], forward[size - 1 : n])


def pieces(texts: list[bytes], size: int, anchor: int) -> dict[str, np.ndarray]:
    """The pieces of several texts: text number, first window, number of windows, anchor hash, piece hash."""
    empty = {k: np.empty(0, np.int64) for k in ("text", "start", "windows", "anchor", "piece")}
    lengths = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or lengths.max(initial=0) < size:
        return empty
    raw = b"".join(texts)
    hashes = rolling_hashes(np.frombuffer(raw, np.uint8), anchor)
    places = np.arange(len(hashes), dtype=np.uint64)
    # the upper half of the hash, and the place so that the leftmost of equal ones is taken
    smallest = sliding_minimum(hashes & np.uint64(0xFFFFFFFF00000000) | places, size - anchor + 1)
    at = (smallest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    long = lengths >= size
    edge = np.bincount(starts[long], minlength=len(raw) + 1) - np.bincount(ends[long] - size + 1, minlength=len(raw) + 1)
    window = np.flatnonzero(np.cumsum(edge)[: len(at)] > 0)
    chosen = at[window]
    first = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)))
    head = np.flatnonzero(first)
    begin, count = window[head], np.diff(np.append(head, len(window)))
    digest = xxhash.xxh3_64_intdigest
    # the anchor's offset is part of what makes two pieces equal
    whole = [digest(raw[b : b + n + size - 1], seed=a - b & 0xFFFFFFFF) for b, n, a in zip(begin.tolist(), count.tolist(), chosen[head].tolist(), strict=True)]
    text = np.searchsorted(ends, begin, side="right")
    return {
        "text": text,
        "start": begin - starts[text],
        "windows": count,
        "anchor": hashes[chosen[head]].view(np.int64),
        "piece": np.array(whole, np.uint64).view(np.int64),
    }


def repeated_windows(run: list[bytes], windows: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In a run of distinct pieces, of which the first ``windows`` places of each begin a window of ``size`` bytes: the places of these
    windows in order of their bytes, whether each is repeated in the run, and whether it is the first of its kind."""
    data = np.frombuffer(b"".join(run), np.uint8)
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = padded[:n].copy()
    for k in range(1, 8):
        key = key << np.uint64(8) | padded[k : n + k]
    order, _ = suffix_array((key ^ np.uint64(1 << 63)).view(np.int64), 8)
    shared = common_prefixes(data, order, size, key)
    ends = np.cumsum([len(p) for p in run])
    starts = ends - np.array([len(p) for p in run])
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + np.array(windows), minlength=n + 1)
    valid = np.cumsum(edge)[:n] > 0
    # suffixes of equal first `size` bytes form a group; only places that begin a window count
    group = np.cumsum(shared < size) - 1
    mine = valid[order]
    place, group = order[mine], group[mine]
    number = np.bincount(group, minlength=1)
    new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.empty(0, bool)
    return place, number[group] > 1, new


def _spans(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive places as (first, number)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    return [(int(p[0]), len(p)) for p in np.split(places, cut)]


SPAN = "struct<first:int,number:int>"


def _described(docs: DataFrame, text: str, size: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch in by_bytes(batches, "bytes"):
            got = pieces(batch.column("bytes").to_pylist(), size, anchor)
            rows = pa.array(got.pop("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1").take(rows), batch.column("t2").take(rows)] + [pa.array(v).cast(t) for v, t in zip(got.values(), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                names=["t1", "t2", *got],
            )

    source = docs.where(F.octet_length(text) >= size).select(*_text_key(text), F.col(text).cast("binary").alias("bytes"))
    return source.mapInArrow(run, "t1 long, t2 long, start int, windows int, anchor long, piece long")


def _text_key(text: str):
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2")


def _sorted_runs(batches):
    """In-task shards: runs of pieces cut by bytes out of a partition sorted by anchor."""
    held, bytes_held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            bytes_held += len(row["bytes"])
            if bytes_held >= RUN_BYTES:
                yield held
                held, bytes_held = [], 0
    if held:
        yield held


def repeated_places(docs: DataFrame, text: str = "text", size: int = MIN_BYTES, anchor: int = ANCHOR_BYTES) -> DataFrame:
    """Rows (``t1``, ``t2``, ``spans``): per distinct text with any, the runs of windows that begin elsewhere too."""
    described = keep(_described(docs, text, size, anchor))
    # most anchors occur once: only the others move with all their columns
    common = described.groupBy("anchor").agg(F.count("*").alias("number")).where("number > 1")
    members = keep(attach_by_size(described, common, ["anchor"], "number").where("number is not null").drop("number"))
    kinds = members.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "start", "windows")).alias("at"))
    kinds = keep(kinds)
    kinds = kinds.join(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor")
    wanted = (
        kinds.where("kinds > 1")
        .select("anchor", "piece", "at.*", F.ceil(F.col("kinds") / SHARD_PIECES).alias("shards"))
        .groupBy("t1", "t2")
        .agg(F.collect_list(F.struct("anchor", "piece", "start", "windows", "shards")).alias("cuts"))  # bounded by the text's own length
    )
    sources = docs.where(F.octet_length(text) >= size).select(*_text_key(text), F.col(text).cast("binary").alias("bytes"))
    cut = (
        sources.join(wanted, ["t1", "t2"])
        .select("bytes", F.explode("cuts").alias("c"))
        .select("c.*", F.expr(f"substring(bytes, c.start + 1, c.windows + {size - 1})").alias("bytes"))
        # copies of a text give equal pieces; they are dropped where they are read
        .groupBy("anchor", "piece", "windows", "shards")
        .agg(F.first("bytes").alias("bytes"))
    )
    shards = cut.repartition("anchor", F.pmod(F.col("piece"), F.col("shards"))).sortWithinPartitions("anchor", "piece")

    def compare(batches):
        last_anchor = None
        for held in _sorted_runs(batches):
            place, again, new = repeated_windows([r["bytes"] for r in held], [r["windows"] for r in held], size)
            starts = np.cumsum([0] + [len(r["bytes"]) for r in held])
            owner = np.searchsorted(starts, place, side="right") - 1
            offset = place - starts[owner]
            marked = np.sort(place[again])
            bounds = np.searchsorted(marked, starts)
            # anchors that may go on in another run or shard: those of several shards, the first and the last
            edge = {held[0]["anchor"], held[-1]["anchor"], last_anchor}
            last_anchor = held[-1]["anchor"]
            open_piece = np.array([r["shards"] > 1 or r["anchor"] in edge for r in held])
            rows = [(r["anchor"], r["piece"], _spans(marked[bounds[k] : bounds[k + 1]] - starts[k])) for k, r in enumerate(held) if bounds[k] < bounds[k + 1]]
            yield _batch(rows)
            # of these, each window seen once here, and one of each kind that is repeated here for the other runs to find
            pick = np.flatnonzero(open_piece[owner] & (new | ~again))
            if pick.size:
                raw = b"".join(r["bytes"] for r in held)
                digest = xxhash.xxh3_128_digest
                hashes = np.array([digest(raw[p : p + size]) for p in place[pick].tolist()], "S16")
                order = np.argsort(hashes, kind="stable")
                pick = pick[order]
                who, rows_of = np.unique(owner[pick], return_inverse=True)
                one = Windows(hashes[order], np.array([held[k]["anchor"] for k in who])[rows_of], np.array([held[k]["piece"] for k in who])[rows_of], offset[pick].astype(np.int32), again[pick])
                yield from (_packed(one[k : k + PACKED_WINDOWS], 0) for k in range(0, len(one), PACKED_WINDOWS))

    compared = keep(shards.mapInArrow(compare, f"anchor long, piece long, spans array<{SPAN}>, part int, number long, packed binary"))
    packed = compared.where("packed is not null").select("part", "number", "packed")
    windows = packed.agg(F.coalesce(F.sum("number"), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES, windows // RANGE_WINDOWS)

    def deal(batches):
        for batch in batches:
            for blob in batch.column("packed").to_pylist():
                yield from (_packed(part, k).select(["part", "packed"]) for k, part in Windows.unpack(blob).ranges(ranges))

    dealt = packed.mapInArrow(deal, "part int, packed binary")
    across = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, f"anchor long, piece long, spans array<{SPAN}>")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("at.windows").alias("number")))
    marks = (
        compared.where("packed is null")
        .select("anchor", "piece", "spans", F.lit(1).cast("long").alias("n"))
        .unionAll(across.withColumn("n", F.lit(1).cast("long")))
        .unionAll(kinds.where("n > 1").select("anchor", "piece", whole.alias("spans"), "n"))
        .groupBy("anchor", "piece")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("n").alias("n"))  # bounded by the windows of a piece
    )
    marked = attach_by_size(members, marks, ["anchor", "piece"], "n").where("spans is not null")
    found = marked.select("t1", "t2", F.transform("spans", lambda s: F.struct((s["first"] + F.col("start")).alias("first"), s["number"].alias("number"))).alias("spans"))
    # copies of a text have equal rows here
    return found.distinct().groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


@dataclass
class Windows:
    """Windows in order of their hashes: the piece each is in (anchor, piece), where in it, and whether it is known to be repeated."""

    hashes: np.ndarray
    anchor: np.ndarray
    piece: np.ndarray
    offset: np.ndarray
    known: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def __getitem__(self, which) -> Windows:
        return Windows(self.hashes[which], self.anchor[which], self.piece[which], self.offset[which], self.known[which])

    def pack(self) -> bytes:
        kinds = ("S16", "<i8", "<i8", "<i4", "?")
        columns = (self.hashes, self.anchor, self.piece, self.offset, self.known)
        return b"".join(np.asarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))

    @classmethod
    def unpack(cls, blob: bytes) -> Windows:
        n, at, out = len(blob) // 37, 0, []
        for kind, width in (("S16", 16), ("<i8", 8), ("<i8", 8), ("<i4", 4), ("?", 1)):
            out.append(np.frombuffer(blob, kind, n, at))
            at += n * width
        return cls(*out)

    @classmethod
    def joined(cls, several: list[Windows]) -> Windows:
        """All windows of several, in order."""
        columns = zip(*((w.hashes, w.anchor, w.piece, w.offset, w.known) for w in several), strict=True)
        all_of = cls(*(np.concatenate(c) for c in columns))
        return all_of[np.argsort(all_of.hashes, kind="stable")]

    def ranges(self, number: int):
        """(range, windows of it) for the ranges of hashes that hold any."""
        head = np.frombuffer(self.hashes.tobytes(), ">u8")[::2] >> np.uint64(32)
        of = (head * np.uint64(number) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self)], strict=True):
            if b > a:
                yield int(of[a]), self[a:b]


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))


def _packed(windows: Windows, part: int) -> pa.RecordBatch:
    columns = [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], SPANS), pa.array([part], pa.int32()), pa.array([len(windows)], pa.int64()), pa.array([windows.pack()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "piece", "spans", "part", "number", "packed"])


def _batch(rows) -> pa.RecordBatch:
    anchor, piece, spans = zip(*rows, strict=True) if rows else ((),) * 3
    n = len(rows)
    spans = [[{"first": a, "number": k} for a, k in s] for s in spans]
    columns = [pa.array(anchor, pa.int64()), pa.array(piece, pa.int64()), pa.array(spans, SPANS), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "piece", "spans", "part", "number", "packed"])


class Merge:
    """Runs of windows of one range, one after the other; keeps one window of each kind, so memory does not grow with the number of runs."""

    def __init__(self):
        self.seen: Windows | None = None
        self.waiting: list[Windows] = []
        self.held = 0

    def add(self, run: Windows):
        """Take a run; yields windows that turn out to be repeated. Small runs wait until they are as many as half of what is kept."""
        self.waiting.append(run)
        self.held += len(run)
        if self.held >= max(4096, len(self.seen) // 2 if self.seen else 0):
            yield from self.settle()

    def settle(self):
        if not self.waiting:
            return
        new, seen = Windows.joined(self.waiting), self.seen
        self.waiting, self.held = [], 0
        first = np.searchsorted(new.hashes, new.hashes, side="left")
        again = np.searchsorted(new.hashes, new.hashes, side="right") - first > 1
        if seen is not None:
            at = np.searchsorted(seen.hashes, new.hashes)
            met = seen.hashes[np.minimum(at, len(seen) - 1)] == new.hashes
            again |= met
            older = np.unique(at[met])
            yield from _marked(seen[older][~seen.known[older]])
            seen.known[older] = True
        yield from _marked(new[again & ~new.known])
        head = first == np.arange(len(new))
        kept = new[head]
        kept.known = kept.known | again[head]
        self.seen = kept if seen is None else Windows.joined([seen, kept[~met[head]]])


def _marked(windows: Windows):
    """A row per piece, with the places of its windows as spans."""
    if not len(windows):
        return
    order = np.lexsort((windows.offset, windows.piece, windows.anchor))
    anchor, piece, offset = windows.anchor[order], windows.piece[order], windows.offset[order]
    cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(piece) != 0)) + 1
    bounds = [0, *cuts.tolist(), len(order)]
    rows = [(int(anchor[a]), int(piece[a]), _spans(offset[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]
    yield _batch(rows).select(["anchor", "piece", "spans"])


def _merge(batches):
    """Rows (range, packed windows) in order of ranges."""
    part, merge = None, Merge()
    for batch in batches:
        for of, blob in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if of != part:
                yield from merge.settle()
                part, merge = of, Merge()
            yield from merge.add(Windows.unpack(blob))
    yield from merge.settle()


def remove_repeats(docs: DataFrame, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",), size: int = MIN_BYTES, anchor: int = ANCHOR_BYTES, prefix: str = "") -> DataFrame:
    """``keep_columns`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (of the bytes left) and ``kept_text`` of every row.

    The new columns' names begin with ``prefix``.

    Every byte in a string of ``size`` bytes that begins anywhere else in the corpus is removed, at all its places, as judged on the
    input. Matches end at the ends of texts. Null and empty texts have no bytes; texts shorter than ``size`` are left whole. Repeated rows
    are copies of each other. Where a cut breaks a character in two, ``kept_text`` leaves its other bytes out.
    An empty table gives no rows. Null ids and texts of any length are allowed.
    """
    columns = list(keep_columns)
    spans = repeated_places(docs, text, size, anchor)
    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__bytes"), *(c.alias(f"__{k}") for k, c in zip(("t1", "t2"), _text_key(text), strict=True)))
    joined = rows.join(spans.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("spans").alias("__spans")), ["__t1", "__t2"], "left").drop("__t1", "__t2")

    def run(batches):
        for batch in by_bytes(batches, "__bytes"):
            got = [_cut(raw, spans or [], size) for raw, spans in zip(batch.column("__bytes").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            kept = [k for k, _, _ in got]
            yield with_rest(
                batch,
                columns,
                {
                    f"{prefix}n_bytes": pa.compute.binary_length(batch.column("__bytes")).cast(pa.int64()),
                    f"{prefix}n_removed": pa.array([r for _, r, _ in got], pa.int64()),
                    f"{prefix}n_spans": pa.array([n for _, _, n in got], pa.int64()),
                    f"{prefix}kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    f"{prefix}kept_text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                },
            )

    fields = [f"{prefix}{f}" for f in ("n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "kept_text string")]
    return joined.mapInArrow(run, _schema([docs.schema[c] for c in columns], ", ".join(fields)))


def _cut(raw: bytes, spans: list[dict], size: int) -> tuple[bytes, int, int]:
    runs: list[list[int]] = []
    for first, last in sorted((s["first"], s["first"] + s["number"] - 1 + size) for s in spans):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    at, kept = 0, []
    for first, last in runs:
        kept.append(raw[at:first])
        at = last
    kept.append(raw[at:])
    left = b"".join(kept)
    return left, len(raw) - len(left), len(runs)
