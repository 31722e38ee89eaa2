"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups of near duplicates that its links make.

Shingles are ordered rare first; their frequency is estimated by a sketch that covers all documents (any estimate gives an order
that is the same everywhere, so results are exact whatever its error). If two sets are similar enough, their prefixes of
``n - ceil(t n) + l`` shingles share at least ``l``. The shortest prefixes (l = 1) decide which documents can meet at all; each
document's own ``l`` grows with the estimated cost of its prefix, and a pair is verified only if its prefixes share
as many shingles as the smaller of the two ``l``.

1. Sets are described (size, hash of the set, prefix); documents with equal sets form a class.
2. The classes that share a shingle of their prefixes are joined to the smallest one there. Classes joined by several shingles, or by
   one that very many share, are neighbours, and connected components of neighbours are neighbourhoods: groups of copies stand in one, and
   texts that share one shingle by chance do not chain. Within a neighbourhood no group is expanded into pairs.
   Across neighbourhoods the pairs of every other shingle are counted, and those that share enough shingles are verified too, so no link is lost.
3. A neighbourhood is verified in blocks of bounded size. In a block, pairs that are known to be connected are not compared
   again, so a dense group costs about one comparison per member. Neighbourhoods of several blocks get a few delegates in every
   block; what is then not connected to the neighbourhood's largest part is compared with every block of it.
4. Connected components of the verified links give the groups.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import by_bytes, components, keep, shuffles_freed, with_rest
from plumbline.llm.suffix_dedup import MIX, ROLL, _powers

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class JoinSettings:
    """Two sets link when ``100 * intersection >= percent * union``. ``sketch_bits``: the sketch has 2 ** bits counters of a byte.
    ``most_matches``: the longest prefix asks for so many shared shingles. ``block``: classes verified in one task at once.
    ``delegates``: about so many of a neighbourhood stand in each of its blocks. ``hot``: classes that share a shingle with more than so
    many are neighbours by it alone, as pairs across neighbourhoods would be too many."""

    words: int = 4
    percent: int = 85
    sketch_bits: int = 26
    most_matches: int = 8
    block: int = 2048
    delegates: int = 32
    hot: int = 256


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and the number of them per text.

    Letters A-Z are lowered; words are runs without space, tab, line feed, vertical tab, form feed or carriage return. A text with
    fewer words than a shingle has its whole sequence as one, a text without words none.
    """
    n = len(texts)
    raws = [(t or "").encode().translate(LOWER) for t in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    inside = ~SPACES[data]
    edge = np.diff(np.concatenate(([False], inside)).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    letters = (np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[data] * _powers(ROLL, len(data)))))
    word = _mixed((sums[ends] - sums[starts]) * _powers(pow(ROLL, -1, 1 << 64), len(data))[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(r) + 1 for r in raws])
    owner = np.searchsorted(text_ends, starts, side="right")
    number = np.bincount(owner, minlength=n)
    first = np.cumsum(number) - number
    hashes, owners = [], []
    if len(word) >= words:
        whole = np.flatnonzero(owner[: len(word) - words + 1] == owner[words - 1 :])
        h = np.full(len(whole), words, np.uint64)
        for k in range(words):
            h = _mixed(h * np.uint64(ROLL) + word[whole + k])
        hashes.append(h)
        owners.append(owner[whole])
    short = np.flatnonzero((number > 0) & (number < words))
    if len(short):
        h = number[short].astype(np.uint64)
        for k in range(words - 1):
            h = np.where(k < number[short], _mixed(h * np.uint64(ROLL) + word[np.minimum(first[short] + k, len(word) - 1)]), h)
        hashes.append(h)
        owners.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(o[order].astype(np.uint32), kind="stable")]
    h, o = h[order], o[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
    return h[new], np.bincount(o[new], minlength=n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(MIX)
    return h ^ h >> np.uint64(32)


def frequency_sketch(docs: DataFrame, text: str, settings: JoinSettings) -> np.ndarray:
    """Frequency classes of shingle hashes, over all documents: 2 ** bits counters of a byte each, whatever the corpus.

    A task adds up its own documents and sends the counters that are not zero; the sums are made per slice of the counters.
    """
    bits = settings.sketch_bits
    slices = 1 << min(6, bits)
    part = (1 << bits) // slices

    def added(total, cells, counts):
        total[cells] = np.minimum(total[cells].astype(np.int64) + counts, 255)

    def rows(numbers, blobs):
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    def count(batches):
        total = np.zeros(1 << bits, np.uint8)
        for batch in by_bytes(batches, text):
            hashes, _ = shingle_sets(batch.column(text).to_pylist(), settings.words)
            added(total, *np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True))
        for k in range(slices):
            own = total[k * part : (k + 1) * part]
            cells = np.flatnonzero(own)
            if len(cells):
                packed = np.diff(cells, prepend=0).astype(np.uint32).tobytes() + own[cells].tobytes()
                yield rows([k], [zlib.compress(packed, 1)])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = zlib.decompress(blob)
                n = len(packed) // 5
                cells = np.cumsum(np.frombuffer(packed, np.uint32, n).astype(np.int64))
                added(held.setdefault(k, np.zeros(part, np.uint8)), cells, np.frombuffer(packed, np.uint8, n, 4 * n))
        for k, total in held.items():
            yield rows([k], [zlib.compress(total.tobytes(), 1)])

    fields = "slice int, counts binary"
    out = np.zeros(1 << bits, np.uint8)
    for r in keep(docs.select(text).mapInArrow(count, fields).repartition(slices, "slice").mapInArrow(add, fields)).toLocalIterator():
        out[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return frequency_classes(out)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """The binary order of what a counter holds above the usual one."""
    usual = int(np.median(counts))
    order = np.log2(1 + np.maximum(np.arange(256) - max(usual, 1), 0)).astype(np.uint8)
    return order[counts]


def prefixes(hashes: np.ndarray, number: np.ndarray, classes: np.ndarray, settings: JoinSettings) -> list[tuple[np.ndarray, int]]:
    """Per set: the prefix in rare-first order and its ``l``, larger the more candidates the shortest prefix would bring."""
    shift = np.uint64(64 - int(len(classes)).bit_length() + 1)
    ends = np.cumsum(number)
    rank = classes[(hashes >> shift).astype(np.int64)]
    out = []
    for a, b in zip((ends - number).tolist(), ends.tolist(), strict=True):
        own, r = hashes[a:b], rank[a:b]
        n = b - a
        if not n:
            out.append((own, 0))
            continue
        if r.any():
            own = own[np.argsort(r, kind="stable")]
            r = np.sort(r, kind="stable")
        least = -(-settings.percent * n // 100)
        cost = float(np.exp2(r[: n - least + 1].astype(float)).mean())
        matches = int(min(settings.most_matches, least, 2 + np.log2(cost)))
        out.append((own[: n - least + matches], matches))
    return out


def _described(docs: DataFrame, id_column: str, text: str, classes: Broadcast, settings: JoinSettings) -> DataFrame:
    def run(batches):
        for batch in by_bytes(batches, "text"):
            hashes, number = shingle_sets(batch.column("text").to_pylist(), settings.words)
            ends = np.cumsum(number)
            raw = hashes.tobytes()
            signs = [xxhash.xxh3_128_intdigest(raw[8 * (e - n) : 8 * e]) for e, n in zip(ends.tolist(), number.tolist(), strict=True)]
            got = prefixes(hashes, number, classes.value, settings)
            yield with_rest(
                batch,
                ["id", "t1", "t2"],
                {
                    "n": pa.array(number, pa.int64()),
                    "s1": pa.array([(s >> 64) - (1 << 63) for s in signs], pa.int64()),
                    "s2": pa.array([(s & (1 << 64) - 1) - (1 << 63) for s in signs], pa.int64()),
                    "least": pa.array([m for _, m in got], pa.int64()),
                    "prefix": pa.array([p.view(np.int64) for p, _ in got], pa.list_(pa.int64())),
                },
            )

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, t1 long, t2 long, n long, s1 long, s2 long, least long, prefix array<long>")


class Links:
    """Union of places, with the smallest place as the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[a]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def verify(hashes: np.ndarray, number: np.ndarray, classes: np.ndarray, settings: JoinSettings, probes: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """The component of each set among these sets (the place of its first member), by links verified exactly.

    Pairs in one component are not compared. With ``probes`` only pairs with a probe are. ``known`` gives components to
    begin with. A pair is verified when its prefixes share as many shingles as the smaller ``l`` and its sizes allow a link.
    """
    n = len(number)
    links = Links(n)
    if known is not None:
        _, links.root = np.unique(known, return_inverse=True)
        first = np.full(n, n)
        np.minimum.at(first, links.root, np.arange(n))
        links.root = first[links.root]
    ends = np.cumsum(number)
    starts = ends - number
    symbols = np.unique(hashes, return_inverse=True)[1]
    got = prefixes(hashes, number, classes, settings)
    ell = np.array([m for _, m in got], np.int64)
    names = np.unique(hashes)
    pre = [np.searchsorted(names, p) for p, _ in got]
    pre_len = np.array([len(p) for p in pre])
    pre_all = np.concatenate(pre) if pre else np.empty(0, np.int64)
    pre_start = np.cumsum(pre_len) - pre_len
    mark = np.zeros(len(names) + 1, bool)
    order = np.arange(n) if probes is None else np.flatnonzero(probes)
    done = np.zeros(n, bool)

    def within(begin, length, values):
        """Marked values in each of several stretches."""
        total = int(length.sum())
        offset = np.repeat(begin - (np.cumsum(length) - length), length)
        hit = mark[values[np.arange(total) + offset]]
        return np.bincount(np.repeat(np.arange(len(length)), length), weights=hit, minlength=len(length)).astype(np.int64)

    for x in order.tolist():
        done[x] = True
        size = number[x]
        y = np.flatnonzero(~done & (links.root != links.root[x]) & (100 * np.minimum(number, size) >= settings.percent * np.maximum(number, size)))
        if not len(y):
            continue
        mark[pre[x]] = True
        shared = within(pre_start[y], pre_len[y], pre_all)
        mark[pre[x]] = False
        y = y[shared >= np.minimum(ell[y], ell[x])]
        if not len(y):
            continue
        own = symbols[starts[x] : ends[x]]
        mark[own] = True
        both = within(starts[y], number[y], symbols)
        mark[own] = False
        links.join(x, y[100 * both >= settings.percent * (size + number[y] - both)])
    return links.root


def _verified(rows: DataFrame, classes: Broadcast, settings: JoinSettings) -> DataFrame:
    """Rows (place, nbh, block, probe, known, text), one task per run of blocks: edges (a, b) between linked classes."""

    def blocks(batches):
        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["nbh"], row["block"]) != key:
                    if held:
                        yield held
                    held, key = [], (row["nbh"], row["block"])
                if not held or held[-1]["place"] != row["place"]:  # a repeated row brings its text again
                    held.append(row)
                elif row["probe"]:
                    held[-1]["probe"] = True
        if held:
            yield held

    def run(batches):
        for held in blocks(batches):
            if len(held) < 2:
                continue
            hashes, number = shingle_sets([r["text"] for r in held], settings.words)
            place = np.array([r["place"] for r in held])
            probes = np.array([r["probe"] for r in held])
            known = np.array([r["known"] for r in held])
            root = verify(hashes, number, classes.value, settings, probes if probes.any() else None, known)
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(place[linked]), pa.array(place[root[linked]])], names=["a", "b"])

    return rows.repartition("nbh", "block").sortWithinPartitions("nbh", "block", "place").mapInArrow(run, "a long, b long")


def _met(sets: DataFrame) -> DataFrame:
    """Rows (token, place, of, pivot): the classes that share a shingle of their prefixes with others, how many do, and the smallest of them."""
    postings = sets.select("place", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("of"), F.min("place").alias("pivot")).where("of > 1")
    return postings.join(shared, "token")


def _neighbourhoods(met: DataFrame, settings: JoinSettings) -> DataFrame:
    """Rows (place, nbh, size, blocks, block): the classes in each neighbourhood, dealt to its blocks."""
    joined = met.where("place <> pivot").groupBy("place", "pivot").agg(F.count("*").alias("shared"), F.max("of").alias("of"))
    edges = joined.where((F.col("shared") > 1) | (F.col("of") > settings.hot)).select(F.col("place").alias("a"), F.col("pivot").alias("b"))
    near = components(edges).select(F.col("node").alias("place"), F.col("root").alias("nbh"))
    sizes = near.groupBy("nbh").agg(F.count("*").alias("size"))
    near = near.join(sizes, "nbh").withColumn("blocks", F.ceil(F.col("size") / settings.block))
    return near.select("place", "nbh", "size", "blocks", F.pmod(F.xxhash64("place"), F.col("blocks")).alias("block"))


def _pairs(met: DataFrame, near: DataFrame, sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """Rows (a, b): pairs in different neighbourhoods whose sizes allow a link and whose prefixes share enough shingles for one.

    The classes of a shingle that more than ``hot`` share are in one neighbourhood, so no larger group is expanded."""
    rows = met.where(F.col("of") <= settings.hot).join(near.select("place", "nbh"), "place", "left")
    rows = rows.select("token", "place", F.coalesce("nbh", "place").alias("nbh"))
    mixed = rows.groupBy("token").agg(F.min("nbh").alias("low"), F.max("nbh").alias("high")).where("low <> high").select("token")
    rows = rows.join(mixed, "token", "left_semi").join(sets.select("place", "n", "least"), "place")
    sizes = 100 * F.least("x.n", "y.n") >= settings.percent * F.greatest("x.n", "y.n")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.place") < F.col("y.place")) & (F.col("x.nbh") != F.col("y.nbh")) & sizes
    found = rows.alias("x").join(rows.alias("y"), on).groupBy(F.col("x.place").alias("a"), F.col("y.place").alias("b"))
    return found.agg(F.count("*").alias("shared"), F.first(F.least("x.least", "y.least")).alias("least")).where("shared >= least").select("a", "b")


def _across(pairs: DataFrame, settings: JoinSettings) -> DataFrame:
    """Rows as of ``_neighbourhoods`` and ``probe``: the first class of a pair is the probe of a neighbourhood of its own, in every block of it."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / settings.block).alias("of"))
    names = [(-1 - F.col("a")).alias("nbh"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("blocks")]
    heads = sizes.select(F.col("a").alias("place"), *names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("block"), F.lit(True).alias("probe"))
    others = pairs.join(sizes, "a").select(F.col("b").alias("place"), *names, F.pmod(F.xxhash64("b"), F.col("of")).alias("block"), F.lit(False).alias("probe"))
    return heads.unionAll(others)


def _grouped(docs: DataFrame, settings: JoinSettings, id_column: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows, the classes, and rows (node, root): the linked classes with the smallest one of their group."""
    # of a fixed size; sent once and read by every step
    classes = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, text, settings))
    described = keep(_described(docs, id_column, text, classes, settings))
    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("at")
    first = [F.first(c).alias(c) for c in ("n", "least", "prefix")]
    sets = described.where("n > 0").groupBy("s1", "s2").agg(lowest, *first)
    sets = keep(sets.withColumn("place", F.monotonically_increasing_id()))
    met = keep(_met(sets))
    near = keep(_neighbourhoods(met, settings))
    wanted = near.withColumn("probe", F.lit(False)).unionByName(_across(keep(_pairs(met, near, sets, settings)), settings))
    wanted = wanted.join(sets.select("place", "at.id", "at.t1", "at.t2"), "place")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"), F.col(text).alias("text"))
    on = (F.col("w.t1") == F.col("d.t1")) & (F.col("w.t2") == F.col("d.t2")) & F.col("w.id").eqNullSafe(F.col("d.id"))
    held = keep(texts.alias("d").join(wanted.alias("w"), on).select("place", "nbh", "size", "blocks", "block", "probe", "d.text"))

    member = held.withColumn("known", F.col("place"))
    columns = ["place", "nbh", "block", "probe", "known", "text"]
    several = member.where("blocks > 1")
    delegates = several.where(F.pmod(F.xxhash64(F.lit(7), F.col("place")), F.ceil(F.col("size") / settings.delegates)) == 0)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    links = keep(_verified(member.select(columns).unionAll(delegates.withColumn("block", everywhere).select(columns)), classes, settings))
    if not several.isEmpty():
        # what is not connected to the largest part of its neighbourhood meets every block of it
        found = components(links)
        known = several.join(found.select(F.col("node").alias("place"), "root"), "place", "left").withColumn("known", F.coalesce("root", "place"))
        parts = known.groupBy("nbh", "known").count().groupBy("nbh").agg(F.max_by("known", "count").alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
        rest = parts.where("all > most").select("nbh", "largest", F.ceil((F.col("all") - F.col("most")) / settings.block).alias("sides"))
        known = keep(known.join(rest, "nbh"))
        # a block of members meets a block of such rows, so a task holds two blocks at most
        side = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
        members = known.withColumn("side", side).withColumn("block", F.col("block") * F.col("sides") + F.col("side"))
        probes = known.where("known <> largest").withColumn("probe", F.lit(True)).withColumn("side", F.pmod(F.xxhash64(F.lit(3), F.col("place")), F.col("sides")))
        probes = probes.withColumn("block", everywhere).withColumn("block", F.col("block") * F.col("sides") + F.col("side"))
        links = keep(links.unionAll(_verified(members.select(columns).unionAll(probes.select(columns)), classes, settings)))
    return described, sets, components(links)


def near_duplicates(docs: DataFrame, settings: JoinSettings = JoinSettings(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and
    ``representative`` (whether the row is the one that stands for its group), ``t1`` and ``t2`` (hashes of the text).

    Ids are integers. Null and empty texts, and texts without words, have no shingles and link with nothing: their component is
    their own id and they stand for themselves. Rows with equal sets are one class, so copies are linked without pairs. A null id
    never is a component's id unless all ids of the group are null. Rows that repeat with id and text stand together.
    An empty table gives no rows.
    """
    with shuffles_freed(docs.sparkSession):
        described, sets, groups = _grouped(docs, settings, id_column, text)
    named = sets.join(groups.select(F.col("node").alias("place"), "root"), "place", "left").withColumn("root", F.coalesce("root", "place"))
    heads = named.groupBy("root").agg(F.min("at").alias("head"))
    named = named.join(heads, "root").select("s1", "s2", "head")
    out = described.select("id", "t1", "t2", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    stands = F.col("head").isNull() | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("t1") == F.col("head.t1")) & (F.col("t2") == F.col("head.t2")))
    return out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
        stands.alias("representative"),
        "t1",
        "t2",
    )


def drop_near_duplicates(docs: DataFrame, settings: JoinSettings = JoinSettings(words=5, percent=80), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their groups, with all their columns: one row of each group that has words.

    Of rows that repeat with id (or a null one) and text, the one whose other columns come first as JSON stays. Rows without words all stay."""
    keys = ["__id", "__t1", "__t2"]
    stay = near_duplicates(docs, settings, id_column, text).where("representative")
    stay = stay.groupBy(F.col(id_column).cast("long").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    with shuffles_freed(docs.sparkSession):
        stay = keep(stay.agg(((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("__again")))
    on = docs[id_column].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__t1")) & (F.xxhash64(F.lit(1), docs[text]) == F.col("__t2"))
    once = docs.join(stay.where("not __again"), on, "left_semi")
    again = docs.join(stay.where("__again"), on)
    # only repeated rows are grouped; they share their text, so it has no part in the order
    order = F.to_json(F.struct(*(docs[c] for c in docs.columns if c != text)), {"ignoreNullFields": "false"})
    row = F.struct(*(docs[c] for c in docs.columns))
    chosen = again.groupBy(*keys).agg(F.min_by(row, order).alias("__row"))
    return once.unionAll(chosen.select(*(F.col("__row")[c].alias(c) for c in docs.columns)))
