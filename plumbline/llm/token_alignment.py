"""Alignment of two tokenizers over a corpus: which tokens overlap, which share a group, and how common each linked pair of ids is.

For every text both token sequences are laid over the same bytes. With A and B the token-byte incidence matrices (a row per token, a column
per byte), the product A.B' has an entry for each pair of tokens that overlap; where consecutive tokens of A have no overlapping token of B in
common, both tokenizers end a token, and a group ends. The product of the group-incidence matrices gives the pairs of ids that share a
group, with the number of their links. Matrices are in compressed rows (CSR), built here; products are formed row by row (Gustavson):
each entry of a row brings the row of the other matrix that its column names. Texts are worked on in pieces of bounded size.

Counting how many documents hold a pair takes three steps over Spark:

1. Tasks align their texts and store, per batch of documents, the distinct pairs with their number of documents, and each document's
   pairs as places in that list. Every pair moves once per batch, however often it occurs.
2. The batches' numbers are added per pair; the highest of each A id marks its best pairs.
3. The counts go back to the batches by their pairs, and each batch sums them up for its documents.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plumbline.llm.base import by_bytes, keep
from plumbline.llm.bpe import byte_letters

#: Bytes of text in a batch of documents (one longer text is a batch of its own), and of the pieces it is aligned in.
BATCH_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: Entries of a product that are expanded at once.
BLOCK_ENTRIES = 1 << 22
#: Bits of an id in the key of a pair.
ID_BITS = 20
#: Runs of white space for which the fast encoder is not used (it recurses over them).
LONG_SPACE = re.compile(r"\s{1000}")


@dataclass
class Csr:
    """A sparse matrix of counts in compressed rows."""

    starts: np.ndarray
    columns: np.ndarray
    counts: np.ndarray
    width: int

    @classmethod
    def incidence(cls, starts: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        return cls(starts, columns, np.ones(len(columns), np.int64), width)

    @classmethod
    def of_pairs(cls, rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
        """From (row, column) pairs, counting those that occur again."""
        key, counts = np.unique(rows.astype(np.int64) * width + columns, return_counts=True)
        rows, columns = np.divmod(key, width)
        return cls(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=height)))), columns, counts, width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width)))), self.rows()[order], self.counts[order], self.height)


def gustavson(left: Csr, right: Csr, block: int = BLOCK_ENTRIES):
    """The product left.right by rows: yields (row, column, count) arrays, rows ascending, a row's columns ascending and distinct.

    Rows are taken together until they bring ``block`` entries, so memory is bounded by that or by one row's own entries.
    """
    brought = right.starts[left.columns + 1] - right.starts[left.columns]
    total = np.concatenate(([0], np.cumsum(brought)))[left.starts]  # entries brought before each row
    at = 0
    while at < left.height:
        end = max(at + 1, int(np.searchsorted(total, total[at] + block, side="right")) - 1)
        entries = slice(left.starts[at], left.starts[end])
        columns, number = left.columns[entries], brought[entries]
        row = np.repeat(np.repeat(np.arange(at, end), np.diff(left.starts[at : end + 1])), number)
        first = np.concatenate(([0], np.cumsum(number)))[:-1]
        source = np.arange(len(row)) + np.repeat(right.starts[columns] - first, number)
        key = row * right.width + right.columns[source]
        counts = np.repeat(left.counts[entries], number) * right.counts[source]
        if len(key) > 1 and not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        if len(key):
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            row, column = np.divmod(key[head], right.width)
            yield row, column, np.add.reduceat(counts, head)
        at = end


def product(left: Csr, right: Csr) -> Csr:
    parts = list(gustavson(left, right)) or [(np.empty(0, np.int64),) * 3]
    row, column, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Csr(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=left.height)))), column, count, right.width)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens laid one after the other over bytes."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return Csr.incidence(ends, np.arange(ends[-1]), int(ends[-1]))


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """A row per token of A, a column per token of B: the number of bytes that both cover."""
    return product(token_bytes(a_lengths), token_bytes(b_lengths).transposed())


def groups_of(overlap: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of each of B: a group goes on while the next token overlaps a token of this one."""
    first, last = overlap.columns[overlap.starts[:-1]], overlap.columns[overlap.starts[1:] - 1]
    of_a = np.concatenate(([0], np.cumsum(first[1:] != last[:-1]))) if len(first) else np.empty(0, np.int64)
    of_b = np.empty(overlap.width, np.int64)
    of_b[overlap.columns] = np.repeat(of_a, np.diff(overlap.starts))
    return of_a, of_b


class Pair:
    """The two vocabularies: encoding, bytes of each id, alignment of texts."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.a_bytes = vocab | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        # merges in the order of their ids are ranks, which the other library encodes several times faster
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        import public_tokenizers

        self.fast = None
        if plain and made == sorted(made):
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in vocab.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        table = lambda of: np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64)
        self.a_length, self.b_length = table(self.a_bytes), table(self.b_bytes)
        most = max(len(self.a_length), len(self.b_length))
        if most > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        #: An id with what follows it in a text's description.
        self.shown = [np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;"]

    def encode_a(self, text: str) -> list[int]:
        if self.fast is None or LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both for space + text; none where the text is empty or the tokens' bytes are not its bytes."""
        if not text:
            return [], []
        whole = " " + text
        a, b, raw = self.encode_a(whole), self.b.encode(text), whole.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], []
        return a, b

    def align(self, texts: list[str | None]) -> "Aligned":
        found = [self.tokens(t) for t in texts]
        n = len(texts)
        a_of, b_of = (np.repeat(np.arange(n), [len(x[k]) for x in found]) for k in (0, 1))
        a, b = (np.concatenate([np.empty(0, np.int64), *(np.array(x[k], np.int64) for x in found)]) for k in (0, 1))
        overlap = overlap_links(self.a_length[a], self.b_length[b])
        a_group, b_group = groups_of(overlap)
        # a document's tokens cover its bytes on both sides, so no group crosses to the next
        number = int(a_group[-1]) + 1 if len(a_group) else 0
        group_of = np.zeros(number, np.int64)
        group_of[a_group] = a_of
        # a row per document and A id, a column per group; times groups by B ids: links of each pair of ids in each document
        ids_of_a, row = np.unique(a_of << ID_BITS | a, return_inverse=True)
        by_a, by_b = Csr.of_pairs(row, a_group, len(ids_of_a), max(number, 1)), Csr.of_pairs(b_group, b, max(number, 1), 1 << ID_BITS)
        linked = product(by_a, by_b)
        key = ids_of_a[linked.rows()]
        pair = (key & (1 << ID_BITS) - 1) << ID_BITS | linked.columns
        return Aligned(n, a, b, a_of, b_of, a_group, b_group, group_of, key >> ID_BITS, pair, linked.counts)

    def described(self, x: Aligned) -> list[str]:
        """Per text ``a1,a2|b1;a3|b2,b3``: ids of A, then of B, group by group."""
        number = len(x.group_of)
        a_ends, b_ends = np.cumsum(np.bincount(x.a_group, minlength=number)), np.cumsum(np.bincount(x.b_group, minlength=number))
        out = np.empty(len(x.a) + len(x.b), object)
        comma, bar, semicolon = self.shown
        a_words, b_words = comma[x.a], comma[x.b]
        a_words[a_ends - 1], b_words[b_ends - 1] = bar[x.a[a_ends - 1]], semicolon[x.b[b_ends - 1]]
        out[np.arange(len(x.a)) + np.concatenate(([0], b_ends))[x.a_group]] = a_words
        out[np.arange(len(x.b)) + a_ends[x.b_group]] = b_words
        cut = np.cumsum(np.bincount(x.a_of, minlength=x.n) + np.bincount(x.b_of, minlength=x.n)).tolist()
        words = out.tolist()
        return ["".join(words[i:j])[:-1] for i, j in zip([0, *cut], cut)]


@dataclass
class Aligned:
    """Several texts: ids of both, each token's text and group, each group's text; per text and pair of ids the number of links."""

    n: int
    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_of: np.ndarray
    doc: np.ndarray
    pair: np.ndarray
    links: np.ndarray


@functools.lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^31 as compressed differences, byte planes apart."""
    steps = np.diff(numbers.astype(np.int32), prepend=np.int32(0)).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _batches_of(docs: DataFrame, a_path: str, b_path: str, batch_bytes: int, piece_bytes: int) -> DataFrame:
    """Rows of a batch of documents (``id``, ``text``) each: ``batch``, ``ids`` and the documents' numbers and digests; the distinct ``pairs`` and how many
    documents hold each (``holders``); where each document's pairs start, their ``places`` among the batch's and their ``links``."""

    def pieces(batches):
        pair = pair_of(a_path, b_path)
        for batch in by_bytes(batches, "text", piece_bytes):
            texts = batch.column("text").to_pylist()
            x = pair.align(texts)
            count = lambda of: np.bincount(of, minlength=x.n)  # noqa: B023, E731
            links = np.zeros(x.n, np.int64)
            np.add.at(links, x.doc, x.links)
            shown = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in pair.described(x)]
            size = sum(len(t) for t in texts if t)
            yield size, batch.column("id"), (count(x.a_of), count(x.b_of), count(x.group_of), links), shown, count(x.doc), x.pair, x.links

    def whole(held, batch):
        _, ids, numbers, shown, per_doc, pair, links = zip(*held, strict=True)
        pair, links = np.concatenate(pair), np.concatenate(links)
        pairs, places, holders = np.unique(pair, return_inverse=True, return_counts=True)
        starts = np.concatenate(([0], np.cumsum(np.concatenate(per_doc))))
        if links.max(initial=0) >= 1 << 31:
            raise ValueError("a pair has more links in a text than 31 bits hold")
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if kind else x)
        columns = {
            "batch": pa.array([batch], pa.int64()),
            "ids": one(pa.concat_arrays(ids), None),
            **{name: one(np.concatenate(n), pa.int64()) for name, n in zip(NUMBERS, zip(*numbers, strict=True), strict=True)},
            "shown": one([s for x in shown for s in x], pa.string()),
            "starts": one(starts, pa.int32()),
            "pairs": one(pairs, pa.int64()),
            "holders": one(holders, pa.int32()),
            "places": pa.array([packed(places)]),
            "links": pa.array([packed(links)]),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches):
        held, size, batch = [], 0, TaskContext.get().partitionId() << 32
        for piece in pieces(batches):
            held.append(piece)
            size += piece[0]
            if size >= batch_bytes:
                yield whole(held, batch)
                held, size, batch = [], 0, batch + 1
        if held:
            yield whole(held, batch)

    schema = StructType.fromDDL("batch long").add("ids", ArrayType(docs.schema["id"].dataType))
    for name in NUMBERS:
        schema = schema.add(name, ArrayType(schema["batch"].dataType))
    for field in StructType.fromDDL("shown array<string>, starts array<int>, pairs array<long>, holders array<int>, places binary, links binary"):
        schema = schema.add(field)
    return docs.mapInArrow(run, schema)


def pair_counts(held: DataFrame) -> DataFrame:
    """From rows (``pair``, ``holders``): ``pair``, ``documents`` (how many hold it) and ``best`` (no pair of its A id is in more)."""
    counts = held.groupBy("pair").agg(F.sum("holders").alias("documents")).withColumn("a_id", F.shiftright("pair", ID_BITS))
    most = counts.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counts.join(most, "a_id").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def alignment(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (pairs of tokens that share a group), ``n_best`` (links whose pair of
    ids is held by as many documents as any of its A id), ``count_sum`` (documents holding its pair, summed over links), ``groups_sha256``.

    ``a_path`` is a byte-level BPE file of the tokenizers library, ``b_path`` a sentencepiece model that adds a space in front. Special tokens are neither
    added nor found in texts. Null and empty texts, and texts whose tokens' bytes differ from space + text, have no tokens: zeros and an empty digest. A row is a document,
    so repeated rows and null ids count each. Memory is bounded by a batch or by the longest text. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    stored = keep(_batches_of(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), a_path, b_path, batch_bytes, piece_bytes))
    held = stored.select("batch", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "x")).select("batch", "place", "x.pairs", "x.holders").withColumnRenamed("pairs", "pair")
    counts = keep(pair_counts(held))
    answers = held.join(counts, "pair").select(F.col("batch").alias("of"), "place", "documents", "best")

    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        documents, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        documents[place], best[place] = right.column("documents").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        row = left.slice(0, 1).combine_chunks().to_batches()[0]
        places, links = unpacked(row.column("places")[0].as_py()), unpacked(row.column("links")[0].as_py()).astype(np.int64)
        starts = row.column("starts").flatten().to_numpy()
        upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[starts])
        part = lambda name: row.column(name).flatten()
        return pa.table([part("ids"), *(part(n) for n in NUMBERS), pa.array(upto(links * best[places])), pa.array(upto(links * documents[places])), part("shown")], names=names)

    names = [id_column, *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    schema = StructType().add(id_column, docs.schema[id_column].dataType)
    for name in names[1:-1]:
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")
    return stored.drop("pairs", "holders").groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
