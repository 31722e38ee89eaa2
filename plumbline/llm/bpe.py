"""Byte-level BPE with forced boundaries: encoding, decoding.

A text is cut in three steps, each of which no merge can cross, so that the parts are encoded on their own and their
ids are concatenated:

* before white space that follows other characters (the split pattern never joins these two),
* where the vocabulary's split pattern cuts,
* between two bytes that stand side by side inside no token of the vocabulary (a forced boundary).

Parts that come again are looked up. The table of known parts is bounded, so memory does not grow with the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import by_bytes, with_rest

#: White space as Unicode defines it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The split pattern of this family of vocabularies.
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: Known parts per Python worker, in two halves: when the younger half is full it becomes the older one.
KNOWN_PARTS = 400_000
#: Longer parts are not remembered.
KNOWN_LENGTH = 64
NO_MERGE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    table.update({b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in table)})
    return table


class Vocabulary:
    """A byte-level BPE vocabulary file (tokenizers' JSON): encode, decode, forced boundaries."""

    def __init__(self, path: str, known_parts: int = KNOWN_PARTS):
        self.known_parts = known_parts
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        self.ids = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        #: Pair of ids (16 bits each) to merge rank and new id; an int each, so that a rank compares as the int does.
        self.rank: dict[int, int] = {}
        of = {token: i for token, i in spec["model"]["vocab"].items()}
        if max(self.bytes_of) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        for n, pair in enumerate(spec["model"]["merges"], 1):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[of[left] << 16 | of[right]] = n << 16 | of[left + right]
        inside = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        #: For each byte, the bytes that may follow it inside a token.
        self.follows = [frozenset(p[1] for p in inside if p[0] == b) for b in range(256)]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        #: Tokens that their own bytes encode to.
        self.whole = {}
        self.whole = {t: ids for t in self.ids if len(ids := self.merge(t)) == 1}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        cuts = [k + 1 for k in range(len(raw) - 1) if raw[k + 1] not in self.follows[raw[k]]]
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)] if cuts else [raw]

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Merge by rank, leftmost first."""
        if (whole := self.whole.get(raw)) is not None:
            return whole
        ids, rank = [self.single[b] for b in raw], self.rank
        if len(ids) > KNOWN_LENGTH:
            return self.merge_long(ids)
        order = [rank.get(a << 16 | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while order and (best := min(order)) < NO_MERGE:
            k = order.index(best)
            ids[k] = best & 0xFFFF
            del ids[k + 1], order[k]
            if k:
                order[k - 1] = rank.get(ids[k - 1] << 16 | ids[k], NO_MERGE)
            if k < len(order):
                order[k] = rank.get(ids[k] << 16 | ids[k + 1], NO_MERGE)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list, for long runs without a boundary."""
        after, before, rank = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], self.rank
        heap = [(r, k) for k in range(len(ids) - 1) if (r := rank.get(ids[k] << 16 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            step, k = heapq.heappop(heap)
            right = after[k]
            if right < 0 or ids[k] < 0 or rank.get(ids[k] << 16 | ids[right]) != step:
                continue
            ids[k], ids[right] = step & 0xFFFF, -1
            after[k] = after[right]
            for left in (k, before[k]):
                if left >= 0 and after[left] >= 0:
                    before[after[left]] = left
                    if r := rank.get(ids[left] << 16 | ids[after[left]]):
                        heapq.heappush(heap, (r, left))
        return tuple(i for i in ids if i >= 0)

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of a part that begins and ends where the split pattern always cuts."""
        out: list[int] = []
        for word in WORDS.findall(part):
            for fragment in self.fragments(word.encode()):
                out += self.merge(fragment)
        return tuple(out)

    def _missing(self, part: str) -> tuple[int, ...]:
        ids = self.older.get(part) or self.encode_part(part)
        if len(part) <= KNOWN_LENGTH:
            if len(self.known) >= self.known_parts // 2:
                self.older, self.known = self.known, {}
            self.known[part] = ids
        return ids

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text, part by part."""
        if self.split_special and any(s in text for s in self.special):
            out = []
            for piece in self.split_special.split(text):
                out += [(self.special[piece],)] if piece in self.special else self.parts(piece) if piece else []
            return out
        get, missing = self.known.get, self._missing
        return [get(p) or missing(p) for p in CHUNK.findall(text)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, known_parts: int = KNOWN_PARTS) -> Vocabulary:
    return Vocabulary(path, known_parts)


def encode(docs: DataFrame, path: str, text: str = "text", keep_columns: tuple[str, ...] = (), out: str = "token_ids") -> DataFrame:
    """``keep_columns`` and an array of token ids per row. A null or empty text gives an empty array."""
    columns = list(keep_columns)

    def run(batches):
        vocab = vocabulary(path)
        for batch in by_bytes(batches, text):
            ids = [vocab.encode(t) if t else [] for t in batch.column(text).to_pylist()]
            yield with_rest(batch, columns, {out: pa.array(ids, pa.list_(pa.int32()))})

    fields = [docs.schema[c] for c in columns]
    schema = _schema(fields, f"{out} array<int>")
    return docs.select(*columns, *([text] if text not in columns else [])).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", keep_columns: tuple[str, ...] = (), out: str = "text") -> DataFrame:
    """``keep_columns`` and the decoded text per row; special tokens are kept as their strings. Null ids give null."""
    columns = list(keep_columns)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else vocab.decode(x) for x in batch.column(ids).to_pylist()]
            yield with_rest(batch, columns, {out: pa.array(texts, pa.string())})

    return encoded.select(*columns, ids).mapInArrow(run, _schema([encoded.schema[c] for c in columns], f"{out} string"))


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", known_parts: int = KNOWN_PARTS) -> DataFrame:
    """Encode every text, decode its ids again and digest both, in one pass.

    ``known_parts`` bounds what a worker remembers between texts: memory against time.

    Rows: the id column, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256`` (decoded text
    in UTF-8). Null and empty texts have no tokens; their digests are those of the empty string. Repeated rows and null
    ids give a row each; other columns are not read. An empty table gives no rows.
    """

    def run(batches):
        vocab = vocabulary(path, known_parts)
        names, tokens = vocab.text_of, vocab.bytes_of
        for batch in by_bytes(batches, text):
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(text).to_pylist():
                ids = vocab.encode(value) if value else []
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back = b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield with_rest(
                batch,
                [id_column],
                {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)},
            )

    schema = _schema([docs.schema[id_column]], "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, schema)


def _schema(fields, rest: str):
    from pyspark.sql.types import StructType

    return StructType([*fields, *StructType.fromDDL(rest).fields])
