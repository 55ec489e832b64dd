"""Byte-level BPE as a reduction over a tree of text halves.

A token sequence is the encoding of its bytes exactly if every two neighbours are what their joined bytes encode to. So
two encoded halves can be joined by looking at their border only: re-encode a window of tokens around it, and accept the
window once its outer tokens are valid next to the untouched tokens outside; otherwise double it. The joins are
associative, hence a tree of any shape gives the same ids, and decoding is concatenation up the same tree.

Nulls are empty texts; an empty text has no tokens. Texts of any length, repeated documents and extra columns need no care:
one row in, one row out, and every row is worked on alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weirworks.llm.common import pick, quoted, ship

#: Pieces up to this many bytes are merged directly; longer ones are split in halves.
LEAF_BYTES = 16
NO_RANK = 1 << 62
#: Different pieces of text that a worker remembers.
MEMO = 800_000
#: Tokens that are concatenated at one leaf of the decoding tree.
DECODE_LEAF = 2_048

#: Characters beyond which the short form of the splitting pattern could differ from the Unicode classes.
_UNUSUAL = re.compile("[\x1c-\x1f²³¹¼-¾ɐ-\U0010ffff]")
_FORMS = {r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d", r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)"}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank from a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Splitter:
    """``findall`` of the pattern; texts of common Latin characters go through an equal, faster form of it."""

    def __init__(self, pattern: str):
        self._full = regex.compile(pattern)
        short = pattern
        for unicode_class in sorted(_FORMS, key=len, reverse=True):
            short = short.replace(unicode_class, _FORMS[unicode_class])
        self._short = None if r"\p" in short else re.compile(short)

    def __call__(self, text: str) -> list[str]:
        if self._short is None or _UNUSUAL.search(text):
            return self._full.findall(text)
        return self._short.findall(text)


class Bpe:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks = ranks
        self.leaf = max(2, leaf)
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self._fits: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The lowest-ranked, leftmost pair is merged until none is left."""
        rank_of, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank_of(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != NO_RANK:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + parts[i], NO_RANK)
            if i < len(pairs):
                pairs[i] = rank_of(parts[i] + parts[i + 1], NO_RANK)
        return [self.ranks[part] for part in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their joined bytes."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > MEMO:
                self._fits.clear()
            known = self._fits[left, right] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours from the encodings of each."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            size *= 2
            a, b = min(size, len(left)), min(size, len(right))
            inside = b"".join(map(self.pieces.__getitem__, left[-a:] + right[:b]))
            window = self.encode_bytes(inside, whole=True)
            stable_left = a == len(left) or self.fits(left[-a - 1], window[0])
            stable_right = b == len(right) or self.fits(window[-1], right[b])
            if stable_left and stable_right:
                return left[:-a] + window + right[b:]

    def encode_bytes(self, piece: bytes, whole: bool = False) -> list[int]:
        """Ids of a piece of any length. ``whole`` ends the growth of a window: it is then merged directly."""
        if len(piece) <= self.leaf:
            return self.merge(piece)
        if whole:
            return _merge_long(self, piece)
        middle = 1 << ((len(piece) - 1).bit_length() - 1)  # a power of two: runs of one character fall into equal parts
        return self.join(self.encode_bytes(piece[:middle]), self.encode_bytes(piece[middle:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """A match of the pattern: one token if it is one, else the tree."""
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.encode_bytes(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined up a tree of halves."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.pieces.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _merge_long(bpe: Bpe, piece: bytes) -> list[int]:
    """Direct merging of a long piece with a heap instead of a scan for each merge."""
    ranks, size = bpe.ranks, len(piece)
    following, previous, end = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
    alive = [True] * size

    def pair(i: int) -> int | None:
        j = following[i]
        return ranks.get(piece[i : end[j]]) if j < size else None

    heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        if not alive[i] or following[i] >= size or end[following[i]] != stop or pair(i) != rank:
            continue
        j = following[i]
        alive[j], end[i], following[i] = False, end[j], following[j]
        if following[j] < size:
            previous[following[j]] = i
        for at in (previous[i], i):
            if at >= 0 and (new := pair(at)) is not None:
                heapq.heappush(heap, (new, at, end[following[at]]))
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i : end[i]]])
        i = following[i]
    return out


class Encoder(dict):
    """Ids of a text as little-endian 32-bit integers; a dictionary that remembers the pieces met so far."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        self.bpe = Bpe(load_ranks(ranks_path))
        self.split = Splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = np.array(self.bpe.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(ids, dtype="<u4").tolist())


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and tokenizer."""
    return Encoder(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): the ids of every whole text as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        code = encoder(ranks_path, pattern)
        for batch in batches:
            ids = pa.array([code(text or "") for text in batch.column(1).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    source = pick(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text): the inverse of ``encode``; ids that are no valid UTF-8 together give replacement characters."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        code = encoder(ranks_path, pattern)
        for batch in batches:
            texts = [code.decode(ids or b"").decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    source = pick(encoded, doc_id="doc_id", ids="ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def with_ids(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` with the text as decoded from its ids, and the ids and their number; a null text stays null.

    A text whose decoded bytes differ from it ends the job. New columns replace those of the same name.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (ids_col, count_col)]
    added = T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(count_col, T.LongType())])
    schema = T.StructType([*[docs.schema[c] for c in kept], *added.fields])
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        code = encoder(ranks_path, pattern)
        for batch in batches:
            texts, ids, counts = [], [], []
            for text in batch.column(place).to_pylist():
                own = code(text or "")
                back = code.decode(own).decode("utf-8")
                if back != (text or ""):
                    raise ValueError("a text does not decode to itself")
                texts.append(None if text is None else back)
                ids.append(np.frombuffer(own, dtype="<i4"))
                counts.append(len(own) // 4)
            columns = [*batch.columns[:place], pa.array(texts, pa.string()), *batch.columns[place + 1 :]]
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[docs[quoted(c)] for c in kept]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of every text and of the bytes they decode to.

    Both ways run in one pass, because the ids of a document are no larger than a few times its text.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        code = encoder(ranks_path, pattern)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1):
                ids = code(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(code.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = pick(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
