"""Scores of texts by a trigram model in Elias-Fano tries.

1. Texts become blocks of word numbers with a dictionary of word hashes each (one pass over the texts).
2. Dictionaries are added up by hash: counts of every word in all training texts, and a number for each word.
3. Every position of every text goes to the shard of its word, as (word, the one before, the one before that, text), equal ones
   of a block once. A shard counts its training runs, builds a trie of them and answers its positions. Sums by text return to the block.

Model: p(w) = (c(w) + 1) / (N + V + 1); p(w | v) = (c(v w) + a p(w)) / (c(v) + a); p(w | u v) = (c(u v w) + b p(w | v)) /
(c(u v) + b), c being counts in training texts. Tries hold logarithms in steps of 1 / ``STEP``: of p(w), of p(w | v), of the
numerator of p(w | u v), and of the denominator of what follows a pair. These sums are integers, so no order changes a score.

A word in more than ``shard_positions`` positions is split over shards by the word before it, a pair of that size by the word before
that, and a run of that size by block; counts of such pairs and runs are added up before and given to all tasks. There are at most
three of these for each ``shard_positions`` positions.

Definitions: only A-Z are lower-cased; words are split at the characters ``[\\x20\\x09-\\x0D]``; an end follows the last word and
counts as a token. A null text is empty: one end. Rows that repeat an id are texts of their own. Held out are texts whose crc32
of the id as text, modulo ``folds``, is ``fold``; a null id counts as an empty text. Words are known by a 64-bit hash. Without
any training text all words are unknown, and scores follow from the formulas with zero counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import pick, ship
from weirworks.llm.eliasfano import TrigramTrie
from weirworks.llm.packing import pack, unpack
from weirworks.session import scratch_path

STEP = 1024
#: Words that a worker remembers.
MEMO = 200_000
_END = b""


@dataclass(frozen=True)
class ModelRules:
    folds: int = 7
    fold: int = 2
    #: Weights of the shorter context, in counts.
    pair_prior: float = 500.0
    run_prior: float = 20.0
    #: Tokens of a block; at most 2^21 - 2, since three word numbers make one sorting key.
    block_tokens: int = 1_500_000
    shard_positions: int = 1_500_000
    dictionary_words: int = 1_000_000


def steps(value: np.ndarray | float) -> np.ndarray:
    """A logarithm in steps."""
    return np.rint(STEP * np.log10(value)).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def code_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 63-bit numbers."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


class _Codes(dict):
    """Numbers of words in the order met, with their hashes beside."""

    def __init__(self):
        super().__init__()
        self.codes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.codes)
        self.codes.append(code_of(word))
        return place


_BLOCK = "rows array<long>, ids array<{kind}>, held array<boolean>, body binary, n_codes long, n_trained long, n_trained_texts long, n_all long, words binary"


def text_blocks(docs: DataFrame, rules: ModelRules) -> DataFrame:
    """Blocks of (row, doc_id, held, text): ``body`` has the lengths of the pieces of texts, how many first words of each are
    context only, the words as places in ``words``, and the place of the end; ``words`` has steps of the sorted hashes, training counts, other counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known, schema, pieces, size, end = _Codes(), None, [], 0, code_of(_END)

        def block():
            flat = np.concatenate([p[4] for p in pieces])
            lengths, skips = np.array([len(p[4]) for p in pieces]), np.array([p[3] for p in pieces])
            used, flat = np.unique(flat, return_inverse=True)
            codes = np.array([known.codes[i] for i in used.tolist()], dtype=np.int64)
            order = np.argsort(codes)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            flat, codes, owner = rank[flat], codes[order], np.repeat(np.arange(len(pieces)), lengths)
            counted = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= skips[owner]
            held = np.array([p[2] for p in pieces])
            total = np.bincount(flat[counted], minlength=len(codes))
            trained = np.bincount(flat[counted & ~held[owner]], minlength=len(codes))
            row = {
                "rows": [p[0] for p in pieces], "ids": [p[1] for p in pieces], "held": held.tolist(), "body": pack(lengths, skips, flat, np.flatnonzero(codes == end)),
                "n_codes": len(codes), "n_trained": int(trained.sum()), "n_trained_texts": int(((skips == 0) & ~held).sum()), "n_all": int(total.sum()),
                "words": pack(np.diff(codes, prepend=0), trained, total - trained),
            }
            pieces.clear()
            if len(known) > MEMO:
                known.clear()
                known.codes = []
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            schema = schema or pa.schema(
                [("rows", pa.list_(pa.int64())), ("ids", pa.list_(batch.schema.field(1).type)), ("held", pa.list_(pa.bool_())), ("body", pa.binary())]
                + [(name, pa.int64()) for name in ("n_codes", "n_trained", "n_trained_texts", "n_all")] + [("words", pa.binary())]
            )
            for row, doc, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                words.append(_END)
                for start in range(0, len(words), rules.block_tokens):
                    skip = min(start, 2)
                    piece = words[start - skip : start + rules.block_tokens]
                    if pieces and size + len(piece) > rules.block_tokens + 2:
                        yield block()
                        size = 0
                    pieces.append((row, doc, held, skip, np.fromiter(map(known.__getitem__, piece), dtype=np.int32, count=len(piece))))
                    size += len(piece)
        if pieces:
            yield block()

    return docs.mapInArrow(run, _BLOCK.format(kind=kind))


_ANSWER = "block long, part int, numbers binary, n_known long, often array<struct<code: long, number: long>>"


def add_dictionaries(blocks: DataFrame, parts: int, rules: ModelRules) -> DataFrame:
    """Of every block and part of all hashes: places, numbers, training counts and other counts of the block's words in that part.

    ``n_known`` adds up to the words with training counts; ``often`` has the hashes and numbers of those to be split.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, trained, other = unpack(words)
                codes = np.cumsum(codes)
                part = _mix(codes) % parts
                for k in np.unique(part).tolist():
                    mine = np.flatnonzero(part == k)
                    row = pack(np.diff(codes[mine], prepend=0), trained[mine], other[mine], np.diff(mine, prepend=0))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int64()), pa.array([row], pa.binary())], names=["part", "block", "words"])

    def add(table: pa.Table) -> pa.Table:
        part, blocks_in = table.column(0)[0].as_py(), table.column(1).to_pylist()
        found = [unpack(w) for w in table.column(2).to_pylist()]
        codes = np.concatenate([np.cumsum(f[0]) for f in found])
        all_codes, place = np.unique(codes, return_inverse=True)
        trained, other = (np.zeros(len(all_codes), dtype=np.int64) for _ in range(2))
        np.add.at(trained, place, np.concatenate([f[1] for f in found]))
        np.add.at(other, place, np.concatenate([f[2] for f in found]))
        often = [{"code": int(all_codes[i]), "number": i * parts + part + 1} for i in np.flatnonzero(trained + other > rules.shard_positions).tolist()]
        ends = np.cumsum([len(f[0]) for f in found])
        rows = []
        for i, own in enumerate(np.split(place, ends[:-1])):
            numbers = pack(found[i][3], np.diff(own * parts + part + 1, prepend=0), trained[own], other[own])
            rows.append({"block": blocks_in[i], "part": part, "numbers": numbers, "n_known": 0 if i else int((trained > 0).sum()), "often": [] if i else often})
        pair = pa.struct([("code", pa.int64()), ("number", pa.int64())])
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("part", pa.int32()), ("numbers", pa.binary()), ("n_known", pa.int64()), ("often", pa.list_(pair))]))

    dealt = blocks.select("block", "words").mapInArrow(deal, "part int, block long, words binary")
    return dealt.groupBy("part").applyInArrow(add, _ANSWER)


def _contexts(lengths: np.ndarray, skips: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """(last, middle, first, piece) of every counted position; words count from 1, 0 stands before the first word."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    word = flat.astype(np.int32) + 1
    middle, first = np.zeros_like(word), np.zeros_like(word)
    middle[1:], first[2:] = word[:-1], word[:-2]
    middle[offset < 1], first[offset < 2] = 0, 0
    keep = offset >= skips[owner]
    return word[keep], middle[keep], first[keep], owner[keep]


def often_runs(blocks: DataFrame, often: dict[int, int], rules: ModelRules) -> dict[tuple[int, ...], tuple[int, int]]:
    """(training count, count) by the numbers of the pairs (last, middle) and runs (last, middle, first) to be split; 0 stands before a text.

    Each of their words is one to be split, so only runs of such words are counted, per block first.
    """
    if not often:
        return {}
    order = np.array(sorted(often), dtype=np.int64)
    wide = len(order) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for body, words, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.cumsum(unpack(words)[0])
                at = np.minimum(np.searchsorted(order, codes), len(order) - 1)
                # 1: before the first word; 0: another word.
                rank = np.concatenate([[1], np.where(order[at] == codes, at + 2, 0)])
                last, middle, first, owner = _contexts(*unpack(body)[:3])
                last, middle, first = rank[last], rank[middle], rank[first]
                trained = ~np.array(held, dtype=bool)[owner]
                both = (last > 1) & (middle > 0)
                for mask, key in ((both, (last * wide + middle) * wide), (both & (first > 0), (last * wide + middle) * wide + first)):
                    met, place = np.unique(key[mask], return_inverse=True)
                    arrays = met, np.bincount(place, trained[mask], minlength=len(met)).astype(np.int64), np.bincount(place, minlength=len(met))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["run", "trained", "n"])

    counted = blocks.select("body", "words", "held").mapInArrow(run, "run long, trained long, n long")
    totals = counted.groupBy("run").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n")).where(F.col("n") > rules.shard_positions).collect()
    number = lambda rank: 0 if rank == 1 else often[int(order[rank - 2])]
    out = {}
    for row in totals:
        ranks = row.run // wide // wide, row.run // wide % wide, row.run % wide
        out[tuple(number(r) for r in (ranks if ranks[2] else ranks[:2]))] = (row.trained, row.n)
    return out


_ROUTED = "shard int, block long, positions binary, rows array<long>, ids array<{kind}>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"


@dataclass(frozen=True)
class Totals:
    """What the model needs to know of all training texts."""

    tokens: int
    known: int
    texts: int
    shards: int
    parts: int


def route(met: DataFrame, totals: Totals, split: dict, rules: ModelRules) -> DataFrame:
    """The positions of every block by shard, and one row (shard below 0) with the sums that need no trie."""
    kind = met.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema(
                [("shard", pa.int32()), ("block", pa.int64()), ("positions", pa.binary()), ("rows", pa.list_(pa.int64())), ("ids", batch.schema.field("ids").type),
                 ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))]
            )
            for block in batch.to_pylist():
                yield from (pa.RecordBatch.from_pylist([row], schema=out) for row in _routed(block, totals, split, rules))

    return met.mapInArrow(run, _ROUTED.format(kind=kind))


def _routed(block: dict, totals: Totals, split: dict, rules: ModelRules) -> Iterator[dict]:
    answers = [unpack(a["numbers"]) for a in block["answers"]]
    size = sum(len(a[0]) for a in answers)
    number, trained, total = (np.zeros(size + 1, dtype=np.int64) for _ in range(3))
    trained[0] = totals.texts
    for places, numbers, own_trained, own_other in answers:
        mine = np.cumsum(places) + 1
        number[mine], trained[mine], total[mine] = np.cumsum(numbers), own_trained, own_trained + own_other
    # From here on words are places in the order of their numbers.
    order = np.argsort(number)
    rank = np.empty(size + 1, dtype=np.int32)
    rank[order] = np.arange(size + 1)
    number, trained, total = number[order], trained[order], total[order]
    lengths, skips, flat, end = unpack(block["body"])
    last, middle, first, owner = _contexts(lengths, skips, flat)
    last, middle, first, end = rank[last], rank[middle], rank[first], rank[end + 1]
    n = len(lengths)
    own = np.log10((trained + 1) / (totals.tokens + totals.known + 1))
    yield {
        "shard": -1 - block["block"] % 1024, "block": block["block"], "rows": block["rows"], "ids": block["ids"], "held": block["held"],
        "n_tokens": np.bincount(owner, minlength=n).tolist(), "n_known": np.bincount(owner, trained[last] > 0, minlength=n).astype(np.int64).tolist(),
        "base": np.bincount(owner, own[last], minlength=n).tolist(),
    }
    # The piece of the word that a position belongs to, by what stands before it.
    shard = _mix(number)[last]
    big = total[last] > rules.shard_positions
    shard[big] ^= 1 + _mix(number[middle[big]]) % (total[last[big]] // rules.shard_positions + 1)
    for key, (_, count) in sorted(split.items(), key=lambda s: len(s[0])):
        local = np.minimum(np.searchsorted(number, key), size)
        if (number[local] != key).any():
            continue
        same = (last == local[0]) & (middle == local[1])
        if len(key) == 3:
            same &= first == local[2]
        which = _mix(number[first[same]]) if len(key) == 2 else _mix(np.full(int(same.sum()), block["block"]))
        shard[same] = _mix(number[local[:1]])[0] ^ ((1 << 20) * len(key) + which % (count // rules.shard_positions + 1))
    shard = (_mix(shard) % totals.shards).astype(np.int16 if totals.shards < 1 << 15 else np.int32)
    key = ((last.astype(np.int64) << 21) | middle) << 21 | first
    del last, middle, first
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(shard[order], kind="stable")]
    key, shard, owner = key[order], shard[order], owner[order]
    del order
    in_training = ~np.array(block["held"], dtype=bool)
    # Entries: a run in a piece of text, with how often; runs: with all their entries.
    fresh_run = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(shard) != 0)])
    entry_at = np.flatnonzero(fresh_run | np.concatenate([[True], np.diff(owner) != 0]))
    times = np.diff(entry_at, append=len(key))
    owner, fresh = owner[entry_at], fresh_run[entry_at]
    run_at = np.flatnonzero(fresh)
    entries = np.diff(run_at, append=len(entry_at))
    key, shard = key[entry_at[run_at]], shard[entry_at[run_at]]
    seen = np.add.reduceat(times * in_training[owner], run_at)
    mask, place = (1 << 21) - 1, np.zeros(size + 1, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=True):
        w, v, u = (key[a:b] >> 42) & mask, (key[a:b] >> 21) & mask, key[a:b] & mask
        counted = np.zeros(size + 1, dtype=bool)
        counted[w] = counted[v] = True
        used = counted.copy()
        used[u] = True
        used = np.flatnonzero(used)
        place[used] = np.arange(len(used))
        mine = slice(run_at[a], run_at[b] if b < len(run_at) else len(owner))
        # Counts are asked of the last two words only.
        packed = pack(
            np.diff(number[used], prepend=0), trained[used] * counted[used], np.diff(place[w], prepend=0), np.diff(place[v], prepend=0), place[u],
            seen[a:b], entries[a:b], owner[mine], times[mine], number[end],
        )
        yield {"shard": int(shard[a]), "block": block["block"], "positions": packed}


_SUMS = "block long, owners binary, rows array<long>, ids array<{kind}>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"


def score_shards(routed: DataFrame, totals: Totals, split: dict, rules: ModelRules) -> DataFrame:
    """Of each shard and block: pieces of text and their sums, in steps; rows below 0 pass."""
    kind = routed.schema["ids"].dataType.elementType.simpleString()

    def score(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table.drop_columns(["shard"]).rename_columns(["block", "owners", *table.column_names[3:]])
        blocks, found = table.column("block").to_pylist(), [unpack(p, narrow=True) for p in table.column("positions").to_pylist()]
        rows = []
        values = _answers(found, totals, split, rules)
        for block, part, value in zip(blocks, found, values, strict=True):
            count, owner, times = part[6:9]
            sums = np.bincount(owner, np.repeat(value, count) * times)  # integers below 2^53, so exact
            met = np.unique(owner)
            rows.append({"block": block, "owners": pack(np.diff(met, prepend=0), sums[met].astype(np.int64))})
        schema = pa.schema([("block", pa.int64()), ("owners", pa.binary()), *[table.schema.field(c) for c in table.column_names[3:]]])
        return pa.Table.from_pylist(rows, schema=schema)

    return routed.groupBy("shard").applyInArrow(score, _SUMS.format(kind=kind))


def _answers(found: list, totals: Totals, split: dict, rules: ModelRules) -> list[np.ndarray]:
    """The value of every run of every block, from a trie of the training runs among all of them."""
    numbers = [np.cumsum(f[0], dtype=np.int64) for f in found]
    all_numbers, at = np.unique(np.concatenate(numbers), return_inverse=True)
    all_trained = np.zeros(len(all_numbers), dtype=np.int64)
    np.maximum.at(all_trained, at, np.concatenate([f[1] for f in found]))
    places = np.split(at, np.cumsum([len(n) for n in numbers])[:-1])
    last = np.concatenate([p[np.cumsum(f[2])] for p, f in zip(places, found, strict=True)])
    middle = np.concatenate([p[np.cumsum(f[3])] for p, f in zip(places, found, strict=True)])
    first = np.concatenate([p[f[4]] for p, f in zip(places, found, strict=True)])
    wide = len(all_numbers)
    pair_keys, pair_of = np.unique(last * wide + middle, return_inverse=True)
    del last, middle
    run_keys, run_of = np.unique(pair_of * wide + first, return_inverse=True)
    del pair_of, first
    run_pair, run_first = run_keys // wide, run_keys % wide
    pair_last, pair_middle = pair_keys // wide, pair_keys % wide
    run_count = np.bincount(run_of, np.concatenate([f[5] for f in found]), minlength=len(run_keys)).astype(np.int64)
    pair_count = np.bincount(run_pair, run_count, minlength=len(pair_keys)).astype(np.int64)
    for key, (trained, _) in sorted(split.items(), key=lambda s: len(s[0])):
        local = np.minimum(np.searchsorted(all_numbers, key), wide - 1)
        if (all_numbers[local] != key).any():
            continue
        pair_key = local[0] * wide + local[1]
        pair = min(int(np.searchsorted(pair_keys, pair_key)), len(pair_keys) - 1)
        run_key = pair * wide + local[-1]
        run = min(int(np.searchsorted(run_keys, run_key)), len(run_keys) - 1)
        if len(key) == 2 and pair_keys[pair] == pair_key:
            pair_count[pair] = trained
        elif len(key) == 3 and pair_keys[pair] == pair_key and run_keys[run] == run_key:
            run_count[run] = trained
    trie = _trie(all_numbers, all_trained, (pair_last, pair_middle, pair_count), (run_pair, run_first, run_count), totals, rules)
    word, pair = trie.find_pairs(all_numbers, pair_last, pair_middle)
    run = trie.find_runs(all_numbers, word[run_pair], pair[run_pair], run_first)
    unknown = steps(1 / (totals.tokens + totals.known + 1))
    code = {name: np.concatenate([v.astype(np.int64), [0]]) for name, v in trie.values.items()}
    of_word = np.where(word >= 0, code["word_code"][word], unknown)
    of_pair = np.where(pair >= 0, code["pair_code"][pair], of_word + steps(rules.pair_prior) - steps(all_trained + rules.pair_prior)[pair_middle])
    norm = np.where(pair >= 0, code["pair_norm"][pair], -steps(rules.run_prior))
    norm[np.isin(all_numbers[pair_last], np.concatenate([f[9] for f in found]))] = 0  # nothing follows an end
    value = np.where(run >= 0, code["run_code"][run], (of_pair + steps(rules.run_prior))[run_pair]) + norm[run_pair]
    return np.split(value[run_of], np.cumsum([len(f[5]) for f in found])[:-1])


def _trie(numbers: np.ndarray, trained: np.ndarray, pairs: tuple, runs: tuple, totals: Totals, rules: ModelRules) -> TrigramTrie:
    """The trie of the training runs: words, pairs and runs with counts above 0, in the order of their numbers."""
    pair_last, pair_middle, pair_count = pairs
    run_pair, run_first, run_count = runs
    word_at = np.unique(pair_last)
    word_at = word_at[trained[word_at] > 0]
    single = (trained[word_at] + 1) / (totals.tokens + totals.known + 1)
    kept = np.flatnonzero(pair_count > 0)
    pair_word = np.searchsorted(word_at, pair_last[kept])
    double = (pair_count[kept] + rules.pair_prior * single[pair_word]) / (trained[pair_middle[kept]] + rules.pair_prior)
    pair_place = np.full(len(pair_count), -1, dtype=np.int64)
    pair_place[kept] = np.arange(len(kept))
    known = np.flatnonzero((run_count > 0) & (pair_place[run_pair] >= 0))
    run_at = pair_place[run_pair[known]]
    values = {
        "word_code": steps(single), "pair_code": steps(double), "pair_norm": -steps(pair_count[kept] + rules.run_prior),
        "run_code": steps(run_count[known] + rules.run_prior * double[run_at]),
    }
    trie = TrigramTrie.of(
        numbers[word_at], (pair_word, numbers[pair_middle[kept]]), (run_at, numbers[run_first[known]]), {k: v.astype("<i2") for k, v in values.items()}
    )
    return TrigramTrie.mapped(trie.to_bytes())


def _by_text(sums: DataFrame, kind: str) -> DataFrame:
    """The sums of all shards added to the pieces of texts of their block."""

    def merge(table: pa.Table) -> pa.Table:
        base = next(r for r in table.to_pylist() if r["rows"] is not None)
        units = np.zeros(len(base["rows"]), dtype=np.int64)
        for owners in table.column("owners").to_pylist():
            if owners is not None:
                places, added = unpack(owners)
                units[np.cumsum(places)] += added
        ids = table.schema.field("ids").type.value_type
        columns = [pa.array(base["rows"], pa.int64()), pa.array(base["ids"], ids), pa.array(base["held"], pa.bool_()), pa.array(base["n_tokens"], pa.int64()),
                   pa.array(base["n_known"], pa.int64()), pa.array(base["base"], pa.float64()), pa.array(units)]
        return pa.Table.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "units"])

    pieces = sums.groupBy("block").applyInArrow(merge, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, units long")
    added = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "units")]
    return pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *added)


def score_texts(docs: DataFrame, rules: ModelRules = ModelRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    if not 2 < rules.block_tokens < (1 << 21) - 2:
        raise ValueError("block_tokens must lie between 3 and 2^21 - 3")
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % rules.folds == rules.fold
    path = scratch_path(spark, "text-blocks")
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held"), "text")
    text_blocks(numbered, rules).withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    blocks = spark.read.parquet(path)
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_codes", "n_trained", "n_trained_texts", "n_all")]).first()
    parts = sums.n_codes // rules.dictionary_words + 1
    answer_path = scratch_path(spark, "dictionaries")
    add_dictionaries(blocks, parts, rules).write.parquet(answer_path)
    answers = spark.read.parquet(answer_path)
    known = answers.agg(F.coalesce(F.sum("n_known"), F.lit(0)).alias("n")).first().n
    often = {row.code: row.number for row in answers.select(F.inline("often")).collect()}
    split = often_runs(blocks, often, rules)
    totals = Totals(sums.n_trained, known, sums.n_trained_texts, 5 * sums.n_all // (4 * rules.shard_positions) + 1, parts)
    whole = answers.groupBy("block").agg(F.collect_list(F.struct("part", "numbers")).alias("answers"))
    met = blocks.select("block", "rows", "ids", "held", "body").join(whole, "block")
    by_text = _by_text(score_shards(route(met, totals, split, rules), totals, split, rules), kind)
    # The first word of each text has its empty context's denominator once.
    units = F.col("units") - F.lit(int(steps(totals.texts + rules.run_prior)))
    return by_text.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", (units / STEP).alias("score"))
