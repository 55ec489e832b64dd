"""Byte-level BPE, token streams, shards and rollups against the tokenizer library and plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weirworks.llm import bpe, rollups, shards
from weirworks.llm.tokens import TokenEncoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = "a\t\n  b\r\n \x1c\x85 ²½x1٣ don't 日本語 ñ😀    end  "
CLASH = "doc_id long, text string, ids string, n_tokens string, part string, slot string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(5)
    kinds = ["ab", "aab  ", "thiner e", "\n\t \x1c\x85", "é²½x1٣ ", "=-_*", "a", "日本語 ñ'sll", "0123456789"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(0, 250))) for _ in range(600)] + [ODD, "", "a" * 5000, "=-" * 3000]


def test_tree_and_library_agree(library):
    tree, fast = bpe.Encoder(RANKS, PATTERN), TokenEncoder(RANKS, PATTERN)
    for text in texts():
        wanted = library.encode_ordinary(text)
        assert np.frombuffer(tree(text), "<u4").tolist() == wanted
        assert np.frombuffer(fast(text), "<u2").tolist() == wanted
        assert tree.decode(tree(text)) == text.encode()


@pytest.mark.parametrize("leaf", [2, 5, 16])
def test_any_tree_shape_gives_the_same_ids(library, leaf):
    code, rng = bpe.Bpe(bpe.load_ranks(RANKS), leaf), random.Random(leaf)
    for _ in range(150):
        piece = bytes(rng.choice(b"thineraos") for _ in range(rng.randrange(1, 300)))
        assert code.encode_bytes(piece) == library._encode_single_piece(piece)
        cut = rng.randrange(len(piece) + 1)
        assert code.join(code.encode_bytes(piece[:cut]), code.encode_bytes(piece[cut:])) == code.encode_bytes(piece)


def test_round_trip_of_odd_rows(spark, library):
    rows = [(1, ODD, "x", "y", "z", "s"), (2, None, "x", "y", "z", "s"), (3, "", None, None, None, None), (3, "again", "", "", "", ""), (None, "w" * 30_000, "", "", "", "")]
    docs = spark.createDataFrame(rows, CLASH)
    got = sorted(map(tuple, bpe.round_trip(docs, RANKS, PATTERN).collect()), key=str)
    wanted = []
    for doc_id, text, *_ in rows:
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()
        wanted.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(wanted, key=str)
    decoded = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(r.text for r in decoded.collect()) == sorted(t or "" for _, t, *_ in rows)
    both = bpe.with_ids(docs, RANKS, PATTERN)
    assert both.columns == ["doc_id", "text", "part", "slot", "ids", "token_ids", "n_tokens"][:2] + ["ids", "part", "slot", "token_ids", "n_tokens"]
    assert sorted(r.text for r in both.collect() if r.text is not None) == sorted(t for _, t, *_ in rows if t is not None)
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_keyed_bijection(size):
    order, numbers = shards.Permutation(size, 42), np.arange(size)
    slots = order.slots(numbers)
    assert sorted(slots.tolist()) == numbers.tolist() and (order.numbers(slots) == numbers).all()
    if size > 100:
        assert (slots != shards.Permutation(size, 43).slots(numbers)).any() and abs(np.corrcoef(slots, numbers)[0, 1]) < 0.2


def test_shards_hold_every_token_once(spark, library, tmp_path):
    rows = [(1, ODD, "x", "y", "z", "s"), (2, None, "", "", "", ""), (3, "", "", "", "", ""), (4, "word " * 500, "", "", "", ""), (4, "word " * 500, "", "", "", "")]
    rows += [(i, f"text {i} of several words", "", "", "", "") for i in range(5, 60)]
    rules = shards.ShardRules(length=16, per_shard=8)
    docs = spark.createDataFrame(rows, CLASH).repartition(5)
    path = str(tmp_path / "shards")
    count = shards.write_shards(docs, path, RANKS, PATTERN, rules)
    records = shards.with_numbers(shards.read_shards(spark, path, count, rules), count, rules).collect()
    assert sorted(r.slot for r in records) == list(range(count)) == sorted(r.sequence for r in records)
    raw = {}
    for folder in (tmp_path / "shards").glob("shard=*"):
        (file,) = folder.glob("part-*")
        content = file.read_bytes()[:-1]
        for i in range(len(content) // rules.stride):
            raw[int(folder.name[6:]) * rules.per_shard + i] = content[i * rules.stride : (i + 1) * rules.stride]
    for r in records:
        assert hashlib.sha256(raw[r.slot]).hexdigest() == r.ids_sha256 and r.byte_offset == r.slot % rules.per_shard * rules.stride
    stream = np.frombuffer(b"".join(raw[r.slot] for r in sorted(records, key=lambda r: r.sequence)), "<u2").tolist()
    docs_found, current = [], []
    for token in stream:
        if token == rules.separator:
            docs_found.append(library.decode(current))
            current = []
        else:
            current.append(token)
    wanted = sorted([t or "" for _, t, *_ in rows])
    assert sorted(docs_found) == sorted(wanted + [""] * (len(docs_found) - len(wanted)))
    assert shards.write_shards(docs.limit(0), str(tmp_path / "none"), RANKS, PATTERN, rules) == 0
    assert shards.read_shards(spark, str(tmp_path / "none"), 0, rules).count() == 0


def test_rollup_follows_inserts_revisions_and_deletes(spark, tmp_path):
    totals = rollups.TokenRollup(spark, str(tmp_path / "rollup"))

    def change(*rows):
        return spark.createDataFrame(rows, rollups.CHANGE)

    def now():
        return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in totals.totals().collect()}

    assert now() == {}
    assert totals.apply(1, change((1, "v", "a", "en", 10), (2, "v", "a", "en", 5), (2, "v", "a", "en", 5), (3, "v", None, None, 7), (None, "v", "a", "en", 9)))
    assert now() == {("a", "en", "v"): (2, 15), (None, None, "v"): (1, 7)}
    assert not totals.apply(1, change((1, "v", "a", "en", 99)))
    assert totals.apply(2, change((1, "v", "b", "en", 11), (2, "v", "a", "en", None), (3, "w", "a", "de", 1), (9, "v", "a", "en", None)))
    assert now() == {("b", "en", "v"): (1, 11), (None, None, "v"): (1, 7), ("a", "de", "w"): (1, 1)}
    # A batch that died before its mark leaves files that nobody reads.
    spark.createDataFrame([("a", "en", "v", 5, 5)], rollups.DELTA).write.parquet(f"{totals.folder}/deltas/batch=3")
    assert ("a", "en", "v") not in now()
    assert totals.apply(3, change((2, "v", "a", "en", 4), (3, "v", "a", "en", 2), (3, "v", "a", "en", 1)))
    assert now() == {("b", "en", "v"): (1, 11), ("a", "en", "v"): (2, 6), ("a", "de", "w"): (1, 1)}
    with pytest.raises(ValueError):
        rollups.TokenRollup(spark, totals.folder).apply(0, change((1, "v", "a", "en", 1)))


def test_token_counts_match_the_library(spark, library):
    multi = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(multi), special_tokens={})
    docs = spark.createDataFrame([(1, ODD, "s", "en", "x"), (2, None, None, None, "x"), (3, "z" * 9000, "s", "de", "x")], "doc_id long, text string, source string, lang string, version string")
    got = {(r.doc_id, r.version): r.n_tokens for r in rollups.token_counts(docs, {"a": RANKS, "b": multi}, PATTERN).collect()}
    for doc_id, text in ((1, ODD), (2, ""), (3, "z" * 9000)):
        assert got[doc_id, "a"] == len(library.encode_ordinary(text)) and got[doc_id, "b"] == len(other.encode_ordinary(text))
