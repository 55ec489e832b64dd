"""Top-k search and benchmark decontamination against brute force, and on odd rows."""

import random

import numpy as np

from weirworks.llm import covertree
from weirworks.llm import decontaminate as leak


def brute_top(rows, asked, k):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault((i, tuple(np.floor(256 * np.array(v, dtype=np.float64)).astype(int))))
    out = []
    for q, a in whole:
        if asked(q):
            scored = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b)})[:k]
            out += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 2
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(12)] + rng.normal(size=8) * 0.05]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [rows[0], rows[50]]
    rows += [(2000, None), (2050, []), (2100, [1.0, None] * 4), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (None, rows[1][1]), (2250, [1.0, 2.0]), (2300, [2.0, 1.0]), (2350, [0.0] * 8)]
    vectors = spark.createDataFrame([(*r, "b", 1) for r in rows], "vec_id long, embedding array<float>, block string, score int").repartition(5)
    for block in (37, 5000):
        got = covertree.top_k(vectors, vectors.where("vec_id % 50 = 0"), block_rows=block, query_rows=6)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda q: q % 50 == 0, 5)
    assert covertree.top_k(vectors.limit(0), vectors.where("vec_id % 50 = 0")).count() == 0
    assert covertree.top_k(vectors, vectors.limit(0)).count() == 0


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(1, 4)) * 300 + rng.normal(size=(120, 4)) * 10 for _ in range(8)])
    tree = covertree.CoverTree(points, leaf=8)
    assert len(tree.span) > 8 and sorted(tree.order.tolist()) == list(range(len(points)))
    for node, (start, end) in enumerate(tree.span_of):
        reach = np.sqrt(((points[tree.order[start:end]] - tree.centre_of[node]) ** 2).sum(1))
        assert reach.max() <= tree.radius_of[node] + 1e-9
        first, last = tree.children_of[node]
        if last:
            centres = tree.centre_of[first:last]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(last - first, 1)]
            assert (apart > tree.radius_of[node] / 2).all() and (tree.radius_of[first:last] <= tree.radius_of[node] / 2 + 1e-9).all()
            assert np.array_equal(centres[0], tree.centre_of[node])


def test_spread_points_come_in_levels_down_to_small_leaves():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(700, 64))
    points = np.floor(256 * points / np.linalg.norm(points, axis=1, keepdims=True))
    points = np.concatenate([points, points[:5], np.tile(points[9], (60, 1)), np.zeros((2, 64))])
    tree = covertree.CoverTree(points, leaf=8, step=1.3)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    depth = np.zeros(len(tree.span_of), dtype=int)
    for node, (start, end) in enumerate(tree.span_of):
        inside, (first, last) = points[tree.order[start:end]], tree.children_of[node]
        reach = np.sqrt(((inside - tree.centre_of[node]) ** 2).sum(1))
        norms = np.sqrt((inside**2).sum(1))
        assert reach.max() <= tree.radius_of[node] + 1e-9 and (tree.low_of[node], tree.top_of[node]) == (norms.min(), norms.max())
        if last:
            depth[first:last] = depth[node] + 1
            assert last - first > 1 and (tree.radius_of[first:last] <= tree.radius_of[node] / 1.3 + 1e-9).all()
            assert tree.span_of[first, 0] == start and tree.span_of[last - 1, 1] == end
        else:
            assert end - start <= 8 or reach.max() == 0
    assert depth.max() >= 2


def test_dual_descent_prunes_clusters_and_stays_exact():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 500
    points = np.floor(centres[rng.integers(40, size=3000)] + rng.normal(size=(3000, 16)) * 20).astype(np.int64)
    ids, asked = np.arange(3000), np.arange(0, 3000, 50)
    best = covertree.Best(asked, 5)
    tally = covertree.search(points[asked], ids, points, best, covertree.CoverTree(points[asked], covertree.QUERY_LEAF, covertree.STEP))
    for row, q in enumerate(asked):
        scores = points @ points[q]
        wanted = sorted((-int(scores[i]), i) for i in ids if i != q)[:5]
        assert [(-s, i) for s, i in zip(best.score[row].tolist(), best.id[row].tolist())] == wanted
    assert tally.pruned_groups > 0 and tally.scores < len(asked) * 3000 / 2


def substring_distance(item, text):
    before = np.zeros(len(text) + 1, dtype=int)
    codes, place = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        now = np.empty(len(text) + 1, dtype=int)
        now[0] = i
        now[1:] = np.minimum(before[:-1] + (codes != ord(c)), before[1:] + 1)
        before = np.minimum.accumulate(now - place) + place
    return int(before.min()), int(before.argmin())


def brute_leaks(docs, items, rules):
    forms = {}
    for i, text in items:
        if i is not None and len(leak.normal(text)) >= rules.min_chars:
            forms[leak.normal(text)] = min(i, forms.get(leak.normal(text), i))
    found = {}
    for d, text in docs:
        for form, i in forms.items():
            distance, end = substring_distance(form, leak.normal(text))
            if distance <= int(len(form) * rules.rate):
                found[d, i] = min(found.get((d, i), (10**9,)), (distance, int(len(form) * rules.rate), end))
    return sorted(((*k, *v) for k, v in found.items()), key=str)


def edited(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.3:
            del out[at]
        elif kind < 0.6:
            out.insert(at, rng.choice("xyzé"))
        else:
            out[at] = rng.choice("qvwñ")
    return "".join(out)


def test_leaks_match_brute_force(spark, sf_dir):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:14]
    filler = [r.text[:700] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    docs = []
    for n in range(40):
        text = items[rng.randrange(len(items))][1]
        docs.append((n, filler[n][:300] + " " + edited(text, rng.choice([0, 0, 3, 9, 14, 19, 24, 40]), rng) + filler[n][300:]))
    docs += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", "\n\t ")), (None, items[1][1]), (103, (items[2][1] + " ") * 300), (103, edited(items[2][1], 2, rng))]
    items += [(500, None), (501, ""), (502, "the of and"), (503, items[3][1].upper()), (None, items[4][1]), (2, items[2][1])]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, distance int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, block string")
    wanted = brute_leaks(docs, items, leak.LeakRules())
    assert len(wanted) > 20
    for rules in (leak.LeakRules(), leak.LeakRules(block_chars=600, windows=7)):
        assert sorted(map(tuple, leak.leaks(d, b, rules).collect()), key=str) == wanted
    clean = leak.drop_leaks(d, b)
    assert clean.columns == d.columns
    gone = {w[0] for w in wanted if w[0] is not None}
    assert sorted(r.doc_id for r in clean.where("doc_id IS NOT NULL").collect()) == sorted(i for i, _ in docs if i is not None and i not in gone)
    assert clean.where("doc_id IS NULL").count() == 1
    assert leak.leaks(d, b.limit(0)).count() == 0 and leak.leaks(d.limit(0), b).count() == 0
