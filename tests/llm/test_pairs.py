"""Operators on pairs against brute force: Jaccard join, embeddings, components."""

import random

import numpy as np
import pytest

from barloom.llm import embedding_dedup, jaccard_join
from barloom.llm.common import Forest, connected_components

from .helpers import components, documents, jaccard, smallest


def _near_copies(seed, groups=25):
    """Texts with copies edited by a little or a lot, short ones, and a line that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for _ in range(groups):
        words = rng.choices(vocabulary, k=rng.choice([3, 6, 9, 14, 40, 120, 300]))
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25 + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [f"{line} {' '.join(rng.choices(vocabulary, k=k))}" for k in (3, 4, 5, 6, 7, 8, 9, 30, 60) for _ in range(4)]
    return texts


def _check(spark, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(documents(spark, rows)).collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(jaccard([r[:2] for r in rows]), key=key)


def test_jaccard_join_equals_brute_force(spark):
    rows = [(k, t, None) for k, t in enumerate(_near_copies(1))]
    rows += [(900, None, None), (901, "", "en"), (902, " \t\n", "en"), (None, rows[0][1], "en"), (3, rows[3][1], "en"), (3, rows[3][1], "en")]
    rows += [(903, "A B C", None), (904, "a b c", None), (905, "a b\u00a0c", None), (906, "x " * 30000, "en"), (907, "X " * 29999, "en")]
    _check(spark, rows)


def test_jaccard_join_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(words), None))
    _check(spark, rows)


def _hot_group(n):
    """Near copies of one text, pairs of which are similar to each other only, and unlike texts with a passage of it."""
    rng = random.Random(8)
    base = [f"v{k}" for k in range(100)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(k % 5):
            words[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(words if k % 7 else words[:60] + [f"y{k // 14}-{i}" for i in range(40)] + [f"e{k}"]), None))
    return rows


def test_jaccard_join_hot_group_by_a_join(spark):
    rows = _hot_group(300)
    docs = documents(spark, rows).coalesce(2)
    got = sorted(tuple(r) for r in jaccard_join.components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(jaccard([r[:2] for r in rows]))


def test_jaccard_join_no_task_gets_a_hot_group(spark):
    docs = documents(spark, _hot_group(300)).coalesce(2).select("doc_id", "text")
    packed = jaccard_join._signature_blocks(docs, 4).where("sigs is not null").select("sigs").collect()
    _, count = np.unique(np.concatenate([np.frombuffer(r.sigs, np.uint64) for r in packed]), return_counts=True)
    assert count.max() < 32


def test_sketches_of_any_width_bound_the_difference():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 9000).astype(np.uint64))
    for n, more in ((5, 3), (1000, 40), (1020, 300), (4000, 5000), (9000, 0)):
        h, g = base[:n], np.unique(np.r_[base[n // 5 : n], rng.integers(0, 2**63, more).astype(np.uint64)])
        x, y = jaccard_join.sketch(h).tobytes(), jaccard_join.sketch(g).tobytes()
        exact = len(np.setxor1d(h, g))
        both = jaccard_join.Sketches([x, y])
        got, same = both.differ(np.array([0, 1]), np.array([1, 1])).tolist()
        assert got <= exact and got % 2 == exact % 2 and same == 0
        if n >= 1000:
            assert got > exact / 4
        short = both.folded(128)
        assert int(np.bitwise_count(short[0] ^ short[1]).sum()) <= got


def test_jaccard_join_empty_table(spark):
    assert jaccard_join.components(documents(spark, [])).count() == 0
    assert jaccard_join.deduplicate(documents(spark, [])).columns == documents(spark, []).columns


def test_jaccard_deduplicate_keeps_one_row_of_a_group(spark):
    text = " ".join(f"q{k}" for k in range(50))
    rows = [(4, text, "a"), (2, text + " end", "b"), (2, text + " end", "b"), (None, text, "c"), (7, None, "d"), (8, "", "e"), (9, "other words", "f")]
    kept = jaccard_join.deduplicate(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.lang) for r in kept) == [(2, "b"), (7, "d"), (8, "e"), (9, "f")]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 40, 100])
def test_signatures_of_similar_sets_meet(size):
    """Pigeonhole: every pair at the threshold shares a signature."""
    rng = np.random.default_rng(size)
    bands = jaccard_join.Bands()
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        drop = rng.integers(0, len(x) // 5 + 1)
        y = np.unique(np.r_[rng.permutation(x)[drop:], rng.integers(0, 2**63, rng.integers(0, len(x) // 5 + 1), dtype=np.uint64)])
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= 80 * (len(x) + len(y) - common):
            assert len(np.intersect1d(jaccard_join.signatures(x, bands), jaccard_join.signatures(y, bands)))


def _embeddings(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, mult long")


def _check_vectors(spark, rows, **sizes):
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(_embeddings(spark, rows), **sizes).collect()}
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and g is not None for _, v, g in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links.append((i, j))
    ids = [r[0] for r in rows]
    low = smallest(ids, components(len(rows), links))
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    assert got == {(i, int(k), c, i == c) for i, k, c in zip(ids, n, low, strict=True)}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        v = rng.standard_normal(32)
        rows.append((len(rows), v.tolist(), int(k % 3)))
        for noise in rng.choice([0.0, 0.1, 0.3, 0.4], rng.integers(0, 4)):
            rows.append((len(rows), (v + noise * rng.standard_normal(32)).tolist(), int(k % 3)))
    one = rows[0][1]
    rows += [(1000, None, 1), (1001, [0.0] * 32, 0), (1002, [*one[:-1], None], 0), (1003, [*one[:-1], float("nan")], 0)]
    rows += [(1004, [*one[:-1], float("inf")], 0), (1005, one, None), (1006, [], 0), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0)]
    rows += [(1009, [-x for x in one], 0), (1010, [x * 3 for x in one], 0), (1011, [-0.0] * 32, 0)]
    _check_vectors(spark, rows)
    _check_vectors(spark, rows, cell=20, block=8)  # many cells and split cells give the same


def test_embeddings_empty_table(spark):
    assert embedding_dedup.near_duplicates(_embeddings(spark, [])).count() == 0


def test_collision_count_reaches_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    plan = embedding_dedup.plan_for(64)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((4000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    hits = (np.abs((x - y) @ plan.counting.T) <= plan.window).sum(axis=1)
    assert (hits >= plan.count).mean() >= 0.998


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)] + [(500, k) for k in range(501, 600)]
    df = spark.createDataFrame([*links, (5, 5), (None, 3), *links[:10]], "a long, b long")
    got = {r.vertex: r.root for r in connected_components(df).collect()}
    want = components(600, links)
    assert got == {v: want[v] for link in links if link[0] != link[1] for v in link}


def test_forest():
    f = Forest(8)
    f.add(np.array([1, 2, 6]), np.array([2, 3, 7]))
    f.add(np.array([3]), np.array([0]))
    assert f.root.tolist() == [0, 0, 0, 0, 4, 5, 6, 6]
