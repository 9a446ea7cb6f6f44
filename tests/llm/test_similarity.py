import random

import numpy as np
import pytest

from barline.llm import cross_polytope, ngram_join
from barline.llm.components import components


def brute_groups(docs):
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_copies(seed, n=160):
    """Texts of many sizes whose edits put many pairs close to the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    docs, i = [], 0
    while i < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 450]))]
        if rng.random() < 0.3:
            base += shared
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 18)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text = text[: rng.randint(1, len(text))]
            docs.append((i, rng.choice([" ", "\n", "\t  "]).join(text)))
            i += 1
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(frame, seed):
    docs = near_copies(seed)
    got = sorted(tuple(r) for r in ngram_join.similar_groups(frame([(a, b, "s") for a, b in docs])).collect())
    assert got == brute_groups(docs)


def test_signatures_of_similar_sets_meet():
    """Every pair at or above the threshold shares a signature that one of the two files at home."""
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(4, 400))
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        add = int(rng.integers(0, max(1, n // 9) + 1))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: len(a) - drop], rng.integers(0, 2**63, add).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(np.setxor1d(a, b)) == 0 or ngram_join.NUM * (len(a) + len(b) - both) > ngram_join.DEN * both:
            continue
        (ah, ag), (bh, bg) = ngram_join.signatures(a), ngram_join.signatures(b)
        assert np.isin(ah, np.concatenate((bh, bg))).any() or np.isin(bh, ag).any()
        met += 1
        low = ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b))
        assert low <= len(a) + len(b) - 2 * both
    assert met > 800


def test_group_edge_rows(frame, nasty):
    docs = frame([*nasty, (None, "one two three four five six", "s"), (8, nasty[0][1], "t")])
    got = sorted((tuple(r) for r in ngram_join.similar_groups(docs).collect()), key=repr)
    want = {1: 1, 2: 1, 8: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 9: 9}
    assert {r[0]: r[2] for r in got if r[0] is not None} == want
    assert (None, 2, None) in got and (4, 0, 4) in got and (7, 1, 7) in got
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(docs).collect()) == sorted(["1", "3", "4", "5", "6", "7", "9", "None"])


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 4), (4, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=3, n=500, dim=48):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 2, n):  # half are turned copies at cosines around the threshold
        a = x[i - n // 2] / np.linalg.norm(x[i - n // 2])
        b = rng.normal(size=dim)
        b -= (b @ a) * a
        c = rng.uniform(0.85, 1.0)
        x[i] = (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)) * rng.uniform(0.1, 50)
    return x


def test_near_vectors_match_brute_force(spark):
    x = vectors().astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, x[0].tolist()), (901, x[0].tolist()), (902, None), (903, []), (904, [0.0] * 48), (905, [None] * 48)]
    rows += [(906, [float("nan")] * 48), (907, [float("inf")] + [1.0] * 47), (908, [1.0]), (909, [2.0]), (None, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' vector", "1 as id", "2 as c0")
    got = {r.vec_id: r for r in cross_polytope.near_vectors(df).collect()}
    valid = {i: np.array(v, np.float64) for i, v in rows if v and i is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = {i: set() for i in got}
    for a in valid:
        for b in valid:
            p, q = valid[a], valid[b]
            if a < b and len(p) == len(q) and p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= 0.9:
                links[a].add(b)
                links[b].add(a)
    wanted, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert found <= wanted and found >= 0.99 * wanted
    if found == wanted:
        for i in got:
            assert got[i].n_links == len(links[i])
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            if i is not None:
                assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    assert got[908].n_links == 1 and got[902].n_links == 0 and got[None].kept
    assert cross_polytope.near_vectors(df.limit(0)).count() == 0
