import random

import pytest
from pyspark.sql import functions as F

from snapstore.llm import line_dedup, near_dedup

from .helpers import AWKWARD, frame


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k):
    sets = {}
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        if i is not None:
            parent.setdefault(i, i)
            sets.setdefault(i, []).append(shingles(t, k))
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def near_copies(seed, groups=12, copies=12, words=60):
    rng, rows, at = random.Random(seed), [], 100
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 10))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((at, " ".join(own)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_brute_force(spark, k):
    rows = AWKWARD + near_copies(k) + [(2000 + i, "one hot text of several words that many rows repeat") for i in range(50)]
    got = near_dedup.near_dedup(frame(spark, rows).repartition(4), shingle_words=k, cell=8, cell_shingles=300).collect()
    expected = brute(rows, k)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == expected.get(r["doc_id"]), r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in got) == sorted((i or 0, len(shingles(t, k))) for i, t in rows)


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_dedup(frame(spark, [])).collect() == []


def test_what_a_star_misses_is_found(spark):
    """Two neighbours of a chain that both miss their bucket's centre still link."""
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 100])) for k in range(12)]
    got = near_dedup.near_dedup(frame(spark, rows), shingle_words=2).collect()
    expected = brute(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == expected and set(expected.values()) == {0}


def test_densified_signatures_agree_as_often_as_sets():
    import numpy as np

    signer, rng = near_dedup.Signer(), np.random.default_rng(1)
    for size in (5, 40, 700):
        shares = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, size=size + size // 8, dtype="u8")
            a, b = np.unique(pool[:size]), np.unique(pool[size // 8 :])
            shares.append((signer.signature(a) == signer.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(shares)) < 0.05


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 103), (103, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in near_dedup.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 103: 100}


def brute_lines(rows, min_sites=5):
    sites, first = {}, {}
    key = lambda i: (i is None, i or 0)
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n")):
            x = line.strip(" \t\r\x0b\x0c")
            if len(x.encode().split()) >= 2:
                sites.setdefault(x, set()).update({s} - {None})
                first[x] = min(first.get(x, (key(i), p)), (key(i), p))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for p, x in enumerate(lines) if len(sites.get(x.strip(" \t\r\x0b\x0c"), ())) < min_sites or first[x.strip(" \t\r\x0b\x0c")] == (key(i), p)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    shared = [f"a line that {n} sites share" for n in range(1, 12)]
    rows = [(i, t, "s0") for i, t in AWKWARD if i != 6]
    for d in range(200):
        own = [f"own line {d} {k}" for k in range(3)] + [s + " " * rng.randint(0, 2) for n, s in enumerate(shared, 1) if d % 11 < n] + ["short", "", "x"]
        rng.shuffle(own)
        rows.append((1000 + d, "\n".join(own), f"site{d % 11}" if d % 17 else None))
    got = line_dedup.line_dedup(frame(spark, rows).repartition(4)).select("row.doc_id", "cleaned", "n_lines", "n_removed", "row.rep").collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute_lines(rows)
    assert {r["rep"] for r in got} == {"x"}
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []


def test_line_sketch_far_from_the_threshold(spark):
    rows = [(k, "spread over many sites\nown text of this row", f"site{k}") for k in range(60)]
    got = line_dedup.line_dedup(frame(spark, rows), min_sites=5)
    assert got.agg(F.sum("n_removed")).first()[0] == 59 + 59
