from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np

from pagemill.llm import superminhash as S

SCHEMA = "doc_id long, text string"


def brute(rows):
    """doc_id, set, and the least doc_id reachable, from the contract's words."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            up[root(b)] = root(a)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[k]), least, doc_id == least if doc_id is not None and least is not None else least is None))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def edited(words, n, rng):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return words


def planted(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"W{k}ö" for k in range(500)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 20, 60, 150, 400]))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            rows.append(rng.choice([" ", "\t", "\n\n"]).join(edited(base, min(len(base), rng.choice([0, 0, 1, 2, 3])), rng)))
    chain = rng.choices(vocabulary, k=120)  # each link holds, the ends don't
    for _ in range(12):
        chain = edited(chain, 1, rng)
        rows.append(" ".join(chain))
    rows += ["", None, " \n ", "", "x", "X", "\xa0", "a b c d e", "a b c d e f"]
    ids = rng.sample(range(10_000), len(rows))
    return [*zip(ids, rows, strict=True), (None, rows[0]), (None, "only nulls here"), (ids[3], rows[3])]


def test_groups_are_those_of_brute_force(spark):
    rows = planted()
    assert found(spark, rows) == brute(rows)


def test_large_buckets_in_small_units(spark, monkeypatch):
    unit = 4
    monkeypatch.setattr(S, "UNIT", unit)
    rng = random.Random(unit)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(edited(base, rng.choice([0, 1, 1, 2, 4]), rng))) for k in range(60)] + planted(unit)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert found(spark, rows) == brute(rows)


def test_recall_of_bands_at_the_limit():
    rng = np.random.default_rng(5)
    met = plausible = total = 0
    for n in (20, 60, 200, 1000):
        for _ in range(150):
            pool = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
            extra = int(0.075 * n)
            common = int(np.ceil(0.85 * (n + extra)))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : n + extra]]))
            x, y = (np.frombuffer(S.sketch(s), np.uint8).reshape(S.BANDS, S.ROWS) for s in (a, b))
            total += 1
            met += bool((x == y).all(axis=1).any())
            plausible += int((x == y).sum()) >= S.PLAUSIBLE
    assert total > 300 and met == total and plausible == total


def test_signature_is_the_least_rank_of_permutations():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 37).astype(np.uint64))
    want = [min(v) for v in zip(*[S.signature(grams[k : k + 1], 50).tolist() for k in range(len(grams))], strict=True)]
    assert S.signature(grams, 50).tolist() == want
    assert S.signature(grams, 50, chunk=5).tolist() == want
    assert sorted(x >> 32 for x in S.signature(grams[:1], 50).tolist()) == list(range(50))  # one element's ranks are a permutation


def test_estimate_varies_less_than_independent_minima():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 30).astype(np.uint64)
        a, b = np.unique(pool[:24]), np.unique(pool[6:])
        errors.append((S.signature(a) == S.signature(b)).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * 0.6 * 0.4 / S.SIZE


def test_overlaps_equal_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 40, 80, 1)]
    assert S.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_empty_and_long_texts_and_other_columns(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{k % 7919}" for k in range(60_000))
    docs = spark.createDataFrame([(1, long, "a", b"x"), (2, long + " end", "b", None), (None, None, None, None)], "doc_id int, text string, root string, key binary")
    rows = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    assert rows[2].component_id == 1 and not rows[2].kept and rows[1].kept and rows[None].kept
    assert list(rows[1].asDict()) == ["doc_id", "n_shingles", "component_id", "kept"]
