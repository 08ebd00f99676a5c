from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from pagemill.llm import resampling as R

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, target, run, buckets, percent):
    def bucketed(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, run + 1) for k in range(len(w) - n + 1)]

    raw, aim = Counter(b for _, t in rows for b in bucketed(t)), Counter(b for t in target for b in bucketed(t))
    n, m = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (n + buckets) / ((raw[b] + 1) * (m + buckets)))) for b in range(buckets)}
    out = []
    for doc_id, text in rows:
        f = bucketed(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= 20])
    fit = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0]))
    for rank, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize(("run", "buckets", "head"), [(1, 10_000, R.HEAD), (2, 97, 30), (2, 70_000, 0)])
def test_draw_is_that_of_brute_force(spark, run, buckets, head):
    rng = random.Random(run + buckets)
    vocabulary = ["word", "Ärger", "the", "a1", "日本", "x" * 90, *(f"w{k}" for k in range(200))]
    rows = [(k, rng.choice([" ", ". "]).join(rng.choices(vocabulary, weights=[9] * 6 + [1] * 200, k=rng.choice([0, 3, 19, 20, 60])))) for k in rng.sample(range(-50, 5000), 150)]
    rows += [(9000, rows[0][1]), (None, " ".join(vocabulary)), (9001, None), (9002, ""), (9003, "?!")]
    target = [" ".join(rng.choices(vocabulary[:40], k=50)) for _ in range(10)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rank string, n_words int")
    found = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), run, buckets, percent=30, head=head)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, target, run, buckets, 30)


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.resample(none, none).count() == 0
    rows = [(1, "a " * 30), (2, None), (1, "a " * 30)]
    got = sorted((tuple(r) for r in R.resample(spark.createDataFrame(rows, SCHEMA), none, percent=100).collect()), key=repr)
    assert got == brute(rows, [], 1, R.BUCKETS, 100) or {r[4] for r in got} == {None, 1, 2}


def test_draws_go_towards_the_target(spark):
    rng = random.Random(1)
    near, far = [f"n{k}" for k in range(50)], [f"f{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(near if k % 4 == 0 else far, k=40))) for k in range(400)]
    found = R.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(" ".join(near),)] * 200, "text string")).where("rank is not null").collect()
    assert len(found) == 40 and sum(r.doc_id % 4 == 0 for r in found) >= 36


def test_very_long_text(spark):
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    (row,) = R.resample(spark.createDataFrame([(1, long)], SCHEMA), spark.createDataFrame([("w1",)], "text string"), percent=100).collect()
    assert (row.n_features, row["rank"]) == (200_000, 1)
