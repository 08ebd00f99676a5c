"""The fixed columns of operators against plain versions, over whole tables and odd rows."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagemill.llm import minhash_join, packing, secrets, token_planes
from pagemill.llm.shared import shared_folder
from pagemill.llm.tokens import END_ID, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, start string, ids binary, length int"


@pytest.fixture(scope="module")
def rows():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    odd = [None, "", " ", "a  b\n\n", "<|endoftext|>", "long " * 20_000, "é" * 5000, table[0]["text"], "password: abcdefgh token=short SECRET='x1y2z3w4v5'", "AKIA" + "Z" * 15 + " " + "0f" * 20 + "g"]
    return [(r["doc_id"], r["text"]) for r in table] + [(10_000 + k, t) for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    return {d: np.array([*plain.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4") for d, t in rows}


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", b"y", 1) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_hold_the_tokenizer_s_ids(spark, rows, ids, kind):
    folder = shared_folder(spark, "tokens")
    found = token_planes.read_token_files(token_planes.write_token_files(docs(spark, rows), folder, kind=kind), folder).collect()
    start, want = 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), zlib.crc32(ids[d].tobytes())))
        start += len(ids[d])
    assert sorted(map(tuple, found)) == want


def test_pieces_are_the_tokenizer_s_and_sequences_few(spark, rows, ids):
    found = packing.pack(packing.pieces_of(docs(spark, rows))).collect()
    by_doc, used = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0 and sum(r.length for r in own) == len(ids[d])
        assert all(r.length == 1024 for r in own[1:]) and all(a.start + a.length == b.start for a, b in zip(own, own[1:], strict=False))
    assert set(by_doc) == set(ids)
    for placed in used.values():
        ends = sorted(placed)
        assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and sum(n for _, n in placed) <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert least <= len(used) <= 1.02 * least + 1


def test_base_spans_are_those_of_re(spark, rows):
    found = {r.doc_id: r for r in secrets.scan(docs(spark, rows).withColumn("tokens", F.lit(1)), [0.0] * secrets._CELLS**2).collect()}
    kinds = {"assign": re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
    for d, t in rows:
        spans = []
        for n, (kind, pattern) in enumerate(kinds.items()):
            for m in pattern.finditer(t or ""):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    spans.append((m.start(), n, kind, m.end()))
        told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert (found[d].n_assign, found[d].n_access, found[d].n_hex) == tuple(sum(s[1] == n for s in spans) for n in range(3)), d
        assert found[d].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and found[d].spans == told


def test_classes_are_those_of_brute_force(spark, rows):
    from pagemill.llm.words import words_of

    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    known = [d for d in sets if sets[d]]
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    none = [d for d in sets if not sets[d]]
    for d in none[1:]:
        up[root(d)] = root(none[0])
    for k, a in enumerate(known):
        for b in known[:k]:
            common = len(sets[a] & sets[b])
            if common and common / (len(sets[a]) + len(sets[b]) - common) >= 0.8 - 1e-9:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    least = defaultdict(list)
    for d in sets:
        least[root(d)].append(d)
    want = {d: min(g) for g in least.values() for d in g}
    assert {r.doc_id: r.class_id for r in minhash_join.similar_documents(docs(spark, rows)).collect()} == want
