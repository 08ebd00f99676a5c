from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from pagemill.llm import alignment as A
from pagemill.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string"
TEXTS = [
    "The quick brown fox, isn't it? 12,345 times!", "x<|endoftext|> y <s> z</s>", "  two  spaces ", "a\n\n b", "a \n \nb", "é\nü ñ", "日本 語 テキスト", "tab\there", "\n", " ", "nb\xa0sp ace",
    "a b", "é ﬁn", "end ", "long" * 60, "", None, "👩‍👩‍👧 fam", "the the the", "x" * 700, "\x1c \x85 q", "▁ already ▁x", "<0x0A> literal", "mixed     sep　 x",
]


@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A.BYTE_LEVEL))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=tokenizer_path(A.PIECES))


def whole(text, tools):
    """(A ids, B ids, groups) of a text encoded whole, from the contract; None without tokens."""
    if not text:
        return None
    a, b = tools
    ids, pieces = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    decode = A.byte_level_bytes()
    parts = [bytes(decode[c] for c in a.id_to_token(k)) for k in ids], [A.piece_bytes(b.id_to_piece(k)) for k in pieces]
    if not (b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode()):
        return None
    ends = []
    for x in parts:
        at, e = 0, []
        for p in x:
            at += len(p)
            e.append(at)
        ends.append(e)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    of = [[next(k for k, c in enumerate(cuts) if end <= c) for end in e] for e in ends]
    groups = [([i for i, g in zip(ids, of[0], strict=True) if g == k], [i for i, g in zip(pieces, of[1], strict=True) if g == k]) for k in range(len(cuts))]
    return ids, pieces, groups


def brute(rows, tools):
    held = {k: whole(t, tools) for k, (_, t) in enumerate(rows)}
    links = {k: [(x, y) for a, b in v[2] for x in a for y in b] if v else [] for k, v in held.items()}
    count = Counter(p for v in links.values() for p in set(v))
    best: dict = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        v = held[k]
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in v[2]).encode()).hexdigest() if v else ""
        out.append((doc_id, *((len(v[0]), len(v[1]), len(v[2])) if v else (0, 0, 0)), len(links[k]), sum(count[p] == best[p[0]] for p in links[k]), sum(count[p] for p in links[k]), digest))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(4)
    words = re.findall(r"\S+", " ".join(t for t in TEXTS if t)) + ["tokenization", "naïve", "Ünïcode", "antidisestablishmentarianism", "don't", "(x)", "3.14"]
    texts = [*TEXTS, *(rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40))]
    texts += texts[:4] * 3
    return [*enumerate(texts), (None, texts[0]), (3, texts[3])]


@pytest.mark.parametrize("head", [A.HEAD, 40, 0])
def test_measures_are_those_of_brute_force(spark, tools, head):
    found = A.align(spark.createDataFrame(rows(), SCHEMA), head=head)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows(), tools)


def test_forgetting_changes_nothing(tools):
    texts = [t for _, t in rows() if t]
    big, small = (A.Aligner(tokenizer_path(A.BYTE_LEVEL), tokenizer_path(A.PIECES), n) for n in (1000, 3))
    for text in texts:
        x, y = big.measure([text]), small.measure([text])
        assert x[1] == y[1] and all((p == q).all() for p, q in zip((x[0], *x[2:]), (y[0], *y[2:]), strict=True))


def test_no_rows_no_text_long_text_and_other_columns(spark, tools):
    assert A.align(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"word{k % 997}" for k in range(30_000))
    docs = spark.createDataFrame([(1, long, "k"), (2, None, None), (None, "", "x")], "doc_id int, text string, key string")
    got = {r.doc_id: r for r in A.align(docs).collect()}
    assert got[1].groups_sha256 == hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in A.aligner(tokenizer_path(A.BYTE_LEVEL), tokenizer_path(A.PIECES)).groups(" " + long)).encode()).hexdigest()
    assert got[2].n_a == got[None].n_links == 0 and got[2].groups_sha256 == ""
