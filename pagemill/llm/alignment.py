"""Alignment of two tokenizers over a corpus: which tokens of one cover the same bytes as which of the other, and how often.

Rows are shuffled by their full text, and each distinct text is encoded and aligned once. Byte offsets where tokens of
both end cut the tokens into groups; tokens of one group are linked. Over the corpus each linked pair of ids is counted
by documents, copies included, and each document gets the counts of its links back.

Neither tokenizer merges across a single space or line feed between two characters that aren't white space: the
byte-level BPE splits there before it merges, and no piece of the other holds a space after another character, or a line
feed (that is checked). So a text is cut there into units, a worker remembers what it has met, and both tokens end at each
cut, so that no group spans two. New units are encoded in one go, joined, and aligned by arrays of their offsets.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import small, written
from pagemill.llm.tokens import slices, tokenizer_path

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
HEAD = 1 << 20  # pairs whose counts are sent to all tasks, 17 bytes each; others are joined
CACHED_UNITS = 300_000  # that a worker remembers; past it, it forgets all. Memory only
LONGEST = 64  # characters of a unit that is remembered
SHIFT = 20  # a pair is (A << SHIFT) | B
TOGETHER = 2000  # units that are encoded in one go
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ODD = re.compile(r"^\s|\s$|\s[ \n]|[ \n]\s")  # a space or line feed here may be no cut


def byte_level_bytes() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: itself where it prints, others from U+0100 on in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """A piece's bytes: <0xHH> is one byte, U+2581 a space."""
    found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()


def cut(text: str) -> list[str]:
    """The units of a text that isn't empty, each with the space or line feed before it (the first with the space that is put there)."""
    if _ODD.search(text):
        return _CUT.split(" " + text) if not text[0].isspace() else [" " + (parts := _CUT.split(text))[0], *parts[1:]]
    return [w if w[0] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")]


Group = tuple[list[int], list[int]]


class Aligner:
    """Groups of both tokenizers' ids, and sums of them by text."""

    def __init__(self, byte_level: str, pieces: str, cached_units: int = CACHED_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self._a.encode_special_tokens = True
        decode = byte_level_bytes()
        vocabulary = self._a.get_vocab()
        self._a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, n in vocabulary.items():
            self._a_bytes[n] = bytes(map(decode.__getitem__, t)) if all(c in decode for c in t) else t.encode()
        named = [self._b.id_to_piece(n) for n in range(self._b.get_piece_size())]
        self._b_bytes = [piece_bytes(p) for p in named]
        self._whole = any("▁" in p.lstrip("▁") or "\n" in p for p in named)  # then texts can't be cut
        self._lengths = [np.array([len(x) for x in part], np.int64) for part in (self._a_bytes, self._b_bytes)]
        self._b_from = len(self._a_bytes)
        self._said = np.array([*(f",{k}" for k in range(len(self._a_bytes))), *(f",{k}" for k in range(len(named))), *(f";{k}" for k in range(len(self._a_bytes))), *(f"|{k}" for k in range(len(named)))], object)
        self._limit = cached_units
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._names: list[str] = []
        self._sums, self._starts = np.zeros((1 << 10, 5), np.int64), np.zeros((1 << 10) + 1, np.int64)
        self._pairs, self._times = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _encode_b(self, text: str) -> list[int]:
        """B's tokens of a text that begins with a space, which it puts there itself, or with a line feed."""
        return self._b.encode(text[1:], num_threads=1) if text[0] == " " else self._b.encode(text, num_threads=1)[1:]

    def groups(self, unit: str) -> list[Group] | None:
        """The groups of a unit; None where the bytes of one tokenizer's tokens aren't those of the unit."""
        octets, a, b = unit.encode(), self._a.encode(unit, add_special_tokens=False).ids, self._encode_b(unit)
        a_parts, b_parts = [self._a_bytes[k] for k in a], [self._b_bytes[k] for k in b]
        return _grouped(a, a_parts, b, b_parts) if b"".join(a_parts) == octets == b"".join(b_parts) else None

    def _put(self, units: list[str], names: list[str], sums: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        """Puts away what is known of units; a unit's pairs are as many as the last of its sums says."""
        n, filled = len(self._names), int(self._starts[len(self._names)])
        end = n + len(units)
        if end >= len(self._sums):
            self._sums, self._starts = np.resize(self._sums, (2 * end, 5)), np.resize(self._starts, 2 * end + 1)
        if filled + len(pairs) > len(self._pairs):
            size = 2 * (filled + len(pairs))
            self._pairs, self._times = np.resize(self._pairs, size), np.resize(self._times, size)
        self._pairs[filled : filled + len(pairs)], self._times[filled : filled + len(pairs)] = pairs, times
        self._starts[n + 1 : end + 1] = filled + np.cumsum(sums[:, 5])
        self._sums[n:end] = sums[:, :5]
        self._names += names
        self._known.update(zip(units, range(n, end), strict=True))

    def _learn(self, units: list[str]) -> None:
        """Puts away each unit's counts, group text and linked pairs."""
        plain = [u for u in units if len(u) <= LONGEST and len(u) > 1 and not u[1].isspace() and not u[-1].isspace()] if not self._whole else []
        for at in range(0, len(plain), TOGETHER):
            self._learn_joined(plain[at : at + TOGETHER])
        for unit in units:
            if unit not in self._known:
                groups = self.groups(unit)
                pairs = _linked(groups or [])
                counts = [groups is None, *([sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(len(a) * len(b) for a, b in groups)] if groups else [0] * 4), len(pairs)]
                name = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
                self._put([unit], [name], np.array([counts]), np.array([*pairs], np.int64), np.array([*pairs.values()], np.int64))

    def _learn_joined(self, units: list[str]) -> None:
        """The same for units that are joined to one text, with one in front that B can begin with; nothing if a cut wasn't one."""
        units = [" a", *units]
        text = "".join(units)
        a, b = np.array(self._a.encode(text, add_special_tokens=False).ids, np.int64), np.array(self._encode_b(text), np.int64)
        if not b"".join([self._a_bytes[k] for k in a]) == text.encode() == b"".join([self._b_bytes[k] for k in b]):
            return
        a_end, b_end = np.cumsum(self._lengths[0][a]), np.cumsum(self._lengths[1][b])
        ends = np.cumsum([len(u.encode()) for u in units])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        last = np.searchsorted(cuts, ends)  # of each unit's groups
        if not (cuts[np.minimum(last, len(cuts) - 1)] == ends).all():
            return
        of_a, of_b = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        n_a, n_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        first = np.concatenate([[0], last[:-1] + 1])
        links = n_a * n_b
        sums = np.zeros((len(units), 6), np.int64)
        for k, x in enumerate((n_a, n_b, np.ones(len(cuts), np.int64), links, links), 1):
            sums[:, k] = np.add.reduceat(x, first)
        times = n_b[of_a]  # how many pairs each A token is in
        place = np.repeat((np.cumsum(n_b) - n_b)[of_a] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pairs = np.repeat(a, times) << SHIFT | b[place]
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        side = np.concatenate([2 * of_a, 2 * of_b + 1])[order]
        opens = np.concatenate([[True], side[1:] != side[:-1]])
        said = self._said[np.concatenate([a, b + self._b_from])[order] + opens * (len(self._said) // 2)].tolist()
        bounds = np.searchsorted(side, 2 * np.concatenate([first, [len(cuts)]])).tolist()
        names = ["".join(said[x:y])[1:] for x, y in zip(bounds[1:-1], bounds[2:], strict=True)]
        skipped = int(sums[0, 5])
        self._put(units[1:], names, sums[1:], pairs[skipped:], np.ones(len(pairs) - skipped, np.int64))

    def measure(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of A, of B, groups, links) of each text, the digest of its groups, and its distinct pairs: bounds, pairs, how often."""
        if len(self._known) > self._limit:
            self._forget()
        known = self._known
        cuts = [[" " + t] if self._whole else cut(t) for t in texts]
        missing = dict.fromkeys(u for units in cuts for u in units if u not in known)
        if missing:
            self._learn(list(missing))
        sizes = np.array([len(u) for u in cuts])
        unit = np.fromiter((known[u] for units in cuts for u in units), np.int64, sizes.sum())
        first = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(self._sums[unit], first, axis=0)
        ok = sums[:, 0] == 0
        names, at, digests = self._names, unit.tolist(), []
        for fine, begin, n in zip(ok.tolist(), first.tolist(), sizes.tolist(), strict=True):
            digests.append(hashlib.sha256(";".join([names[k] for k in at[begin : begin + n]]).encode()).hexdigest() if fine else "")
        sums[~ok] = 0
        lengths = np.where(np.repeat(ok, sizes), self._starts[unit + 1] - self._starts[unit], 0)
        ends = np.cumsum(lengths)
        place = np.repeat(self._starts[unit] - (ends - lengths), lengths) + np.arange(ends[-1])
        keys = (np.repeat(np.repeat(np.arange(len(texts)), sizes), lengths) << (2 * SHIFT)) | self._pairs[place]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], self._times[place][order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        pairs = keys[begin]
        bounds = np.searchsorted(pairs, np.arange(len(texts) + 1) << (2 * SHIFT))
        for u in missing:  # long ones aren't kept by name
            if len(u) > LONGEST:
                del known[u]
        if len(self._pairs) > 16 * self._limit:
            self._forget()
        return sums[:, 1:], digests, bounds, pairs & ((1 << (2 * SHIFT)) - 1), np.add.reduceat(times, begin) if len(begin) else times


def _grouped(a: list[int], a_parts: list[bytes], b: list[int], b_parts: list[bytes]) -> list[Group]:
    """Ids of both between the offsets where both end; the parts have the same bytes together."""
    found: list[Group] = []
    i = j = a_end = b_end = a_from = b_from = 0
    while i < len(a) or j < len(b):
        if a_end <= b_end and i < len(a):
            a_end += len(a_parts[i])
            i += 1
        else:
            b_end += len(b_parts[j])
            j += 1
        if a_end == b_end and (i > a_from and j > b_from):
            found.append((a[a_from:i], b[b_from:j]))
            a_from, b_from = i, j
    return found


def _linked(groups: list[Group]) -> dict[int, int]:
    """How often each pair is linked."""
    found: dict[int, int] = {}
    for a, b in groups:
        if len(a) == 1 and len(b) == 1:
            pair = a[0] << SHIFT | b[0]
            found[pair] = found.get(pair, 0) + 1
        else:
            of_b = Counter(b).items()
            for x, m in Counter(a).items():
                for y, n in of_b:
                    found[x << SHIFT | y] = found.get(x << SHIFT | y, 0) + m * n
    return found


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """This worker's aligner."""
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


_CODED = "key binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _coded(texts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Measures and distinct pairs of distinct texts `key, text, n`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for begin, end in slices(batch.column("text")):
                part = batch.slice(begin, end - begin)
                sums, digests, bounds, pairs, times = aligner(byte_level, pieces).measure(part.column("text").to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), *[pa.array(c, pa.int64()) for c in sums.T], pa.array(digests), *lists], names=[x.split()[0] for x in _CODED.split(", ")])

    return texts.mapInArrow(run, _CODED)


def _head(counts: DataFrame, head: int) -> tuple[int, pa.Table]:
    """(the least count of the head, its pairs): counts of at least a power of two, so that no more than `head` pairs have it."""
    bits = F.floor(F.log2(F.col("count").cast("double"))).cast("int")
    sizes = dict(map(tuple, counts.groupBy(bits.alias("bits")).agg(F.count("*")).collect()))  # 64 rows at most
    least, total = 64, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= head:
        least -= 1
        total += sizes.get(least, 0)
    floor = 1 << least if least < 63 else (1 << 63) - 1
    return floor, counts.where(F.col("count") >= floor).select("pair", "count", "best").toArrow().sort_by("pair")


def pair_counts(coded: DataFrame) -> DataFrame:
    """`pair, count, best`: how many documents have a pair linked, and whether no pair of its A id has more.

    An A id has at most as many pairs as B has ids, so a window over it is bounded.
    """
    counts = coded.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, head: int = HEAD) -> DataFrame:
    """One row a row of `doc_id, text`: `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`.

    A encodes a space and the text, B the text (and puts the space there itself); strings of special tokens are text. A
    text that is null or empty, or whose tokens' bytes aren't a space and the text, has zeros and an empty digest, and
    counts nowhere. A pair's count is how many rows have it linked, repeated rows and copies each; of an A id's pairs all
    with the highest count are best. Ids may be null or repeated. Only the two columns are read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    byte_level, pieces = byte_level or tokenizer_path(BYTE_LEVEL), pieces or tokenizer_path(PIECES)
    key = F.unhex(F.sha2("text", 256)).alias("key")
    distinct = docs.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("n"))
    coded = written(_coded(distinct.select(key, "text", "n"), byte_level, pieces), "coded")
    counts = written(pair_counts(coded), "pairs")
    floor, held = _head(counts, head)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("pair", "count", "best")))
    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = sent.value
        for batch in small(batches):
            lists = batch.column("pairs")
            pairs, times = np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[there], times[there] * best[at[there]])
            np.add.at(sums[1], row[there], times[there] * count[at[there]])
            bounds = pa.array(np.searchsorted(row[~there], np.arange(batch.num_rows + 1)), pa.int32())
            rest = [pa.ListArray.from_arrays(bounds, pa.array(x[~there], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums[0]), pa.array(sums[1]), *rest], names=[*kept, "n_best", "count_sum", "pairs", "times"])

    scored = written(coded.mapInArrow(score, "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"), "scored")
    rest = written(scored.where(F.size("pairs") > 0).select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")), "rest")
    rest = rest.hint("merge").join(counts.where(F.col("count") < floor), "pair").groupBy("key").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("rest_best"), F.sum(F.col("times") * F.col("count")).alias("rest_sum"))
    told = scored.select(*kept, "n_best", "count_sum").hint("merge").join(written(rest, "rest-sums"), "key", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a)
    told = written(told.select(*kept, plus("n_best", "rest_best"), plus("count_sum", "rest_sum")), "told")
    found = docs.select("doc_id", key).hint("merge").join(told, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over all documents."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
