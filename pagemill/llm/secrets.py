"""Secret scans by DataFrame functions alone: fixed patterns, and character Markov models for what they miss.

The models are chains over character pairs, one of random strings and one of ordinary identifiers. Their samples are the
corpus's own long tokens, labelled by the patterns: values inside a pattern's match are random, all other tokens ordinary.
A token is a secret if its log-likelihood ratio is at least `LEAST_RATIO`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns by kind, in the order of kinds, and the least length of what each must find.
PATTERNS = {
    "assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST_LENGTH = {"assign": 8, "access": 16, "hex": 32}
#: Equal to the above for what is kept, and quicker: a shorter match holds no longer one.
_SEARCHED = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}"}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
LEAST_RATIO = 12.0
_MARK, _OTHER = "\ue000", "\ufffd"
_CELLS = 96
PRIOR = 5.0
_STEP = 64


def _with_matches(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds an array of `start, end, value` of a pattern's leftmost matches without overlap, in code points.

    Each match is put between marks and the text split at them, so every other part is a match; where it starts is the
    sum of the lengths before it, taken from sums over runs of parts and then within a run.
    """
    parts, sizes, runs = f"{name} parts", f"{name} sizes", f"{name} runs"
    df = df.withColumn(parts, F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK))
    df = df.withColumn(sizes, F.transform(parts, lambda p: F.length(p)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    df = df.withColumn(runs, F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _STEP).cast("int")), lambda k: total(F.slice(sizes, k * _STEP + 1, _STEP))))

    def match(i: Column) -> Column:
        run = F.floor(i / _STEP).cast("int")
        start = total(F.slice(runs, F.lit(1), run)) + total(F.slice(sizes, run * _STEP + 1, i - run * _STEP))
        return F.struct(start.alias("start"), (start + F.get(sizes, i)).alias("end"), F.get(parts, i).alias("value"))

    odd = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(name, F.transform(odd, match)).drop(parts, sizes, runs)


def with_base(docs: DataFrame) -> DataFrame:
    """Adds for each kind the array of its spans, and `tokens`, the long tokens that no span overlaps."""
    docs = docs.withColumn("marked text", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, _OTHER))
    for kind, pattern in PATTERNS.items():
        docs = _with_matches(docs, "marked text", kind, _SEARCHED.get(kind, pattern))
    docs = docs.withColumn("assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["value"], PATTERNS["assign"], 2)) >= LEAST_LENGTH["assign"]))
    docs = _with_matches(docs, "marked text", "tokens", TOKEN)
    for kind in PATTERNS:
        docs = docs.withColumn("tokens", _apart("tokens", kind))
    return docs.drop("marked text")


def _apart(tokens: str, kind: str) -> Column:
    return F.filter(tokens, lambda t: ~F.exists(kind, lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"])))


def _pairs(value: Column) -> Column:
    """The cells of a token's character pairs; the first character follows a space."""
    chars = F.split(value, "")
    code = lambda c: F.ascii(c) - 32
    return F.zip_with(F.concat(F.array(F.lit(" ")), F.slice(chars, F.lit(1), F.size(chars) - 1)), chars, lambda a, b: code(a) * _CELLS + code(b))


def pair_counts(found: DataFrame) -> DataFrame:
    """`secret, cell, n`: how often labelled samples have each character pair; at most 2 * 96 * 96 rows."""
    values = lambda kind: F.transform(kind, lambda m: m["value"])
    assigned = F.transform("assign", lambda m: F.regexp_extract(m["value"], PATTERNS["assign"], 2))
    labelled = [(True, assigned), (True, values("access")), (True, values("hex")), (False, values("tokens"))]
    samples = F.concat(*[_labelled(c, label) for label, c in labelled])
    rows = found.select(F.explode(samples).alias("s")).select("s.secret", F.explode(_pairs(F.col("s.value"))).alias("cell"))
    return rows.groupBy("secret", "cell").agg(F.count("*").alias("n"))


def _labelled(values: Column, secret: bool) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(secret).alias("secret"), v.alias("value")))


def log_ratios(counts: dict[tuple[bool, int], int]) -> list[float]:
    """For each cell, how much likelier the second character is after the first in a random string than in an identifier.

    A pair's probability is smoothed by `PRIOR` occurrences dealt as the second characters of all pairs are, and those by
    half an occurrence of each of 66 characters. A corpus without samples gives ratios of 0.
    """
    chains = []
    for label in (True, False):
        after, before = [0.0] * _CELLS, [0.0] * _CELLS
        for (secret, cell), n in counts.items():
            if secret == label:
                before[cell // _CELLS] += n
                after[cell % _CELLS] += n
        total = sum(after)
        share = [(n + 0.5) / (total + 33) for n in after]
        chains.append([(counts.get((label, k), 0) + PRIOR * share[k % _CELLS]) / (before[k // _CELLS] + PRIOR) for k in range(_CELLS * _CELLS)])
    return [math.log(a / b) for a, b in zip(*chains, strict=True)]


def train(docs: DataFrame) -> list[float]:
    """The log ratios of all samples in `text`."""
    return log_ratios({(r["secret"], r["cell"]): r["n"] for r in pair_counts(with_base(docs.select("text"))).collect()})


def scan(docs: DataFrame, ratios: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """`doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random` of each row of `doc_id, text`.

    `spans` lists kind:start:end of all spans by start, then kind, where `random` is what the models add. Null is empty.
    """
    table = F.split(F.lit(" ".join(f"{x:.6g}" for x in ratios)), " ").cast("array<double>")
    found = with_base(docs.select("doc_id", "text"))
    ratio = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda a, c: a + F.get(table, c))
    found = found.withColumn("random", F.filter("tokens", lambda t: ratio(t["value"]) >= least))
    kinds = [*PATTERNS, "random"]
    placed = [_placed(kind, n) for n, kind in enumerate(kinds)]
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.element_at(F.array(*map(F.lit, kinds)), s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    base = F.sha2(text(F.concat(*placed[:-1])).cast("binary"), 256)
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts[:-1], base.alias("base_sha256"), text(F.concat(*placed)).alias("spans"), counts[-1])


def _placed(kind: str, n: int) -> Column:
    return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(n + 1).alias("kind"), m["end"].alias("end")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by models trained on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs))
