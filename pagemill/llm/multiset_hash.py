"""Document fingerprints: homomorphic multiset hashes, by DataFrame functions alone.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, and a fingerprint is the sum
of these vectors, lane by lane modulo a power of two. So it doesn't depend on the order of paragraphs, and inserting or
deleting one adds or subtracts its vector. An array of longs holds

* one lane: the number of units, modulo 2^20;
* 16 lanes modulo 2^32 for equality, from two 64-bit hashes of the whole paragraph;
* 96 lanes modulo 2^14 for likeness, four to a long: how many units have each of 96 bits set in their hashes. Units are the
  runs of three words of a paragraph, one at each word, or the whole of a shorter paragraph. Taken as signs, the lanes are
  a sketch whose inner products estimate how many units two texts share, a unit by the product of its numbers in both; the
  standard error is about 0.12. A sum of signs is known from its count modulo 2^14 while it is under 16,384: as long as
  no unit is repeated more often in a text, and by chance in texts of up to 7 million words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EQUAL_LANES = 16
_M32 = (1 << 32) - 1
_BITS = 14  # of a field; one more takes the carry
_FIELDS = (0, 15, 30, 45)
_ONES = sum(1 << k for k in _FIELDS)
_FULL = _ONES * ((1 << _BITS) - 1)
_GUARD = _ONES << _BITS
_PACKED = 24
_OF_HASH = 15  # longs that one hash of a unit fills: its bits k, k + 15, ...
_RUN = 3  # words of a unit


def _and(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask))


def _sums(parts: list[Column], count: int, step) -> list[Column]:
    """For each k, the sum of `step(k)` over the hashes of an array; the arrays take equal numbers of k in turn."""
    each = -(-count // len(parts))
    return [F.aggregate(parts[k // each], F.lit(0).cast("long"), step(k)) for k in range(count)]


def _units(paragraph: Column) -> Column:
    """Hashes of a paragraph's runs of three words; of a shorter paragraph with a word, one of all its words."""
    words = F.transform(F.filter(F.split(paragraph, " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda ws: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (_RUN - 1), F.least(F.size(ws), F.lit(1)))), lambda w, k: F.xxhash64(w, *[F.get(ws, k + n) for n in range(1, _RUN)]))
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds a text column's vector; null is the empty text, which has one empty paragraph."""
    paragraphs = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    whole, parts = f"{name} paragraphs", [f"{name} units {k}" for k in range(-(-_PACKED // _OF_HASH))]  # columns of their own, so that they are made once
    df = df.withColumn(whole, F.transform(paragraphs, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(7), p).alias("b"))))
    df = df.withColumn(parts[0], F.flatten(F.transform(paragraphs, _units)))
    df = df.withColumns({p: _again(F.col(parts[0]), n) for n, p in enumerate(parts[1:], 1)})
    equal = _sums([F.col(whole)], EQUAL_LANES, lambda k: lambda a, h: _and(a + _and(F.xxhash64(h["a"], h["b"], F.lit(k)), _M32), _M32))
    alike = _sums([F.col(p) for p in parts], _PACKED, lambda k: lambda a, h: _and(a + _and(F.shiftrightunsigned(h, k % -(-_PACKED // len(parts))), _ONES), _FULL))
    vector = F.array(_and(F.size(parts[0]).cast("long"), (1 << 20) - 1), *equal, *alike)
    return df.withColumn(name, vector).drop(whole, *parts)


def _again(hashes: Column, number: int) -> Column:
    """The hashes hashed once more."""
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(number)))


def _lanes(of) -> Column:
    """An array of vector length from `of(position, mask)`."""
    masks = [(1 << 20) - 1] + [_M32] * EQUAL_LANES + [_FULL] * _PACKED
    return F.array(*[of(k, m) for k, m in enumerate(masks)])


def inserted(vector: Column, part: Column) -> Column:
    """The vector of both multisets together."""
    return _lanes(lambda k, m: _and(vector[k] + part[k], m))


def deleted(vector: Column, part: Column) -> Column:
    """The vector without a part that it holds."""
    guard = {(1 << 20) - 1: 1 << 20, _M32: 1 << 32, _FULL: _GUARD}
    return _lanes(lambda k, m: _and(vector[k].bitwiseOR(F.lit(guard[m])) - part[k], m))


def fingerprint(vector: Column) -> Column:
    """The vector as lower-case hexadecimal text."""
    return F.lower(F.concat(*[F.lpad(F.hex(vector[k]), 5 if not k else 8 if k <= EQUAL_LANES else 16, "0") for k in range(1 + EQUAL_LANES + _PACKED)]))


def _signed(vector: Column) -> Column:
    """The sums of signs, from counts of set bits modulo 2^14."""
    packed = F.slice(vector, 2 + EQUAL_LANES, _PACKED)
    fields = F.flatten(F.transform(packed, lambda x: F.array(*[_and(F.shiftrightunsigned(x, k), (1 << _BITS) - 1) for k in _FIELDS])))
    return F.transform(fields, lambda x: F.pmod(x * 2 - vector[0] + (1 << _BITS), F.lit(2 << _BITS)) - (1 << _BITS))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def with_likeness(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Adds the estimated share of units that two vector columns have in common, 0 to 1; 1 for equal vectors."""
    x, y, products = f"{name} a", f"{name} b", f"{name} products"
    df = df.withColumn(x, _signed(F.col(a))).withColumn(y, _signed(F.col(b)))
    df = df.withColumn(products, F.array(_dot(F.col(x), F.col(y)), _dot(F.col(x), F.col(x)) + _dot(F.col(y), F.col(y))))
    shared = F.when(F.col(products)[1] > 0, 2 * F.col(products)[0] / F.col(products)[1]).otherwise(0.0)
    value = F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared)))
    return df.withColumn(name, value).drop(x, y, products)


def _nested(values: list, size: int) -> list[list]:
    return [values[k : k + size] for k in range(0, len(values), size)]


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """`doc_id, text` with `block, place` and `next_text`, the text of the next row by descending doc_id, after the last the first.

    Ranges of doc_id, whose bounds are read from the ids alone, make blocks; a row of a block's largest id also goes to
    the block above it as a guest, and from the last block to the first. So a window over a block sees each row's next
    and no task holds more than a range. Rows of equal id follow each other by descending text; a null id is the least.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select("doc_id").repartitionByRange(wanted, "doc_id").groupBy(F.spark_partition_id().alias("k"))
    bounds = sorted(ranges.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect(), key=lambda r: r["k"])
    lows = [-(2**63) if not k or r["low"] is None else r["low"] for k, r in enumerate(bounds)] or [0]
    highs = F.array(*[F.lit(r["high"]).cast("long") for r in bounds] or [F.lit(0).cast("long")])
    size = max(1, int(len(lows) ** 0.5))
    groups = _nested(lows, size)
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    own = F.coalesce("doc_id", F.lit(-(2**63)))
    group = F.size(F.filter(literal([g[0] for g in groups]), lambda x: x <= own)) - 1
    docs = docs.withColumn("group", group)
    inner = F.size(F.filter(F.get(F.array(*[literal(g) for g in groups]), F.col("group")), lambda x: x <= own)) - 1
    docs = docs.withColumn("block", F.col("group") * size + inner)
    last = F.col("doc_id").eqNullSafe(F.get(highs, F.col("block")))
    at = F.struct(F.col("block").alias("block"), F.lit(0).alias("guest"))
    above = F.struct(((F.col("block") + 1) % len(lows)).alias("block"), F.lit(1).alias("guest"))
    placed = docs.select("doc_id", "text", F.explode(F.when(last, F.array(at, above)).otherwise(F.array(at))).alias("at")).select("doc_id", "text", "at.*")
    return placed.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))


def edited_text(text: Column, following: Column) -> Column:
    """The last third of a text's code points, rounded down, replaced by as many of the following text's first, or all."""
    size = F.length(text)
    third = F.floor(size / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a row of `doc_id, text`: its fingerprint, its edited text's, and their likeness to each other and to the next text's.

    Only these two columns are read; an empty table gives an empty result.
    """
    rows = with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = with_vector(with_vector(rows, "text", "own"), "edited", "changed")
    rows = rows.withColumn("following", F.lead("own").over(_order())).where("guest = 0")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "changed", "following")
    rows = with_likeness(with_likeness(rows, "near_edited", "own", "changed"), "near_next", "own", "following")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
