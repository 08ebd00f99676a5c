"""Connected groups of a graph held as a table of links, and the work units in which candidates are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import written

CELLS = 1 << 16
MAP_WORDS = 1 << 20  # 64-bit words of a membership bitmap, 8 MB whatever the corpus


def connected(links: DataFrame) -> DataFrame:
    """`node, root` of every node of the links `a, b`: the root is the least node of its connected group.

    Large and small stars take turns (each node hands its greater, then its smaller neighbours to its least one) until
    the links no longer change, which takes about as many rounds as the logarithm of the longest path. Each round is
    written, so a round's plan reads tables only. Links of a node to itself and repeated links are fine.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.hint("merge").join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.hint("merge").join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        links = written(small.where("a <> b").distinct(), "small-star")
        before, state = state, _state(links)
        if state == before:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def pair_units(rows: DataFrame, key: str, node: str, most: int, weight: str | None = None) -> DataFrame:
    """Adds `i, j, chunk`: the unit of work in which a row's pairs with others of its key are looked at.

    A key of up to `most` rows is one unit. A larger one is cut into chunks, and each pair of chunks is a unit (within a
    chunk where i = j, between two chunks elsewhere), so every pair meets in exactly one and no unit has over about
    twice `most` rows. Which keys are large is learned from counts over 65,536 cells of keys, then of the keys in cells
    that could hold one. With `weight`, a column of integers from 1 on, rows count by it.
    """
    spark = rows.sparkSession
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    number = F.sum(weight) if weight else F.count("*")
    full = [r[0] for r in rows.groupBy(cell.alias("cell")).agg(number.alias("n")).where(F.col("n") > most).select("cell").collect()]
    if not full:
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0), "chunk": F.lit(0)})
    cells = F.broadcast(spark.createDataFrame([(c,) for c in full], "cell long"))  # 65,536 at most
    rows = rows.withColumn("cell", cell)
    here = rows.join(cells, "cell", "left_semi").drop("cell")
    counts = written(here.groupBy(key).agg(F.ceil(number / most).cast("int").alias("chunks")), "units")
    here = here.hint("merge").join(counts, key)
    chunk = F.pmod(F.xxhash64(F.lit(7), node), F.col("chunks")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j")))
    here = here.withColumn("unit", F.explode(units)).select(*[c for c in rows.columns if c != "cell"], "unit.i", "unit.j", chunk.alias("chunk"))
    rest = rows.join(cells, "cell", "left_anti").drop("cell").withColumns({"i": F.lit(0), "j": F.lit(0), "chunk": F.lit(0)})
    return rest.unionByName(here)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, where each group begins, its size) of a partition sorted by keys, a batch at a time.

    The last group of a batch waits for the next batch, as it may go on there.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        begin = _begins(table, keys)
        last = int(begin[-1])
        if last:
            yield table.slice(0, last), begin[:-1], np.diff(begin)
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.zeros(1, np.int64), np.array([table.num_rows])


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        values = table.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    change[0] = True
    return np.flatnonzero(change)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[pa.Table]:
    """The groups of `least` rows or more, of a partition sorted by keys."""
    for table, begin, size in whole_groups(batches, keys):
        for k in np.flatnonzero(size >= least).tolist():
            yield table.slice(int(begin[k]), int(size[k]))


class Local:
    """Groups of the rows of one unit."""

    def __init__(self, size: int):
        self._up = list(range(size))

    def root(self, k: int) -> int:
        while self._up[k] != k:
            self._up[k] = k = self._up[self._up[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self._up[max(a, b)] = min(a, b)


def membership(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of long ids that are hashes, of 8 MB whatever their number; use `among` to ask it."""
    at = F.shiftrightunsigned(F.col(column), 44)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(F.lit(63)).cast("int"))
    found = np.zeros(MAP_WORDS, np.uint64)
    rows = ids.groupBy(at.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    found[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return found


def among(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the bitmap may hold: all that were put in, and those that share a bit with one."""
    ids = ids.view(np.uint64)
    return (bitmap[(ids >> np.uint64(44)).astype(np.int64)] >> (ids & np.uint64(63))) & np.uint64(1) == 1
