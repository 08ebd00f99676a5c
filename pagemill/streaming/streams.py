"""Streaming operators: scoring without state, windowed throughput, and two rules with state in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions.quality import with_quality
from pagemill.plans.batches import size_bucket


def score_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """Quality metrics of each row; the same columns as in a batch."""
    return with_quality(stream, text)


def throughput_stream(runs: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Pages and MB a second, and failures, by window of `ts` and size bucket; rows later than `delay` are left out."""
    found = runs.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("window"), size_bucket(F.col("size_mb")).alias("bucket"))
    found = found.agg(F.count("*").alias("n_runs"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.sum("pages").alias("pages"), F.sum("size_mb").alias("mb"), F.sum("total_s").alias("seconds"))
    rate = lambda c: F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds")).otherwise(0.0)
    return found.select(F.col("window.start").alias("start"), "bucket", "n_runs", "n_failed", "pages", rate("pages").alias("pages_per_s"), rate("mb").alias("mb_per_s"))


#: Into how many groups keys are dealt by their hash; a group's rows are taken from its state and put back at once.
GROUPS = 480


class _InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of their time, whatever the order in which they come.

    State is by group of keys, as a call for each key would cost more than its rows. Rows wait as a table until the
    watermark passes their time; then `step` sees those of a key in order. One timer a group stands at the earliest time
    at which something is due: a waiting row, or what `step` asks for.
    """

    #: Columns of a row behind its key, the time in microseconds first; columns that are held for a key.
    ROW, HELD = ["micros"], ["last"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getValueState("waiting", "rows binary, first long")
        self._held = handle.getValueState("held", "rows binary, due long")

    def taken(self, frame: pd.DataFrame) -> pa.Table:
        """The rows of a frame as they wait: their key, and ROW."""
        return pa.table({"key": pa.array(frame["key"], pa.string()), "micros": _micros(frame["ts"])})

    def step(self, key: tuple, held: tuple | None, rows: list[tuple], now: int) -> tuple[list[tuple], tuple | None, int | None]:
        """(rows to emit, what is held from now on, when there is more to do) for rows in order, up to the time `now`."""
        raise NotImplementedError

    def frame(self, keys: list[str], out: list[tuple]) -> pd.DataFrame:
        """Rows to emit, given with their keys."""
        raise NotImplementedError

    def _arm(self, first: int | None, due: int | None) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        times = [t for t in (first, due) if t is not None]
        if times:
            self._handle.registerTimer(-(-min(times) // 1000))

    def _wait(self, rows: pa.Table) -> int | None:
        """Puts rows into the state and gives their first time."""
        if not rows.num_rows:
            self._waiting.clear()
            return None
        first = pc.min(rows["micros"]).as_py()
        self._waiting.update((_packed(rows), first))
        return first

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [self.taken(frame) for frame in rows]
        before = [_unpacked(self._waiting.get()[0])] if self._waiting.exists() else []
        first = self._wait(pa.concat_tables([*before, *new]))
        self._arm(first, self._held.get()[1] if self._held.exists() else None)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[str, list[tuple]] = {}
        first = None
        if self._waiting.exists():
            waiting = _unpacked(self._waiting.get()[0])
            come = pc.less_equal(waiting["micros"], now)
            found = waiting.filter(come).sort_by([(c, "ascending") for c in ("key", *self.ROW)])
            for k, *row in zip(*(c.to_pylist() for c in found.columns), strict=True):
                ready.setdefault(k, []).append(tuple(row))
            first = self._wait(waiting.filter(pc.invert(come)))
        held: dict[str, tuple] = {}
        if self._held.exists():
            held = {k: (tuple(rest), until) for k, until, *rest in zip(*(c.to_pylist() for c in _unpacked(self._held.get()[0]).columns), strict=True)}
        keys, emitted = [], []
        for k in ready.keys() | {k for k, (_, until) in held.items() if until <= now}:
            out, stays, until = self.step((k,), held[k][0] if k in held else None, ready.get(k, []), now)
            keys += [k] * len(out)
            emitted += out
            if stays is None:
                held.pop(k, None)
            else:
                held[k] = (tuple(stays), until)
        due = min((until for _, until in held.values()), default=None)
        if held:
            columns = zip(*[(k, until, *rest) for k, (rest, until) in held.items()], strict=True)
            self._held.update((_packed(pa.table(dict(zip(("key", "until", *self.HELD), map(list, columns), strict=True)))), due))
        else:
            self._held.clear()
        self._arm(first, due)
        if emitted:
            yield self.frame(keys, emitted)

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> pa.Array:
    return pa.array(ts.astype("datetime64[us]").astype("int64"), pa.int64())


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(rows)).read_all()


def _by_group(rows: DataFrame, delay: str):
    """Rows with a `key`, dealt into GROUPS groups by its hash."""
    return rows.withColumn("keys", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int")).withWatermark("ts", delay).groupBy("keys")


class _Uploads(_InOrder):
    """Holds the last upload that was no hit until its time is over."""

    def __init__(self, ttl_s: int):
        self._ttl = ttl_s * 1_000_000

    def step(self, key, held, rows, now):
        last, out = held[0] if held else None, []
        for (micros,) in rows:
            hit = last is not None and micros - last < self._ttl
            out.append((micros, hit))
            last = last if hit else micros
        over = last is None or last + self._ttl <= now
        return out, None if over else (last,), None if over else last + self._ttl

    def frame(self, keys, out):
        return pd.DataFrame({"content_hash": keys, "ts": pd.to_datetime([m for m, _ in out], unit="us"), "hit": [h for _, h in out]})


def dedup_uploads(uploads: DataFrame, ttl_s: int = 43_200, delay: str = "1 hour") -> DataFrame:
    """`content_hash, ts, hit` of a stream of uploads, by the exact rule: within ttl_s of the last upload that was no hit.

    Rows may come in any order within `delay`; each is emitted when the watermark has passed its time. State is the rows
    that wait and one number a hash that was uploaded within ttl_s. Needs the RocksDB state store.
    """
    return _by_group(uploads.select(F.col("content_hash").cast("string").alias("key"), "ts"), delay).transformWithStateInPandas(_Uploads(ttl_s), "content_hash string, ts timestamp, hit boolean", "Append", "EventTime")


class _Registry(_InOrder):
    """Holds the last registration of a path until its time is over; a registration in time renews it."""

    ROW, HELD = ["micros", "after", "file_type"], ["due", "file_type"]

    def taken(self, frame):
        return pa.table({"key": pa.array(frame["key"], pa.string()), "micros": _micros(frame["ts"]), "after": pa.array(frame["cleanup_after"], pa.int64()), "file_type": pa.array(frame["file_type"], pa.string(), from_pandas=True)})

    def step(self, key, held, rows, now):
        held, out = tuple(held) if held else None, []
        for micros, after, kind in rows:
            if held and held[0] < micros:
                out.append(held)
            held = (micros + after * 1_000_000, kind)
        if held and held[0] <= now:
            out.append(held)
            held = None
        return out, held, held[0] if held else None

    def frame(self, keys, out):
        return pd.DataFrame({"path": keys, "file_type": [k for _, k in out], "expired_at": pd.to_datetime([d for d, _ in out], unit="us")})


def expire_registry(registry: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """`path, file_type, expired_at` of a stream of registrations `path, file_type, ts, cleanup_after` (seconds), once the time is past.

    A registration of a path that comes up to the end of the last one's time takes its place, so that one never expires;
    a later one begins anew. Rows may come in any order within `delay`. Of registrations at one time the one of longer
    time counts. State is the rows that wait and one row a path that is registered. Needs the RocksDB state store.
    """
    kept = registry.select(F.col("path").cast("string").alias("key"), F.col("file_type").cast("string"), "ts", F.col("cleanup_after").cast("long")).where("key is not null and cleanup_after is not null")
    return _by_group(kept, delay).transformWithStateInPandas(_Registry(), "path string, file_type string, expired_at timestamp", "Append", "EventTime")
