"""The row rules and the order rules as Structured Streaming queries.

Order rules keep their rows in Spark's state store: rows wait there until the watermark
has passed them, so they are taken in event time, and a batch that is run again starts
from the same version of the state. Machines share a state by a hash (``BUCKETS``), since every
key with state costs calls; the rows of one bucket in one micro-batch are one task, and
``files_per_batch`` bounds them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from plantwatch import constants as K
from plantwatch.functions import expressions as X
from plantwatch.operators import timeline as tl
from plantwatch.operators.training import Detector
from plantwatch.operators.validation import Rule, with_reasons
from plantwatch.session import fresh_path, ship_package

AT = "at_micros"
LATE = "10 minutes"
#: Keys of the state of an order rule, each with the rows of many machines.
BUCKETS = 1024
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
STORES = "org.apache.spark.sql.execution.streaming.state."
ROCKS, MEMORY = f"{STORES}RocksDBStateStoreProvider", f"{STORES}HDFSBackedStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files per batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None, store: str = ROCKS,
                  partitions: int | None = None) -> None:
    """Process what is there and stop; the file sink commits each batch once.

    State is kept in the RocksDB store, which keyed state with timers needs and which does not
    hold all keys in memory. ``MEMORY`` is faster by row, for a join whose state is bounded by its batches.
    ``partitions`` of the state, all of which are loaded and committed in every batch; a checkpoint keeps its own number.
    """
    spark = stream.sparkSession
    wanted = {STATE_STORE: store, **({PARTITIONS: str(partitions)} if partitions else {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        running = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
                   .option("checkpointLocation", checkpoint or fresh_path(spark, "stream-log"))
                   .trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    running.awaitTermination()


def run_batches(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], mode: str = "append",
                checkpoint: str | None = None) -> None:
    spark = stream.sparkSession
    (stream.writeStream.foreachBatch(on_batch).outputMode(mode)
     .option("checkpointLocation", checkpoint or fresh_path(spark, "stream-log"))
     .trigger(availableNow=True).start().awaitTermination())


def _write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    """One folder per batch, replaced when the batch is run again."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def read_batches(spark: SparkSession, out: str, keep_batch: bool = False) -> DataFrame:
    df = spark.read.parquet(out)
    return df if keep_batch else df.drop("batch")


def quarantine_stream(stream: DataFrame, rules: list[Rule], valid_out: str, rejected_out: str,
                      checkpoint: str | None = None) -> None:
    """Valid rows to one table, rejected rows with their reasons to another."""
    checked = with_reasons(stream, rules)

    def on_batch(df: DataFrame, batch_id: int) -> None:
        df.persist()
        _write_batch(df.filter(F.size("reasons") == 0).drop("reasons"), valid_out, batch_id)
        _write_batch(df.filter(F.size("reasons") > 0), rejected_out, batch_id)
        df.unpersist()

    run_batches(checked, on_batch, checkpoint=checkpoint)


def score_stream(stream: DataFrame, detector: Detector, score: str = "attack_probability") -> DataFrame:
    """Score, decision and risk tier of every row; stateless, so it runs unchanged on a stream."""
    return detector.score(stream, score).withColumns({
        "attack": X.at_least(score, K.ATTACK_THRESHOLD),
        "classification": X.classification(score), "risk_level": X.risk_level(score)})


class TrailingFlags(StatefulProcessor):
    """Counts of flags over the last rows of a machine, in event time.

    Rows wait in list state until the watermark has passed them, so rows that are out of
    order inside the allowed lateness are put in order. A timer at the earliest waiting row
    wakes the state. Rows are kept some at a time, as one Arrow message each; ``tail`` keeps the last ``window`` rows of
    each machine, so that the row before a new one has its own count. Nothing else is kept.

    ``series`` names the columns that tell machines apart that share a state; without it a state is one machine, ``key``.
    """

    def __init__(self, key: str, columns: list[str], flag: str, lag: list[str], window: int, schema: StructType, series: list[str] = ()):
        self.key, self.columns, self.flag, self.lag, self.window, self.schema = key, columns, flag, lag, window, schema
        self.series = list(series)

    def init(self, handle) -> None:
        self.handle = handle
        # Times stay as pandas has them, without a zone.
        self.arrow = pa.schema([pa.field(f.name, pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type)
                                for f in to_arrow_schema(self.schema)])
        self.waiting = handle.getListState("waiting", "rows binary")
        self.tail = handle.getListState("tail", "rows binary")

    def _table(self, state) -> pa.Table:
        parts = [pa.ipc.open_stream(r[0]).read_all() for r in state.get()] if state.exists() else []
        return pa.concat_tables(parts) if parts else self.arrow.empty_table()

    def _frame(self, state) -> pd.DataFrame:
        table = self._table(state)
        # Object columns keep NULL apart from NaN and whole numbers whole.
        return pd.DataFrame({c: pd.Series(table[c].to_pylist(), dtype=object) for c in self.columns}, columns=self.columns)

    def _packed(self, table: pa.Table) -> list[tuple[bytes]]:
        """Some rows as one element of a list state: an element costs a call, whatever it holds."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.arrow) as out:
            out.write_table(table)
        return [(sink.getvalue().to_pybytes(),)]

    def _keep(self, state, table: pa.Table) -> None:
        if len(table):
            state.put(self._packed(table))
        else:
            state.clear()

    def _wake(self, micros) -> None:
        self.handle.registerTimer(-(-int(micros) // 1000))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        first = None
        for pdf in rows:
            arrays = [pa.array(pdf[f.name], f.type, from_pandas=True) for f in self.arrow]
            self.waiting.appendList(self._packed(pa.Table.from_arrays(arrays, schema=self.arrow)))
            low = int(pdf[AT].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        waiting = self._table(self.waiting)
        ripe = pc.less_equal(waiting[AT], timerValues.getCurrentWatermarkInMs() * 1000)
        rest, new = waiting.filter(pc.invert(ripe)), waiting.filter(ripe)
        self._keep(self.waiting, rest)
        if len(rest):
            self._wake(pc.min(rest[AT]).as_py())
        if not len(new):
            return
        order = self.columns[:self.columns.index(self.flag)]
        new = new.take(pc.sort_indices(new, sort_keys=[(c, "ascending") for c in order]))
        tail = self._table(self.tail)
        both = pa.concat_tables([tail, new])
        fresh = np.arange(len(both)) >= len(tail)
        series = self._series(both)
        # The rows of a machine side by side, the kept ones first.
        place = np.argsort(series, kind="stable")
        both, fresh, series = both.take(pa.array(place)), fresh[place], series[place]
        starts = np.flatnonzero(np.append(True, series[1:] != series[:-1]))
        start = np.repeat(starts, np.diff(np.append(starts, len(series))))
        flag = both[self.flag]
        known, hit = (x.to_numpy(zero_copy_only=False).astype(bool) for x in (pc.is_valid(flag).combine_chunks(), pc.fill_null(flag, False).combine_chunks()))
        n_flagged, n_seen = (trailing_counts(x, start, self.window) for x in (hit, known))
        every = np.arange(len(series))
        none = every == start
        before = pa.array(every - 1, mask=none)
        added = {**{f"prev_{c}": both[c].take(before) for c in self.lag}, "n_flagged": pa.array(n_flagged), "n_seen": pa.array(n_seen),
                 "prev_n_flagged": pa.array(n_flagged).take(before)}
        ends = np.append(starts[1:], len(series))
        self._keep(self.tail, both.filter(pa.array(every >= np.repeat(ends, ends - starts) - self.window)))
        for name, column in added.items():
            both = both.append_column(name, column)
        out = both.filter(pa.array(fresh)).drop_columns([AT]).to_pandas(integer_object_nulls=True)
        if not self.series:
            out.insert(0, self.key, key[0])
        yield out

    def _series(self, table: pa.Table) -> np.ndarray:
        """A number per machine."""
        code = np.zeros(len(table), np.int64)
        for c in self.series:
            mine = table[c].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * (len(mine.dictionary) + 1) + mine.indices.to_numpy(zero_copy_only=False)
        return code

    def close(self) -> None:
        pass


def trailing_counts(x: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Set entries among the last ``window`` rows, for every row; ``start``: the first row of its series."""
    total = np.concatenate([[0], np.cumsum(x)])
    at = np.arange(1, len(total))
    return (total[at] - total[np.maximum(at - window, start)]).astype("int64")


def trailing_stream(stream: DataFrame, order: list[str], flag: str, window: int, late: str, lag: list[str] = (),
                    key: str = "machine") -> DataFrame:
    """n_flagged and n_seen over the last ``window`` rows of each key, by event time ``ts``, then ``order``.

    Columns out: key, order, flag, lag, n_flagged, n_seen and the lagged columns of the row before
    (``prev_``; NULL at the start). A row comes out once the watermark has passed it; rows later than
    ``late`` are dropped. Rows without a key take no part, though their time moves the watermark:
    a source that falls silent sends such a row to release what waits.
    """
    columns = [AT, *order, flag, *lag]
    marked = stream.withWatermark("ts", late).withColumn(AT, F.unix_micros("ts"))
    # One condition on both columns stays above the watermark, which must see the rows without a key.
    kept = marked.filter(F.when(F.col("ts").isNotNull(), F.col(key).isNotNull())).select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket"), key, "ts", *columns)
    state = StructType([StructField(c, kept.schema[c].dataType) for c in [*columns, key]])
    typed = {f.name: f for f in state.fields}
    out = StructType([*[typed[c] for c in [*columns[1:], key]], *[StructField(f"prev_{c}", typed[c].dataType) for c in lag],
                      *[StructField(c, LongType()) for c in ("n_flagged", "n_seen", "prev_n_flagged")]])
    ship_package(stream.sparkSession)
    return kept.groupBy("_bucket").transformWithStateInPandas(
        TrailingFlags("_bucket", [*columns, key], flag, list(lag), window, state, [key]), out, "Append", "EventTime").select(
            key, *[c for c in out.names if c != key])


def debounce_stream(stream: DataFrame, window: int = K.CONFIRM_WINDOW, count: int = K.CONFIRM_COUNT,
                    late: str = LATE) -> DataFrame:
    """Trailing flag counts per machine; stream columns: machine, ts, event_id, flagged."""
    rows = stream.withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    out = trailing_stream(rows, ["event_id"], "flagged", window, late)
    return out.select("machine", "event_id", "flagged", "n_flagged", "n_seen", (F.col("n_flagged") >= count).alias("confirmed"))


def event_stream(stream: DataFrame, window: int = K.CONFIRM_WINDOW, count: int = K.CONFIRM_COUNT, late: str = LATE,
                 primary: float = K.PRIMARY_THRESHOLD, early: float = K.EARLY_WARNING_THRESHOLD) -> DataFrame:
    """Level-change events; stream columns: machine, tick, ts, p, attack_p, flagged.

    The state holds counts only; levels and texts are the batch expressions on its output.
    """
    rows = trailing_stream(stream, ["tick"], "flagged", window, late, ["p"])
    level = lambda p, n: X.fuse(X.machine_status(p, primary, early), F.col(n) >= count)
    line = rows.withColumns({
        "status": X.machine_status("p", primary, early), "level": level("p", "n_flagged"),
        "prev_level": F.when(F.col("prev_n_flagged").isNull(), "OK").otherwise(level("prev_p", "prev_n_flagged"))})
    line = line.withColumn("reason", X.explain_fusion("level", "status", "p", "n_flagged", "n_seen"))
    return tl.level_events(line)


def join_stream(telemetry: DataFrame, flows: DataFrame, late: str = LATE, how: str = "full_outer") -> DataFrame:
    """Readings with the flow of the same machine, tick and event time ``ts``; unmatched rows of both sides are kept.

    Both sides have a watermark: an unmatched row comes out when both have passed it, the
    state of that time is dropped, and rows later than that are dropped as well.
    """
    a = telemetry.withWatermark("ts", late)
    b = flows.withWatermark("ts", late)
    return a.join(b, ["machine", "tick", "ts"], how)


def kpi_stream(stream: DataFrame, out: str, width: str = "1 day", late: str = "1 hour",
               checkpoint: str | None = None) -> None:
    """Flagged, total and peak per machine and time window, updated as rows arrive.

    A window may be written by several batches; ``latest_kpis`` keeps the last state.
    """
    agg = (stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "machine")
           .agg(F.sum(F.col("flagged").cast("bigint")).alias("flagged"), F.count(F.lit(1)).alias("flows"),
                F.max("attack_p").alias("peak"))
           .select(F.col("w.start").alias("window_start"), "machine", "flagged", "flows", "peak"))
    run_batches(agg, lambda df, i: _write_batch(df, out, i), "update", checkpoint)


def latest_kpis(spark: SparkSession, out: str) -> DataFrame:
    last = F.max_by(F.struct("flagged", "flows", "peak"), "batch")
    return (read_batches(spark, out, keep_batch=True).groupBy("window_start", "machine")
            .agg(last.alias("k")).select("window_start", "machine", "k.*"))
