"""Structured Streaming: day counts from events, the monitor and charts as keyed state, alarms as a keyed sink.

Days of a series are taken in order; days that are skipped count zero, days that come again are dropped and counted.
The monitor's state is on disk: a list of counts that days are appended to, two bit masks over the paths (left, gone
above) that looks write, and a few numbers; so what a day writes doesn't grow with the series. Normals are made again from
their seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.blocks import best_start, corners
from riskloom.operators.monitor import TRACE, Monitor, MonitorConfig


def online_counts(events: DataFrame, keys: list[str], when: str, case, death, delay: str = "1 day") -> DataFrame:
    """Counts of closed days: (keys, date, cases, deaths), appended once the watermark has passed the day."""
    rows = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, delay)
    out = rows.groupBy(*keys, F.window(when, "1 day").alias("w")).agg(F.count_if(case).cast("double").alias("cases"), F.count_if(death).cast("double").alias("deaths"))
    return out.select(*keys, F.to_date("w.start").alias("date"), "cases", "deaths")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB and checkpoint its changes alone;
    stateful processors with list state need it. A stream goes on only with the store that it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class OnlineMonitor(StatefulProcessor):
    """State of a series: a list of its days, that days are appended to and only looks read; where it stands; and the two
    bit masks over the paths, that only looks write."""

    def __init__(self, config: MonitorConfig, keys: list[str]):
        self.config, self.keys = config, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getListState("days", "cases double, deaths double")
        self.place = handle.getValueState("place", "days long, look int, stopped boolean, dropped long")
        self.masks = handle.getValueState("masks", "eligible binary, crossed binary")

    def _watch(self, look: int) -> Monitor:
        watch = Monitor(self.config)
        watch.state.look = look
        if self.masks.exists():
            left, above = (np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))[: self.config.paths]) for x in self.masks.get())
            watch.state.left, watch.state.above = left, frozenset(above.tolist())
        return watch

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        length, look, stopped, dropped = self.place.get() if self.place.exists() else (0, 0, False, 0)
        looks, last = set(self.config.looks), self.config.looks[-1]
        frame, fresh, out = pd.concat(list(rows)).sort_values("t"), [], []
        for t, c, d in zip(frame.t.tolist(), frame.cases.tolist(), frame.deaths.tolist(), strict=True):
            if stopped or t < length:
                dropped += 1
                continue
            while length <= t and not stopped:
                fresh.append((float(c), float(d)) if length == t else (0.0, 0.0))
                length += 1
                if length in looks:
                    self.days.appendList(fresh)
                    fresh = []
                    prefix, watch = np.array(list(self.days.get()), float), self._watch(look)
                    out.append({**watch.look(prefix[:, 0], prefix[:, 1]), "dropped": dropped})
                    look = watch.state.look
                    self.masks.update(tuple(np.packbits(np.isin(np.arange(self.config.paths), [*x])).tobytes() for x in (watch.state.left, watch.state.above)))
                    stopped = out[-1]["crossed"] or length >= last
        if fresh:
            self.days.appendList(fresh)
        self.place.update((int(length), int(look), bool(stopped), int(dropped)))
        if out:
            names = [*self.keys, *(f.split()[0] for f in TRACE.split(", ")), "dropped"]
            yield pd.DataFrame([{**dict(zip(self.keys, key, strict=True)), **r} for r in out], columns=names)

    def close(self) -> None:
        pass


def online_monitor(stream: DataFrame, keys: list[str], config: MonitorConfig) -> DataFrame:
    """A row per planned look of (keys, t, cases, deaths), with the number of rows dropped so far.

    After an alarm or the last look further days are dropped and counted. The rows equal those of the batch monitor
    on the same prefix. Sets the session's state store to the one on disk (`keep_state_on_disk`).
    """
    keep_state_on_disk(stream.sparkSession)
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.select(*keys, "t", "cases", "deaths").groupBy(*keys).transformWithStateInPandas(OnlineMonitor(config, keys), f"{kinds}, {TRACE}, dropped long", "append", "None")


class OnlineFocus(StatefulProcessor):
    """State of a series: the starts that can still win (a handful, the corners of a hull), and the walk's end."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.starts = handle.getListState("starts", "start long, p double")
        self.place = handle.getValueState("place", "t long, total double, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, total, dropped = self.place.get() if self.place.exists() else (-1, 0.0, 0)
        held = np.array(list(self.starts.get()), float).reshape(-1, 2) if self.starts.exists() else np.zeros((0, 2))
        frame = pd.concat(list(rows)).sort_values("t")
        out = []
        for t, v in zip(frame.t.tolist(), frame.v.tolist(), strict=True):
            if t <= last:
                dropped += 1
                continue
            held = np.vstack([held, [t, total]])
            held = held[corners(held[:, 0], held[:, 1])]
            total, last = total + (v if v == v else 0.0), t
            out.append((*key, t, *best_start(held[:, 0].astype(int), held[:, 1], t, total), len(held), dropped))
        self.starts.put([(int(s), float(p)) for s, p in held])
        self.place.update((int(last), float(total), int(dropped)))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "t", "statistic", "start", "direction", "candidates", "dropped"])

    def close(self) -> None:
        pass


def online_focus(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Mean change of (keys, t, v), a row per day: statistic, start and direction over all starts so far, the number of
    starts that are kept, and of days dropped for coming late. Days are taken in order in a batch."""
    keep_state_on_disk(stream.sparkSession)
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.select(*keys, "t", "v").groupBy(*keys).transformWithStateInPandas(OnlineFocus(keys), f"{kinds}, t long, statistic double, start long, direction int, candidates int, dropped long", "append", "None")


def online_page_cusum(stream: DataFrame, keys: list[str], allowance: float = 0.5) -> DataFrame:
    """Two-sided CUSUM of (keys, t, v) in constant state: two sums and their starts; a row per day, in order of t in a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, up_start, down_start = state.get if state.exists else (0.0, 0.0, -1, -1)
        rows, out = pd.concat(list(frames)).sort_values("t"), []
        for t, v in zip(rows.t.tolist(), rows.v.tolist(), strict=True):
            up_start, down_start = (t if s < 0 else s for s in (up_start, down_start))
            up, down = up + v - allowance, down - v - allowance
            if up <= 0:
                up, up_start = 0.0, t + 1
            if down <= 0:
                down, down_start = 0.0, t + 1
            side = 0 if up <= 0 and down <= 0 else 1 if up >= down else -1
            out.append((*key, t, max(up, down), t if side == 0 else up_start if side > 0 else down_start, side))
        state.update((up, down, int(up_start), int(down_start)))
        yield pd.DataFrame(out, columns=[*keys, "t", "statistic", "start", "direction"])

    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.select(*keys, "t", "v").groupBy(*keys).applyInPandasWithState(
        step, f"{kinds}, t long, statistic double, start long, direction int", "up double, down double, up_start long, down_start long", "append", GroupStateTimeout.NoTimeout
    )


class AlarmTable:
    """First alarm per series in a folder: a delta a batch, merged into a base every `every` batches.

    A folder counts once its job has committed it (Spark's _SUCCESS). A batch that runs twice writes its own delta anew, or
    its own base from the base before and the same deltas, so replay changes nothing. Readers take the latest base and the
    deltas after it. A new base drops what the base before it had replaced, so that readers of that one can finish; there
    are never more than twice `every` deltas.
    """

    FIELDS = "look int, prefix int, tau_hat int, statistic double, boundary double"

    def __init__(self, spark: SparkSession, path: str, keys: list[str], kinds: str, every: int = 16):
        """kinds: the key columns with their types, as in a schema."""
        self.spark, self.path, self.keys, self.every = spark, path.rstrip("/"), keys, every
        self.schema = f"{kinds}, {self.FIELDS}"

    def _folders(self, kind: str) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        done = [x for x in names if x.startswith(f"{kind}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        return sorted(int(x.partition("=")[2]) for x in done)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _rows(self, parts: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], self.schema)
        return rows.unionByName(self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in parts))) if parts else rows

    def _first(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), "look").alias("_first")).select(*self.keys, "_first.*")

    def _parts(self, before: int) -> list[str]:
        bases = [b for b in self._folders("base") if b < before]
        start = bases[-1] if bases else -1
        return [f"base={b}" for b in bases[-1:]] + [f"delta={d}" for d in self._folders("delta") if start < d < before]

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in the alarms of batch `number`."""
        alarms = batch.where("crossed").select(*self.keys, *(f.split()[0] for f in self.FIELDS.split(", ")))
        self._first(alarms).write.mode("overwrite").parquet(f"{self.path}/delta={number}")
        if number % self.every != self.every - 1:
            return
        bases = [b for b in self._folders("base") if b < number]
        self._first(self._rows([*self._parts(number), f"delta={number}"])).write.mode("overwrite").parquet(f"{self.path}/base={number}")
        for old in bases[:-1]:
            self._delete(f"base={old}")
        for old in self._folders("delta"):
            if bases and old <= bases[-1]:
                self._delete(f"delta={old}")

    def read(self) -> DataFrame:
        """The first alarm of each series so far; no rows before any alarm."""
        return self._first(self._rows(self._parts(1 << 60)))


def online_alarm_table(trace: DataFrame, table: AlarmTable, checkpoint: str):
    """The stream's alarms into the table, batch by batch."""
    return trace.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table.merge).start()
