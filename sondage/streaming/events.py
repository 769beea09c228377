"""Events over a stream: windows of each node against the node's running level, then nodes of each window.

Three stateful steps in append mode on one watermark: a window of a node is closed by the watermark, its level comes from
keyed state, and the window over all nodes is closed in turn. ``events`` is the same for a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

SCORES = "node string, at timestamp, score double"


def _windows(samples: DataFrame, node: str, time: str, value: str, length: str) -> DataFrame:
    """(node, at, rms): deviation of the samples of each node and window; ``at`` is inside it, just before its end."""
    each = samples.groupBy(F.col(node).cast("string").alias("node"), F.window(time, length).alias("w")).agg(F.stddev_pop(value).alias("rms"))
    return each.select("node", F.window_time("w").alias("at"), "rms").where("rms IS NOT NULL")


def _closed(scores: DataFrame, length: str, nodes: int, factor: float) -> DataFrame:
    """(start, score, nodes) of the windows in which all nodes have a score, the least of them ``factor`` or more."""
    each = scores.groupBy(F.window("at", length).alias("w")).agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("nodes"))
    return each.where((F.col("nodes") >= nodes) & (F.col("score") >= factor)).select(F.col("w.start").alias("start"), "score", "nodes")


def events(samples: DataFrame, node: str, time: str, value: str, length: str, nodes: int, factor: float) -> DataFrame:
    """(start, score, nodes): tumbling windows in which each of ``nodes`` nodes is ``factor`` times its level or more.

    A node's level is the mean deviation of its earlier windows; its first window has none and no score, and so have
    windows after silence alone. Windows without a sample of a node count as that node's absence: they are no events.
    """
    w = _windows(samples, node, time, value, length)
    level = F.avg("rms").over(Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return _closed(w.withColumn("score", F.col("rms") / F.when(level > 0, level)).where("score IS NOT NULL"), length, nodes, factor)


class RunningLevel(StatefulProcessor):
    """Per node the number and the sum of the deviations so far; a row for each window that has a level before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at")  # the windows that one batch closes
        n, total = self.seen.get() if self.seen.exists() else (0, 0.0)
        out = []
        for at, rms in zip(new["at"], new["rms"], strict=True):
            if n and total > 0:
                out.append((key[0], at, rms * n / total))
            n, total = n + 1, total + float(rms)
        self.seen.update((n, total))
        if out:
            yield pd.DataFrame(out, columns=["node", "at", "score"])

    def close(self) -> None:
        """Nothing is held open."""


def event_stream(samples: DataFrame, node: str, time: str, value: str, length: str, nodes: int, factor: float, late: str) -> DataFrame:
    """As ``events`` for a stream: rows up to ``late`` behind the latest count, later ones are dropped.

    Windows of a node close in order, so its level is that of all earlier ones. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass) and append mode.
    """
    w = _windows(samples.withWatermark(time, late), node, time, value, length)
    scores = w.groupBy("node").transformWithStateInPandas(RunningLevel(), SCORES, "append", "eventTime", eventTimeColumnName="at")
    return _closed(scores, length, nodes, factor)
