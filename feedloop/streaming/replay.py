"""Replay of a live log with Structured Streaming, and click rates over event time.

The windowed rates are an addition: the studied system has no event time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from feedloop.policies.loop import replay
from feedloop.policies.registry import Spec

MATCHES = "run string, seed int, seq bigint, u int, i int, reward double"


class ReplayProcessor(StatefulProcessor):
    """The state of a run is its policy. Within a micro-batch, rows are taken in the order of seq."""

    def __init__(self, runs: list[tuple[Spec, int]], n_users: int, n_items: int, ties: str) -> None:
        self.runs, self.n_users, self.n_items, self.ties = runs, n_users, n_items, ties

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("policy", StructType([StructField("policy", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spec, seed = self.runs[int(key[0])]
        policy = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else spec.build(self.n_users, self.n_items, seed, self.ties)
        batch = pd.concat(list(rows)).sort_values("seq")
        lines = zip(batch["seq"].tolist(), batch["u"].tolist(), batch["i"].tolist(), batch["reward"].tolist(), (np.asarray(c) for c in batch["cands"]), strict=True)
        found = pd.DataFrame(list(replay(policy, lines)), columns=["seq", "u", "i", "reward"])
        self.state.update((pickle.dumps(policy),))
        yield found.assign(run=spec.name, seed=seed)[["run", "seed", "seq", "u", "i", "reward"]]

    def close(self) -> None:
        pass


def replay_stream(log: DataFrame, specs: list[Spec], seeds: list[int], n_users: int, n_items: int, ties: str = "random") -> DataFrame:
    """As the replay of a log, for a streaming log ``(seq, u, i, reward, cands)``. Needs the RocksDB state store."""
    runs = [(s, seed) for s in specs for seed in seeds]
    todo = F.broadcast(log.sparkSession.createDataFrame([(k,) for k in range(len(runs))], "k int"))
    rows = log.where("u IS NOT NULL AND i IS NOT NULL").crossJoin(todo)
    return rows.groupBy("k").transformWithStateInPandas(
        statefulProcessor=ReplayProcessor(runs, n_users, n_items, ties), outputStructType=MATCHES, outputMode="Append", timeMode="None"
    )


def windowed_rates(events: DataFrame, time: str, hit: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(begin, shown, clicked, rate)`` for each window of event time; rows later than the watermark are left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    out = rows.agg(F.count("*").alias("shown"), F.count_if(hit).alias("clicked"))
    return out.select(F.col("w.start").alias("begin"), "shown", "clicked", (F.col("clicked") / F.col("shown")).alias("rate"))
