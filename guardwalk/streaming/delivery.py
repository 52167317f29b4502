"""The stateful behaviours as streams: outcome delivery, replayed series, and a ledger that the first witness wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from guardwalk.operators.replay import delivered
from guardwalk.sources.stores import KEY, WITNESS, credit


def deliver(calls: DataFrame, series: dict[str, list[str]], terminal: str) -> DataFrame:
    """(op, call_id, n, outcome) of a stream of (op, call_id): the n-th call of an operation gets its n-th outcome, then the terminal.

    State per operation: the number delivered so far.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        mine = series.get(key[0], [])
        for pdf in frames:
            ids = sorted(pdf["call_id"])
            yield pd.DataFrame({"op": key[0], "call_id": ids, "n": range(done + 1, done + 1 + len(ids)), "outcome": [mine[i] if i < len(mine) else terminal for i in range(done, done + len(ids))]})
            done += len(ids)
        state.update((done,))

    return calls.groupBy("op").applyInPandasWithState(step, "op string, call_id long, n long, outcome string", "done long", "append", "NoTimeout")


def keep_ledger(witnesses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of witnesses into versions of a ledger under `path`; a batch that is run again writes its version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], WITNESS)
        credit(before, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return witnesses.select(*KEY, "recipe", "run_seq").writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


class Replay(StatefulProcessor):
    """State per operation: its outcomes by call, its ending, how many calls it has had. An outcome leaves the state with its call; what stays is the ending."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.outcomes = handle.getMapState("outcomes", "call long", "fields string")
        self.ending = handle.getValueState("ending", "fields string")
        self.done = handle.getValueState("done", "n long")

    def handleInitialState(self, key: tuple, row: Row, timers) -> None:
        if row["call"] is None:
            self.ending.update((row["fields"],))
        else:
            self.outcomes.updateValue((row["call"],), (row["fields"],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        n = self.done.get()[0] if self.done.exists() else 0
        ending = self.ending.get()[0] if self.ending.exists() else None
        for i in sorted(r["call_id"] for r in rows):  # the order of one micro-batch
            n += 1
            if self.outcomes.containsKey((n,)):
                yield Row(op=key[0], call_id=i, call=n, source="outcome", fields=self.outcomes.getValue((n,))[0])
                self.outcomes.removeKey((n,))
            else:
                yield Row(op=key[0], call_id=i, call=n, source="none" if ending is None else "terminal", fields=ending)
        self.done.update((n,))


def replay(calls: DataFrame, held: DataFrame, ends: DataFrame) -> DataFrame:
    """(op, call_id, call, source, set) of a stream of (op, call_id), equal to `operators.replay.replayed` if calls come in the order of call_id.

    The series and endings are the state that the first batch starts from, by operation; nothing of them passes the driver. Needs the RocksDB state store.
    """
    own = delivered(held).select("op", "call", F.to_json("set").alias("fields"))
    start = own.union(ends.select("op", F.lit(None).cast("long"), F.to_json("terminal"))).groupBy("op")
    asked = calls.select(F.upper("op").alias("op"), F.col("call_id").cast("long").alias("call_id"))
    out = asked.groupBy("op").transformWithState(Replay(), "op string, call_id long, call long, source string, fields string", "append", "none", start)
    return out.select("op", "call_id", "call", "source", F.from_json("fields", "map<string,string>").alias("set"))
