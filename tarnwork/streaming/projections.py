"""Projections of logs: one definition for a table and for a stream.

A projection has a version, an initial state, a step and a view.  Over a table it is a fold of each
key's rows in order; over a stream Spark keeps a typed state for each key.  The state and the
checkpoint belong to a version: with a new one the log is read again from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Projection(NamedTuple):
    """``apply`` takes a state and a row to the next state, ``view`` a state to what is shown; both are tuples."""

    name: str
    version: int
    key: str
    order: str
    columns: tuple[str, ...]
    state: str
    shown: str
    initial: tuple
    apply: Callable[[tuple, Any], tuple]
    view: Callable[[tuple], tuple]


def over_table(rows: DataFrame, p: Projection) -> DataFrame:
    """(key, shown...): the view of each key after all its rows."""
    names = [x.name for x in StructType.fromDDL(p.shown)]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = p.initial
        for row in pdf.sort_values(p.order).itertuples(index=False):
            state = p.apply(state, row)
        return pd.DataFrame([(pdf[p.key].iloc[0], *p.view(state))], columns=[p.key, *names])

    schema = f"{p.key} {rows.schema[p.key].dataType.simpleString()}, {p.shown}"
    return rows.select(p.key, p.order, *p.columns).groupBy(p.key).applyInPandas(fold, schema)


class _Keeper(StatefulProcessor):
    """Keeps (version, state) of each key and gives its view after every batch that names it."""

    def __init__(self, p: Projection):
        self.p = p
        self.names = [x.name for x in StructType.fromDDL(p.shown)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState(f"{self.p.name}_{self.p.version}", f"version int, {self.p.state}")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = self.held.get()
        state = tuple(found)[1:] if found is not None and found[0] == self.p.version else self.p.initial
        for row in sorted(rows, key=lambda r: r[self.p.order]):  # the key's rows of one batch
            state = self.p.apply(state, row)
        self.held.update((self.p.version, *state))
        yield Row(**dict(zip([self.p.key, *self.names], [key[0], *self.p.view(state)], strict=True)))

    def close(self) -> None:
        pass


def over_stream(stream: DataFrame, p: Projection, root: str) -> DataFrame:
    """The same of a stream whose batches follow the order, run over all that is there now.

    Results and checkpoint are under ``root``, in a folder of the version; a later run goes on from
    there, and a batch that is tried again overwrites what it wrote.
    """
    spark: SparkSession = stream.sparkSession
    schema = f"{p.key} {stream.schema[p.key].dataType.simpleString()}, {p.shown}"
    folder = f"{root}/{p.name}-v{p.version}"
    made = stream.select(p.key, p.order, *p.columns).groupBy(p.key).transformWithState(_Keeper(p), schema, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        run = made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    run.awaitTermination()
    views = spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/data")
    names = [x.name for x in StructType.fromDDL(p.shown)]
    return views.groupBy(p.key).agg(F.max_by(F.struct(*names), "batch").alias("v")).select(p.key, "v.*")
