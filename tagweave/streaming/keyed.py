"""Counts of rows that arrive in pieces: keyed state that holds every row's counts so far."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keyed state needs; it is set for the session when a stream uses one.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RowCounts(StatefulProcessor):
    """Of each row ``i`` the sum of its counts by column; gives out the whole row whenever some of it arrives.

    The cells of a row are one value, read and written once a micro-batch: every call on the state is a message to the JVM.
    With ``forget_after`` milliseconds a count that got no more in that time is cleared; without it all stay.
    """

    def __init__(self, forget_after: int | None):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        # by cell its column, its count and the time at which it last got more
        cells = T.StructType().add("d", T.ArrayType(T.IntegerType())).add("x", T.ArrayType(T.DoubleType())).add("at", T.ArrayType(T.LongType()))
        self.cells = handle.getValueState("cells", cells, self.forget_after)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        more: dict[int, float] = {}
        for _, d, x in rows:
            if d is not None:  # a null or undefined count adds nothing
                more[d] = more.get(d, 0.0) + (0.0 if x is None or x != x else x)
        now = 0 if self.forget_after is None else timerValues.getCurrentProcessingTimeInMs()
        before = self.cells.get() or ((), (), ())
        whole = {d: (x, at) for d, x, at in zip(*before, strict=True) if self.forget_after is None or at + self.forget_after > now}
        for d, x in more.items():
            whole[d] = (whole[d][0] + x if d in whole else x, now)
        columns = sorted(whole)
        if more:
            self.cells.update((columns, [whole[d][0] for d in columns], [whole[d][1] for d in columns]))
        for d in columns:
            yield Row(i=key[0], d=d, x=whole[d][0])

    def close(self) -> None:
        pass


def whole_rows(stream: DataFrame, forget_after: int | None = None) -> DataFrame:
    """A stream of counts ``(i, d, x)`` as a stream of whole rows: in each micro-batch the rows that it touched, with all
    their counts so far. Counts of one cell add up, within a micro-batch and over micro-batches.

    A micro-batch that is delivered again starts from the state before it, so it gives the same rows again.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = T.StructType([T.StructField("i", stream.schema["i"].dataType)]).add("d", T.IntegerType()).add("x", T.DoubleType())
    given = stream.select("i", stream["d"].cast("int").alias("d"), stream["x"].cast("double").alias("x"))
    return given.groupBy("i").transformWithState(
        statefulProcessor=RowCounts(forget_after), outputStructType=kind, outputMode="Update",
        timeMode="none" if forget_after is None else "processingTime",
    )
