"""Recent lists as state: the last names of each user, with pinned ones first.

The state of a user is at most ``cap`` names with the time of their last use, and the pins.
Rows of a micro-batch are folded into it in any order, as what counts of a name is its last use
and of a pin the parity of its toggles; so the lists do not depend on how the rows were cut
into batches, and a restart from the checkpoint goes on with them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAP = 12
OUT = "user_id long, version long, place int, name string, pinned boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RecentList(StatefulProcessor):
    def __init__(self, cap: int = CAP, ttl_ms: int | None = None):
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, read and written once: each call to the store costs more than a user's rows
        self.state = handle.getValueState("list", "names array<string>, at array<long>, pins array<string>, n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names, at, pinned, n = self.state.get() or ([], [], [], 0)
        last: dict[str, int] = dict(zip(names, at))
        pins: dict[str, int] = dict.fromkeys(pinned, 0)
        for r in rows:
            if r.pin:
                pins.pop(r.name, None) if r.name in pins else pins.update({r.name: 0})
            elif r.at > last.get(r.name, -1):
                last[r.name] = r.at
                if len(last) > 64 * self.cap:  # names beyond the cap are never needed again
                    last = self._newest(last)
        last = self._newest(last)
        version = n + 1
        self.state.update((list(last), list(last.values()), sorted(pins), version))
        names = sorted(pins) + [n for n in last if n not in pins]
        for place, name in enumerate(names or [None], 1):
            yield Row(user_id=key[0], version=version, place=place, name=name, pinned=name in pins)

    def _newest(self, last: dict[str, int]) -> dict[str, int]:
        return dict(sorted(last.items(), key=lambda x: (-x[1], x[0]))[: self.cap])

    def close(self) -> None:
        pass


def recent_lists(uses: DataFrame, cap: int = CAP, ttl_ms: int | None = None) -> DataFrame:
    """(user_id, version, place, name, pinned): after each micro-batch, the whole list of every user that it touched.

    ``uses`` is a stream of (user_id, at, name, pin): a use of a name at a number that grows, or
    a toggle of its pin. Pins come first, by name, then the ``cap`` names used last, newest first,
    without the pinned. A list that has become empty is one row without a name. With ``ttl_ms``,
    a state is forgotten that long after it was last written. Needs the RocksDB state store.
    """
    rows = uses.where(F.col("name").isNotNull() & F.col("user_id").isNotNull()).select(F.col("user_id").cast("long").alias("user_id"), F.col("at").cast("long").alias("at"), "name", F.coalesce("pin", F.lit(False)).alias("pin"))
    return rows.groupBy("user_id").transformWithState(RecentList(cap, ttl_ms), OUT, "Append", "ProcessingTime" if ttl_ms else "None")


def latest_lists(written: DataFrame) -> DataFrame:
    """The last version of each user's list, of all that a stream has written."""
    newest = written.groupBy(F.col("user_id").alias("__user")).agg(F.max("version").alias("__version"))
    last = written.join(newest, (F.col("user_id") == F.col("__user")) & (F.col("version") == F.col("__version")))
    return last.where("name IS NOT NULL").select("user_id", "place", "name", "pinned")
