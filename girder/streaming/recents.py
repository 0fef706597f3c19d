"""Lists of what each key opened last, kept as state of a stream.

A list is newest first and holds at most ``cap`` entries; one file (name, size, modified;
an unknown time of modification agrees with any) is one entry, at its latest opening.
Entries that are older than the key's newest event by more than ``expiry`` go. A removal
takes away the file's openings up to its own time and is remembered until it expires,
so events may come late and in any order within a batch: openings and removals of
files whose time of modification is known give the same list however they are dealt
to batches, but that an entry which the cap has pushed out doesn't come back when
another is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CAP = 5
AT_ONCE = 4096  # events of a key that are held at a time
ENTRY = "name string, size long, modified long, opened_at long, removed boolean"
FIELDS = [x.split()[0] for x in ENTRY.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(entries: list[tuple], event: tuple, cap: int, expiry: int) -> list[tuple]:
    """Entries (name, size, modified, opened_at, removed) with one event more, newest first."""
    same = [e for e in entries if e[:2] == event[:2] and (e[2] == event[2] or e[2] is None or event[2] is None)]
    # of one file the later event counts; a removal wins a tie
    if any((e[3], e[4]) >= (event[3], event[4]) for e in same):
        return entries
    out = sorted([event, *(e for e in entries if e not in same)], key=lambda e: (-e[3], e[0], e[1]))
    oldest, left = out[0][3] - expiry, cap
    kept = []
    for e in out:
        if e[3] < oldest or not e[4] and not left:
            continue
        left -= not e[4]
        kept.append(e)
    return kept


def merged_all(entries: list[tuple], events: list[tuple], cap: int, expiry: int) -> list[tuple]:
    """Entries with several events more. An event that the newest one expires changes nothing that stays, so it isn't merged."""
    oldest = max(e[3] for e in events + entries[:1]) - expiry
    for event in events:
        if event[3] >= oldest:
            entries = merged(entries, event, cap, expiry)
    return entries


class Recents(StatefulProcessor):
    """Keeps one list state for each key and gives the whole list out when it has new events."""

    def __init__(self, cap: int, expiry: int):
        self.cap, self.expiry = cap, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:  # noqa: N802  Spark's name
        before = held = [tuple(e) for e in self.entries.get()]
        opened = (tuple(e)[-len(FIELDS):] for e in rows)  # by place, as a Row looks each name up anew
        known = (e for e in opened if e[0] is not None and e[1] is not None and e[3] is not None)
        while events := list(islice(known, AT_ONCE)):
            held = merged_all(held, events, self.cap, self.expiry)
        if held != before:
            self.entries.put(held) if held else self.entries.clear()
        # a list that became empty is told as one row without a file
        shown = [(k, *e[:4]) for k, e in enumerate((e for e in held if not e[4]), 1)] or [(0, None, None, None, None)]
        for place, name, size, modified, opened_at in shown:
            yield Row(owner=key[0], place=place, name=name, size=size, modified=modified, opened_at=opened_at)

    def close(self) -> None:
        pass


def keep_recents(events: DataFrame, table: str, checkpoint: str, cap: int = CAP, expiry: int = 1 << 62) -> StreamingQuery:
    """Start the stream: events (owner: long, name, size, modified, opened_at, removed) update the lists, each batch's lists go to the folder ``table`` under the batch's number. All there is is worked off; the checkpoint lets the next start go on from there."""
    spark = events.sparkSession
    rows = events.select(F.col("owner").cast("long").alias("owner"), "name", F.col("size").cast("long").alias("size"), F.col("modified").cast("long").alias("modified"), F.col("opened_at").cast("long").alias("opened_at"), F.coalesce("removed", F.lit(False)).alias("removed")).filter("owner is not null")
    lists = rows.groupBy("owner").transformWithState(Recents(cap, expiry), "owner long, place int, name string, size long, modified long, opened_at long", "update", "none")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # list states need it; a query keeps the settings it starts with
    try:
        return lists.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def current_recents(lists: DataFrame) -> DataFrame:
    """(owner, place, name, size, modified, opened_at) of each owner's newest list."""
    newest = lists.groupBy("owner").agg(F.max("batch").alias("batch"))
    return lists.join(newest, ["owner", "batch"]).filter("place > 0").select("owner", "place", "name", "size", "modified", "opened_at")
