"""Best-fit packing of token pieces into fixed-length sequences, with dominance reduction first."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaklens.llm.shared import small_batches, stash
from leaklens.llm.tokens import encoder

#: (length, first rank, number, first sequence, offset, how many of them follow each other in a sequence)
Run = tuple[int, int, int, int, int, int]


class _Plan:
    """Runs of equal pieces given to runs of sequences; its size depends on the lengths, not on the rows."""

    def __init__(self, counts: dict[int, int], room: int) -> None:
        self.room, self.left, self.used = room, {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0)
        self.runs: list[Run] = []
        self.bins = 0

    def put(self, length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        self.runs.append((length, self.used[length], n, first, offset, each))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def reduce(self) -> int:
        """Fix sets that dominate every other set with their largest piece; returns the sequences fixed.

        A piece alone where nothing else fits; with a partner that fills the rest exactly; or with the largest
        partner that fits where no two others fit together.
        """
        begun = self.bins
        while True:
            before = self.bins
            sizes = sorted(self.left)
            for big in sorted(self.left, reverse=True):
                if big not in self.left:
                    continue
                rest = self.room - big
                while big in self.left:
                    at = bisect.bisect_right(sizes, rest) - 1
                    while at >= 0 and (sizes[at] not in self.left or (sizes[at] == big and self.left[big] < 2)):
                        at -= 1
                    if at < 0:
                        n = self.left[big]
                        self.put(big, n, self.bins, 0)
                        self.bins += n
                        break
                    mate = sizes[at]
                    low = self._two_least(sizes, big)
                    if mate != rest and (low is None or low <= rest):
                        break
                    n = self.left[big] // 2 if mate == big else min(self.left[big], self.left[mate])
                    self.put(big, n, self.bins, 0)
                    self.put(mate, n, self.bins, big)
                    self.bins += n
            if self.bins == before:
                return self.bins - begun

    def _two_least(self, sizes: list[int], big: int) -> int:
        """Sum of the two least pieces besides one of `big`; past any room if there are not two."""
        found: list[int] = []
        for x in sizes:
            n = self.left.get(x, 0) - (x == big)
            found += [x] * min(2, max(0, n))
            if len(found) >= 2:
                return found[0] + found[1]
        return 1 << 62

    def fit(self) -> None:
        """Longest pieces first, each where the least room is left over; new sequences where none has room."""
        spare: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def free(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in spare:
                    spare[room] = []
                    bisect.insort(rooms, room)
                spare[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = spare[room].pop()
                    if not spare[room]:
                        del spare[room], rooms[at]
                else:
                    room, first = self.room, self.bins
                    n = -(-self.left[length] // (room // length))
                    self.bins += n
                each = room // length
                full = min(n, self.left[length] // each)
                if full:
                    self.put(length, full * each, first, self.room - room, each)
                    free(room - each * length, first, full)
                    first, n = first + full, n - full
                if n and length in self.left:
                    some = min(each - 1, self.left[length])
                    if some > 0:
                        self.put(length, some, first, self.room - room, some)
                        free(room - some * length, first, 1)
                        first, n = first + 1, n - 1
                free(room, first, n)


def plan(counts: dict[int, int], room: int = 4096) -> tuple[list[Run], int, int]:
    """Runs for a histogram of lengths (1 to room), the sequences they need, and how many of these reduction fixed."""
    if any(not 0 < k <= room for k in counts):
        raise ValueError("lengths must be from 1 to the room")
    p = _Plan(counts, room)
    fixed = p.reduce()
    p.fit()
    return p.runs, p.bins, fixed


def token_pieces(docs: DataFrame, path: str, room: int = 4096, end_id: int = 1) -> DataFrame:
    """Cut every document's ids (null text: none) and end_id into pieces of at most `room`."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        own = encoder(path)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            whole, ends = own.encode(b.column(1))
            begin = 0
            for key, stop in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                ids = whole[begin:stop].tobytes() + end
                begin = stop
                for k in range(0, len(ids), 4 * room):
                    piece = ids[k : k + 4 * room]
                    for column, value in zip(out, (key, k // (4 * room), k // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, room: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents' pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram of lengths (at most `room` rows) reaches the driver; the plan made from it is broadcast
    and has a bound that depends on `room` alone. Equal lengths are ranked in hashed buckets, so that no length
    is sorted in one task. An empty or null text is one piece of end_id; repeated rows and null ids are packed
    as often as they come; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stash(token_pieces(docs, path, room, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    runs, _, _ = plan(counts, room)
    runs.sort()
    wide = 1 << 40
    table = spark.sparkContext.broadcast(np.array(runs or [(0,) * 6], np.int64))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // 50_000 + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = rows.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def place(batches):
        t = table.value
        begins = t[:, 0] * wide + t[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = t[np.searchsorted(begins, length * wide + rank, "right") - 1]
            at, step = np.divmod(rank - run[:, 1], np.maximum(run[:, 5], 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + at), pa.array(run[:, 4] + step * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
