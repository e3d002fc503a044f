"""Which occurrences of equal keys are not the first, over a whole corpus.

Keys are 128-bit hashes of what stands at a place of a document. A mapper sends
packed arrays, not a row for each key, and of keys that it has seen several
times only the first place: the others are known to be repeats already. So a key
that stands in a third of all documents reaches its reducer once for each
flush of a mapper, not once for each document. Keys are dealt by their hash to
as many reducers as the input's bytes ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import NO_ID, trimmed

#: Places that a mapper gathers before it sends them.
FLUSH = 1_500_000
PLACE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<i4")])

BLOB = "bucket int, kind int, n int, data binary"
MARKS = "doc long, tag long, places array<int>"


def starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column (the first does)."""
    new = np.ones(len(columns[0]), bool)
    for k, c in enumerate(columns):
        differs = c[1:] != c[:-1]
        new[1:] = differs if k == 0 else new[1:] | differs
    return new


def earliest_first(a: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places whose groups begin at ``new``: (places in order within each group, mask of those that are not the first's place).

    Only groups of several places are sorted.
    """
    group = np.cumsum(new) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1) if len(a) else np.zeros(0, np.int64)
    if len(many):
        s = a[many]
        a[many] = s[np.lexsort((s["pos"], s["tag"], s["doc"], s["tag"] == NO_ID, group[many]))]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    other = np.zeros(len(a), bool)
    x, y = a[many], a[lead[many]]
    other[many] = (x["doc"] != y["doc"]) | (x["tag"] != y["tag"]) | (x["pos"] != y["pos"])
    return a, other


def later_places(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places by key and order, mask of those after their key's first, mask of each key's first row).

    Equal places of a key are one.
    """
    a = a[np.lexsort((a["h2"], a["h1"]))]
    new = starts(a["h1"], a["h2"])
    a, later = earliest_first(a, new)
    return a, later, new


def send(batches: Iterable[pa.RecordBatch], places: Callable[[pa.RecordBatch], Iterator[np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of places by bucket (kind 0), and of places known to be repeats (kind 1)."""
    held: list[np.ndarray] = []
    size = turn = 0
    for batch in batches:
        for a in places(batch):
            held.append(a)
            size += len(a)
            if size >= FLUSH:
                yield _flush(held, buckets, turn)
                held, size, turn = [], 0, turn + 1
    if size:
        yield _flush(held, buckets, turn)


def by_bucket(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows dealt to it) for each bucket that gets any."""
    order = np.argsort(to, kind="stable")
    dealt = to[order]
    at = np.flatnonzero(starts(dealt)) if len(dealt) else np.zeros(0, np.int64)
    for lo, hi in zip(at.tolist(), np.append(at[1:], len(dealt)).tolist()):
        yield int(dealt[lo]), order[lo:hi]


def _flush(held: list[np.ndarray], buckets: int, turn: int) -> pa.RecordBatch:
    a, later, new = later_places(np.concatenate(held))
    fresh, known = a[~later & new], a[later]
    to = (fresh["h1"] % np.uint64(buckets)).astype(np.int64)
    rows = [(b, 0, fresh[k]) for b, k in by_bucket(to, buckets)]
    if len(known):
        rows.append(((int(known["doc"][len(known) // 2]) * 2_654_435_761 + turn) % buckets, 1, known))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([len(r[2]) for r in rows], pa.int32()),
            pa.array([r[2].tobytes() for r in rows], pa.binary()),
        ],
        ["bucket", "kind", "n", "data"])


def by_document(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order, first row of each document, the row after its last)."""
    a = a[np.lexsort((a["pos"], a["tag"], a["doc"]))]
    first = np.flatnonzero(starts(a["doc"], a["tag"])) if len(a) else np.zeros(0, np.int64)
    return a, first, np.append(first[1:], len(a)) if len(first) else first


def pack_marks(a: np.ndarray) -> pa.RecordBatch:
    a, first, ends = by_document(a)
    edge = np.append(first, len(a)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(a["doc"][first]), pa.array(a["tag"][first].astype(np.int64)), pa.ListArray.from_arrays(pa.array(edge), pa.array(a["pos"].astype(np.int32)))],
        ["doc", "tag", "places"])


def reduce_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of one bucket's blobs."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            a = np.frombuffer(data.as_buffer(), PLACE)
            if kind:
                yield pack_marks(a)
            else:
                parts.setdefault(bucket, []).append(a.copy())
    for bucket in sorted(parts):
        a, later, _ = later_places(np.concatenate(parts.pop(bucket)))
        yield pack_marks(a[later])


def repeated_places(rows: DataFrame, places: Callable[[pa.RecordBatch], Iterator[np.ndarray]], buckets: int) -> DataFrame:
    """(doc, tag, places): the places of each document whose key stands earlier too.

    Earlier is an earlier document in the order of ``common.row_key``, or a
    smaller place of the same one. A document may have several rows.
    """
    blobs = rows.mapInArrow(trimmed(lambda batches: send(batches, places, buckets)), BLOB)
    return blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(trimmed(reduce_places), MARKS)


def marks_by_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc", "tag").agg(F.flatten(F.collect_list("places")).alias("places"))
