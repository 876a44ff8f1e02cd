"""Long exact spans shared between records, by difference-cover anchors (problem 3).

The residues ``COVER`` form a perfect difference cover modulo ``PERIOD``: for
any two positions there is a shift below the period that brings both onto cover
residues. So two records that share `length` characters, wherever they stand in
each, share a window of ``length - PERIOD + 1`` characters that starts at a
cover position in both. Hashing only those windows (9 of 73 positions) finds
every anchor of a long match. Anchors that records of two owners share are then
extended: only the windows of the full length around a shared anchor are hashed,
and those that also occur in a record of another owner are the shared spans.

Both steps ask the same question of (key, record, position) entries: which keys
stand in records of two owners? A task combines its own entries first. A key
already seen under two owners there is settled on the spot, and only two
witnesses are passed on for the other tasks, once for each task, so a text that
a third of all records share costs two entries per task and no pairs are formed
at all. Entries travel in packed blobs, partitioned by key, with the number of
partitions taken from the size of the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import PrefixHash, batches_by_chars, code_points
from siltstone.session import Stage, partitions_for

PERIOD = 73
#: A Singer difference set: every residue modulo 73 is a difference of two of these.
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)

_OWNER_SHIFT = np.uint64(40)
_ENTRIES_PER_PARTITION = 1_500_000


def _window_entries(texts: list[str], docs: np.ndarray, width: int, anchors: list | None, reach: int):
    """(key, doc, position) of the windows of each text, in chunks: those at cover
    positions or, given the shared anchors of each text, those that begin at an
    anchor or up to `reach` characters before one."""
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    for a, b in batches_by_chars(lengths):
        # a character outside the BMP is one code point here as in `len`
        prefix = PrefixHash(code_points("".join(texts[a:b])))
        at = np.concatenate([[0], np.cumsum(lengths[a:b])])[:-1]
        n = np.maximum(lengths[a:b] - width + 1, 0)
        row = np.repeat(np.arange(b - a), n)
        first = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(first, n)
        if anchors is None:
            ok = cover[pos % PERIOD]
        else:
            mark = np.zeros(len(pos) + 1, dtype=np.int32)
            for i in range(b - a):
                if not n[i]:
                    continue
                spot = np.unique(np.frombuffer(b"".join(anchors[a + i]), dtype=np.uint32)).astype(np.int64)
                begin = np.minimum(np.maximum(spot - reach, 0), n[i])
                np.add.at(mark, first[i] + begin, 1)
                np.add.at(mark, first[i] + np.minimum(spot + 1, n[i]), -1)
            ok = np.cumsum(mark[:-1]) > 0
        row, pos = row[ok], pos[ok]
        start = at[row] + pos
        yield prefix.of(start, start + width), docs[a:b][row], pos


def _settle(key: np.ndarray, doc: np.ndarray):
    """Sorted entries: (order, group starts, flag per entry: its key has two owners)."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    if not len(k):
        return order, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    owner = d >> _OWNER_SHIFT
    two = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
    return order, start, np.repeat(two, np.diff(np.concatenate([start, [len(k)]])))


def _pack6(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


SETTLED_KEPT = 4_000_000  # settled keys a task remembers; beyond them it may send witnesses again


def _emit(width: int, reach: int | None, parts: int):
    """Packed entries by partition of the key (part >= 0), and the entries that
    are settled already (part -1)."""

    def flush(key, doc, pos, settled):
        order, start, two = _settle(key, doc)
        key, doc, pos = key[order], doc[order], pos[order]
        heads = key[start]
        known = np.zeros(len(heads), dtype=bool)
        if len(settled):
            at = np.minimum(np.searchsorted(settled, heads), len(settled) - 1)
            known = settled[at] == heads
        size = np.diff(np.concatenate([start, [len(key)]]))
        fresh = two[start] & ~known  # settled here for the first time: two witnesses, the first and last owner
        done = two | np.repeat(known, size)
        send = ~done
        send[start[fresh]] = True
        send[(start + size - 1)[fresh]] = True
        if fresh.any():
            settled = np.union1d(settled, heads[fresh])
            if len(settled) > SETTLED_KEPT:
                settled = heads[fresh]
        direct = ([-1], [np.flatnonzero(done)]) if done.any() else ([], [])
        at = np.flatnonzero(send)
        part = ((key[at] >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        by = np.lexsort((pos[at], doc[at], part))
        at, part = at[by], part[by]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
        groups = np.split(at, cut[1:]) if len(part) else []
        names = [*direct[0], *(part[cut] if len(part) else [])]
        rows = [*direct[1], *groups]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(names, dtype=np.int32)),
                pa.array([b"" if n < 0 else _pack6(key[r]) for n, r in zip(names, rows)], pa.binary()),
                pa.array([doc[r].tobytes() for r in rows], pa.binary()),
                pa.array([pos[r].astype(np.uint32).tobytes() for r in rows], pa.binary()),
            ],
            names=["part", "keys", "docs", "at"],
        )
        return batch, settled

    def run(batches):
        settled = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            docs = batch.column("doc").to_numpy().view(np.uint64)
            anchors = None if reach is None else batch.column("anchors").to_pylist()
            for key, doc, pos in _window_entries(batch.column("text").to_pylist(), docs, width, anchors, reach or 0):
                if len(key):
                    out, settled = flush(key, doc, pos, settled)
                    yield out

    return run


def _settle_partition():
    """All entries of a partition's keys: the records and positions shared.

    Entries already settled by the task that made them pass straight through."""

    def out(doc, pos):
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
        rows = np.split(pos, cut[1:]) if len(doc) else []
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[cut].view(np.int64)), pa.array([r.astype(np.uint32).tobytes() for r in rows], pa.binary())],
            names=["doc", "at"],
        )

    def run(batches):
        keys, docs, at = [], [], []
        for batch in batches:
            part = batch.column("part").to_pylist()
            for i in range(batch.num_rows):
                d = np.frombuffer(batch.column("docs")[i].as_py(), dtype=np.uint64)
                p = np.frombuffer(batch.column("at")[i].as_py(), dtype=np.uint32)
                if part[i] < 0:
                    yield out(d, p)
                    continue
                keys.append(_unpack6(batch.column("keys")[i].as_py()))
                docs.append(d)
                at.append(p)
        if keys:
            key, doc, pos = np.concatenate(keys), np.concatenate(docs), np.concatenate(at)
            order, _, two = _settle(key, doc)
            hit = order[two]
            yield out(doc[hit], pos[hit])

    return run


def _shared(df: DataFrame, width: int, reach: int | None, entries: float) -> DataFrame:
    """``doc, at``: positions (packed) of windows that two owners share, in rows by task."""
    parts = partitions_for(df.sparkSession, entries, _ENTRIES_PER_PARTITION)
    columns = ["doc", "text"] if reach is None else ["doc", "text", "anchors"]
    sent = df.select(*columns).mapInArrow(_emit(width, reach, parts), "part int, keys binary, docs binary, at binary")
    # settled entries need no company: spread them over the partitions, the same way on a retry
    where = F.when(F.col("part") < 0, F.pmod(F.xxhash64("docs"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    return sent.repartitionById(parts, where).mapInArrow(_settle_partition(), "doc long, at binary")


def _documents(df: DataFrame, id_col: str, text_col: str, owner_col: str, length: int) -> DataFrame:
    """One row per id: id, doc (24 bits of the owner's hash, 40 of the id's), text."""
    owner = F.xxhash64(F.coalesce(F.col(owner_col).cast("string"), F.lit("\0none")))
    ident = F.xxhash64(F.col(id_col).cast("string"))
    doc = F.shiftleft(F.shiftrightunsigned(owner, 40), 40).bitwiseOR(F.shiftrightunsigned(ident, 24))
    return (
        df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= length))
        .select(F.col(id_col).alias("id"), doc.alias("doc"), F.col(text_col).alias("text"))
    )


def shared_windows(df: DataFrame, id_col: str, text_col: str, owner_col: str, length: int = 200) -> DataFrame:
    """Every record with a span of `length` or more characters that also stands
    verbatim in a record of another owner: ``id, n_chars, at`` where `at` holds
    the (distinct, sorted) starts of shared windows of `length` characters.

    Rows with a null id or text are left out, a null owner is an owner of its
    own, ids that repeat count once, texts are used whole, other columns are
    ignored, and empty tables give an empty result. Equality of windows is that
    of 64-bit hashes (48 bits and the partition for keys in transit).
    """
    if length < 2 * PERIOD:
        raise ValueError(f"length must be at least {2 * PERIOD}")
    spark = df.sparkSession
    stage = Stage(spark, "spans")
    docs = _documents(df, id_col, text_col, owner_col, length)
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    near = stage.write(_shared(docs, length - PERIOD + 1, None, total * len(COVER) / PERIOD), "anchors")
    near = near.groupBy("doc").agg(F.collect_list("at").alias("anchors"))
    # repeated rows of an id only repeat entries; the texts of the others stay where they are if the anchors are few
    some = stage.write(docs.join(near, "doc").withColumn("n_chars", F.length("text")), "candidates")
    total = some.agg(F.sum("n_chars")).first()[0] or 0
    hits = stage.write(_shared(some, length, PERIOD - 1, total), "hits")
    stage.drop("anchors")
    merged = hits.groupBy("doc").agg(F.collect_list("at").alias("at"))
    names = stage.write(some.select("doc", "id", "n_chars").dropDuplicates(["doc"]), "names")
    stage.drop("candidates")
    return merged.join(names, "doc").select("id", "n_chars", "at")


def shared_spans(df: DataFrame, id_col: str, text_col: str, owner_col: str, length: int = 200) -> DataFrame:
    """Per record with shared spans: ``id, spans`` (array of start and end, end
    exclusive, maximal, in order), ``shared_chars`` and ``shared_share``."""

    def run(batches):
        for batch in batches:
            spans, chars = [], []
            for row in batch.column("at").to_pylist():
                pos = np.unique(np.frombuffer(b"".join(row), dtype=np.uint32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(pos) > length)
                start = pos[np.concatenate([[0], cut + 1])]
                end = pos[np.concatenate([cut, [len(pos) - 1]])] + length
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(start, end)])
                chars.append(int((end - start).sum()))
            n = batch.column("n_chars").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(np.asarray(chars, dtype=np.int32)),
                    pa.array(np.asarray(chars) / np.maximum(n, 1), pa.float64()),
                ],
                names=["id", "spans", "shared_chars", "shared_share"],
            )

    return shared_windows(df, id_col, text_col, owner_col, length).mapInArrow(
        run, "id string, spans array<struct<start:int,end:int>>, shared_chars int, shared_share double"
    )
