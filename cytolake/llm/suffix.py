"""Repeated-passage removal with a logarithmic family of suffix arrays.

Every byte is removed that lies in a string of `length` bytes which also starts
anywhere else.  The suffix arrays are sparse: a text enters with the suffixes
that start at its anchors.  The anchor of a window of `length` bytes is the least of the
hashes of the `gram`-byte strings in it, the leftmost if several are least.  Equal
windows have equal anchors at equal places, so an anchor's suffix with the windows it
stands for (a segment: consecutive starts) takes the place of about 70 suffixes.

An array is a table of suffixes in text order: by their first `gram` bytes, and among
equal ones by their segment (64-bit hash).  Documents come in batches.  A batch's array
is merged with the levels before it in one scan of neighbours in this order: neighbours
with the same segment are repeated as a whole; neighbours that have `gram` bytes in
common but unlike segments are noted.  Levels of equal size, counted in batches, become
one (1, 2, 4, … batches), each as a table in the shared folder, and the levels that went
into it are deleted.  The order is dealt out in ranges that may split one suffix; what
meets at the ends of ranges is put together last.

What unlike segments of one suffix share is found from the segments' bytes: their windows
are brought together by hash, and the bytes of neighbours are compared over the whole length.
Where very many segments have one suffix, their windows are counted
as rows, by 64-bit hash, so that no task has to hold them all.

Texts aren't shuffled for the search: some 70 bytes are, for about 70 of text, and the
bytes of segments at the edges of repeats.  Only texts that lose bytes meet their spans
in a join; others are told by a bit table of fixed size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._spark import dropped, shared_dir, small_batches, written
from cytolake.llm._text import _R, _RINV, _TABLE, Chunk, U, _power, chunks, mix, prefix_hash, signed
from cytolake.llm.jaccard import _groups

LENGTH, GRAM = 200, 40
BLOOM_BITS = 24
CHUNK = 1 << 18
PIECE = 1 << 22  # bytes of text whose equal segments are put together before they are dealt
PLACES = 64  # of one segment in a row
MANY = 2048  # segments of one suffix
LEVEL = "head binary, key long, n int, span int, d1 long, d2 int, at int, places binary, scanned boolean"
EVENT = "kind int, head binary, h long, key long, n int, span int, d1 long, d2 int, at int"
ROW, REPEAT, UNLIKE, END = range(4)  # kinds of events
PLACE = np.dtype([("d1", "<i8"), ("d2", "<i4"), ("at", "<i4")])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[step:], values[:-step])
        done += step
    return values


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` hashes in a row is; the leftmost if several are least.

    The place is kept in a hash's low bits.  Where that has picked a hash that isn't
    the least, as only those bits differ, windows are halved instead.
    """
    bits = U(max(1, len(grams) - 1).bit_length())
    at = (_least((grams >> bits << bits) | np.arange(len(grams), dtype=U), width) & ((U(1) << bits) - U(1))).astype(np.int64)
    if (grams[at] == _least(grams, width)).all():
        return at
    value, at, done = grams, np.arange(len(grams)), 1
    while done < width:
        step = min(done, width - done)
        further = value[step:] < value[:-step]
        value, at = np.where(further, value[step:], value[:-step]), np.where(further, at[step:], at[:-step])
        done += step
    return at


def segments(chunk: Chunk, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Place and hash of the anchor, hash of the segment, row, first and last window start of every segment of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(U), none.view(U), none, none, none
    with np.errstate(over="ignore"):
        h = prefix_hash(data, _TABLE)
        inverse = _power(_RINV, n + 1)
        grams = mix((h[gram:] - h[:-gram]) * inverse[: n - gram + 1])
    anchor = _anchors(grams, width)
    starts = len(anchor)
    change = np.ones(starts, bool)
    change[1:] = anchor[1:] != anchor[:-1]
    change[offsets[offsets < starts]] = True
    past = offsets - length + 1  # the first start whose window crosses into the next text
    change[past[(past > 0) & (past < starts)]] = True
    a = np.flatnonzero(change)
    b = np.append(a[1:], starts) - 1
    row = np.searchsorted(offsets, a, "right") - 1
    inside = b + length <= offsets[row + 1]
    a, b, row = a[inside], b[inside], row[inside]
    p = anchor[a]
    with np.errstate(over="ignore"):
        key = mix((h[b + length] - h[a]) * inverse[a] + ((b - a).astype(U) << U(32)) + (p - a).astype(U))
    return p, grams[p], key, row, a - offsets[row], b - offsets[row]


def _gram_hash(heads: np.ndarray) -> np.ndarray:
    """The anchor's hash, as `segments` has it, from rows of bytes."""
    with np.errstate(over="ignore"):
        return mix((_TABLE[heads] * _power(_R, heads.shape[1])).sum(axis=1, dtype=U))


def _entries(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchored suffixes of some documents; those of one segment in a piece of text as rows with up to PLACES places."""

    def emitted(parts: list[tuple]) -> pa.RecordBatch:
        h, key, head, place, span = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(key)))
        inside = np.arange(len(key)) - np.repeat(first, times)
        at = np.flatnonzero(inside % PLACES == 0)
        end = np.append(at[1:], len(key))
        place = place[order]
        one, n = place[at], np.minimum(np.repeat(times, times)[at], 2)
        more = [place[s:e].tobytes() if m > 1 else None for s, e, m in zip(at, end, n, strict=True)]
        heads = pa.Array.from_buffers(pa.binary(gram), len(at), [None, pa.py_buffer(np.ascontiguousarray(head[order[at]]))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [heads, pa.array(key[at]), pa.array(n.astype(np.int32)), pa.array(span[order[at]].astype(np.int32)), *(pa.array(one[x]) for x in ("d1", "d2", "at")), pa.array(more, pa.binary()), pa.array(np.zeros(len(at), bool))],
            names=["head", "key", "n", "span", "d1", "d2", "at", "places", "scanned"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in chunks(batch.column(2), CHUNK):
                p, h, key, row, a, b = segments(c, length, gram)
                size += len(c.data)
                if len(p):
                    place = np.empty(len(p), PLACE)
                    place["d1"], place["d2"], place["at"] = d1[c.row + row], d2[c.row + row], a
                    parts.append((h, signed(key), c.data[p[:, None] + np.arange(gram)], place, b - a))
                if size >= PIECE and parts:
                    yield emitted(parts)
                    parts, size = [], 0
        if parts:
            yield emitted(parts)

    return rows.mapInArrow(run, LEVEL)


def _merge_scan(arrays: DataFrame, length: int, gram: int) -> DataFrame:
    """One scan over arrays in text order, a range of it in each task.

    ROW: a row of the new level; REPEAT: a place repeated as a whole (span: where it
    stops); UNLIKE: a suffix of unlike segments; END: the first and the last segment
    of a range.  Rows that are only scanned don't go into the new level.  n = 2 of a
    row that comes with one place means that the place has been told.  Between two
    batches of rows only the last segment is kept, as a row.
    """

    def event(kind: int, x: dict[str, np.ndarray], own: np.ndarray, heads: bool) -> pa.RecordBatch:
        size = len(own)
        head = pa.Array.from_buffers(pa.binary(gram), size, [None, pa.py_buffer(np.ascontiguousarray(x["head"][own]))]).cast(pa.binary()) if heads else pa.nulls(size, pa.binary())
        h = pa.nulls(size, pa.int64()) if kind in (ROW, REPEAT) else pa.array(signed(_gram_hash(x["head"][own])))
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), head, h, *(pa.array(x[c][own]) for c in ("key", "n", "span", "d1", "d2", "at"))], names=["kind", "head", "h", "key", "n", "span", "d1", "d2", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "n", "span", "d1", "d2", "at", "scanned")
        held: dict[str, np.ndarray] | None = None  # the last segment so far, as one row
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(0).cast(pa.binary())
            start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            x = {"head": np.frombuffer(column.buffers()[2], np.uint8)[start : start + gram * len(column)].reshape(-1, gram)}
            x |= {c: b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in names}
            places = [None] * b.num_rows if (more := b.column(b.schema.names.index("places"))).null_count == b.num_rows else more.to_pylist()
            if held is not None:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
                places = [None, *places]
            apart = np.ones(len(x["key"]), bool)  # another suffix than before
            apart[1:] = (x["head"][1:] != x["head"][:-1]).any(axis=1)
            new = apart.copy()
            new[1:] |= x["key"][1:] != x["key"][:-1]
            lead, group = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.minimum(np.bincount(group, x["n"]), 2).astype(np.int32)
            many = np.array([p is not None for p in places])
            tell = (total[group] == 2) & ((x["n"] == 1) | many)
            if tell.any():
                one = np.flatnonzero(tell & ~many)
                parts = [np.stack([x["d1"][one], x["d2"][one], x["at"][one], x["at"][one] + x["span"][one] + length], 1)]
                for i in np.flatnonzero(tell & many):
                    p = np.frombuffer(places[i], PLACE)
                    parts.append(np.stack([p["d1"], p["d2"], p["at"], p["at"] + x["span"][i] + length], 1))
                told = np.concatenate(parts)
                zero = np.zeros(len(told), np.int64)
                yield event(REPEAT, {"key": zero, "n": zero.astype(np.int32), "span": told[:, 3].astype(np.int32), "d1": told[:, 0], "d2": told[:, 1].astype(np.int32), "at": told[:, 2].astype(np.int32)}, np.arange(len(told)), False)
            unlike = np.unique(np.flatnonzero(new & ~apart))
            if len(unlike):
                yield event(UNLIKE, x, unlike[np.unique(_gram_hash(x["head"][unlike]), return_index=True)[1]], False)
            # a row stands for its segment: the first that isn't only scanned
            stands = lead.copy()
            kept = np.flatnonzero(~x["scanned"])
            owner, at = np.unique(group[kept], return_index=True)
            stands[owner] = kept[at]
            x["n"] = total[group]
            x["scanned"] = np.isin(group, owner, invert=True)
            if first and len(lead) > 1:  # the range's first segment is over
                first = False
                yield event(END, x, stands[:1], True)
            out = stands[:-1][~x["scanned"][stands[:-1]]]
            if len(out):
                yield event(ROW, x, out, True)
            held = {c: v[stands[-1:]].copy() for c, v in x.items()}
        if held is not None:
            if not held["scanned"][0]:
                yield event(ROW, held, np.zeros(1, np.int64), True)
            yield event(END, held, np.zeros(1, np.int64), True)

    ranges = arrays.withColumn("_r", F.xxhash64("d1", "at")).repartitionByRange("head", "key", "_r").drop("_r")
    return ranges.sortWithinPartitions("head", "key").mapInArrow(run, EVENT)


class Family:
    """The levels: tables of suffixes, each of a power of two of batches."""

    def __init__(self, spark, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.length, self.gram = spark, length, gram
        self.root = f"{shared_dir(spark)}/suffix-{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []  # batches, path
        self.events: list[str] = []

    def _read(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(f"{path}/kind={kind}").drop("kind")

    def add(self, rows: DataFrame) -> None:
        """Scan a batch (d1, d2, t) against all levels, and merge levels of equal size into its own."""
        size, merge = 1, []
        while self.levels and self.levels[-1][0] == size:
            level = self.levels.pop()
            merge.append(level)
            size += level[0]
        own = arrays = written(_entries(rows, self.length, self.gram), "suffixes")
        for scanned, levels in ((False, merge), (True, self.levels)):
            for _, path in levels:
                more = self._read(path, ROW).select("head", "key", "n", "span", "d1", "d2", "at", F.lit(None).cast("binary").alias("places"), F.lit(scanned).alias("scanned"))
                arrays = arrays.unionByName(more)
        path = f"{self.root}/{len(self.events)}"
        _merge_scan(arrays, self.length, self.gram).write.partitionBy("kind").parquet(path)
        dropped(own)
        for _, old in merge:
            self._delete(f"{old}/kind={ROW}")
        self.events.append(path)
        if self._has(path, ROW):
            self.levels.append((size, path))

    def _has(self, path: str, kind: int) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete the levels that are left."""
        for _, path in self.levels:
            self._delete(f"{path}/kind={ROW}")
        self.levels = []

    def _union(self, found: list[DataFrame]) -> DataFrame | None:
        out = None
        for x in found:
            out = x if out is None else out.unionByName(x)
        return out

    def repeated(self) -> DataFrame | None:
        """(d1, d2, start, stop) of the segments repeated as a whole."""
        place = lambda stop: [F.col("d1"), F.col("d2"), F.col("at").alias("start"), stop.cast("int").alias("stop")]
        found = [self._read(p, REPEAT).select(*place(F.col("span"))) for p in self.events if self._has(p, REPEAT)]
        for p in self.events:
            if self._has(p, END):  # two rows a range
                ends = self._read(p, END).distinct()
                split = ends.groupBy("h", "key").agg(F.sum("n").alias("_n")).filter("_n > 1").select("h", "key")
                found.append(ends.filter("n = 1").join(split, ["h", "key"]).select(*place(F.col("at") + F.col("span") + self.length)))
        return self._union(found)

    def unlike(self) -> DataFrame | None:
        """(h) of the suffixes of unlike segments."""
        found = [self._read(p, UNLIKE).select("h") for p in self.events if self._has(p, UNLIKE)]
        found += [self._read(p, END).groupBy("h").agg(F.min("key").alias("_l"), F.max("key").alias("_m")).filter("_l < _m").select("h") for p in self.events if self._has(p, END)]
        return self._union(found)


def bit_table(values: DataFrame | None, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """Two bits set for every value; of fixed size whatever the number of values."""
    out = np.zeros(1 << (bits - 6), U)
    if values is None:
        return out
    mask = F.lit((1 << bits) - 1)
    each = values.select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, bits).bitwiseAND(mask))).alias("bit"))
    got = each.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).toArrow()
    out[got["w"].to_numpy()] = got["v"].to_numpy().view(U)
    return out


def in_table(values: np.ndarray, table: np.ndarray, bits: int = BLOOM_BITS) -> np.ndarray:
    values = values.view(U)
    has = lambda bit: (table[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) > 0
    mask = U((1 << bits) - 1)
    return has(values & mask) & has((values >> U(bits)) & mask)


def repeated(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the `length`-byte strings at these places occur twice or more among them, by hash and then by their bytes."""
    with np.errstate(over="ignore"):
        p = prefix_hash(data, _TABLE)
        w = mix((p[starts + length] - p[starts]) * _power(_RINV, len(data) + 1)[starts])
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    for s in range(0, len(same), 1 << 14):  # neighbours in the order of hashes: as many bytes have to be in common
        own = s + np.flatnonzero(same[s : s + (1 << 14)])
        a, b = starts[order[own]], starts[order[own + 1]]
        same[own] = (data[a[:, None] + np.arange(length)] == data[b[:, None] + np.arange(length)]).all(axis=1)
    out = np.zeros(len(starts), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _edges(rows: DataFrame, table, length: int, gram: int) -> DataFrame:
    """(d1, d2, start, stop) of what unlike segments of one suffix share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            d1, d2 = batch.column(0), batch.column(1)
            for c in chunks(batch.column(2), CHUNK):
                _, h, key, row, a, b = segments(c, length, gram)
                hit = np.flatnonzero(in_table(h, table.value))
                hit = np.array([i for i in hit if not (int(key[i]) in seen or seen.add(int(key[i])))], np.int64)
                if not len(hit):
                    continue
                begin = c.offsets[row[hit]] + a[hit]
                stop = c.offsets[row[hit]] + b[hit] + length
                own = pa.array(c.row + row[hit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)[hit]), pa.array(signed(key)[hit]), d1.take(own), d2.take(own), pa.array(a[hit].astype(np.int32)), pa.array([c.data[s:e].tobytes() for s, e in zip(begin, stop, strict=True)], pa.binary())], names=["h", "key", "d1", "d2", "at", "bytes"]
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_, _ in _groups(batches, ["h"]):
            h, key, at = (table_[x].to_numpy() for x in ("h", "key", "at"))
            new = np.ones(len(h), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            u, suffix = np.unique(h, return_inverse=True)
            own = np.flatnonzero(new & (np.bincount(suffix[new], minlength=len(u)) > 1)[suffix])
            if not len(own):
                continue
            texts = [x.as_py() for x in table_["bytes"].take(pa.array(own))]
            size = np.array([len(t) for t in texts])
            begin = np.cumsum(size) - size
            index = np.repeat(np.arange(len(own)), size - length + 1)
            offset = np.arange(len(index)) - np.repeat(np.cumsum(size - length + 1) - (size - length + 1), size - length + 1)
            hit = repeated(np.frombuffer(b"".join(texts), np.uint8), begin[index] + offset, length)
            index, offset = index[hit], offset[hit]
            if not len(index):
                continue
            lead = np.ones(len(index), bool)
            lead[1:] = (index[1:] != index[:-1]) | (offset[1:] != offset[:-1] + 1)
            tail = np.append(lead[1:], True)
            i = own[index[lead]]
            which = pa.array(i)
            yield pa.RecordBatch.from_arrays([table_["d1"].take(which).combine_chunks(), table_["d2"].take(which).combine_chunks(), pa.array((at[i] + offset[lead]).astype(np.int32)), pa.array((at[i] + offset[tail] + length).astype(np.int32))], names=["d1", "d2", "start", "stop"])

    def every_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(b.schema.names.index("bytes"))):
                data = np.frombuffer(x.as_py(), np.uint8)
                with np.errstate(over="ignore"):
                    p = prefix_hash(data, _TABLE)
                    w = mix((p[length:] - p[:-length]) * _power(_RINV, len(data) + 1)[: len(data) - length + 1])
                n = len(w)
                one = lambda c, i=i, n=n, b=b: np.full(n, b.column(b.schema.names.index(c))[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(one("d1")), pa.array(one("d2").astype(np.int32)), pa.array((one("at") + np.arange(n)).astype(np.int32))], names=["w", "d1", "d2", "start"])

    spans = "d1 long, d2 int, start int, stop int"
    found = written(rows.mapInArrow(cut, "h long, key long, d1 long, d2 int, at int, bytes binary"), "unlike")
    many = written(found.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("h"), "frequent-suffixes")
    few = found.join(many, "h", "left_anti").select("h", "key", "d1", "d2", "at", "bytes").repartition("h").sortWithinPartitions("h", "key").mapInArrow(shared, spans)
    # a segment that occurs twice is told already; its windows come once
    each = found.join(many, "h", "left_semi").dropDuplicates(["h", "key"]).mapInArrow(every_window, "w long, d1 long, d2 int, start int")
    twice = each.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    frequent = each.join(twice, "w").select("d1", "d2", "start", (F.col("start") + length).cast("int").alias("stop"))
    return few.unionByName(frequent)


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = 4) -> DataFrame:
    """doc_id, kept (bytes), spans and n_bytes of every row; spans are the removed runs, in bytes, ascending.

    A null text is empty.  Texts shorter than `length` bytes lose nothing.
    Rows that repeat lose every window, as each is elsewhere too.  Other columns
    are left out; ids may be null or repeat.
    """
    spark = documents.sparkSession
    small_batches(spark)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), t).alias("d1"), F.hash(t, F.col(doc_id)).alias("d2"), t.alias("t"))
    rows = named.select("d1", "d2", "t")
    family = Family(spark, length, gram)
    for b in range(batches):
        family.add(rows.filter(F.pmod(F.xxhash64("t", "d1"), F.lit(batches)) == b))
    family.close()
    found = family.repeated()
    unlike = spark.sparkContext.broadcast(bit_table(family.unlike(), "h"))
    edges = _edges(rows, unlike, length, gram)
    spans = edges if found is None else edges.unionByName(found)
    spans = written(spans.groupBy("d1", "d2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")
    losing = spark.sparkContext.broadcast(bit_table(spans, "d1"))
    kind = dict(named.dtypes)["doc_id"]
    out = f"doc_id {kind}, kept binary, spans array<array<int>>, n_bytes long"

    names = ["doc_id", "kept", "spans", "n_bytes"]

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            kept, removed, size = [], [], []
            for t, s in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = t.as_py().encode()
                gone = _merged([(x["start"], x["stop"]) for x in s or ()])
                ends = [0, *(x for g in gone for x in g), len(raw)]
                kept.append(b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
                removed.append(gone)
                size.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.list_(pa.int32()))), pa.array(size, pa.int64())], names=names)

    def untouched(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            b = b.filter(pa.array(~in_table(b.column(1).to_numpy(), losing.value)))
            raw = b.column(3).cast(pa.binary())
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(b.num_rows + 1, np.int32)), pa.array([], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0), raw, empty, pa.compute.binary_length(raw).cast(pa.int64())], names=names)

    def touched(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            yield b.filter(pa.array(in_table(b.column(1).to_numpy(), losing.value)))

    parts = named.mapInArrow(touched, named.schema).join(spans, ["d1", "d2"], "left").select("doc_id", "t", "spans")
    return named.mapInArrow(untouched, out).unionByName(parts.mapInArrow(cut, out))


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the rows of `remove_repeats`."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return removed.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
