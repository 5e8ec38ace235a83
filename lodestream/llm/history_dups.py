"""Checking new batches for exact and near duplicates against all that was accepted before.

Two keys are nearly equal when their endings (after the last dot) are equal and their stems differ by at
most two insertions, deletions or replacements. ``ChunkStore`` keeps a persistent table of the chunks of all
accepted keys. A batch makes the chunks of its own keys only, looks them up in its parts of the table, decides by
coverage and appends its chunks; the stored side is neither recomputed nor shuffled.

Content-defined cut points can't promise to find near keys: a host has a dozen or two characters, and two edits
can fall into every chunk that a rolling hash cuts (see the README for the share that is lost). The chunks are
therefore *gapped*: the stem with none, one or two characters left out, hashed with the ending by a rolling
polynomial hash from whose prefix values each of the L^2/2 gapped hashes follows in a few operations.

Coverage: a chunk comes with its gaps, the places in it where characters were left out. Two stems that share a
chunk have it in common; what it doesn't cover are the i and j characters left out of either, and where c of their
gaps are at the same place, a character stands against a character. So they differ by at most i + j - c edits, and the
least such sum over all shared chunks is their distance if that is at most two (leave out each edited character on
either side). i + j - c <= 2 is the decision, without looking at any pair of records: a chunk needs to be kept
only once for each set of gaps, with the earliest batch that has it. A chunk that is shared by a third of all keys
so has no more entries than a rare one (1 + L + L^2/2 at most, L its length), and no pairs are made at all.
Hashes have 64 bits; unequal chunks are taken for equal with a chance of 2^-64 for each pair of entries.

Stems of more than ``LONGEST`` characters (a host name has at most 253) would have too many chunks. They share
one of their thirds, shifted by two places at most, with any near stem; such pairs are verified exactly.

Exact copies are collapsed first, so a key that fills a third of all rows is one record here.

Defined results: rows without a key are never duplicates; rows of a null batch are compared with the
accepted keys of the batches before 1 only and never count as history; rows of one batch aren't compared with each
other; repeated rows are all reported; empty batches and an empty history give no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import materialize, remove, shared_dir, shuffle_partitions

EDITS = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stems of more characters (no host name has more than 253) are cut into thirds instead of being gapped.
LONGEST = 255
_NO_ERA = 2**31 - 1
#: Chunks that one task sorts, so that its memory is bounded.
_PER_TASK = 3_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gapped_hashes(codes: np.ndarray) -> np.ndarray:
    """For strings of one length (rows of code points): the hashes of each with 0, 1 and 2 characters left out."""
    n, length = codes.shape
    with np.errstate(over="ignore"):
        letters = _mix(codes.astype(np.uint64) + _BASE)
        power = np.ones(length + 1, np.uint64)
        prefix = np.zeros((n, length + 1), np.uint64)
        for k in range(length):
            power[k + 1] = power[k] * _BASE
            prefix[:, k + 1] = prefix[:, k] * _BASE + letters[:, k]
        piece = lambda a, b: prefix[:, b] - prefix[:, a] * power[b - a]
        out = [prefix[:, -1:]]
        if length:
            i = np.arange(length)
            out.append(prefix[:, i] * power[length - 1 - i] + piece(i + 1, np.full_like(i, length)))
        if length > 1:
            i, j = np.triu_indices(length, 1)
            out.append((prefix[:, i] * power[j - i - 1] + piece(i + 1, j)) * power[length - 1 - j] + piece(j + 1, np.full_like(j, length)))
        return np.concatenate(out, axis=1)


def gaps(length: int) -> np.ndarray:
    """For the columns of ``gapped_hashes``: how many characters are left out, and how many of the chunk stand before either."""
    i = np.arange(length)
    p, q = np.triu_indices(length, 1)
    none = np.zeros(1, int)
    return np.stack([np.r_[none, np.ones_like(i), np.full_like(p, 2)], np.r_[none, i, p], np.r_[none, np.zeros_like(i), q - 1]], axis=1).astype(np.uint8)


def piece_hashes(codes: np.ndarray) -> np.ndarray:
    """For strings of one length beyond ``LONGEST``: the hashes of their thirds, and of what may be a third of a near string.

    Two edits leave one third of a string whole, shifted by two places at most; so a fixed number of chunks will do.
    """
    n, length = codes.shape
    with np.errstate(over="ignore"):
        letters, power, prefix = _mix(codes.astype(np.uint64) + _BASE), np.ones(length + 1, np.uint64), np.zeros((n, length + 1), np.uint64)
        for k in range(length):
            power[k + 1] = power[k] * _BASE
            prefix[:, k + 1] = prefix[:, k] * _BASE + letters[:, k]
        out = []
        for other in range(length - EDITS, length + EDITS + 1):
            for i in range(EDITS + 1):
                begin, end = other * i // (EDITS + 1), other * (i + 1) // (EDITS + 1)
                for shift in range(-EDITS, EDITS + 1):
                    a, b = begin + shift, end + shift
                    if a >= 0 and b <= length:
                        out.append(_mix(prefix[:, b] - prefix[:, a] * power[b - a] + np.uint64(other * 8 + i)))
        return np.stack(out, axis=1)


def _variants(length: int) -> int:
    return 1 + length + length * (length - 1) // 2


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, gaps, place of their record in the batch) in blocks of bounded size."""
    tail = batch.column("tail").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    stems = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in batch.column("stem").to_pylist()]
    sizes = np.array([len(s) for s in stems])
    for length in np.unique(sizes[sizes <= LONGEST]):
        of, form = np.flatnonzero(sizes == length), gaps(int(length))
        step = max(1, 400_000 // _variants(int(length)))
        for k in range(0, len(of), step):
            some = of[k : k + step]
            with np.errstate(over="ignore"):
                chunk = _mix(gapped_hashes(np.stack([stems[i] for i in some])) + tail[some][:, None])
            yield chunk.ravel(), np.tile(form, (len(some), 1)), np.repeat(some, len(form))


def _packed(batches: Iterator[pa.RecordBatch], labels: list[int]) -> Iterator[pa.RecordBatch]:
    """(part, block): the entries of many records, divided by chunk into parts; one block instead of thousands of rows."""
    for batch in batches:
        hid, era = batch.column("hid").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("era").to_numpy(zero_copy_only=False).astype(np.int32)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for one in _entries(batch):
            held.append(one)
            if sum(len(c) for c, _, _ in held) > 1_500_000:
                yield from _blocks(held, hid, era, labels)
                held = []
        if held:
            yield from _blocks(held, hid, era, labels)


def _blocks(held: list, hid: np.ndarray, era: np.ndarray, labels: list[int]) -> Iterator[pa.RecordBatch]:
    chunk, form, place = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(chunk)
    chunk, form, place = chunk[order], form[order], place[order]
    # Ranges of the hash are the parts, so what is sorted is divided already.
    ends = np.r_[0, np.searchsorted(chunk, np.array([(i << 64) // len(labels) for i in range(1, len(labels))], np.uint64)), len(chunk)]
    for i in np.flatnonzero(ends[1:] > ends[:-1]):
        at = slice(ends[i], ends[i + 1])
        present = np.zeros(len(hid), bool)
        present[place[at]] = True
        rows, index = np.flatnonzero(present), (np.cumsum(present) - 1)[place[at]]
        yield pa.record_batch([pa.array([labels[i]], pa.int32()), pa.array([_pack(chunk[at], form[at], era[rows], index, hid[rows])], pa.binary())], names=["part", "block"])


def _planes(a: np.ndarray) -> bytes:
    """Numbers by planes of bytes, which compress better than whole numbers."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel(), at + size * n


def _pack(chunk: np.ndarray, form: np.ndarray, era: np.ndarray, index: np.ndarray | None = None, hid: np.ndarray | None = None) -> bytes:
    """Entries sorted by chunk as one compressed block: steps between chunks, gaps, eras. With ``index``, eras and ids are of the records it points to."""
    kind = np.uint16 if len(era) < 1 << 16 else np.uint32
    parts = [np.array([len(chunk), len(era), 0 if index is None else kind().itemsize], np.int64).tobytes(), _planes(np.diff(chunk, prepend=np.uint64(0))), form.T.tobytes(), _planes(era.astype(np.int32))]
    if index is not None:
        parts += [_planes(index.astype(kind)), hid.astype(np.int64).tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(chunk, form, era, hid) of each entry of a block; stored blocks have no ids."""
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    n, rows, size = map(int, np.frombuffer(raw, np.int64, 3))
    step, at = _from_planes(raw, np.uint64, n, 24)
    with np.errstate(over="ignore"):
        chunk = np.cumsum(step, dtype=np.uint64)
    form = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 3 * n, at).reshape(3, n).T)
    era, at = _from_planes(raw, np.int32, rows, at + 3 * n)
    if not size:
        return chunk, form, era, None
    index, at = _from_planes(raw, np.uint16 if size == 2 else np.uint32, n, at)
    return chunk, form, era[index], np.frombuffer(raw, np.int64, rows, at)[index]


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The characters that a shared chunk leaves uncovered on either side, those at the same place counted once."""
    i, j = a[:, 0].astype(int), b[:, 0].astype(int)
    a1, a2, b1, b2 = a[:, 1], a[:, 2], b[:, 1], b[:, 2]
    first = (i > 0) & (((j > 0) & (a1 == b1)) | ((j > 1) & (a1 == b2)))
    second = (i > 1) & (((j > 0) & (a2 == b1)) | ((j > 1) & (a2 == b2)))
    twice = np.minimum(2, ((j > 0) & (b1 == a1)).astype(int) + ((j > 1) & (b2 == a1)))  # both gaps of a at one place
    common = np.where((i > 1) & (a1 == a2), twice, first.astype(int) + second)
    return i + j - common


def _met(chunk: np.ndarray, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of equal chunks in two sorted arrays, one stored entry of each chunk at a time.

    A chunk has a bounded number of stored entries, so the loop is short however many records share it.
    """
    at = np.searchsorted(stored, chunk)
    open_ = np.flatnonzero(at < len(stored))
    at = at[open_]
    while len(open_):
        equal = stored[at] == chunk[open_]
        open_, at = open_[equal], at[equal]
        yield open_, at
        more = at + 1 < len(stored)
        open_, at = open_[more], at[more] + 1


def _decided(label: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
    """(part, block, hits): one part of a batch looked up in the stored part and in the batch itself, and what is to be appended."""
    blocks = [_unpack(b) for b in new.column("block").to_pylist()]
    known = [_unpack(b) for b in old.column("block").to_pylist()]
    if not blocks:
        return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.binary()), "hits": pa.array([], _HITS)})
    chunk, form, era, hid = (np.concatenate(c) for c in zip(*blocks, strict=True))
    del blocks
    order = np.argsort(chunk, kind="stable")  # merges the blocks, which are sorted
    chunk = chunk[order]
    same = chunk[1:] == chunk[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    form, era, hid = form[order], era[order], hid[order]
    code = _codes(form)
    at = np.flatnonzero(shared)  # only these need an order within their chunk
    within = at[np.lexsort((era[at], code[at], chunk[at]))]
    form[at], era[at], hid[at], code[at] = form[within], era[within], hid[within], code[within]
    first = np.r_[True, ~same | (code[1:] != code[:-1])] & (era < _NO_ERA)  # the earliest era of each chunk and gaps
    several = first & shared
    found: dict[int, int] = {}
    fresh = np.ones(len(chunk), bool)  # what is stored already isn't appended again
    pool = (np.flatnonzero(shared), chunk[several], form[several], era[several], None)
    for mine, chunks, forms, eras, codes in (pool, *((slice(None), *k[:3], _codes(k[1])) for k in known)):
        hids, own_form, own_era, own_code = hid[mine], form[mine], era[mine], code[mine]
        for place, at in _met(chunk[mine], chunks):
            if codes is not None:
                fresh[place[codes[at] == own_code[place]]] = False
            earlier = eras[at] < own_era[place]
            place, at = place[earlier], at[earlier]
            near = _edits(own_form[place], forms[at]) <= EDITS
            who, index = np.unique(hids[place[near]], return_inverse=True)
            low = np.full(len(who), _NO_ERA, np.int64)
            np.minimum.at(low, index, eras[at[near]])
            for h, e in zip(who.tolist(), low.tolist(), strict=True):
                found[h] = min(e, found.get(h, e))
    kept = first & fresh
    hits = pa.array([[{"hid": h, "era": e} for h, e in found.items()]], _HITS)
    return pa.table({"part": pa.array([label[0].as_py()], pa.int32()), "block": pa.array([_pack(chunk[kept], form[kept], era[kept])], pa.binary()), "hits": hits})


def _codes(form: np.ndarray) -> np.ndarray:
    """The gaps of each entry as one number."""
    return form[:, 0].astype(np.uint32) << np.uint32(16) | form[:, 1].astype(np.uint32) << np.uint32(8) | form[:, 2]


_HITS_SQL = "hits array<struct<hid: bigint, era: int>>"
_HITS = pa.list_(pa.struct([("hid", pa.int64()), ("era", pa.int32())]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, hid) of stems that are too long for gapped chunks."""
    for batch in batches:
        tail, hid = batch.column("tail").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), batch.column("hid").to_pylist()
        for i, s in enumerate(batch.column("stem").to_pylist()):
            with np.errstate(over="ignore"):
                found = np.unique(_mix(piece_hashes(np.frombuffer(s.encode("utf-32-le"), np.uint32)[None, :]) + tail[i]).view(np.int64))
            yield pa.record_batch([pa.array(found), pa.array([hid[i]] * len(found), pa.int64())], names=["piece", "hid"])


_PARTED = ("substring(host, 1, length(host) - length(substring_index(host, '.', -1)) - 1) as stem", "xxhash64(substring_index(host, '.', -1)) as tail")


def records(df: DataFrame, key: Column, era: Column) -> DataFrame:
    """(hid, host, era, stem, tail): one record for each key with the earliest era that has it; written once."""
    hosts = df.select(key.alias("host"), era.cast("int").alias("era")).where("host is not null").groupBy("host").agg(F.min("era").alias("era"))
    split = hosts.selectExpr("host", "era", *_PARTED)
    return materialize(split.withColumn("hid", F.monotonically_increasing_id()), "hosts")


def parts_for(spark: SparkSession, host: DataFrame) -> int:
    """The parts of a store for a single column of keys, so that a task sorts at most ``_PER_TASK`` entries of them."""
    n = F.length(F.col(host.columns[0])).cast("long")
    total = host.select(F.sum(F.when(n <= LONGEST, 1 + n + n * (n - 1) / 2))).first()[0] or 0
    return max(shuffle_partitions(spark), int(-(-total // _PER_TASK)))


class ChunkStore:
    """The persistent chunk table of accepted keys: (batch, part, block, hits, host), bucketed by part.

    ``part`` is a range of the chunks' hash. A batch's chunks are shuffled once, to the parts, and meet the stored
    ones there bucket by bucket. One write appends a batch's blocks together with its verdicts, and it is committed
    as a whole, so a failure leaves the table as it was and the batch can be admitted again. ``parts`` is fixed
    when the table is made: choose it by ``parts_for`` of the history that is expected.

    Batches are numbered; ``admit`` takes one or several, each compared with what is stored and with those before
    it in the call. A batch with a number that is stored already is decided again, but not appended.
    """

    def __init__(self, spark: SparkSession, name: str, parts: int = 64, path: str | None = None) -> None:
        self.spark, self.name, self.parts = spark, name, parts
        self.path = path or f"{shared_dir(spark)}/lodestream/store-{name}"
        # Labels of the parts are such that each falls into a bucket of its own.
        bucket: dict[int, int] = {}
        at = 0
        while len(bucket) < parts:
            for r in spark.range(at, at + 16 * parts).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("b")).collect():
                bucket.setdefault(r.b, r.i)
            at += 16 * parts
        self.labels = sorted(bucket.values())

    def stored(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else None

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        remove(self.spark, self.path)

    def _near_long(self, hosts: DataFrame, stored: DataFrame | None) -> DataFrame:
        """(hid, era): the earliest era of a near stem for those of more than ``LONGEST`` characters, whose pairs are verified."""
        new = hosts.where(F.length("stem") > LONGEST - EDITS).select("hid", "era", "stem", "tail")
        old = new.where("era is not null")
        if stored is not None:
            texts = stored.where("host is not null").selectExpr("batch as era", *_PARTED)
            old = old.unionByName(materialize(texts.withColumn("hid", -F.monotonically_increasing_id() - 1), "long"))
        cut = lambda df: df.select("hid", "stem", "tail").mapInArrow(_pieces, "piece bigint, hid bigint")
        pairs = cut(new).join(cut(old).withColumnRenamed("hid", "other"), "piece").select("hid", "other").where("hid <> other").distinct()
        pairs = pairs.join(new.withColumnRenamed("era", "own"), "hid").join(old.select(F.col("hid").alias("other"), F.col("stem").alias("stem_b"), F.col("tail").alias("tail_b"), F.col("era").alias("era_b")), "other")
        near = pairs.where((F.col("tail") == F.col("tail_b")) & (F.levenshtein("stem", "stem_b", EDITS) >= 0) & (F.col("era_b") < F.coalesce("own", F.lit(_NO_ERA))))
        return near.groupBy("hid").agg(F.min("era_b").alias("era"))

    def admit(self, df: DataFrame, key: Column, batch: Column, row_id: str) -> DataFrame:
        """The ids of rows whose key equals or nearly equals one of an earlier batch; then the batches are accepted.

        A null batch is compared with the batches before 1 and isn't accepted.
        """
        rows = df.select(F.col(row_id).alias("row_id"), key.alias("host"), batch.cast("int").alias("era"))
        hosts, stored, labels = records(rows, F.col("host"), F.col("era")), self.stored(), self.labels
        asked = hosts.select("hid", F.coalesce("era", F.lit(_NO_ERA)).alias("era"), "stem", "tail").where(F.length("stem") <= LONGEST)
        packed = asked.mapInArrow(lambda batches: _packed(batches, labels), "part int, block binary")
        old = self.spark.createDataFrame([], "part int, block binary") if stored is None else stored.where("block is not null").select("part", "block")
        found = packed.groupBy("part").cogroup(old.groupBy("part")).applyInArrow(_decided, f"part int, block binary, {_HITS_SQL}")
        found = found.withColumn("host", F.lit(None).cast("string"))
        long = hosts.where(F.length("stem") > LONGEST - EDITS)
        near_long = None
        if not long.isEmpty():
            near_long = materialize(self._near_long(hosts, stored), "near")
            texts = long.where("era is not null").select("era", F.lit(labels[0]).alias("part"), F.lit(None).cast("binary").alias("block"), F.expr(f"cast(null as {_HITS_SQL.split(' ', 1)[1]}) as hits"), "host")
            found = found.withColumn("era", F.lit(None).cast("int")).unionByName(texts)
        else:
            found = found.withColumn("era", F.lit(None).cast("int"))
        newest = hosts.agg(F.max("era")).first()[0]
        if newest is not None and (stored is None or stored.where(F.col("batch") == newest).isEmpty()):
            # A part without an entry of the batch gives no row, so no bucket is written for nothing.
            whole = found.select(F.coalesce("era", F.lit(newest)).alias("batch"), "part", "block", "hits", "host")
            whole.write.mode("append").format("parquet").bucketBy(self.parts, "part").sortBy("part").option("path", self.path).saveAsTable(self.name)
            found = self.spark.table(self.name).where(F.col("batch") == newest)
        near = found.where("hits is not null").select(F.explode("hits").alias("h")).select("h.hid", "h.era")
        near = (near if near_long is None else near.unionByName(near_long)).groupBy("hid").agg(F.min("era").alias("near_era"))
        seen = hosts.join(materialize(near, "near"), "hid", "left").select("host", F.least("era", "near_era").alias("first_era"))
        own = F.coalesce("era", F.lit(1))
        return rows.where("host is not null").join(seen, "host").where(F.col("first_era") < own).select("row_id")


def repeats(df: DataFrame, key: Column, era: Column, row_id: str) -> DataFrame:
    """The ids of rows whose key equals or nearly equals one of an earlier era, by a store of their own.

    Era 0 is what was accepted before the first batch; a null era is a row of no known batch.
    """
    spark = df.sparkSession
    store = ChunkStore(spark, f"repeats_{uuid.uuid4().hex}", parts_for(spark, df.select(key)))
    found = materialize(store.admit(df, key, era, row_id), "repeats")
    store.drop()
    return found
