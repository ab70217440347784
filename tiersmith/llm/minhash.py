"""Near-duplicate documents: MinHash signatures, banding, verification and connected components.

A document's set is its distinct runs of five words. Each set gets 384 minima
of universal hashes a*x+b; the lowest byte of each mixed minimum is kept, and
six neighbouring bytes are a band. A pair at similarity 0.75 agrees in none of
the 64 bands with a chance of 4e-6.

- Documents with equal sets are one class, found by grouping on a fingerprint
  of the set, so copies cost nothing further.
- In every bucket of a band, members are compared with the bucket's smallest
  member: size and signature first, then the full sets. Confirmed links are
  joined into components.
- Buckets that still hold several components are compared in a task, only
  across components: first by size and signature, which leaves the members that
  have a likely partner, then these by their full sets. A pair is compared in the
  first bucket it shares. The tasks give members and confirmed links between
  components, never pairs. A group of near copies that is one component is not
  compared again.
- Of buckets of more than ``BLOCK`` members the documents are compared by
  prefixes instead: a set's shingles are put in one order for all, the rarest
  first, and a set of n is posted under its first n - ceil(0.75 n) + 1 only.
  Of two sets that reach the similarity the smaller one has a shared shingle even
  among its first n - ceil(6 n / 7) + 1, so nothing is missed, and rows are in
  proportion to the sets however large a group is. Members of a posting list are
  compared like those of a bucket; one that is itself too large for a task's
  memory (``BLOCK`` members, ``SET_BLOCK`` full sets) block against block.

Null and empty texts have an empty set and are linked with nothing. A row
without an id takes no part either and keeps a null component. Rows that
repeat an id are judged each by its own text. Fewer than five words count as
one run. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.components import components
from tiersmith.llm.frames import row_blocks, text_bytes, written
from tiersmith.llm.words import BLANKS, windows, word_hashes

WIDTH = 5
HASHES, ROWS = 384, 6
BANDS = HASHES // ROWS
PERCENT = 75
#: Of 384 agreeing bytes, a pair at 0.75 has fewer than this with a chance below 1e-8 (six standard deviations).
LEAST_EQUAL = 236
#: Members of a bucket or posting list that a task holds, and their full sets; each SET_SIZE shingles of a large set count as one.
BLOCK, SET_BLOCK, SET_SIZE = 4096, 2048, 512
#: Counters of the sketch that tells rare shingles from frequent ones; its size doesn't depend on the documents.
COUNTERS = 1 << 18
FAN_IN = 64
#: Ids of documents to be verified are broadcast up to this number (some 50 MB); beyond, they are joined by shuffle.
BROADCAST_IDS = 2_000_000

_draw = np.random.default_rng(20240229)
_A = (_draw.integers(0, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _draw.integers(0, 1 << 32, HASHES, np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``width`` words."""
    for lo, hi in row_blocks(offsets):
        part = data[offsets[lo]:offsets[hi]]
        words, rows = word_hashes(part, offsets[lo:hi + 1] - offsets[lo], BLANKS)
        runs = windows(words, width)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= width:
                s = np.sort(runs[a:b - width + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield windows(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> bytes:
    """One byte for each of the minima."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        h = _A[:, None] * x[None, at:at + 1024]
        h += _B[:, None]
        np.minimum(low, h.min(1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, print, sig): size of the set, its fingerprint and its signature; the latter are null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, sigs = [], [], []
            for s in shingle_sets(*text_bytes(batch.column("text"))):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                                   pa.array(sigs, pa.binary())], names=["id", "n", "print", "sig"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n long, print binary, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, id): the number of the band and its six bytes, for every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(np.int64)
            bucket = np.zeros(sig.shape[:2], np.int64) + (np.arange(BANDS) << 8 * ROWS)
            for k in range(ROWS):
                bucket += sig[:, :, k] << 8 * k
            ids = np.repeat(np.asarray(batch.column("id")), BANDS)
            for at in range(0, len(ids), 1 << 18):
                yield pa.record_batch([pa.array(bucket.ravel()[at:at + (1 << 18)]), pa.array(ids[at:at + (1 << 18)])],
                                      names=["bucket", "id"])

    return classes.select("id", "sig").mapInArrow(run, "bucket long, id long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), HASHES)


def _alike(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs may reach the similarity, by size and signature."""
    near = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    near &= (sig_a == sig_b).sum(-1) >= LEAST_EQUAL
    return near


def _likely(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _alike(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")),
                          np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))) if len(batch) else []
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: members.select(*[F.col(f).alias(t) for f, t in (("id", x), ("n", f"n_{x}"), ("sig", f"sig_{x}"))])
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(
        run, "a long, b long")


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The groups (bucket, x, y) of sorted rows with more than one row, also when they span batches."""
    rest: dict[str, np.ndarray] | None = None
    for last, batch in _with_last(batches):
        g: dict[str, np.ndarray] = {}
        if batch is not None:
            g = {k: np.asarray(batch.column(k)) for k in ("bucket", "x", "y", "block", "id", "part", "n", "short")}
            g["sig"] = _matrix(batch.column("sig"))
            if "items" in batch.schema.names:
                items = batch.column("items").to_pylist()
                g["items"] = np.empty(len(items), object)
                g["items"][:] = items
        if rest is not None:
            g = {k: np.concatenate([v, g[k]]) if g else v for k, v in rest.items()}
        if not g or len(g["id"]) == 0:
            continue
        turn = (g["bucket"][1:] != g["bucket"][:-1]) | (g["x"][1:] != g["x"][:-1]) | (g["y"][1:] != g["y"][:-1])
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), len(g["id"])]
        rest = None
        if not last:  # the last group may go on in the next batch
            rest = {k: v[cuts[-2]:] for k, v in g.items()}
            cuts = cuts[:-1]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                yield {k: v[lo:hi] for k, v in g.items()}


def _partners(g: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of block x its likely partners in block y, of other components, not met in an earlier band.

    In a posting list (a negative bucket) the smaller of two sets must be posted by its short prefix.
    """
    bucket = int(g["bucket"][0])
    band = bucket >> 8 * ROWS if bucket >= 0 else 0
    right = np.flatnonzero(g["block"] == g["y"][0])
    same = g["x"][0] == g["y"][0]
    for i in np.flatnonzero(g["block"] == g["x"][0]).tolist():
        others = right[g["part"][right] != g["part"][i]]
        if same:
            others = others[others > i]
        if bucket < 0:
            smaller = g["n"][others] < g["n"][i]
            both = (g["n"][others] == g["n"][i]) & (g["short"][others] > 0)
            others = others[np.where(smaller, g["short"][others], g["short"][i] * (both | (g["n"][others] > g["n"][i]))) > 0]
        others = others[_alike(g["sig"][i], g["sig"][others], g["n"][i], g["n"][others])] if len(others) else others
        if len(others) and band:
            before = (g["sig"][i][:band * ROWS] == g["sig"][others][:, :band * ROWS]).reshape(len(others), band, ROWS)
            others = others[~before.all(2).any(1)]
        if len(others):
            yield i, others


def _active(members: DataFrame) -> DataFrame:
    """(bucket, id): members of a block that have a likely partner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _in_groups(batches):
            found = np.zeros(len(g["id"]), bool)
            for i, others in _partners(g):
                found[i] = found[others] = True
            if found.any():
                yield pa.record_batch([pa.array(g["bucket"][found]), pa.array(g["id"][found])], names=["bucket", "id"])

    return members.mapInArrow(run, "bucket long, id long")


def _joined(members: DataFrame) -> DataFrame:
    """(a, b): confirmed links of a block, as many as join its components and no more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _in_groups(batches):
            flat = np.frombuffer(b"".join(g["items"]), np.uint64)
            starts = np.cumsum(g["n"]) - g["n"]
            _, code = np.unique(flat, return_inverse=True)
            mark = np.zeros(int(code.max(initial=0)) + 1, np.int64)
            root = {p: p for p in g["part"].tolist()}

            def find(p: int) -> int:
                while root[p] != p:
                    root[p] = p = root[root[p]]
                return p

            a, b = [], []
            for i, others in _partners(g):
                own = code[starts[i]:starts[i] + g["n"][i]]
                mark[own] = 1
                both = np.add.reduceat(mark[code], starts)[others]
                mark[own] = 0
                for j in others[100 * both >= PERCENT * (g["n"][i] + g["n"][others] - both)].tolist():
                    p, q = find(int(g["part"][i])), find(int(g["part"][j]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(int(g["id"][i]))
                        b.append(int(g["id"][j]))
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _slots(items: np.ndarray) -> np.ndarray:
    return (items % np.uint64(COUNTERS)).astype(np.int64)


def _rarity(sets: DataFrame) -> np.ndarray:
    """About how many of the sets have a shingle, by its slot; never less than there are.

    A partial sketch for each task, FAN_IN of them added at a time.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column("items").to_pylist():
                total += np.bincount(_slots(np.frombuffer(raw, np.uint64)), minlength=COUNTERS)
        yield pa.record_batch([pa.array([_pressed(total)], pa.binary())], names=["total"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"total": pa.array([_pressed(sum(map(_unpressed, group.column("total").to_pylist())))], pa.binary())})

    parts = written(sets.select("items").mapInArrow(count, "total binary"), "rarity")
    left = parts.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = written(parts.withColumn("place", F.pmod(F.xxhash64("total"), F.lit(left))).groupBy("place").applyInArrow(add, "total binary"), "rarity")
    return sum((_unpressed(bytes(r["total"])) for r in parts.collect()), np.zeros(COUNTERS, np.int64))


def _pressed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpressed(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.int64)


def _posted(members: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(bucket, id, part, n, short): members by the shingles of their prefix, rarest first; these buckets are negative."""
    shared = members.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "items"))):
                items = np.frombuffer(raw, np.uint64)
                n = len(items)
                often = shared.value[_slots(items)]
                order = np.lexsort((items, often))[:n - -(-PERCENT * n // 100) + 1]
                short = np.arange(len(order)) < n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
                order, short = order[often[order] > 1], short[often[order] > 1]  # nobody else has a shingle that is counted once
                if len(order):
                    same = np.ones(len(order), np.int64)
                    yield pa.record_batch([pa.array((items[order] | np.uint64(1 << 63)).view(np.int64)), pa.array(same * k), pa.array(same * part),
                                           pa.array(same * n), pa.array(short.astype(np.int32))], names=["bucket", "id", "part", "n", "short"])

    return members.select("id", "part", "items").mapInArrow(run, "bucket long, id long, part long, n long, short int")


def _several(members: DataFrame) -> DataFrame:
    """(bucket, size) of buckets with several components."""
    return members.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p < q").select("bucket", "size")


def _dealt(posted: DataFrame, weight: Column, *more: str) -> DataFrame:
    """Members of buckets with several components, each in every pair of blocks that its own is part of; ``weight``: the share of a block."""
    split = written(posted.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.ceil(F.round(F.sum(weight), 9)).cast("int").alias(
        "blocks")).where("p < q").select("bucket", "blocks"), "split")
    blocks = posted.join(split, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "part", "n", "short", *more)
    return dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


def shingle_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, items): the full set of each document as sorted 64-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                sets = [s.tobytes() for s in shingle_sets(*text_bytes(part.column("text")))]
                yield pa.record_batch([part.column("id"), pa.array(sets, pa.binary())], names=["id", "items"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, items binary")


def _sets(ids: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, items) of some documents; their ids are broadcast if they are few enough."""
    ids = written(ids.toDF(key).distinct(), "verify")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return written(shingle_rows(docs.select(key, text).join(wanted, key, "left_semi"), key, text), "sets", small=True)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1) if len(q) else np.zeros(0, np.int64)
                both = int((q[at] == p).sum()) if len(q) else 0
                good.append(both > 0 and 100 * both >= PERCENT * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "items_a", "items_b").mapInArrow(
        run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept): one row for each document.

    component_id is the smallest key that links lead to, kept says that it is the row's own.
    """
    docs = docs.select(key, text)
    known = written(sketches(docs, key, text), "sketches", small=True)
    classes = written(known.where("id is not null and n > 0").groupBy("print").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    bands = _bands(classes)
    # written, so that the joins below are planned with exchanges that adaptive execution can split where a bucket is hot
    shared = written(bands.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"), "shared")
    members = written(bands.join(shared.select("bucket", "least"), "bucket"), "buckets")
    sized = written(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "sig"), "members")

    first = written(_likely(members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(),
                            sized), "likely")
    links = written(_confirmed(first, _sets(first.select(F.explode(F.array("a", "b"))), docs, key, text)), "links")
    parts = components(links)

    placed = written(members.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("part")).join(sized.select("id", "n"), "id").withColumn("short", F.lit(1)), "placed")
    several = written(_several(placed), "several")
    groups = placed.join(several.where(F.col("size") <= BLOCK).select("bucket"), "bucket").select("bucket", "id", "part", "n", "short")
    large = placed.join(several.where(F.col("size") > BLOCK).select("bucket"), "bucket", "left_semi").select("id", "part").distinct()
    if not several.where(F.col("size") > BLOCK).isEmpty():
        large = written(large, "large")
        sets = _sets(large.select("id"), docs, key, text)
        lists = written(_posted(large.join(sets, "id"), _rarity(sets)), "posted")
        groups = groups.unionByName(lists.join(written(_several(lists), "several").select("bucket"), "bucket"))
    active = written(_active(_dealt(groups.join(sized.select("id", "sig"), "id"), F.lit(1 / BLOCK), "sig")).distinct(), "active")
    if not active.isEmpty():
        sets = _sets(active.select("id"), docs, key, text)
        near = groups.join(active, ["bucket", "id"], "left_semi").join(sets, "id").join(sized.select("id", "sig"), "id")
        links = links.union(written(_joined(_dealt(near, F.ceil(F.col("n") / SET_SIZE) / SET_BLOCK, "sig", "items")), "links"))
        parts = components(links)

    root = classes.select("print", F.col("id").alias("node")).join(parts, "node", "left").select(
        "print", F.coalesce("component", "node").alias("root"))
    out = known.select("id", "n", "print").join(root, "print", "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"),
                      F.col("id").eqNullSafe(found).alias("kept"))
