"""Exact top-k search by inner product of integer codes, by columnar branch and bound.

Candidates lie in vertical layout, one array per dimension. Scores accumulate
one block of dimensions after the other; after each block a pair survives only
if its partial score plus the norms of what is left (the most that the other
dimensions can add) reaches the query's bound, and survivors are compacted.
The bound of a query is its k-th best score so far, at first among a small
sample of candidates; it only ever excludes candidates that k others beat.

Queries are taken in blocks of a fixed number, whose codes and bounds are
broadcast; each block is one pass over all candidates. A task keeps k rows for
a query, so what is shuffled does not grow with the size of partitions.

Vectors that are null, or hold a null or a number that is not finite, take no
part, as queries or as candidates, nor do rows without an id. A query is not
compared with rows of its own id nor with vectors of another length; empty
vectors score 0. Ties go to the smaller id. Repeated rows are candidates like
others. Scores beyond 64 bits wrap. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.llm.frames import written

SCALE = 64
DIMENSIONS = 16
QUERIES = 4096
CHUNK = 8192
GROUP = 256
SAMPLE = 2000


def coded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors in the batch: ids and codes (rows x dimensions) of those that take part."""
    ids, vectors = batch.column("id"), batch.column("vector")
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    sizes = np.where(np.asarray(ids.is_null()), -1, sizes)
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    values = vectors.values
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan)) if len(values) else np.zeros(0)
    keys = np.asarray(ids.fill_null(0))
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = flat[offsets[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(1)
        yield keys[rows[good]], np.floor(SCALE * x[good])


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """The cheapest number type in which all sums of products are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def search_chunk(q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, x: np.ndarray, x_ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) of the pairs that reach the query's bound; x is dimensions x candidates."""
    kind, size = _kind(q, x), q.shape[1]
    q, x = q.astype(kind), np.ascontiguousarray(x.astype(kind))
    cuts = list(range(0, size, DIMENSIONS)) + [size]
    left_q = [np.sqrt((q[:, c:].astype(np.float64) ** 2).sum(1)) for c in cuts[1:]]
    left_x = [np.sqrt((x[c:].astype(np.float64) ** 2).sum(0)) for c in cuts[1:]]
    found = []
    for at in range(0, len(q), GROUP):
        rows = slice(at, min(len(q), at + GROUP))
        low = bounds[rows]
        alive = q_ids[rows][:, None] != x_ids[None, :]
        dense, a, b, part = np.zeros(alive.shape, kind), None, None, None
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a is None:
                dense += q[rows, lo:hi] @ x[lo:hi]
                most = np.multiply.outer((left_q[k][rows] * 1.00001).astype(np.float32), left_x[k].astype(np.float32)) + np.float32(1)
                alive &= dense + most >= low[:, None]
                if alive.sum() * 8 < alive.size:  # compact: from here on only the survivors
                    a, b = np.nonzero(alive)
                    part = dense[a, b]
            else:
                part = part + (q[at + a, lo:hi] * x[lo:hi, b].T).sum(1, dtype=kind)
                keep = part + left_q[k][at + a] * left_x[k][b] * 1.00001 + 1 >= low[a]
                a, b, part = a[keep], b[keep], part[keep]
        if a is None:
            a, b = np.nonzero(alive)
            part = dense[a, b]
        keep = part.astype(np.float64) >= low[a]
        found.append((at + a[keep], x_ids[b[keep]], part[keep].astype(np.int64)))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of every query, in order."""
    order = np.lexsort((ids, -scores, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def _bounds(query: np.ndarray, scores: np.ndarray, k: int, bounds: np.ndarray) -> np.ndarray:
    """Raise bounds by rows that ``best`` has ordered: the k-th score where a query has k."""
    out = bounds.copy()
    last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
    out[query[last]] = np.maximum(out[query[last]], scores[last])
    return out


class QueryBlock:
    """Queries of one length with their bounds."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes, self.bounds = ids, codes, np.full(len(ids), -np.inf)


def _local(rows: DataFrame, blocks: dict[int, QueryBlock], k: int) -> DataFrame:
    """(query, size, query_id, vec_id, score): the k best candidates of each task for every query."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    names = ["query", "size", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}
        for batch in batches:
            for ids, codes in coded(batch):
                block = shared.value.get(codes.shape[1])
                if block is None:
                    continue
                held, bounds = state.get(codes.shape[1], ((np.zeros(0, np.int64),) * 3, block.bounds))
                for lo in range(0, len(ids), CHUNK):
                    got = search_chunk(block.codes, block.ids, bounds, codes[lo:lo + CHUNK].T, ids[lo:lo + CHUNK])
                    both = [np.concatenate(p) for p in zip(held, got)]
                    top = best(*both, k)
                    held = tuple(p[top] for p in both)
                    bounds = _bounds(held[0], held[2], k, bounds)
                state[codes.shape[1]] = held, bounds
        for size, ((query, ids, scores), _) in state.items():
            yield pa.record_batch([pa.array(query), pa.array(np.full(len(query), size)), pa.array(shared.value[size].ids[query]),
                                   pa.array(ids), pa.array(scores)], names=names)

    return rows.mapInArrow(run, "query long, size long, query_id long, vec_id long, score long")


def _collected(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    parts: dict[int, list] = {}
    for batch in rows.toArrow().combine_chunks().to_batches():
        for ids, codes in coded(batch):
            parts.setdefault(codes.shape[1], []).append((ids, codes))
    return {s: (np.concatenate([p[0] for p in ps]), np.concatenate([p[1] for p in ps])) for s, ps in parts.items()}


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           block_queries: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row for which ``is_query`` (a column) holds, against all rows."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    usable = rows.where("id is not null and vector is not null")
    total, asking = usable.agg(F.count("*"), F.count_if("asks")).first()
    spread = 1_000_000 * max(1, total // 500_000_000)  # finer where a millionth would be too coarse for the share
    share = int(min(1.0, sample / max(1, total)) * spread)
    seeds = _collected(usable.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(spread)) < share).select("id", "vector"))
    count, out = max(1, -(-asking // block_queries)), []
    for part in range(count):
        asks = usable.where(F.col("asks") & (F.pmod(F.xxhash64("id"), F.lit(count)) == part))
        blocks = {size: QueryBlock(ids, codes) for size, (ids, codes) in _collected(asks.select("id", "vector")).items()}
        for size, block in blocks.items():
            if size in seeds:
                query, ids, scores = search_chunk(block.codes, block.ids, block.bounds, seeds[size][1].T, seeds[size][0])
                top = best(query, ids, scores, k)
                block.bounds = _bounds(query[top], scores[top], k, block.bounds)
        local = _local(usable.select("id", "vector"), blocks, k)
        order = Window.partitionBy("size", "query").orderBy(F.desc("score"), "vec_id")
        ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(ranked.select("query_id", "rank", "vec_id", "score"))
    if count == 1:
        return out[0]
    done = [written(x, "nearest") for x in out]
    result = done[0]
    for x in done[1:]:
        result = result.union(x)
    return result


#: Every 20th id against all rows, in DuckDB.
SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id query_id, (row_number() over w)::int as rank, c.vec_id, list_inner_product(q.e, c.e)::bigint score
from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
where q.vec_id % 20 = 0
window w as (partition by q.vec_id order by list_inner_product(q.e, c.e) desc, c.vec_id)
qualify row_number() over w <= 20
"""
