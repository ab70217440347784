"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to five bytes, counted over all
training texts (A-Z lower-cased, an end symbol after each). A byte that its
context has seen has probability count / (total + distinct); otherwise the
context escapes with distinct / (total + distinct) to the next shorter one, in
which the symbols of the longer one are excluded; below the empty context all
symbols left are alike. As the model is fixed when texts are scored, each
context's complete distribution is worked out once and a byte costs one look-up.
Logarithms are kept in steps of 1/2048.

Counting and scoring cover all texts. Contexts are dealt into blocks by their
last two bytes; a block's tables stay below ``block_bytes``, or are those of a
single pair of bytes, of which the three bytes before it bound the contexts, so
a broadcast has a bound whatever the corpus. Blocks are taken one at a time:
its counts are fetched and broadcast, every text gets its partial score for the
places that the block knows, and these are written before the next block.
A score depends on the text alone, so partial scores go by the text's hash and
are added up once for each different text.

``unigram`` gives the score of a plain word model beside it. Counts of words
that are frequent (``HOT`` words at most) are broadcast, all others are joined.

A null text is an empty one: it has only its end. Rows are scored one by one,
so repeated rows score alike. Without training texts every symbol is equally
likely. Columns to carry may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import Lookup, row_blocks, text_bytes, written
from tiersmith.llm.words import BLANKS, LOWER, word_hashes

ORDER = 5
#: Bytes that UTF-8 never has.
START, STOP = 0xFE, 0xFF
SYMBOLS = 255
STEPS = 2048
END_WORD = 1
HOT = 200_000
BLOCK_BYTES = 96 << 20
GRAM, WORD = 0, 1


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with start symbols before and the end symbol behind; the places to predict; their first by row."""
    n = len(offsets) - 1
    out = np.full(len(data) + n * (ORDER + 1), START, np.uint8)
    begins = offsets[:-1] + ORDER + np.arange(n) * (ORDER + 1)
    place = np.arange(len(data)) + np.repeat(begins - offsets[:-1], np.diff(offsets))
    out[place] = LOWER[data]
    out[begins + np.diff(offsets)] = STOP
    return out, np.flatnonzero(out != START), offsets[:-1] + np.arange(n)


def grams(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of context, the nearest first, and the symbol, as one number, for each place.

    The nearest byte is the highest, so that in sorted order every context is
    followed by the longer ones that end with it.
    """
    wide = a.astype(np.int64)
    code = wide[at - 1]
    for k in range(2, ORDER + 1):
        code = (code << 8) | wide[at - k]
    return (code << 8) | wide[at]


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, rows = word_hashes(data, offsets, BLANKS)
    return (hashes >> np.uint64(1)).astype(np.int64) | 2, rows  # never END_WORD


def _add(total: tuple[np.ndarray, np.ndarray], more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([total[0], *(k for k, _ in more)])
    counts = np.concatenate([total[1], *(c for _, c in more)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count(training: DataFrame, text: str = "text") -> DataFrame:
    """(kind, code, n): occurrences of byte grams and of words in all training texts, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        totals, waiting, held = [none, none], [[], []], 0

        def emit() -> Iterator[pa.RecordBatch]:
            for kind in (GRAM, WORD):
                keys, n = totals[kind]
                for lo in range(0, len(keys), 100_000):
                    part = keys[lo:lo + 100_000]
                    yield pa.record_batch([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[lo:lo + 100_000])],
                                          names=["kind", "code", "n"])
                totals[kind] = none

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(offsets):
                part, ends = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                a, at, _ = padded(part, ends)
                words, _ = _word_keys(part, ends)
                for kind, keys in ((GRAM, grams(a, at)), (WORD, np.append(words, np.full(hi - lo, END_WORD)))):
                    waiting[kind].append(np.unique_counts(keys))
                    held += len(waiting[kind][-1][0])
                if held > 1_000_000:
                    for kind in (GRAM, WORD):
                        totals[kind], waiting[kind] = _add(totals[kind], waiting[kind]), []
                    held = 0
                    if len(totals[GRAM][0]) + len(totals[WORD][0]) > 4_000_000:  # bounded memory; Spark adds up
                        yield from emit()
        for kind in (GRAM, WORD):
            totals[kind] = _add(totals[kind], waiting[kind])
        yield from emit()

    parts = training.select(F.col(text).alias("text")).mapInArrow(run, "kind int, code long, n long")
    return written(parts.groupBy("kind", "code").agg(F.sum("n").alias("n")), "counts")


@dataclass
class Grams:
    """What a worker needs to build the tables of one block."""

    pairs: np.ndarray  # counts of (last byte, symbol), 256 x 256, of the whole corpus
    codes: np.ndarray  # grams of this block
    counts: np.ndarray
    mine: np.ndarray | None  # for each pair of last bytes, the nearest higher, whether this block scores it; None: all


class Tables:
    """Complete distributions of the contexts of a block, and how to find a context."""

    def __init__(self, g: Grams):
        self.source = g  # keeps it alive, for its identity is the key under which workers remember the tables
        root = g.pairs.sum(0)
        seen = np.flatnonzero((root > 0) | (g.pairs.sum(1) > 0))
        self.code = np.full(256, len(seen), np.int64)
        self.code[seen] = np.arange(len(seen))
        self.width = wide = len(seen) + 1
        bi = np.argwhere(g.pairs > 0)
        # by order: contexts in order, then (row, symbol, count) in the order of rows
        levels = [self._level(bi[:, 0], self.code[bi[:, 1]], g.pairs[bi[:, 0], bi[:, 1]])]
        symbol = self.code[g.codes & 255]
        for k in range(2, ORDER + 1):
            levels.append(self._level(g.codes >> 8 * (ORDER + 1 - k), symbol, g.counts))
        keys = [level[0] for level in levels]
        self.base = np.cumsum([1, *map(len, keys)]).tolist()
        self.logs = np.empty((self.base[-1], wide), np.uint16)
        total, distinct = root.sum(), int((root > 0).sum())
        dense = np.zeros((1, wide), np.float32)
        dense[0, self.code[root > 0]] = root[root > 0]
        rest = np.full((1, wide), 1 / max(1, SYMBOLS - distinct), np.float32)
        self._keep(0, np.where(dense > 0, dense / max(1, total + distinct), (distinct / (total + distinct) if total else 1.0) * rest))
        parents = [np.zeros(len(keys[0]), np.int64)] + [np.searchsorted(a, b >> 8) for a, b in zip(keys, keys[1:])]
        for first in range(len(keys[0])):  # the contexts that end with one byte
            above, above_rest, above_lo, lo, hi = dense, rest, 0, first, first + 1
            for k, level in enumerate(levels):
                above, above_rest = self._distribute(level, parents[k] - above_lo, lo, hi, above, above_rest, self.base[k], k + 1 < ORDER)
                if k + 1 < ORDER:
                    above_lo, (lo, hi) = lo, np.searchsorted(parents[k + 1], [lo, hi]).tolist()
        self.logs = self.logs.ravel()
        self.one, self.two = np.full(256, -1, np.int32), np.full(65536, -1, np.int32)
        self.one[keys[0]] = np.arange(len(keys[0]))
        self.two[keys[1]] = np.arange(len(keys[1]))
        # children by the next older byte; the last row answers for "no such context"
        self.deeper = [self._children(keys[k - 2], keys[k - 1]) for k in range(3, ORDER + 1)]
        self.mine = g.mine

    def _keep(self, row: int, p: np.ndarray) -> None:
        self.logs[row:row + len(p)] = np.minimum(np.rint(-np.log10(p) * STEPS), 65535)

    def _distribute(self, level: tuple[np.ndarray, ...], parent: np.ndarray, lo: int, hi: int, above: np.ndarray,
                    above_rest: np.ndarray, base: int, hold: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distributions of the contexts lo to hi of a level; returns their counts and what lies below their escape."""
        _, row, symbol, n = level
        held = [np.empty((hi - lo if hold else 0, self.width), np.float32) for _ in range(2)]
        for a in range(lo, hi, 2048):
            b = min(hi, a + 2048)
            s = slice(*np.searchsorted(row, [a, b]))
            here = np.zeros((b - a, self.width), np.float32)
            here[row[s] - a, symbol[s]] = n[s]
            shorter, below = above[parent[a:b]], above_rest[parent[a:b]]
            remain = np.where(here > 0, 0, shorter)  # the shorter context without what the longer has seen
            t, d = remain.sum(1, keepdims=True, dtype=np.float64), (remain > 0).sum(1, keepdims=True)
            lower = np.where(remain > 0, remain, np.where(t > 0, d, 1.0) * below) / np.where(remain > 0, t + d, np.maximum(t + d, 1))
            t, d = here.sum(1, keepdims=True, dtype=np.float64), (here > 0).sum(1, keepdims=True)
            self._keep(base + a, np.where(here > 0, here / (t + d), d / (t + d) * lower))
            if hold:
                held[0][a - lo:b - lo], held[1][a - lo:b - lo] = here, lower
        return held[0], held[1]

    @staticmethod
    def _level(keys: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        (both, total) = _add((keys * 512 + symbol, n.astype(np.int64)), [])
        contexts, row = np.unique(both // 512, return_inverse=True)
        return contexts, row, both % 512, total

    def _children(self, short: np.ndarray, long: np.ndarray) -> np.ndarray:
        out = np.full((len(short) + 1, self.width), -1, np.int32)
        out[np.searchsorted(short, long >> 8), self.code[long & 255]] = np.arange(len(long))
        return out.ravel()

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each row, as far as this block knows the contexts."""
        a, at, first = padded(data, offsets)
        last = a[at - 1].astype(np.int64)
        pair = (last << 8) | a[at - 2]
        value = np.zeros(len(at))
        own = slice(None) if self.mine is None else np.flatnonzero(self.mine[pair])  # what other blocks score is not looked up
        at, last, pair = at[own], last[own], pair[own]
        code = self.code
        known = self.one[last]
        row = np.where(known >= 0, known + self.base[0], 0)
        known = self.two[pair]
        row = np.where(known >= 0, known + self.base[1], row)
        for k, children in enumerate(self.deeper, 3):
            none = len(children) // self.width - 1
            known = children[np.where(known < 0, none, known).astype(np.int64) * self.width + code[a[at - k]]]
            row = np.where(known >= 0, known + self.base[k - 1], row)
        row = row.astype(np.int64)
        value[own] = self.logs[row * self.width + code[a[at]]] * (-1.0 / STEPS)
        return np.add.reduceat(value, first)


@dataclass
class Blocks:
    """Each block scores a range of pairs of last bytes; ``fetch`` brings the counts of one block to the driver."""

    counts: DataFrame
    pairs: np.ndarray
    bounds: list[int]  # the first pair of each block, and 65536; pairs never seen are in a range too

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def fetch(self, k: int) -> Grams:
        part, mine = self.counts, None
        if len(self) > 1:
            lo, hi = self.bounds[k:k + 2]
            first, behind = (pair << 8 * (ORDER - 1) for pair in (lo, hi))
            # two comparisons: a list of pairs would be up to 65536 literals in the driver's plan
            part = part.where((F.col("code") >= first) & (F.col("code") < behind))
            mine = np.zeros(65536, bool)
            mine[lo:hi] = True
        rows = part.toArrow()
        return Grams(self.pairs, np.asarray(rows.column("code").combine_chunks()), np.asarray(rows.column("n").combine_chunks()), mine)


def blocks_of(counts: DataFrame, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Contexts packed into blocks by their last two bytes, one after the other."""
    got = counts.where(F.col("kind") == GRAM).select("code", "n")
    pairs = np.zeros((256, 256), np.int64)
    last = F.shiftright("code", 8 * ORDER).alias("a")
    for r in got.groupBy(last, F.col("code").bitwiseAND(255).alias("s")).agg(F.sum("n").alias("n")).collect():
        pairs[r["a"], r["s"]] = r["n"]
    pair = F.shiftright("code", 8 * (ORDER - 1))
    # contexts of full length, and of one byte less, which have children
    long, short = (F.countDistinct(F.shiftright("code", 8 * k)) for k in (1, 2))
    sizes = got.groupBy(pair.alias("p")).agg(long.alias("long"), short.alias("short"), F.count("*").alias("grams"))
    width = int(((pairs.sum(0) + pairs.sum(1)) > 0).sum()) + 1
    bounds, used = [0], 0
    for r in sorted(sizes.collect()):
        # two bytes a cell for logarithms of all lengths, four for children, 24 for each gram and its place while tables are made
        need = int(width * (2 * (r["long"] + 1.5 * r["short"]) + 4 * 1.5 * r["short"])) + 24 * r["grams"]
        if used and used + need > block_bytes:
            bounds.append(r["p"])
            used = 0
        used += need
    return Blocks(got, pairs, [*bounds, 65536])


_tables: dict[int, Tables] = {}


def _mapped(docs: DataFrame, keep: tuple[str, ...], text: str, names: str, work) -> DataFrame:
    taken = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("v"))
    carried = "".join(f"`k{i}` {f.dataType.simpleString()}, " for i, f in enumerate(taken.schema.fields[:-1]))
    fields = [x.split()[0] for x in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("v"))
            for lo, hi in row_blocks(offsets):
                part = batch.slice(lo, hi - lo)
                made = work(part, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield pa.record_batch([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *fields])

    out = taken.mapInArrow(run, carried + names)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *fields)


def print_of(text: str = "text") -> Column:
    """128 bits of a text, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def text_scores(docs: DataFrame, blocks: Blocks, text: str = "text") -> DataFrame:
    """(print, score): the log10 probability of each different text and its end, written."""
    parts = []
    for k in range(len(blocks)):
        shared = docs.sparkSession.sparkContext.broadcast(blocks.fetch(k))

        def work(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, shared=shared) -> list[pa.Array]:
            key = id(shared.value)
            if key not in _tables:
                _tables.clear()  # one block at a time
                _tables[key] = Tables(shared.value)
            return [pa.array(_tables[key].score(data, offsets))]

        seen = docs.select(print_of(text).alias("print"), F.col(f"`{text}`").alias("text"))
        scored = _mapped(seen, ("print",), "text", "s double", work)
        parts.append(written(scored.groupBy("print").agg(F.max("s").alias("s")).withColumn("block", F.lit(k)), "scores"))
        shared.destroy()
    if len(parts) == 1:
        return parts[0].select("print", F.col("s").alias("score"))
    return reduce(DataFrame.unionByName, parts).groupBy("print").agg(F.sum("s").alias("score"))


def score(docs: DataFrame, blocks: Blocks, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text and score, the log10 probability of the whole text and its end."""
    taken = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"), print_of(text).alias("print"))
    out = taken.join(text_scores(docs, blocks, text), "print", "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("t").alias(text), "score")


def unigram(docs: DataFrame, counts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_tokens, n_known, train_tokens and base_score, the sum of log10((c+1)/(N+V+1)) over the tokens."""
    words = counts.where(F.col("kind") == WORD)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = words.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, held = 1_000_001, 0
    for r in sizes.limit(100_000).collect():  # the most frequent words that fit; the others are joined
        if held + r["words"] > HOT:
            break
        least, held = r["n"], held + r["words"]
    hot = words.where((F.col("n") >= least) | (F.col("code") == END_WORD)).select("code", "n").toArrow()
    table = Lookup(np.asarray(hot.column("code").combine_chunks()), np.asarray(hot.column("n").combine_chunks()), 0)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        keys, rows = _word_keys(data, offsets)
        n = shared.value.get(keys)
        logs, known = np.concatenate([[0], np.cumsum(np.log10(n + 1.0))]), np.concatenate([[0], np.cumsum(n > 0)])
        end = int(shared.value.get(np.array([END_WORD]))[0])
        rare = np.flatnonzero(n == 0)
        cut = np.searchsorted(rare, rows)
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(keys[rare]))
        return [pa.array(np.diff(rows) + 1), pa.array(known[rows[1:]] - known[rows[:-1]] + (end > 0)),
                pa.array(logs[rows[1:]] - logs[rows[:-1]] + np.log10(end + 1.0)), lists]

    plain = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(keep)]).alias("kept"), F.col(text).alias("text"))
    first = written(_mapped(plain, ("kept",), "text", "n_tokens long, near long, logs double, rare array<long>", work).withColumn(
        "row", F.monotonically_increasing_id()), "tokens")
    other = words.where((F.col("n") < least) & (F.col("code") != END_WORD)).select("code", F.log10(F.col("n") + F.lit(1.0)).alias("l"))
    far = first.select("row", F.explode("rare").alias("code")).join(other, "code").groupBy("row").agg(
        F.sum("l").alias("more"), F.count("*").alias("far"))
    each = float(np.log10(total + distinct + 1))
    return first.join(far, "row", "left").select(
        *[F.col("kept")[f"f{i}"].alias(c) for i, c in enumerate(keep)], "n_tokens", (F.col("near") + F.coalesce("far", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"))
