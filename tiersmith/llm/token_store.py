"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th
chunks of the ids that have one, a bitmap that says which of them go on to the
next level, and a rank directory with the number of set bits before every 512.
Token i is read by one look-up per level, its place in the next level being the
rank of its bit; no block around it is decoded.

The store is a Parquet table of segments, written and read by Spark, so that it
may live wherever Spark can write: each row has the documents of one segment in
ascending id order, their token counts and the encoded ids. Files and rows are
in the order of the ids. A segment closes at ``SEGMENT`` tokens; a document is
never split, so a very long one makes a longer segment.

Null and empty texts are documents with only their end id. A null id comes
first; rows that repeat an id lie next to each other, ordered by their text's
hash. Other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersmith.llm.frames import row_blocks, text_bytes

MAGIC = b"DAC1"
END = 2
SEGMENT = 1 << 18
RANK_STEP = 512
#: Bytes of words and codes that a worker remembers, and of the texts that it encodes at once.
REMEMBERED, AT_ONCE = 48 << 20, 2 << 20
#: Letters that lower-case one by one and compose with nothing, then signs that are no apostrophe.
PLAIN = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<signs>[.,;:!?*#%&$|()\"-]*)$"


def pack(ids: np.ndarray) -> bytes:
    """The encoded form: magic, number of levels, then for each its length, bytes, bitmap and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_STEP // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, RANK_STEP // 8).sum(1, dtype=np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append(np.array([len(rest), len(ranks)], "<u8").tobytes() + rest.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint32(8)
        if len(rest) == 0:
            return MAGIC + bytes([len(levels)]) + b"".join(levels)


class Codes:
    """Random and whole access to packed ids."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(raw[4]):
            n, blocks = (int(x) for x in np.frombuffer(raw, "<u8", 2, at))
            at += 16
            chunk = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, blocks * RANK_STEP // 8, at + n)
            ranks = np.frombuffer(raw, "<u4", blocks, at + n + len(bits))
            at += n + len(bits) + 4 * blocks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token i by one look-up per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block, inner = divmod(i, RANK_STEP)
            inside = bits[block * RANK_STEP // 8:(i >> 3) + 1].copy()
            inside[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(inside).sum())
        return out

    def all(self) -> np.ndarray:
        """Every token, level by level from the highest."""
        above = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            out = chunk.astype(np.uint32)
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))
            out[more] |= above << np.uint32(8)
            above = out
        return above


class ChunkEncoder:
    """The public library's codes of whole texts, asked for each distinct word once.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its runs between blanks and line ends, in order. A
    run of Latin letters with signs behind it is its lower-case word followed by
    the signs; words are passed to the library a hundred at a time and told
    apart by their last tokens. Any other run is passed on as it is. What is
    remembered is bounded, which does not change results.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def _keep(self, words: list[str], codes: list[bytes]) -> None:
        self.known.update(zip(words, codes))
        self.held += sum(map(len, words)) + sum(map(len, codes)) + 150 * len(words)

    def _ask(self, strings: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [np.array(c.ids, np.uint32).tobytes() for c in codes]

    def _learn_parts(self, fresh: list[str]) -> None:
        """Codes of lower-case words and of runs of signs."""
        for at in range(0, len(fresh), 20_000):
            some = fresh[at:at + 20_000]
            for k, raw in enumerate(self._ask([" ".join(some[k:k + 100]) for k in range(0, len(some), 100)])):
                words = some[100 * k:100 * k + 100]
                cut = (4 * (np.flatnonzero(self.last[np.frombuffer(raw, np.uint32)]) + 1)).tolist()
                self._keep(words, [raw[a:b] for a, b in zip([0, *cut], cut)] if len(cut) == len(words) else self._ask(words))

    def _codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after the other, and how many each has."""
        if self.held > REMEMBERED:
            self.known, self.held = {"": b""}, 0
        cut = pc.extract_regex(words, PLAIN)
        plain = cut.is_valid()
        found = cut.filter(plain)
        word, signs = (x.dictionary_encode() for x in (pc.utf8_lower(found.field("word")), found.field("signs")))
        names = [*word.dictionary.to_pylist(), *signs.dictionary.to_pylist()]
        self._learn_parts([x for x in dict.fromkeys(names) if x not in self.known])
        other = words.filter(pc.invert(plain)).to_pylist()
        fresh = [x for x in other if x not in self.known]
        for at in range(0, len(fresh), 20_000):
            self._keep(fresh[at:at + 20_000], self._ask(fresh[at:at + 20_000]))
        pool = [*map(self.known.__getitem__, names), *map(self.known.__getitem__, other), b""]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        # each word is two entries of the pool: letters and signs, or the whole and nothing
        pairs = np.full((len(words), 2), len(pool) - 1)
        here = np.asarray(plain)
        pairs[here, 0] = np.asarray(word.indices)
        pairs[here, 1] = len(word.dictionary) + np.asarray(signs.indices)
        pairs[~here, 0] = len(names) + np.arange(len(other))
        return _taken(b"".join(pool), sizes, pairs.ravel()), sizes[pairs].sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end; null is empty."""
        words = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        rows = np.asarray(words.value_lengths(), np.int64)
        coded = words.flatten().dictionary_encode()
        flat, sizes = self._codes(coded.dictionary)
        index = np.asarray(coded.indices)
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        return _taken(flat.tobytes(), sizes, index), ends[np.cumsum(rows)]


def _taken(raw: bytes, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Runs of ids, of which there are ``sizes`` one after the other, in another order or repeated."""
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(raw, np.uint32)))
    return np.asarray(lists.take(pa.array(index)).flatten())


_encoders: dict[str, ChunkEncoder] = {}


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Encode all texts and write the segments to ``path`` in ascending order of the key.

    ``tokenizer`` is the path of a public tokenizer file on every machine. The
    order comes from one range shuffle over (key, text hash), so that even a
    key with most of the rows is spread; segments carry their place within
    their file, and no task sees more than its own range.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, ChunkEncoder(tokenizer))
        keys: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        start = size = 0

        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([start]), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                                    pa.array([pack(np.concatenate(held))], pa.binary())], names=["start", "doc_ids", "counts", "codes"])

        for batch in batches:
            for lo, hi in row_blocks(text_bytes(batch.column("text"))[1], AT_ONCE):
                part = batch.slice(lo, hi - lo)
                ids, ends = encoder.encode(part.column("text"))
                ids = np.insert(ids, ends, end)  # the end id behind each document
                ends = ends + np.arange(1, len(ends) + 1)
                own, at = part.column("key").to_pylist(), 0
                while at < len(own):  # documents up to the one with which the segment is full
                    before = int(ends[at - 1]) if at else 0
                    stop = min(len(own), int(np.searchsorted(ends, before + SEGMENT - size)) + 1)
                    keys += own[at:stop]
                    counts += np.diff(ends[at:stop], prepend=before).tolist()
                    held.append(ids[before:ends[stop - 1]])
                    size += int(ends[stop - 1]) - before
                    if size >= SEGMENT:
                        yield close()
                        start, size, keys, counts, held = start + size, 0, [], [], []
                    at = stop
                held = [np.concatenate(held)] if held else []  # no view keeps a block alive
                del part, ids
        if keys:
            yield close()

    order = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    dealt = order.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    segments = dealt.mapInArrow(run, "start long, doc_ids array<long>, counts array<long>, codes binary")
    segments.withColumn("file", F.spark_partition_id()).write.parquet(path)


def _offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, before): the tokens in all files before each; one row for each file that was written."""
    totals = spark.read.parquet(path).groupBy("file").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).orderBy("file").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r["file"], before))
        before += r["n"]
    return spark.createDataFrame(rows, "file int, before long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, decoded from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, keys, counts, raw in zip(*(batch.column(c).to_pylist() for c in ("first", "doc_ids", "counts", "codes"))):
                ids = Codes(raw).all().astype("<u4").tobytes()
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts)]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(first + ends - counts, pa.int64()),
                                       pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])

    stored = spark.read.parquet(path).join(F.broadcast(_offsets(spark, path)), "file")
    return stored.select((F.col("start") + F.col("before")).alias("first"), "doc_ids", "counts", "codes").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token(spark: SparkSession, path: str, place: int) -> int:
    """The id at a place of the whole sequence: one segment is fetched, one token decoded."""
    stored = spark.read.parquet(path).join(F.broadcast(_offsets(spark, path)), "file")
    first = F.col("start") + F.col("before")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    found = stored.where((first <= place) & (first + size > place)).select(first.alias("first"), "codes").first()
    if found is None:
        raise IndexError(place)
    return Codes(bytes(found["codes"]))[place - found["first"]]
