"""Benchmark decontamination: documents against the word windows of test items.

Texts are lower-cased (A-Z) and split into words of letters, digits and
characters beyond ASCII. A window is ten consecutive words of an item; an item
with fewer words, but not none, is one window. Hashes of all windows of a block
of items are broadcast, documents are scanned with a rolling window, and each
hit is compared word by word with the item's text before it counts.

The items are taken in blocks of at most ``block_bytes`` of text (an item is
never split), so that a broadcast has a bound whatever the size of the
benchmark; the results of a pass are written before the next block is broadcast.

A null or empty text has no words and no hits; an item without words never
occurs; repeated items count once by their id. Items without an id are scanned
for like others and count as one item, whose null comes last among the items. Long texts are scanned whole. Columns to carry may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import Lookup, free_name, row_blocks, text_bytes, written
from tiersmith.llm.words import LOWER, NOT_ALNUM, hash_ranges, windows, word_ranges

WINDOW = 10
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
_SPACED = np.where(NOT_ALNUM, 32, np.arange(256)).astype(np.uint8).tobytes()


def normalised(raw: bytes) -> bytes:
    """Words of lower-cased bytes with one blank between them."""
    return b" ".join(raw.translate(_SPACED).split())


class Windows:
    """The windows of a block of items: by width a table of hashes, the text of each and the items that have it."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for name, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            begins, ends = word_ranges(data, np.array([0, len(data)]), NOT_ALNUM)
            if len(begins) == 0:
                continue
            size = min(width, len(begins))
            hashes = (windows(hash_ranges(data, begins, ends), size) >> np.uint64(1)).astype(np.int64)
            raw = data.tobytes()
            for k, h in enumerate(hashes.tolist()):
                words = normalised(raw[begins[k]:ends[k + size - 1]])
                found.setdefault(size, {}).setdefault(h, {}).setdefault(words, set()).add(name)
        self.widths = {}
        for size, table in found.items():
            keys = np.array(sorted(table), np.int64)
            maybe = np.zeros(1 << 20, bool)
            maybe[keys >> 43] = True
            self.widths[size] = (maybe, Lookup(keys, np.arange(len(keys))), [table[k] for k in keys.tolist()])


def _scan_block(known: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]], list]:
    """Number of words of each row, item names by row, and (row, first word, last word + 1) of each verified hit."""
    low = LOWER[data]
    begins, ends = word_ranges(low, offsets, NOT_ALNUM)
    hashes, rows = hash_ranges(low, begins, ends), np.searchsorted(begins, offsets)
    names: dict[int, set[str]] = {}
    hits = []
    memo: dict[tuple[int, bytes], set[str] | None] = {}
    for size, (maybe, table, texts) in known.widths.items():
        w = (windows(hashes, size) >> np.uint64(1)).astype(np.int64)
        at = np.flatnonzero(maybe[w >> 43])
        place = table.get(w[at])
        at, place = at[place >= 0], place[place >= 0]
        row = np.searchsorted(rows, at, "right") - 1
        inside = at + size <= rows[row + 1]
        for k, p, r in zip(at[inside].tolist(), place[inside].tolist(), row[inside].tolist()):
            raw = low[begins[k]:ends[k + size - 1]].tobytes()
            if (p, raw) not in memo:
                memo[p, raw] = texts[p].get(normalised(raw))
            if memo[p, raw]:
                names.setdefault(r, set()).update(memo[p, raw])
                hits.append((r, k - int(rows[r]), k - int(rows[r]) + size))
    return np.diff(rows), names, hits


def merged_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, known: Windows) -> DataFrame:
    """Add the hits of one block of items to (carried..., v, n_words, spans, items)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("v"))
            for lo, hi in row_blocks(offsets):
                part = batch.slice(lo, hi - lo)
                n, names, hits = _scan_block(shared.value, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                spans, items = part.column("spans"), part.column("items")
                if hits:
                    runs = [[(s["begin"], s["stop"]) for s in x] for x in spans.to_pylist()]
                    for r, a, b in hits:
                        runs[r].append((a, b))
                    spans = pa.array([[{"begin": a, "stop": b} for a, b in merged_runs(x)] for x in runs], SPANS)
                    items = pa.array([sorted({*x, *names.get(r, ())}, key=lambda v: (v is None, v)) for r, x in enumerate(items.to_pylist())],
                                     pa.list_(pa.string()))
                fixed = [part.column(c) for c in batch.schema.names if c not in ("n_words", "spans", "items")]
                names_out = [c for c in batch.schema.names if c not in ("n_words", "spans", "items")]
                yield pa.record_batch([*fixed, pa.array(n, pa.int64()), spans, items], names=[*names_out, "n_words", "spans", "items"])

    return docs.mapInArrow(run, docs.schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         item: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = 16 << 20,
         names: tuple[str, str, str, str] = ("n_words", "spans", "n_hit", "items")) -> DataFrame:
    """``keep`` with, under these names, n_words, spans (runs of hit words, by word number), n_hit (words in them) and items (ids, sorted)."""
    tests = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    others = [c for c in keep if c != text]  # the text passes once
    out = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)], F.col(text).alias("v"),
                      F.lit(0).cast("long").alias("n_words"),
                      F.expr("cast(array() as array<struct<begin:bigint,stop:bigint>>)").alias("spans"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    for k in range(blocks):
        mine = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
        out = _pass(out, Windows([(r["name"], r["text"]) for r in mine.collect()], width))
        if k + 1 < blocks:
            out = written(out, "pass")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    return out.select(*[F.col("v" if c == text else f"k{others.index(c)}").alias(c) for c in keep],
                      *[x.alias(n) for n, x in zip(names, (F.col("n_words"), F.col("spans"), hit, F.col("items")))])


def without_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents in which no window of a test item occurs, with all their columns."""
    names = tuple(free_name(docs, n) for n in ("n_words", "spans", "n_hit", "items"))
    found = scan(docs, benchmark, text, tuple(docs.columns), names=names, **how)
    return found.where(F.col(names[2]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """All documents with their hit words cut out; what separates the words around a cut stays."""
    others = [c for c in docs.columns if c != text]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text).alias("text"))
    found = scan(whole, benchmark, "text", ("row", "text"), **how).select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if spans:
                    raw = value.encode()
                    data = LOWER[np.frombuffer(raw, np.uint8)]
                    begins, ends = word_ranges(data, np.array([0, len(data)]), NOT_ALNUM)
                    cuts = [0, *(int(x) for s in spans for x in (begins[s["begin"]], ends[s["stop"] - 1])), len(raw)]
                    value = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode()
                out.append(value)
            yield pa.record_batch([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    cut = found.mapInArrow(run, found.select("row", "text").schema)
    return cut.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The contract's digest of the same scan in DuckDB.
SQL = f"""
with d as (select doc_id, row_number() over () r, {_WORDS} w from documents),
items as (select item_id::varchar item_id, {_WORDS} w from benchmark),
wins as (
  select distinct item_id, least(len(w), {WINDOW}) k, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') win
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) p from items where len(w) > 0)),
places as (select r, w, unnest(range(1, len(w) + 1)) p from d),
seen as (
  select r, p, k, array_to_string(w[p:p + k - 1], ' ') win
  from places join (select distinct k from wins) on p + k - 1 <= len(w)),
hits as (select r, p, k, item_id from seen join wins using (k, win)),
words as (select r, count(distinct q) n from (select r, unnest(range(p, p + k)) q from hits) group by 1),
found as (select r, count(*) n, string_agg(item_id, ',' order by item_id) ids from (select distinct r, item_id from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(words.n, 0)::bigint n_hit, coalesce(found.n, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
from d left join words using (r) left join found using (r)
"""
