"""Removal of repeated multi-line chunks, in DataFrame functions only.

The lines of a text are hashed; a hash rolling over the last two line hashes
ends a chunk where it is 0 modulo ``SPREAD``, so that the same run of lines is
cut alike wherever it stands and an inserted line shifts no boundary but its
own. A line with ``LONG`` blanks or more is a boundary on both sides: a long
passage pasted as one line is a chunk by itself. Chunks count if they have two
lines that are not blank, or are such a long line.

Chunk hashes that occur more than once give candidates. Candidates are grouped
by their whole text, which is the comparison of bytes. The first occurrence, by
id, text hash and place, stays; all others go. Nothing is gathered per chunk,
so a chunk that a third of all documents share is pre-aggregated like any other.

A null text has no lines and stays null; an empty text is one blank line. Rows
equal in id and text are one document and share its decisions. A null id comes
after all others. All columns are carried along, whatever their names.

``deduplicate`` is this rule and has its SQL twin. It misses most passages of
few lines, whose first and last chunk fuse with the lines around them.
``deduplicate_passages`` adds line windows to the chunks: from every line
onwards, and back from every line, the fewest lines that hold more than
``LONG`` words. Such a window depends on its own lines only, and together they
cover every run of lines of more than ``LONG`` words, so every repeated run is
found whole, however it is laid out. Windows and chunks are compared by their
128-bit hashes. A line goes if it lies in a later occurrence that doesn't
overlap the first one; each line that goes has an equal one that stays. Not
found: runs of up to ``LONG`` words that are no chunk, and passages whose line
breaks differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import written

SPREAD = 4
LONG = 50
#: Hashes of repeated chunks, and places to remove, are broadcast up to this number (some 50 MB); beyond, they are joined.
BROADCAST_ROWS = 1_000_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; a plain column could be computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(text: Column) -> Column:
    """Array of (pos, lines, counts, text): the content-defined chunks of a text, in order."""
    def line(x: Column) -> Column:
        long = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= LONG
        h = F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")
        return F.struct(x.alias("x"), h.alias("h"), long.alias("long"), (F.trim(x) != "").cast("int").alias("full"))

    def ends(facts: Column, n: Column) -> Column:
        def is_end(i: Column) -> Column:
            now, before, after = F.get(facts, i - 1), F.get(facts, i - 2), F.get(facts, i)
            rolling = now["h"] + 31 * F.coalesce(before["h"], F.lit(0))
            return (i == n) | now["long"] | F.coalesce(after["long"], F.lit(False)) | (rolling % SPREAD == 0)

        return F.filter(F.sequence(F.lit(1), n), is_end)

    def cut(lines: Column, facts: Column, stops: Column) -> Column:
        def piece(k: Column) -> Column:
            start = F.coalesce(F.get(stops, k - 2), F.lit(0)) + 1
            size = F.get(stops, k - 1) - start + 1
            full = F.aggregate(F.slice(facts, start, size), F.lit(0), lambda n, f: n + f["full"])
            return F.struct(k.alias("pos"), start.alias("start"), size.alias("lines"), (F.get(facts, start - 1)["long"] | (full >= 2)).alias("counts"),
                            F.array_join(F.slice(lines, start, size), "\n").alias("text"))

        return F.transform(F.sequence(F.lit(1), F.size(stops)), piece)

    return _let(F.split(text, "\n"), lambda lines: _let(F.transform(lines, line), lambda facts: _let(
        ends(facts, F.size(lines)), lambda stops: cut(lines, facts, stops))))


def units(text: Column) -> Column:
    """Array of (pos, lines, h): the windows of just over LONG words and the counting chunks, by first line, number of lines and hash."""
    def reach(near: Column) -> Column:
        """How many of these lines hold more than LONG words; null if all of them don't."""
        return F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda s, f: F.when(s["n"] > LONG, s).otherwise(
            F.struct((s["n"] + f["words"]).alias("n"), (s["k"] + 1).alias("k"))), lambda s: F.when(s["n"] > LONG, s["k"]))

    def span(first: Column, last: Column) -> Column:
        return F.struct(first.cast("int").alias("pos"), (last - first + 1).cast("int").alias("lines"))

    def windows(full: Column) -> Column:
        # blank lines before and behind are also taken along, so that those inside a run are covered
        def around(f: Column, i: Column) -> Column:
            onwards = _let(reach(F.slice(full, i + 1, LONG + 1)), lambda k: _let(F.get(full, i + k - 1)["pos"], lambda last: F.array(
                span(f["pos"], last), span(F.coalesce(F.get(full, i - 1)["pos"] + 1, f["pos"]), last))))
            back = _let(reach(F.reverse(F.slice(full, F.greatest(i + 1 - LONG, F.lit(1)), F.least(i + 1, F.lit(LONG + 1))))),
                        lambda k: _let(F.get(full, i - k + 1)["pos"], lambda first: F.array(
                            span(first, f["pos"]), span(first, F.coalesce(F.get(full, i + 1)["pos"] - 1, f["pos"])))))
            return F.concat(onwards, back)

        return F.filter(F.flatten(F.transform(full, around)), lambda u: u["pos"].isNotNull() & u["lines"].isNotNull())

    def hashed(lines: Column, spans: Column) -> Column:
        return F.transform(spans, lambda u: F.struct(u["pos"].alias("pos"), u["lines"].alias("lines"), F.unhex(F.md5(
            F.array_join(F.slice(lines, u["pos"], u["lines"]), "\n").cast("binary"))).alias("h")))

    pieces = F.transform(F.filter(chunks(text), lambda c: c["counts"]), lambda c: span(c["start"], c["start"] + c["lines"] - 1))
    return _let(F.split(text, "\n"), lambda lines: _let(
        F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("pos"), F.regexp_count(x, F.lit(r"\S+")).alias("words"))), lambda f: f["words"] > 0),
        lambda full: hashed(lines, F.array_distinct(F.concat(pieces, windows(full))))))


def _order(key: str) -> Column:
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("print").alias("print"), F.col("pos").alias("pos"))


def removals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, gone): for each document that loses chunks, their places."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), chunks(F.col(text)).alias("c"))
    counting = rows.select("key", "print", F.explode(F.filter("c", lambda x: x["counts"])).alias("c")).select(
        "key", "print", F.col("c.pos").alias("pos"), F.col("c.text").alias("piece"), F.xxhash64("c.text").alias("h"))
    several = written(counting.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "several")
    found = written(counting.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "h", "left_semi"), "chunks")
    # written, so that the join is one that adaptive execution can split at a chunk with very many occurrences
    first = written(found.groupBy("h", "piece").agg(F.min(_order("key")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    gone = found.join(first, ["h", "piece"]).where(~_order("key").eqNullSafe(F.col("first")))
    return written(gone.groupBy("key", "print").agg(F.collect_set("pos").alias("gone")), "gone")


def repeated_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, gone): for each document that loses lines, their numbers from 1."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.explode(units(F.col(text))).alias("u"))
    every = written(rows.select("key", "print", "u.pos", "u.lines", "u.h"), "units")
    several = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "several")
    found = written(every.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "h", "left_semi"), "found")
    # written, so that the join is one that adaptive execution can split at a unit with very many occurrences
    first = written(found.groupBy("h").agg(F.min(_order("key")).alias("first")), "first")
    overlaps = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("print") == F.col("first.print")) & (
        F.col("pos") < F.col("first.pos") + F.col("lines"))  # the first itself is such a one
    gone = found.join(first, "h").where(~overlaps).select("key", "print", F.explode(F.sequence("pos", F.col("pos") + F.col("lines") - 1)).alias("line"))
    return written(gone.groupBy("key", "print").agg(F.collect_set("line").alias("gone")), "gone")


def _with_lost(docs: DataFrame, key: str, text: str, lost: DataFrame) -> DataFrame:
    """row, whole and gone of every document."""
    # Own names for everything that is not the caller's, so that no column can clash.
    taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"),
                        F.col(text).alias("whole"), F.xxhash64(text).alias("print"))
    lost = lost.toDF("lost_key", "lost_print", "gone")
    places = lost.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]  # no fewer than its rows
    lost = F.broadcast(lost) if places <= BROADCAST_ROWS else lost.hint("shuffle_hash")
    return taken.join(lost, F.col("key").eqNullSafe(F.col("lost_key")) & (F.col("print") == F.col("lost_print")), "left")


def _shortened(seen: DataFrame, columns: list[str], text: str, short: Column, lost_lines: Column) -> DataFrame:
    size = F.coalesce(F.length("whole") - F.length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return seen.select(*[(short if c == text else F.col("row")[c]).alias(c) for c in columns if c not in ("n_lines", "n_removed")],
                       size.alias("n_lines"), F.coalesce(lost_lines, F.lit(0)).cast("long").alias("n_removed"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns with the text shortened, then n_lines of the text before and n_removed of them, which replace columns so named."""
    joined = _with_lost(docs, key, text, removals(docs, key, text))
    parts = F.when(F.col("gone").isNotNull(), chunks(F.col("whole")))
    left = F.transform(parts, lambda c: F.struct(F.array_contains("gone", c["pos"]).alias("out"), c["lines"].alias("lines"), c["text"].alias("text")))
    seen = joined.select("row", "whole", left.alias("left"))
    lost_lines = F.aggregate("left", F.lit(0).cast("long"), lambda n, c: n + F.when(c["out"], c["lines"]).otherwise(0))
    kept = F.array_join(F.transform(F.filter("left", lambda c: ~c["out"]), lambda c: c["text"]), "\n")
    short = F.when(F.col("left").isNull(), F.col("whole")).otherwise(kept)
    return _shortened(seen, docs.columns, text, short, lost_lines)


def deduplicate_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``deduplicate``, but every repeated run of lines of more than LONG words goes, and not only chunks."""
    lines = F.split("whole", "\n")
    stay = F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("gone")))
    seen = _with_lost(docs, key, text, repeated_lines(docs, key, text)).select("row", "whole", stay.alias("stay"))
    kept = F.array_join(_let(lines, lambda x: F.transform("stay", lambda i: F.get(x, i - 1))), "\n")
    short = F.when(F.col("stay").isNull(), F.col("whole")).otherwise(kept)
    return _shortened(seen, docs.columns, text, short, F.size(lines) - F.size("stay"))


#: The same rows in DuckDB.
SQL = f"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) x, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents
  where text is not null),
facts as (
  select *, length(x) - length(replace(x, ' ', '')) >= {LONG} long, ('0x' || md5(x)[1:8])::bigint h,
    (trim(x) <> '')::int filled from lines),
ends as (
  select *, (lead(i) over w is null or long or coalesce(lead(long) over w, false)
    or (h + 31 * coalesce(lag(h) over w, 0)) % {SPREAD} = 0)::int stop from facts window w as (partition by doc_id order by i)),
cut as (
  select *, coalesce(sum(stop) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) pos from ends),
pieces as (
  select doc_id, pos, count(*) n, string_agg(x, chr(10) order by i) piece, bool_or(long) or sum(filled) >= 2 counts from cut group by 1, 2),
marked as (
  select *, counts and row_number() over (partition by counts, piece order by doc_id, pos) > 1 gone from pieces)
select d.doc_id, coalesce(m.n_lines, 0)::bigint n_lines, coalesce(m.n_removed, 0)::bigint n_removed,
  case when d.text is not null then coalesce(m.text, '') end text
from documents d left join (
  select doc_id, sum(n) n_lines, coalesce(sum(n) filter (gone), 0) n_removed, string_agg(piece, chr(10) order by pos) filter (not gone) as text
  from marked group by 1) m using (doc_id)
"""
