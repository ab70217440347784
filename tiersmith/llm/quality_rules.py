"""Line-first cleaning of documents by quality rules, in DataFrame functions only.

Every line with a word is judged by itself; a line that breaks a rule goes:

- *punctuation*: it doesn't end in a mark that ends or continues a sentence,
  more than ``SYMBOL_PERCENT`` of its characters are symbols, or it has four
  words and more than half of its words end in ``!`` or ``?``;
- *navigation*: it has two or more separators that stand alone, and these are a
  quarter of its words;
- *boilerplate*: it holds a phrase of ``PHRASES``, whatever its case.

A document that loses more than ``LOST_PERCENT`` of its characters (blanks not
counted) in this way is rejected. So is one that fails the base measures, which
are taken from the whole text as it came: fewer than ``LEAST_WORDS`` words, or
more than ``REPEAT_PERCENT`` of them in runs of eight words that stand in the
text twice or more.

Everything is worked out within the row, so no row is shuffled and no key, line
or passage can be hot; a document costs time in proportion to its length
(n log n where it repeats itself). Runs of words are compared by 64-bit hashes.
Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words and fails; its clean
text is null. An empty text, and one of blanks, fails with zeros. Rows that
repeat an id are judged each by its own text. All other columns are carried
along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10
LOST_PERCENT = 50
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A line ends well in one of these marks, and blanks behind them.
ENDS = ".!?…:;,\"')]”’»。！？"
CRIES = rf"[!?]+({BLANK}|\z)"
SEPARATORS = rf"(^|{BLANK})([|>/»·•]|->|::)({BLANK}|\z)"
#: Phrases of page furniture.
PHRASES = (
    "all rights reserved", "cookie policy", "enable javascript", "follow us on", "forgot password", "lorem ipsum", "powered by",
    "privacy policy", "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies")
ADDED = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_chars",
         "base_failed", "kept")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(x: Column, signs: str) -> Column:
    return F.translate(x, signs, "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def runs(found: Column) -> Column:
    """A hash of each run of RUN neighbouring words."""
    return _let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= RUN, F.transform(
        F.sequence(F.lit(0), F.size(h) - RUN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)]))))


def repeated(hashes: Column) -> Column:
    """How many words lie in runs that occur twice or more; null hashes have none."""
    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda s, k: (s["h"] == F.get(ordered, k - 1)["h"]) | F.coalesce(s["h"] == F.get(ordered, k + 1)["h"], F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda s: s["i"]))
        return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, i: F.struct(
            (i + RUN).alias("end"), (s["n"] + RUN - F.greatest(s["end"] - i, F.lit(0))).alias("n")), lambda s: s["n"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(ordered, covered)).otherwise(0)


def _has_phrase(lower: Column) -> Column:
    return reduce(or_, [F.contains(lower, F.lit(p)) for p in PHRASES])


def judge(line: Column, phrases: Column) -> Column:
    """(full, symbols, bad) of a line: characters that are no blanks, symbols, and whether it breaks a rule.

    A line without a word breaks none. ``phrases`` says whether its document has a phrase.
    """
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    cries = (F.contains(line, F.lit("!")) | F.contains(line, F.lit("?"))) & (n >= 4) & (2 * F.regexp_count(line, F.lit(CRIES)) > n)

    def judged(x: Column) -> Column:
        full, symbols = x["full"], x["symbols"]
        punctuation = ~F.contains(F.lit(ENDS), x["last"]) | (100 * symbols > SYMBOL_PERCENT * full) | cries
        navigation = F.rlike(line, F.lit("[|>/»·•:]")) & (bars >= 2) & (4 * bars >= n)
        bad = (full > 0) & (punctuation | navigation | (phrases & _let(F.lower(line), _has_phrase)))
        return F.struct(full.alias("full"), symbols.alias("symbols"), bad.alias("bad"))

    return _let(_without(line, BLANKS), lambda dense: _let(F.struct(
        F.length(dense).alias("full"), F.right(dense, F.lit(1)).alias("last"),
        (F.length(dense) - F.length(_without(dense, SYMBOLS))).alias("symbols")), judged))


def _total(facts: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(facts, F.lit(0).cast("long"), lambda n, f: n + value(f))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, then those of ``ADDED``, which replace columns of these names.

    ``clean_text`` is the text without the lines that break a rule,
    ``n_bad_lines`` and ``lost_chars`` say what went, ``kept`` is the verdict.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    seen = docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("whole"))
    seen = seen.select("row", F.split("whole", "\n").alias("lines"), words(F.col("whole")).alias("words"), F.lower("whole").alias("lower"))
    facts = _let(_has_phrase(F.col("lower")), lambda phrases: F.transform("lines", lambda x: judge(x, phrases)))
    seen = seen.select("row", "lines", F.size("words").cast("long").alias("n_words"), runs(F.col("words")).alias("runs"), facts.alias("facts"))
    filled = F.filter("lines", lambda x, i: F.get(F.col("facts"), i)["full"] > 0)
    good = F.array_join(F.filter("lines", lambda x, i: ~F.get(F.col("facts"), i)["bad"]), "\n")
    seen = seen.select(
        "row", F.when(F.col("row")[text].isNotNull(), good).alias("clean_text"), "n_words",
        _total(F.col("facts"), lambda f: f["full"]).alias("word_chars"), _total(F.col("facts"), lambda f: f["symbols"]).alias("n_symbols"),
        filled.alias("filled"), repeated(F.col("runs")).cast("long").alias("n_repeat_words"),
        _total(F.col("facts"), lambda f: f["bad"].cast("long")).alias("n_bad_lines"),
        _total(F.col("facts"), lambda f: F.when(f["bad"], f["full"]).otherwise(0)).alias("lost_chars"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    seen = seen.withColumn("n_dup_lines", (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long")) \
               .withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOST_PERCENT * F.col("word_chars")))
    return seen.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The same rows in DuckDB.
SQL = rf"""
with docs as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
lines as (select id, i, x, length(regexp_replace(x, '{BLANK}', '', 'g')) chars, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) n
  from (select id, unnest(string_split(t, chr(10))) x, unnest(range(len(string_split(t, chr(10))))) i from docs)),
judged as (
  select *, len(regexp_extract_all(x, {_sql_text(SEPARATORS)})) bars,
    not contains({_sql_text(ENDS)}, right(regexp_replace(x, '{BLANK}', '', 'g'), 1)) or 100 * len(regexp_extract_all(x, '[{SYMBOLS}]')) > {SYMBOL_PERCENT} * chars
      or (n >= 4 and 2 * len(regexp_extract_all(x, {_sql_text(CRIES)})) > n) punctuation,
    regexp_matches(lower(x), '{"|".join(PHRASES)}') phrase
  from lines where chars > 0),
by_line as (
  select id, count(*) - count(distinct x) n_dup_lines, coalesce(sum(chars) filter (punctuation or phrase or (bars >= 2 and 4 * bars >= n)), 0) lost
  from judged group by 1),
worded as (select id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from docs),
placed as (select id, unnest(range(len(w))) i, unnest(w) x, len(w) n from worded),
spans as (select id, i, n, concat_ws(' ', x, {", ".join(f"lead(x, {k}) over p" for k in range(1, RUN))}) run
  from placed window p as (partition by id order by i)),
twice as (select id, i from (select id, i, count(*) over (partition by id, run) k from spans where i <= n - {RUN}) where k > 1),
cover as (
  select id, sum(least({RUN}, coalesce(lead_i - i, {RUN}))) n_repeat_words
  from (select id, i, lead(i) over (partition by id order by i) lead_i from twice) group by 1),
base as (
  select w.doc_id, len(w)::bigint n_words, length(regexp_replace(t, '{BLANK}', '', 'g'))::bigint word_chars,
    len(regexp_extract_all(t, '[{SYMBOLS}]'))::bigint n_symbols, coalesce(n_dup_lines, 0)::bigint n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(lost, 0) lost
  from worded w left join by_line using (id) left join cover using (id)),
failed as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words base_failed from base)
select * exclude (lost), not base_failed and 100 * lost <= {LOST_PERCENT} * word_chars kept from failed
"""
