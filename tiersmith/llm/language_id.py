"""Language identification in two levels.

A linear classifier over hashed byte n-grams first predicts the language
family; inside the family, one linear support vector machine for each pair of
languages votes. Both levels are fitted on a bounded sample of distinct
labelled texts (``per_language``, ``total_rows``), those of the smallest hashes
in each language, so that every labelled language is learned however often its
texts are repeated; prediction reads every byte of every row.

Rows without text or without a letter are ``und`` with score 0, and so is
everything if no row carries a label. A row shorter than three bytes has the
n-grams of its space-padded form. Repeated rows are predicted alike. Columns
beyond the named ones are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import bound_batches, row_blocks, text_bytes, written

# Language families of ISO 639-1 codes. Codes outside form a family of their own letter "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue"),
}
UNKNOWN = "und"
BUCKETS = 4096
ROUNDS = 120
PENALTY = 1e-3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, members in FAMILIES.items() if code in members), "other")


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the buckets of the two- and three-byte grams that end there; rows start after a space."""
    b = _FOLD[data]
    before, two = np.empty_like(b), np.empty_like(b)
    before[:1], before[1:] = 32, b[:-1]
    two[:2], two[2:] = 32, b[:-2]
    first = offsets[:-1][offsets[:-1] < len(b)]
    before[first] = 32
    two[first] = 32
    two[first[first + 1 < len(b)] + 1] = 32
    pair = b.astype(np.uint32) * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)
    triple = (pair ^ (two * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    return (pair * np.uint32(0x165667B1)) >> np.uint32(20), triple >> np.uint32(20)


def row_means(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over the bytes of a row of its grams' weights, for each weight vector; weights is (vectors, buckets)."""
    out = np.zeros((len(offsets) - 1, len(weights)))
    for lo, hi in row_blocks(offsets):
        start, part = offsets[lo], offsets[lo:hi + 1] - offsets[lo]
        length = np.diff(part)
        full = np.flatnonzero(length)
        if len(full) == 0:
            continue
        for at in range(0, int(part[-1]), 1 << 23) if hi == lo + 1 else (0,):
            # one row longer than a block: pieces of it, with the two bytes before each
            stop = min(int(part[-1]), at + (1 << 23)) if hi == lo + 1 else int(part[-1])
            lead = min(2, at)
            piece = data[start + at - lead:start + stop]
            ends = np.array([0, len(piece)]) if hi == lo + 1 else part
            two, three = (x[lead:] for x in gram_buckets(piece, ends))
            cut = np.zeros(1, np.int64) if hi == lo + 1 else part[full]
            for k, w in enumerate(weights):
                out[lo + full, k] += np.add.reduceat(w[two] + w[three], cut)
        out[lo:hi] /= np.maximum(length, 1)[:, None]
    return out


def counted(text: bytes) -> np.ndarray:
    """Gram frequencies of one text, scaled so that their weights add up as in row_means."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) == 0:
        return np.zeros(BUCKETS, np.float32)
    two, three = gram_buckets(raw, np.array([0, len(raw)]))
    n = np.bincount(two, minlength=BUCKETS) + np.bincount(three, minlength=BUCKETS)
    return (n / len(raw)).astype(np.float32)


def separate(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """A linear support vector machine: squared hinge loss, both classes of equal weight, accelerated gradient.

    Returns the weights and, last, the bias.
    """
    scale = float(np.sqrt((x * x).sum(1).mean())) or 1.0
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    z = np.hstack([x / scale, np.ones((len(x), 1), np.float32)])
    v = z.T @ (share * sign)
    for _ in range(8):  # the largest curvature, for the step
        v /= np.linalg.norm(v) or 1.0
        v = z.T @ (share * (z @ v))
    step = 1 / (2.4 * float(np.linalg.norm(v)) + PENALTY)
    w = look = np.zeros(z.shape[1], np.float32)
    for k in range(ROUNDS):
        slack = np.maximum(0, 1 - sign * (z @ look))
        new = look - step * (PENALTY * look - 2 * z.T @ (share * sign * slack))
        look, w = new + (k / (k + 3)) * (new - w), new
    w[:-1] /= scale
    return w


def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram frequencies of each text and of three short pieces of it, so that short texts are known too.

    A text counts once in a task.
    """
    seen = set()
    for batch in batches:
        langs, prints, rows = [], [], []
        texts = batch.column("text")
        for i, (lang, h) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist())):
            if (lang, h) in seen:
                continue
            seen.add((lang, h))
            raw = texts[i].as_py().encode()
            pieces = [raw] + [raw[len(raw) * k // 4:len(raw) * k // 4 + 30 * k] for k in (1, 2, 3)]
            langs.append(lang)
            prints.append(h)
            rows.append(b"".join(counted(piece).astype(np.float16).tobytes() for piece in pieces))
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(prints, pa.int64()), pa.array(rows, pa.binary())], names=["lang", "h", "x"])


def _by_language(values: dict[str, int]) -> Column:
    return F.create_map(*[v for k, n in values.items() for v in (F.lit(k), F.lit(n).cast("long"))])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 200,
        total_rows: int = 4000) -> dict:
    """Weights of both levels from at most ``per_language`` texts of a language and ``total_rows`` in all, but at least 20 a language.

    The sample of a language is its distinct texts of the smallest hashes. A
    bound from the exact number of them leaves about twice as many hashes as are
    wanted, and at least the smallest one, of which the last wanted is the cut.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    distinct = written(labelled.select("lang", "h").distinct(), "texts")
    counts = {r["lang"]: (r["n"], r["least"]) for r in distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}
    if not counts:
        return {"langs": []}
    each = max(20, min(per_language, total_rows // len(counts)))
    below = {k: max(least, min((1 << 63) - 1, (1 << 64) * (2 * each + 40) // n - (1 << 63))) for k, (n, least) in counts.items()}
    hashes = distinct.where(F.col("h") <= _by_language(below)[F.col("lang")])
    last = F.array_max(F.slice(F.sort_array(F.collect_list("h")), 1, each))
    cuts = {r["lang"]: r["last"] for r in hashes.groupBy("lang").agg(last.alias("last")).collect()}
    drawn = labelled.where(F.col("h") <= _by_language(cuts)[F.col("lang")])
    once = drawn.mapInArrow(samples, "lang string, h long, x binary").groupBy("lang", "h").agg(F.first("x").alias("x"))
    got = once.orderBy("lang", "h").select("lang", "x").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    names = np.repeat(np.array(got.column("lang").to_pylist(), dtype=object), len(x) // len(got))
    langs = sorted(set(names))
    families = sorted({family_of(v) for v in langs})
    members = {f: [v for v in langs if family_of(v) == f] for f in families}
    kin = np.array([family_of(v) for v in names], dtype=object)
    against_rest = [separate(x, np.where(kin == f, 1, -1).astype(np.float32)) for f in families] if len(families) > 1 else []
    pairs = {}
    for f in families:
        for i, a in enumerate(members[f]):
            for b in members[f][i + 1:]:
                own = (names == a) | (names == b)
                pairs[a, b] = separate(x[own], np.where(names[own] == a, 1, -1).astype(np.float32))
    return {"langs": langs, "families": families, "members": members, "family_weights": against_rest, "pairs": pairs}


def decide(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row: family by the highest margin, then the votes of the family's pairs."""
    n = len(offsets) - 1
    families = model["families"]
    chosen, sure = np.zeros(n, np.int64), np.ones(n)
    squash = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
    if len(families) > 1:
        w = np.stack(model["family_weights"])
        margins = row_means(w[:, :-1], data, offsets) + w[:, -1]
        chosen = margins.argmax(1)
        ranked = np.sort(margins, 1)
        sure = squash((ranked[:, -1] - ranked[:, -2]) / 2)
    langs = np.empty(n, dtype=object)
    for k, f in enumerate(families):
        rows, names = np.flatnonzero(chosen == k), model["members"][f]
        if len(rows) == 0:
            continue
        if len(names) == 1:
            langs[rows] = names[0]
            continue
        couples = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
        w = np.stack([model["pairs"][c] for c in couples])
        if len(rows) == n:
            part, ends = data, offsets
        else:
            length = np.diff(offsets)
            part = data[np.repeat(np.isin(np.arange(n), rows), length)]
            ends = np.concatenate([[0], np.cumsum(length[rows])])
        margins = row_means(w[:, :-1], part, ends) + w[:, -1]
        votes, total = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
        for j, (a, b) in enumerate(couples):
            i, o = names.index(a), names.index(b)
            votes[:, i] += margins[:, j] >= 0
            votes[:, o] += margins[:, j] < 0
            total[:, i] += margins[:, j]
            total[:, o] -= margins[:, j]
        best = (votes + 1e-3 * np.tanh(total)).argmax(1)
        langs[rows] = np.array(names, dtype=object)[best]
        sure[rows] *= squash(total[np.arange(len(rows)), best] / (len(names) - 1))
    return langs, sure


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``keep`` with the language and the score, called ``names``, for every row."""
    others = [c for c in keep if c != text]
    known = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)], F.col(text).alias("v"),
                        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    fields = known.schema.fields[:-1] if text in keep else known.schema.fields[:-2]  # the text passes once
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            if shared.value["langs"] and rows:
                langs, score = decide(shared.value, *text_bytes(batch.column("v")))
                none = ~np.asarray(batch.column("letters"))
                langs[none], score[none] = UNKNOWN, 0.0
            else:
                langs, score = [UNKNOWN] * rows, np.zeros(rows)
            carried = [f.name for f in fields]
            yield pa.record_batch([*[batch.column(c) for c in carried], pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                                  names=[*carried, "lang_pred", "score"])

    out = known.mapInArrow(run, f"{kinds}lang_pred string, score double")
    return out.select(*[F.col("v" if c == text else f"k{others.index(c)}").alias(c) for c in keep],
                      F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def accepted(found: Column, score: Column, least: float = 0.25) -> Column:
    """Whether a prediction is good enough to keep the document."""
    return (found != UNKNOWN) & (score >= least)
