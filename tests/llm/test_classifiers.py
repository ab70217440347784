"""The two classifiers against plain versions: dictionaries, one text and one gram at a time."""

import math
import re

import numpy as np
import pytest

from tiersmith.llm import language_id, quality

TEXTS = {
    "en": ["the cat sat on the mat and looked at the rain", "where there is a will there is a way", "she said that this was the best of them"],
    "de": ["der hund lief durch den wald und bellte laut", "wo ein wille ist da ist auch ein weg", "sie sagte dass es das beste von allen sei"],
    "fr": ["le chat dort sur le lit et regarde la pluie", "quand on veut on peut dit le proverbe", "elle a dit que c'était le meilleur de tous"],
    "es": ["el perro corre por el campo y ladra mucho", "querer es poder dice el refrán de siempre", "ella dijo que era el mejor de todos ellos"],
    "ru": ["кошка сидит на окне и смотрит на дождь", "где есть желание там найдётся и путь", "она сказала что это лучшее из всего"]}


def plain_decision(model, text):
    """Family by the largest margin, then votes of its pairs, from gram weights summed byte by byte."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    mask = (1 << 32) - 1

    def buckets(i):
        b, before, two = raw[i], raw[i - 1] if i > 0 else 32, raw[i - 2] if i > 1 else 32
        pair = (b * 0x9E3779B1 + before * 0x85EBCA77) & mask
        return (pair * 0x165667B1 & mask) >> 20, ((pair ^ (two * 0xC2B2AE3D & mask)) * 0x27D4EB2F & mask) >> 20

    places = [p for i in range(len(raw)) for p in buckets(i)]

    def margin(w):
        return sum(float(w[p]) for p in places) / len(raw) + float(w[-1])

    def squash(m):
        return 1 / (1 + math.exp(-max(-50, min(50, 4 * m))))

    margins = [margin(w) for w in model["family_weights"]]
    order = sorted(margins)
    family = model["families"][margins.index(order[-1])]
    sure, names = squash((order[-1] - order[-2]) / 2), model["members"][family]
    if len(names) == 1:
        return names[0], sure
    votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            m = margin(model["pairs"][a, b])
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
    best = max(names, key=lambda v: votes[v] + 1e-3 * math.tanh(total[v]))
    return best, sure * squash(total[best] / (len(names) - 1))


def test_languages_equal_the_plain_decision(spark):
    rows = [(i, t + f" {'x' * (k % 3)}", lang) for i, (lang, t, k) in enumerate((lang, t, k) for lang, ts in TEXTS.items() for t in ts for k in range(4))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == sorted(TEXTS) and len(model["families"]) == 3
    asked = [(i, t) for i, t in enumerate([*(t for ts in TEXTS.values() for t in ts), "A", "Das ist ein Test.", "12 a 34", "это тест", "zxq!", "é"])]
    got = language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert len(got) == len(asked)
    for r in got:
        lang, score = plain_decision(model, dict(asked)[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-5)
    held = {t: lang for lang, ts in TEXTS.items() for t in ts}
    assert all(r.lang_pred == held[dict(asked)[r.doc_id]] for r in got if dict(asked)[r.doc_id] in held)


def plain_features(text):
    """Buckets with their shares, by dictionaries, from the same hashed streams."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    f, _ = quality.features(raw, np.array([0, len(raw)]))
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    assert len(f) == len(words)
    out = {}
    for row in f.tolist():
        for place in row:
            out[place] = out.get(place, 0) + 1
    return {k: v / max(1, len(words)) for k, v in out.items()}


def plain_leader(examples):
    """Follow-the-regularised-leader, one weight at a time, as published; the same order of examples."""
    z, n, draw = {}, {}, np.random.default_rng(5)

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        s = math.copysign(1, z[i])
        return (s * quality.L1 - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for k in draw.permutation(len(examples)).tolist():
            x, y = examples[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_quality_scores_equal_the_plain_leader(spark):
    good = [f"This sentence number {i} tells a quiet story about rivers, hills and w{i}." for i in range(30)]
    bad = [f"BUY!!! now$$$ {i} *** CHEAP### w{i} &&& CLICK!!!" for i in range(30)]
    docs = list(enumerate([*good, *bad, "", None, "One word", "BUY!!! a river"]))
    labels = [(i, 1 if i < 30 else 0) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(frame, model).collect()}

    def example(text, y):
        x = plain_features(text)
        at = np.array(sorted(x), np.int32)
        return at, np.array([x[i] for i in at.tolist()], np.float32), y

    made = sorted((example(dict(docs)[i], y) for i, y in labels),
                  key=lambda e: (e[2], len(e[0]) + 1, np.append(e[0], quality.BUCKETS).astype(np.int64).tobytes(), np.append(e[1], 1.0).astype(np.float64).tobytes()))
    weights = plain_leader([({**dict(zip(at.tolist(), x.astype(float).tolist())), quality.BUCKETS: 1.0}, y) for at, x, y in made])
    for i, text in docs:
        value = sum(weights.get(k, 0.0) * v for k, v in plain_features(text).items()) + weights.get(quality.BUCKETS, 0.0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-value)), abs=1e-4)
    assert min(got[i] for i in range(30)) > 0.7 > max(got[i] for i in range(30, 60))
