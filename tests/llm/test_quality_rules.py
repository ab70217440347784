import re

import pytest

from tiersmith.llm import quality_rules as q

GOOD = "\n".join(f"Here w{i}a stands, w{i}b follows w{i}c and ends in w{i}d." for i in range(12))
RUN = "one two three four five six seven eight"
CASES = [
    (1, GOOD), (2, None), (3, ""), (4, " \n\x0b\t"), (5, "too short a text."), (6, GOOD + "\nHome | About | Contact | Imprint"),
    (7, "\n".join(f"menu item {i} | next | more" for i in range(20))), (8, GOOD + "\n" + GOOD), (9, " ".join([RUN] * 3) + "."),
    (10, GOOD + "\nAll Rights Reserved by the owners of this site."), (11, "\n".join(f"BUY!! NOW!! {i}!! CHEAP!!" for i in range(12))),
    (12, "\n".join(f"word{i}*** more### signs$$$ here%%% again." for i in range(9))), (13, RUN + " nine " + RUN + " nine ten."),
    (14, "Ünï 世界  x\x01y " + GOOD), (15, "a" * 40_000 + "."), (16, " ".join(f"w{i * 7919 % 30011}" for i in range(20_000)) + "."),
    (None, GOOD), (1, "the same id again, " * 6 + "with another text than before."), (17, "x " * 5000 + ".")]


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i:i + 8]), []).append(i)
    twice = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bad, kept_lines = 0, []
    for x in (text or "").split("\n"):
        full = re.sub(q.BLANK, "", x)
        n = len([w for w in re.split(q.BLANK + "+", x) if w])
        bars = len(re.findall(q.SEPARATORS.replace(r"\z", r"\Z"), x))
        wrong = bool(full) and (
            full[-1] not in q.ENDS or 100 * sum(c in q.SYMBOLS for c in x) > 10 * len(full)
            or (n >= 4 and 2 * len(re.findall(q.CRIES.replace(r"\z", r"\Z"), x)) > n) or (bars >= 2 and 4 * bars >= n)
            or any(p in x.lower() for p in q.PHRASES))
        bad += len(full) if wrong else 0
        if not wrong:
            kept_lines.append(x)
    chars = sum(map(len, words))
    failed = len(words) < 20 or 100 * len(twice) > 30 * len(words)
    return (len(words), chars, sum(c in q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(twice), failed,
            not failed and 100 * bad <= 50 * chars, None if text is None else "\n".join(kept_lines))


@pytest.fixture(scope="module")
def cleaned(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in CASES], "doc_id long, text string, n_words int, row string").repartition(3)
    return q.clean(docs).collect()


def test_every_document_equals_brute_force(cleaned):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept,
                  str(r.clean_text)) for r in cleaned)
    assert got == sorted((str(i), *(b := brute(t))[:-1], str(b[-1])) for i, t in CASES)


def test_lines_go_and_clean_documents_stay(cleaned):
    by = {(r.doc_id, r.text): r for r in cleaned}
    assert by[1, GOOD].kept and by[1, GOOD].clean_text == GOOD and by[1, GOOD].row == "x"
    for i in (6, 10):
        r = by[i, dict(CASES)[i]]
        assert r.kept and r.clean_text == GOOD and r.n_bad_lines == 1
    assert not any(by[i, dict(CASES)[i]].kept for i in (2, 3, 4, 5, 7, 8, 9, 11, 12))


def test_empty_table_and_plan_without_python(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    out = q.clean(none)
    assert out.collect() == [] and out.columns == ["doc_id", "text", *q.ADDED]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
