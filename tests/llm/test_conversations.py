import hashlib
import re
import zlib
from itertools import product

import pytest

from tiersmith.llm import conversations as c
from tiersmith.llm import queries

FILLED = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, at long"


def cheapest(symbols):
    """(cost, edits, roles): plain dynamic programming forwards over whole edit strings, the least string at each state."""
    def inserted(best):
        while True:
            more = dict(best)
            for s, (cost, edits, roles) in best.items():
                new = {0: "u", 1: "u", 2: "a", 3: "u"}[s]
                to = 3 if new == "a" else 2
                more[to] = min(more.get(to, (1 << 40, "", "")), (cost + 3, edits + "I", roles + new))
            if more == best:
                return best
            best = more

    best = inserted({0: (0, "", "")})
    for initial, fault in symbols:
        after = {}

        def put(s, entry):
            after[s] = min(after.get(s, (1 << 40, "", "")), entry)

        for s, (cost, edits, roles) in best.items():
            put(s, (cost + 4, edits + "D", roles))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                forced = "a" if s == 2 else "u"
                put(3 if forced == "a" else 2, (cost + 3 + more, edits + "R", roles + forced))
                if initial == "s" and s == 0:
                    put(1, (cost + more, edits + "K", roles + "s"))
                if initial == forced:
                    put(3 if forced == "a" else 2, (cost + more, edits + "K", roles + forced))
        best = inserted(after)
    return min(v for s, v in best.items() if s in (0, 3))


def brute(rows):
    """The contract's row from the (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, symbols, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        filled = FILLED.findall(text)
        fault = "blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        symbols.append((role[:1], fault))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, roles = cheapest(symbols)
    assert re.fullmatch("(s?(ua)+)?", roles)
    out, old, new = [], iter(rows), iter(roles)
    for edit in audit:
        row = next(old) if edit != "I" else None
        if edit != "D":
            name = {"u": "user", "a": "assistant", "s": ""}[next(new)]
            out.append(f"{row[1] if edit == 'K' else name}:{row[2] if row else ''}")
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            out += [(conv, *row)] * (2 if h == 3 else 1)
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conversation(rows, ids):
    groups = {i: [] for i in ids}
    for conv, *row in rows:
        groups[conv].append(tuple(row))
    return {i: brute(g) for i, g in groups.items()}


def test_tables_on_every_short_conversation():
    """All sequences of up to four of nine symbols, the vectors' costs and the least strings of edits."""
    kinds = [("s", ""), ("u", ""), ("a", ""), ("x", ""), ("u", "blank"), ("s", "truncated"), ("u", "truncated"), ("a", "truncated"), ("", "truncated")]
    code = {k: 4 * " sua".find(k[0] or "x", 1) if k[0] in tuple("sua") else 0 for k in kinds}
    number = {"": 0, "blank": 1, "truncated": 3}
    cases = [p for n in range(1, 5) for p in product(kinds, repeat=n)]
    segments = c.Segments([bytes(code[k] + number[k[1]] for k in case) for case in cases])
    t = c.tables()
    assert len(t.vectors) < 100 and (t.vectors.min(1) == 0).all()
    before, added, behind = segments.back(segments.sizes * 0)
    texts, ends = segments.trace(behind, c.START)
    for case, v, total, text, end in zip(cases, before, added, texts, ends):
        cost, audit, _ = cheapest(case)
        assert (int(total + t.vectors[v][c.START]), text + t.ending[end]) == (cost, audit), case


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = by_conversation(harmed(rows), {r[0] for r in rows})
    got = queries.QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bits", [14, 2])
def test_odd_rows_and_long_conversations(spark, monkeypatch, bits):
    """Nulls anywhere, repeated turns and rows, unknown roles, one conversation with most rows; segments of many and of few turns."""
    monkeypatch.setattr(c, "SEGMENT_BITS", bits)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", None), (1, None, "user", "x"), (1, None, "user", "x"),
            (2, 5, "tool", "y."), (2, 5, "", "z."), (2, 9, "system", "w!"), (3, 0, "user", ""), (4, -3, "system", "only."), (4, 4, "assistant", "é?  "),
            (5, 1, "sales", "q."), (5, 2, "u", "q."), (5, 3, "a", "q. \x0b")]
    roles, texts = ("user", "assistant", "system", "user", "assistant", None), ("Yes.", "No", "Well?", "", "A longer turn.", "yes.", "Hm")
    rows += [(7, i // 2 if i % 11 else None, roles[i * 7919 % 6], texts[i * 104729 % 7] + str(i * 31 % 17) * (i % 3) + "." * (i % 4 == 1)) for i in range(700)]
    rows += [(100 + i, j, ("user", "assistant")[j % 2], f"turn {j}.") for i in range(60) for j in range(i % 7)]
    ids = {r[0] for r in rows}
    df = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(7)
    hurt = queries.damaged(df)
    done = c.repair(hurt, df.select("conv_id"))
    sums = {r.id: r.repaired_sha256 for r in queries.lines_sha256(done.turns).collect()}
    got = {r.conv_id: (*(r[f] for f in FIELDS[:-1]), sums.get(r.conv_id, hashlib.sha256().hexdigest())) for r in done.summary.collect()}
    assert got == by_conversation(harmed(rows), ids)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = c.repair(none, none.select("conv_id"))
    assert done.summary.collect() == [] and done.turns.collect() == []
