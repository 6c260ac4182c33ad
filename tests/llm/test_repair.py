"""Conversation repair: against brute force over all edits, odd rows, long conversations."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from siltstone.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ends = text.rstrip(repair.BLANKS)[-1:]
        out.append("blank" if not ends else "duplicate" if (role, text) in seen else "" if ends in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, audit, turns) over all edits with at most two inserts in a row, without a layer of states."""
    marks, best = faults(rows), []

    def go(k, said, audit, cost, turns, inserts):
        if best and cost > best[0][0]:
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            best[:] = [min([*best, (cost, audit, turns)])]
        if inserts < 2:
            for role in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", said + role[0]):
                    go(k, said + role[0], audit + "I", cost + 5, [*turns, (role, "")], inserts + 1)
        if k == len(rows):
            return
        (role, text), fault = rows[k], marks[k]
        go(k + 1, said, audit + "D", cost + 2, turns, 0)
        if fault in ("", "truncated"):
            more = 5 * (fault == "truncated")
            for edit, new, own in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                if re.fullmatch("s?(ua)*u?", said + new[:1]) and new:
                    go(k + 1, said + new[0], audit + edit, cost + own + more, [*turns, (new, text)], 0)

    go(0, "", "", 0, [], 0)
    return best[0]


def digest(turns):
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


def made(seed, n, most=7):
    rng = random.Random(seed)
    texts = ["one.", "two!", "three?", "cut", " ", "", "end. \n", "x"]
    return {
        c: [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(texts) + str(rng.choice(["", "", k]) or "")) for k in range(rng.randrange(most))]
        for c in range(n)
    }


def test_against_brute_force(spark):
    talks = {c: [(r, t + ("." if k % 3 else "")) for k, (r, t) in enumerate(rows)] for c, rows in made(5, 60).items()}
    flat = [(c, k, role, text) for c, rows in talks.items() for k, (role, text) in enumerate(rows)]
    df = spark.createDataFrame(flat, SCHEMA).withColumn("audit", F.lit("clash")).withColumn("conv", F.lit(1))
    got = {r.conv_id: r for r in repair.audit(df).collect()}
    turns = {}
    for r in repair.repair(df).orderBy("conv_id", "number").collect():
        assert r.number == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append((r.role, r.text))
    assert set(got) == {c for c, rows in talks.items() if rows}
    for c, r in got.items():
        cost, audit, said = brute(talks[c])
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, digest(said)), talks[c]
        assert turns.get(c, []) == said
        marks = faults(talks[c])
        assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(m) for m in ("blank", "duplicate", "truncated"))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(talks[c], talks[c][1:], strict=False)]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 4, "user", "a."), (1, 4, "user", "a."), (1, 9, "assistant", "b."),
        (None, 1, "user", "x."), (None, 2, "assistant", "y" * 300_000 + "."), (2, None, "user", "q."), (2, None, "assistant", "r."),
    ]
    got = {r.conv_id: r for r in repair.audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].audit, got[1].cost) == (4, 1, 1, "DKDK", 4)
    assert (got[None].audit, got[None].cost) == ("KK", 0)
    assert (got[2].gaps, got[2].audit) == (0, "RR")  # rows without a turn follow in the order of their roles
    assert repair.audit(spark.createDataFrame([], SCHEMA)).count() == repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = repair.audit(spark.createDataFrame(rows, SCHEMA), gone=F.lit(True)).where("conv_id = 1").first()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_keeps_few_rows_open():
    told, most = [], 0
    c = repair.Conversation(lambda *edit: told.append(edit))
    for k in range(40_000):
        c.add(k, ("user", "assistant", "assistant", "tool")[k % 4], f"{k}.", "" if k % 11 else "truncated")
        most = max(most, len(c.open))
    c.end()
    assert most < 200
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for edit, role, _ in told if edit != "D"))
    assert sum(edit != "I" for edit, _, _ in told) == 40_000


def test_letting_go_changes_nothing(monkeypatch):
    """The pruned and flushed recursion gives what the plain one gives."""
    for seed in range(200):
        rows = made(seed, 1, 60)[0]
        marks, told = faults(rows), []
        c = repair.Conversation(lambda *edit: told.append(edit))
        layer = repair.close({repair.START: (0, "")})
        for k, ((role, text), fault) in enumerate(zip(rows, marks, strict=True)):
            c.add(k, role, text, fault)
            layer = repair.step(layer, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        cost = c.end()
        assert (cost, "".join(e[0] for e in told)) == min(path for state, path in layer.items() if state in (repair.START, repair.ASSISTANT))


def test_damage_by_row(spark):
    import zlib

    rows = [(c, t, "assistant" if t % 2 else "user", f"Say {c} {t}. And?") for c in range(20) for t in range(6)]
    got = {}
    for r in queries.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = (("user" if kind == 4 else role), {1: "", 2: text.replace(".", "").replace("?", "")}.get(kind, text), kind == 0)
        assert got[c, t] == [want] * (2 if kind == 3 else 1)
