"""Mixing: targets, schedule, whole mixes against plain loops, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mix

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights, share=1.5, most=2.0):
    """Water filling by trial: the sources in the order of what they can give for their weight."""
    budget, full = sum(sizes) * share, set()
    while True:
        rest = [k for k in range(len(sizes)) if k not in full]
        level = (budget - sum(most * sizes[k] for k in full)) / sum(weights[k] for k in rest) if rest else 0
        over = [k for k in rest if level * weights[k] > most * sizes[k]]
        if not over:
            return [most * sizes[k] if k in full else level * weights[k] for k in range(len(sizes))]
        full |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 7, 100, 5000, 90000]) for _ in range(9)]
    df = spark.createDataFrame([(f"a{k}", n, 1) for k, n in enumerate(sizes)], "key string, source_size long, rows long")
    got = [r.target for r in mix.targets(df, mix.in_turn(3, 1, 2)).orderBy("key").collect()]
    assert got == pytest.approx(plain_targets(sizes, [(3, 1, 2)[k % 3] for k in range(9)]))


@pytest.mark.parametrize("short", [10_000, 1])
def test_schedule_is_gapless_and_even(spark, monkeypatch, short):
    monkeypatch.setattr(mix, "SHORT_LIST", short)  # with and without a broadcast of the sources
    monkeypatch.setattr(mix, "POINTS", 64)
    quota = {"a": 600, "b": 1, "c": 299, "d": 100, "e": 0}
    rows = mix.schedule(spark.createDataFrame(list(quota.items()), "key string, quota long")).orderBy("slot").collect()
    for key, n in quota.items():
        assert [r.rank for r in rows if r.key == key] == list(range(n))  # in order, none twice, none lacking
    assert len({r.slot for r in rows}) == 1000
    for n in range(50, 1000, 50):  # every beginning of the mix has each source near its share
        for key in "acd":
            assert abs(sum(r.key == key for r in rows[:n]) - quota[key] * n / 1000) < 5


def test_mix_against_plain_loops(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(f"d{k}w{j}" for j in range(rng.choice([0, 1, 3, 40, 500]))), rng.choice(["x", "y", "y", "y", None, "é"])) for k in range(120)]
    docs += [(7, "again and again", "y")] * 5 + [(None, "no name here", "x"), (None, None, None), (200, "\t \n", "empty")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("slot", F.lit("clash")).withColumn("size", F.lit("clash"))
    block = 16
    taken = mix.mix(df, mix.in_turn(3, 1, 2), block=block)
    rows = mix.account(df, mix.in_turn(3, 1, 2), block=block).collect()
    assert sorted(str((r.doc_id, r.source, r.size)) for r in rows) == sorted(str((d, s, len((t or "").split()))) for d, t, s in docs)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = plain_targets([sum(r.size for r in sizes[s]) for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])
    for source, target in zip(order, want, strict=True):
        assert sizes[source][0].target == pytest.approx(target)
        assert sum(r.taken for r in sizes[source]) == int(sizes[source][0].target)
    pieces = [r for r in taken.collect() if r.slot is not None]
    slots = {}
    for r in pieces:
        slots.setdefault(r.slot, []).append(r)
    full = [sum(r["last"] - r["first"] for r in part) for part in slots.values()]
    assert all(n == block for n in full if n < block) or sum(n < block for n in full) <= len(order)  # only a source's last block is shorter
    assert max(full) == block and all(len({(r.key, r["rank"]) for r in part}) == 1 for part in slots.values())
    # the words of the pieces are those of the texts, each at most twice
    plain = spark.createDataFrame([d for d in docs[:120]], SCHEMA)
    words = {k: (t or "").split() for k, t, _ in docs[:120]}
    for r in mix.text_of(mix.mix(plain, mix.in_turn(3, 1, 2), block=block), plain).collect():
        found = r.text.split()
        assert not found or " ".join(found) in " ".join(words[int(found[0].split("w")[0][1:])])


def test_nothing(spark):
    assert mix.account(spark.createDataFrame([], SCHEMA), mix.in_turn(1)).count() == 0
    rows = mix.account(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA), mix.in_turn(3, 1)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_points_step_by_the_golden_ratio(spark):
    slots = [0, 1, 2, (1 << 20) - 1, 1 << 20, (1 << 33) + 12345]
    got = [r.p for r in spark.createDataFrame([(k,) for k in slots], "k long").select(mix.point(F.col("k")).alias("p")).collect()]
    assert got == [k * mix.STEP % (1 << mix.GRID_BITS) for k in slots]
