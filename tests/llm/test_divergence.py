"""Source divergence: against plain counting, the sketch, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t in df if df[t] >= 3}
        times = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in times.items()}, p(sum(times.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in times:
            terms = [(t, f(ps[s][t], q[t])) for t in kept if times[s][t] and ps[s][t] > q[t]]
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in times if o != s]
            for part, found, most in (("term", terms, top), ("pair", pairs, 10**9)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "delta2x", "éclair", "ÉCLAIR", "漢字", "naïve", "x", "rare"] + [f"w{chr(97 + k)}" for k in range(26)]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(12))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b", "B", None])) for k in range(n)]
    return [*docs, (900, None, "en", "mute"), (901, "", "fr", "a"), (902, "only once", "fr", "b"), (1, "alpha", "en", "a"), (1, "alpha", "en", "a")]


@pytest.mark.parametrize(("seed", "width"), [(1, 1 << 16), (2, 1 << 22)])
def test_against_plain_counting(spark, seed, width):
    rows = made(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(7))
    assert sorted(tuple(r) for r in divergence.audit(df, top=9, width=width, held_terms=20, at_once=8).collect()) == plain(rows, top=9)


def test_the_sketch_never_underestimates(spark):
    rng = random.Random(3)
    counts = [("en", f"t{rng.randrange(30_000)}", 1, [("s", 1, 1)]) for _ in range(60_000)]
    true = Counter(c[1] for c in counts)
    df = spark.createDataFrame(counts, divergence.COUNTS).repartition(7)
    stay = Counter(r.term for r in divergence.possible(df, divergence.sketch(df, 1 << 16)).collect())
    assert all(stay[t] == n for t, n in true.items() if n >= 3)
    assert sum(n < 3 for t, n in true.items() if t in stay) < 0.3 * sum(n < 3 for n in true.values())


def test_long_texts_are_read_in_pieces():
    text = "one TWO thréé 4 five-six " * 50 + "x" * 100
    got = [t for part in divergence._terms(text.encode(), 10) for t in part]
    assert got == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("TWO", "two"))]


def test_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    got = divergence.audit(spark.createDataFrame([(1, None, None, None), (2, None, None, "b")], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_cells_differ_by_row():
    cells = divergence._cells(np.arange(1000, dtype=np.int64) * 7_777_777_777_777, 1 << 18)
    assert len(cells) == divergence.DEPTH and all(0 <= c.min() and c.max() < 1 << 18 for c in cells)
    assert (cells[0] != cells[1]).mean() > 0.9
