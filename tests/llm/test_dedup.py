"""Exact and near deduplication, sharding: against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import common, decontam, dedup, near, shard

SCHEMA = "doc_id long, text string, digest string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(3)


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "a b", "ab", "a\tb\n", " x", "x", "y" * 3, " ", "é"])) for i in range(200)]
    rows += [(1000 + i, "hot copy" + " " * (i % 3)) for i in range(150)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup.classify(frame(spark, rows)).collect()}
    assert got == exact_groups(rows)
    assert sorted(r.doc_id for r in dedup.deduplicate(frame(spark, rows)).collect()) == sorted({k for k, _ in got.values()})


def test_exact_of_nothing(spark):
    assert dedup.classify(frame(spark, [])).count() == 0


def test_state_goes_on_over_several_runs(spark):
    tool = dedup.Deduplicator(spark, common.scratch(spark, "test"))
    tool.add(dedup.fingerprints(frame(spark, [(5, "a"), (7, "b"), (9, "a b")])))
    tool.add(dedup.fingerprints(frame(spark, [(3, "a"), (11, "ab"), (1, "c")])))
    assert sorted((r.keep_id, r.n) for r in tool.groups().collect()) == [(1, 1), (3, 2), (7, 1), (9, 2)]


def test_a_digest_collision_is_seen_in_the_bytes(spark, monkeypatch):
    rows = [(1, "one"), (2, "two"), (3, "one"), (4, "else")]
    real = dedup.fingerprints
    monkeypatch.setattr(dedup, "fingerprints", lambda *a: real(*a).withColumn("digest", F.when(F.col("id") < 4, "same").otherwise(F.col("digest"))))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup.classify(frame(spark, rows)).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked(rows):
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else f"w{rng.randrange(10**6)}" for w in words)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one  TWO"), (5, "one two three four five"), (6, "É é é é é é"), (7, "é é é é é é")]
    for base in range(6):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        rows += [(100 * (base + 1) + k, mutated(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))) for k in range(25)]
    rows += [(5000 + k, "copy " * 3 + "of the same few words here") for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.link(frame(spark, rows)).collect()}
    assert got == linked(rows)
    assert {r.doc_id for r in near.deduplicate(frame(spark, rows)).collect()} == {i for i, (_, c) in got.items() if i == c}


def test_bands_follow_the_similarity():
    at = lambda *a: (near.Scheme(*a).side, near.Scheme(*a).least_equal)
    assert at() == (8, 19) and at(0.8, 1e-5) == (12, 27)
    assert near.Scheme(0.8).similar(80, 100) and not near.Scheme(0.8).similar(79, 100)


def test_near_at_another_similarity(spark):
    words = lambda base, n: " ".join(f"b{base}w{k}" for k in range(n))
    shared, rows = {0: 84, 1: 80, 2: 82, 3: 79}, []
    for base, n in shared.items():
        # 100 shingles, of which the copy has the first n
        rows += [(10 * base, words(base, 104)), (10 * base + 1, words(base, n + 4))]
    stage = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert stage == {0, 10, 20, 30, 31}
    linked_at = lambda s: {r.doc_id for r in near.link(frame(spark, rows), similarity=s).where("not kept").collect()}
    assert linked_at(0.79) == {1, 11, 21, 31} and linked_at(0.82) == {1, 21} and linked_at(0.85) == set()


def test_near_of_nothing_and_of_empty_texts(spark):
    assert near.link(frame(spark, [])).count() == 0
    assert all(r.kept and r.n_shingles == 0 for r in near.link(frame(spark, [(1, None), (2, " ")])).collect())


def test_rows_without_identifier_are_not_lost(spark):
    rows = [(None, "no identifier and no copy of these words"), (1, "has one"), (2, "has  one"), (3, None), (None, "HAS ONE")]
    for tool in (dedup, near):
        kept = [(r.doc_id, r.text) for r in tool.deduplicate(frame(spark, rows)).collect()]
        assert rows[0] in kept and rows[3] in kept
        assert len([i for i, _ in kept if i in (1, 2)]) == 1
    exact = {(r.doc_id, r.keep_id, r.kept) for r in dedup.classify(frame(spark, rows[:2])).collect()}
    assert exact == {(None, None, True), (1, 1, True)}
    near_rows = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near.link(frame(spark, rows)).collect())
    assert near_rows == [(0, 0, True), (0, 1, False), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(10, 60)]
    links = spark.createDataFrame(edges, "x long, y long")
    got = {r.id: r.component for r in near.components(links).collect()}
    assert {got[k] for k in range(101, 141)} == {100} and {got[k] for k in range(10, 60)} == {5}


def smallest(sizes, shards):
    def fits(c):
        n, s = 1, 0
        for x in sizes:
            if x > c:
                return False
            if s + x > c:
                n, s = n + 1, 0
            s += x
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if fits(m) else (m + 1, high)
    return low


@pytest.mark.parametrize("cells", [8, 64, 1 << 14])
def test_shards_are_minimax(spark, cells):
    rng = random.Random(cells)
    rows = [(i, "x" * rng.randrange(400) + str(rng.randrange(300))) for i in range(600)] + [(1000 + i, "the same" * 9) for i in range(120)]
    keyed = common.cut(shard.sized(frame(spark, rows)).select("key", "size"))
    groups = keyed.groupBy("key").agg(F.sum("size").alias("s")).orderBy("key").collect()
    capacity, starts = shard.cuts(keyed, 7, cells)
    assert capacity == smallest([r.s for r in groups], 7)
    sums = np.bincount(np.searchsorted(starts, [r.key for r in groups], "right"), [r.s for r in groups], 7)
    assert sums.max() == capacity


def test_placing(spark):
    rows = [(i, None if i % 50 == 0 else f"text {i % 90}") for i in range(500)] + [(3, "text 3")]
    out = shard.place(frame(spark, rows), 5, buckets=8).toPandas()
    assert len(out) == 501
    assert (out.groupby("text_crc32").shard.nunique() == 1).all()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert (out[out.text_crc32 == 0]["size"] == 8).all()
    assert shard.place(frame(spark, []), 5).count() == 0


def test_repeated_identifiers_are_rows_of_their_own(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "b b"), (3, "b b"), (None, "a"), (None, "q"), (None, "q")]
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in dedup.classify(frame(spark, rows)).collect())
    assert got == [(0, 0, 2, False), (0, 0, 2, True), (0, 1, 3, False), (1, 1, 1, True), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, False), (3, 3, 2, True)]
    kept = sorted((r.doc_id or 0, r.text) for r in dedup.deduplicate(frame(spark, rows)).collect())
    assert kept == [(0, "q"), (1, "a"), (1, "b"), (3, "b b")]


def test_two_runs_on_one_folder(spark, monkeypatch):
    folder = common.scratch(spark, "test")
    dedup.classify(frame(spark, [(5, "a"), (7, "b"), (9, "a b")]), folder=folder).collect()
    second = dedup.classify(frame(spark, [(3, "a"), (11, "ab"), (1, "c"), (12, " b")]), folder=folder)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in second.collect()) == [(1, 1, 1, True), (3, 3, 2, True), (11, 9, 2, False), (12, 12, 2, True)]
    # a text that only shares the digest of a stored one
    real = dedup.fingerprints
    monkeypatch.setattr(dedup, "fingerprints", lambda *a: real(*a).withColumn("digest", F.sha2(F.lit("c"), 256)))
    third = dedup.classify(frame(spark, [(20, "other"), (21, "c")]), folder=folder)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in third.collect()) == [(20, 20, 1, True), (21, 1, 2, False)]


def test_a_run_that_broke_off_is_repeated_without_counting_twice(spark, monkeypatch):
    folder = common.scratch(spark, "test")
    dedup.classify(frame(spark, [(5, "a"), (7, "b")]), folder=folder)
    real = dedup.Deduplicator.groups

    def broken(self):
        raise OSError("lost")

    monkeypatch.setattr(dedup.Deduplicator, "groups", broken)
    with pytest.raises(OSError, match="lost"):  # the rows have arrived, no decision stands
        dedup.classify(frame(spark, [(3, "a"), (4, "c")]), folder=folder)
    monkeypatch.setattr(dedup.Deduplicator, "groups", real)
    with pytest.raises(ValueError, match="did not finish"):
        dedup.classify(frame(spark, [(9, "other")]), folder=folder)
    again = dedup.classify(frame(spark, [(3, "a"), (4, "c")]), folder=folder)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in again.collect()) == [(3, 3, 2, True), (4, 4, 1, True)]
    last = dedup.classify(frame(spark, [(1, "c")]), folder=folder)
    assert [(r.doc_id, r.keep_id, r.group_size) for r in last.collect()] == [(1, 1, 2)]


def test_identifiers_may_be_texts(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "xy "), (None, "x  y"), (None, "z")]
    got = dedup.classify(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted((r.doc_id or "", r.keep_id or "", r.group_size) for r in got.collect()) == [("", "", 1), ("", "", 4), ("a", "", 4), ("b", "", 4), ("c", "", 4)]
    got = dedup.classify(spark.createDataFrame(rows[:3], "doc_id string, text string"))
    assert {r.keep_id for r in got.collect()} == {"b"}  # of the longest the smallest identifier


def test_words_of_a_pattern_that_cancels_in_polynomials():
    """Thue-Morse words: their polynomials agree modulo 2**64 whatever the base."""
    for n in (1 << 6, 1 << 11, 1 << 13):
        one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        sets = near.shingle_sets(*common.text_buffers(pa.array([one, two, one, f"x {one}", f"{one} x"])))
        assert len({tuple(s) for s in sets}) == 4 and (sets[0] == sets[2]).all()
        items = decontam.Items([one + " " + "q" * 40])
        text = two + " " + "q" * 40
        code, _, owner = decontam.normalise(*common.text_buffers(pa.array([text])))
        assert items._equal(code, decontam.sums(code), np.array([0, n]), np.array([0, n]), np.array([n, 41])).tolist() == [0, 41]
        assert items._equal(code, decontam.sums(code), np.array([1]), np.array([n // 2 + 1]), np.array([n // 2])).tolist()[0] in range(n // 2 + 1)


def test_near_keeps_the_texts_of_one_identifier_apart(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [(1, text(1)), (1, text(2)), (2, text(1) + " more"), (3, text(2) + " more"), (4, text(3)), (4, text(3))]
    got = sorted((r.doc_id, r.component_id) for r in near.link(frame(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert sorted(r.text[:2] for r in near.deduplicate(frame(spark, rows)).collect()) == ["t1", "t2", "t3"]


def test_near_copies_of_one_text_that_are_not_linked(spark):
    rng = random.Random(7)
    words = [f"u{k}" for k in range(60)]
    rows = [(k, mutated(rng, words, 0.04)) for k in range(400)]
    rows += [(1000 + k, " ".join([*words[:50], f"z{k % 20}", *(f"y{k // 20}v{j}" for j in range(6))])) for k in range(300)]
    got = {r.doc_id: r.component_id for r in near.link(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in linked(rows).items()}


def test_stages_on_odd_rows(spark):
    copy = " ".join(f"c{k}" for k in range(40))
    rows = [(1, copy), (2, copy + " "), (None, copy + " end"), (3, None), (4, ""), (5, "x " * 60_000), (5, "x " * 60_000), (6, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 7, "clash", "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, mark string, digest string")
    for table in (docs, docs.where("false")):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = common.cut(stage(spark, now, "/root/testdata/sf0.001"))
            assert now.columns == docs.columns
        left = sorted((r.doc_id or 0, (r.text or "")[:5]) for r in now.collect())
        # of equal texts the longest one stays
        assert left == ([(2, "c0 c1"), (3, ""), (5, "x x x"), (6, "alone")] if table is docs else [])
        assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == len(left)
