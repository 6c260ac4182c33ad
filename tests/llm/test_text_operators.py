"""Licences, benchmark leaks, chat templates, toxicity, quality, the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import chat, decontam, license, quality, toxicity

DATA = "/root/testdata/sf0.1"


def test_patience_alignment():
    a, b = "x a b q c d e y".split(), "a b c d e".split()
    assert license.align(a, b) == [(1, 0), (2, 1), (4, 2), (5, 3), (6, 4)]
    assert license.align([], b) == [] and license.align(["z"], b) == []


@pytest.mark.parametrize("name", sorted(license.TEMPLATES))
def test_licences_are_found(spark, name):
    rng = random.Random(3)
    notice = license.TEMPLATES[name]
    noise = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    changed = notice.split()
    changed = " ".join(w for k, w in enumerate(changed) if len(changed) < 20 or k != 7)
    rows = [(1, f"{noise(3000)}\n{notice} {noise(20)}"), (2, noise(500)), (3, None), (4, ""), (5, f"{noise(5)} {changed.upper()}"), (6, f"{notice} and {notice}"), (6, notice)]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit("clash"))).where(F.col("license") == name)
    found = sorted(r.doc_id for r in got.collect())
    assert found == [1, 5, 6, 6, 6]  # both places of a text are reported
    one = got.where("doc_id = 1").first()
    assert rows[0][1][one.first_char : one.last_char].split()[0] == notice.split()[0]


def test_no_licence_without_its_words(spark):
    rows = [(1, "Licensed under nothing at all."), (2, "The MIT people released a paper under stress")]
    assert license.scan(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def edit_distance_inside(item, text):
    """The least number of edits between the item and any part of the text, by plain dynamic programming."""
    row = np.zeros(len(text) + 1, int)
    for k, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        for j, x in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.choice([12, 20, 30])))) for k in range(6)] + [(50, None), (51, ""), (52, "short")]
    docs = []
    for i in range(40):
        part = list(rng.choice(items[:6])[1])
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([["z"], [], ["y", part[at]]])
        docs.append((i, f"{' '.join(word() for _ in range(15))}  {''.join(part).upper()}\n{' '.join(word() for _ in range(9))}"))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.find_leaks(docs_df, bench).collect()}
    for i, text in docs:
        plain = " ".join((text or "").lower().split())
        for k, item in items[:6]:
            least, budget = edit_distance_inside(item, plain), int(0.08 * len(item))
            if least <= budget:
                assert got.get((i, k)) is not None and got[i, k] >= least
            else:
                assert (i, k) not in got
    in_blocks = {(r.doc_id, r.item_id): r.edits for r in decontam.find_leaks(docs_df, bench, block_chars=200).collect()}
    assert in_blocks == got
    assert decontam.find_leaks(docs_df, bench.where("false")).count() == 0
    assert {r.doc_id for r in decontam.remove_leaked(docs_df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_short_items_and_items_without_identifier(spark):
    items = [(1, "Yes, it is"), (2, "No. 7"), (3, "no.  7"), (4, "é"), (5, " \n "), (None, "ab c"), (None, "a passage that has many more letters than q"), (8, "")]
    docs = [(1, "well,\tNO.\n7 and no. 7"), (2, "no.7"), (3, None), (4, "x ab"), (5, "c"), (6, "cAB C A passage that has many more letters than q"), (7, "É"), (8, "c yes, it  is")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(1, 2, 0, 6, 10), (1, 3, 0, 6, 10), (6, -1, 0, 1, 4), (6, -1, 0, 6, 48), (7, 4, 0, 0, 0), (8, 1, 0, 2, 12)])
    for chars in (4_000_000, 20):
        got = decontam.find_leaks(docs_df, bench, block_chars=chars).collect()
        assert sorted((r.doc_id, -1 if r.item_id is None else r.item_id, *r[2:]) for r in got) == want
        assert sorted(r.doc_id for r in decontam.remove_leaked(docs_df, bench, block_chars=chars).collect()) == [2, 3, 4, 5]


def test_template_language():
    t = "{% for x in xs %}{% if x.n == 1 and not false %}one{% elif x.n == 2 %}{{ 'a' + 'b' | upper }}{% else %}{% generation %}{{ x.t | trim }}{% endgeneration %}{% endif %};{% endfor %}{{ missing }}"
    text, spans = chat.render(t, {"xs": [{"n": 1}, {"n": 2}, {"n": 3, "t": " deep "}]})
    assert text == "one;aB;deep;" and [text[a:b] for a, b in spans] == ["deep"]
    assert chat.fold(chat.parse("{% if 1 == 1 %}a{{ 'b' }}{% endif %}c")) == ("block", [("text", "abc")])


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a.b.__class__() }}", "{{ open('x') }}", "{{ x | eval }}", "{% include 'x' %}", "{{ 1 + }}"])
def test_templates_are_sandboxed(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_fields_are_no_attributes():
    assert chat.render("{{ x.__class__ }}{{ x.upper }}", {"x": "s"})[0] == ""


@pytest.mark.parametrize("text", ["", "<turn>", "</turn>", "[/role]", "\\", "\\\\<[", "<\\", "[\\[", "a</turn><turn>b", "</s>[INST] ok [/INST]"])
def test_escaping_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(x in hidden for x in (chat.TURN, chat.TURN_END, chat.ROLE_END))


def test_conversations(spark):
    rows = [(1, 0, "user", "hi</turn>"), (1, 1, "assistant", "[/role] yes"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 0, "assistant", "y"), (None, 0, "user", "z"), (3, 0, "user", "t"), (3, 0, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(out) == 4
    one = out[1]
    assert [chat.unescape(one.formatted[s.start : s.end]) for s in one.loss_spans] == ["[/role] yes"]
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.formatted_chars) for r in chat.digests(df).collect()}
    assert got == {1: (3, 11, len(one.formatted)), 2: (2, 1, len(out[2].formatted)), None: (1, 0, len(out[None].formatted)), 3: (2, 0, len(out[3].formatted))}
    assert chat.digests(df.where("false")).count() == 0


def test_nn_pu_separates():
    rng = np.random.default_rng(0)
    rows = [np.array([0, rng.integers(2, 40)]) for _ in range(100)] + [rng.integers(2, 40, 2) if k % 10 else np.array([0, 1]) for k in range(400)]
    positive = np.arange(500) < 100
    w, b = toxicity.fit(rows, positive, 40, 0.1)
    assert w[0] + b > 0.8 > b


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert bad.predicted.mean() > 0.85 and good.predicted.mean() < 0.03
    assert (rows.score.between(0, 1)).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "x" * 100_000, "c"), (3, "again", "c"), (None, "y", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.where("false")):
        out = toxicity.score(docs, toxicity.train(docs, known)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.filter_clean(docs, toxicity.Model()).columns == docs.columns


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.train(docs, labels, ~toxicity.held_out("id"))
    rows = quality.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    assert rows.keep[rows.quality == 1].mean() > 0.98 and rows.keep[rows.quality == 0].mean() < 0.05


def test_sparse_sites_stay_near_their_prior(spark):
    docs = spark.createDataFrame([(i, "Good words here.", f"h{i % 4}", "p") for i in range(80)] + [(900, None, None, None), (901, "BAD!!!", "lone", "q")], "doc_id long, text string, source string, lang string")
    out = {r.doc_id: r for r in quality.score(docs, None).collect()}
    assert len(out) == 82 and all(abs(r.score - 0.5) < 1e-6 for r in out.values())
    assert quality.score(docs.where("false"), None).count() == 0


def test_hosts_and_paths_of_urls(spark):
    good, bad = "A calm and whole sentence stands here, with words of some length.", "BUY!!! $$$ ### 777 @@@ NOW!!!"
    sites = [("https://a.example/good/x", good, 120), ("https://a.example/bad/x", bad, 40), ("http://a.example/lone", bad, 1), ("https://b.example/good/x?q=1", good, 90), ("https://c.example/bad/x", bad, 90)]
    rows = [(url, text) for url, text, n in sites for _ in range(n)]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)] + [(900, None, good)], "doc_id long, url string, text string")
    labels = docs.select("doc_id", (F.col("text") == good).cast("int").alias("quality"))
    url = F.col("url")
    scored = quality.score(docs, quality.train(docs, labels), host=F.parse_url(url, F.lit("HOST")), path=F.parse_url(url, F.lit("PATH")))
    out = {r.url: r for r in scored.join(docs.select("doc_id", "url"), "doc_id").collect()}
    assert scored.count() == docs.count()
    at = [out[site[0]] for site in sites]
    assert len({round(r.host_posterior, 9) for r in at[:3]}) == 1 and at[4].host_posterior < at[0].host_posterior < at[3].host_posterior
    # the lone page and the dense path have the same evidence; the lone one stays nearer to its host
    assert at[1].path_posterior < at[2].path_posterior < at[2].host_posterior < at[0].path_posterior


def test_pipeline_keeps_what_it_should(spark):
    folder = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == before.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == kept
    model = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    gone = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
    assert not gone & kept


def edits_of(item, text):
    """The fewest edits of the item anywhere in the text, and the first end of such a place; plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_passages_of_repetitive_and_long_texts():
    import tracemalloc

    from siltstone.llm import common

    rng = random.Random(5)
    long_item = "".join(rng.choice("abcdefghij klmnop") for _ in range(50_000)).strip()
    changed = list(long_item)
    for k in range(0, len(changed), 100):
        changed[k] = "#"
    items = ["-" * 200, long_item, "ab" * 150]
    index = decontam.Items(items)
    tracemalloc.start()
    texts = ["-" * 1_000_000, "before " + "".join(changed) + " after", "x" + "ab" * 149 + "b" * 2 + "yy"]
    found = {}
    for k, text in enumerate(texts):
        for _, i, edits, first, last in index.find(*common.text_buffers(pa.array([text]))):
            found[k, i] = (edits, first, last)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert found[0, 0] == (0, 0, 199) and found[1, 1][0] == 500
    assert found[2, 2][0] == edits_of(items[2], texts[2])


def test_alignment_equals_plain_dynamic_programming():
    from siltstone.llm import common

    rng = random.Random(6)
    items = ["".join(rng.choice("ab c") for _ in range(rng.choice([60, 120]))).strip() for _ in range(6)]
    items = [" ".join(x.split()) for x in items]
    index = decontam.Items(items)
    for _ in range(60):
        i = rng.randrange(6)
        text = list(items[i])
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
        text = " ".join(("k" * rng.randrange(30) + "".join(text) + "m" * rng.randrange(30)).split())
        found = {i: e for _, i, e, _, _ in index.find(*common.text_buffers(pa.array([text])))}
        for j, item in enumerate(items):
            edits = edits_of(item, text)
            assert (edits <= index.budget[j]) == (j in found)
            if j in found:
                assert found[j] == edits


def test_item_identifiers_of_any_type(spark):
    docs = spark.createDataFrame([(1, "so this is a passage of the benchmark here"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a-1", "this is a passage of the benchmark"), (None, "is a passage of the bench")], "item_id string, text string")
    got = decontam.find_leaks(docs, bench)
    assert got.schema["item_id"].dataType.simpleString() == "string"
    assert sorted((r.doc_id, r.item_id or "") for r in got.collect()) == [(1, ""), (1, "a-1")]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return row[-1]


def test_licence_coverage_against_plain_alignment():
    rng = random.Random(11)
    tool = license.Scanner(license.TEMPLATES, 0.9)
    for name, template in tool.templates:
        for _ in range(4):
            share = rng.choice([0, 0.03, 0.06, 0.2])
            text = []
            for k, w in enumerate(template):
                text += [] if rng.random() < share else [w]
                text += [f"filler{k}"] if rng.random() < share else []
            best = longest_common(text, template) / len(template)
            found = {n: c for n, c, _, _ in tool.scan("some words before it . " + " ".join(text) + " . and some after it")}
            assert found.get(name, 0) <= best + 1e-9
            # the alignment may lose a few of the words that a text repeats
            if best >= 0.94:
                assert found[name] >= best - 0.04


def test_licence_names_with_a_word_missing_and_all_places():
    tool = license.Scanner(license.TEMPLATES, 0.9)
    names = lambda text: {n for n, _, _, _ in tool.scan(text)}
    assert "MIT" in names("Code: Released under MIT License, 2020")
    assert "GPL-3.0 name" in names("see the GNU General Public License v3 for more")
    assert "all rights reserved" in names("(c) 2011. All rights reserved.")
    assert not names("the license of this work is under review, all of it") and not names("")
    twice = [x for x in tool.scan("Released under the MIT License. " + "and then " * 40 + "Released under the MIT License.") if x[0] == "MIT"]
    assert len(twice) == 2 and twice[0][2] == 0


def test_slopes_of_the_risk_by_finite_differences():
    rng = np.random.default_rng(3)
    f, positive, prior = rng.normal(size=40), np.arange(40) < 15, 0.3
    on_positive, on_negative, by_positive, by_negative = toxicity.risk(f, positive, prior)
    sigma = lambda x: 1 / (1 + np.exp(-x))
    assert on_positive == pytest.approx(prior * np.mean(-np.log(sigma(f[positive]))))
    assert on_negative == pytest.approx(np.mean(-np.log(1 - sigma(f[~positive]))) - prior * np.mean(-np.log(1 - sigma(f[positive]))))
    for k in range(0, 40, 3):
        step = np.zeros(40)
        step[k] = 1e-5
        up, down = toxicity.risk(f + step, positive, prior), toxicity.risk(f - step, positive, prior)
        assert by_positive[k] == pytest.approx((up[0] - down[0]) / 2e-5, abs=1e-7)
        assert by_negative[k] == pytest.approx((up[1] - down[1]) / 2e-5, abs=1e-7)


def test_posteriors_against_plain_sums(spark):
    rng = random.Random(4)
    rows = [(k, f"text {rng.random()} " * rng.randrange(1, 40), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"])) for k in range(300)] + [(900, "alone", "d", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    x = quality.features(*__import__("siltstone.llm.common", fromlist=["x"]).text_buffers(pa.array([r[1] for r in rows])))
    model = quality.fit(x, (np.arange(len(rows)) % 3 == 0).astype(float))
    p = quality.predict(model, x)
    sums: dict = {}
    for (_, _, host, path), value in zip(rows, p, strict=True):
        for key in ((host or "",), (host or "", path)):
            s, n = sums.get(key, (0.0, 0))
            sums[key] = (s + value, n + 1)
    hosts, paths = {k[0]: v for k, v in sums.items() if len(k) == 1}, {k: v for k, v in sums.items() if len(k) == 2}
    mean = p.mean()

    def strength(sites, center):
        between = np.mean([(s / n - center(k)) ** 2 for k, (s, n) in sites.items()]) - np.mean([center(k) * (1 - center(k)) / n for k, (s, n) in sites.items()])
        within = np.mean([center(k) * (1 - center(k)) for k in sites])
        return within / max(between, within * 1e-3)

    u = strength(hosts, lambda k: mean)
    by_host = {k: (s + mean * u) / (n + u) for k, (s, n) in hosts.items()}
    w = strength(paths, lambda k: by_host[k[0]])
    by_path = {k: (s + by_host[k[0]] * w) / (n + w) for k, (s, n) in paths.items()}
    logit = lambda v: np.log(v / (1 - v))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for (i, _, host, path), value in zip(rows, p, strict=True):
        key = (host or "", path)
        assert got[i].host_posterior == pytest.approx(by_host[key[0]], rel=1e-9) and got[i].path_posterior == pytest.approx(by_path[key], rel=1e-9)
        (hs, hn), (s, n) = hosts[key[0]], paths[key]
        others = (s - value + (hs - value + mean * u) / (hn - 1 + u) * w) / (n - 1 + w)  # without the document itself
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(logit(value) + logit(others) - logit(mean)))), rel=1e-6)
    assert got[900].score == pytest.approx(got[900].evidence)  # the only document of its site stands on its own


def test_quality_of_long_texts_and_clashing_names(spark):
    rows = [(k, "word " * (300_000 if k == 0 else k), "h", "p", -1, "c") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, id int, host string").withColumn("p", F.lit("clash")).withColumn("site", F.lit(1))
    got = quality.score(docs, None).collect()
    assert len(got) == 12 and {r.evidence for r in got} == {0.5}
    assert toxicity.score(docs, toxicity.Model()).where("score = 0").count() == 12
