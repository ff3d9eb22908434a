"""Trained operators: held-out accuracy, determinism and odd rows."""

from __future__ import annotations

import math
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tonearm.llm import langid, quality, queries, urls

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    got = queries.op2_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = {q: [r.predicted == q for r in rows if r.quality == q] for q in (0, 1)}
    assert min(np.mean(right[0]), np.mean(right[1])) > 0.75
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "BAD!! %%"), (3, None), (4, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.train_classifier(docs, none, F.lit(True))
    assert [r.score for r in quality.score_documents(docs, model).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 0), (3, None), (4, 7), (99, 0)], "doc_id long, label int")
    model = quality.train_classifier(docs, odd, F.lit(True))
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert scores[1] > scores[2] and scores[3] == scores[4]
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_indicators_are_of_whole_texts():
    long = "word " * 300_000 + "%%%"
    a, b = quality.indicators([long, "word " * 3])
    assert len(a) > len(b) and (np.diff(a) > 0).all()
    many = ["one two", "two BIG", "BIG 7", "", "7 7", "7"]
    assert [x.tolist() for x in quality.indicators(many)] == [quality.indicators([t])[0].tolist() for t in many]
    assert [x.tolist() for x in quality.indicators(["ab c", "x", ""])] == [x[0].tolist() for x in map(quality.indicators, (["ab c"], ["x"], [""]))]


def test_dual_descent_separates():
    rows, values = [np.array([0]), np.array([1]), np.array([0, 2])], [np.ones(1), np.ones(1), np.ones(2)]
    y = np.array([1.0, -1.0, 1.0])
    w, b = quality.dual_descent(rows, values, y, 3, np.full(3, 100.0), 200, 0)
    assert all(y[i] * (w[rows[i]] @ values[i] + b) > 0.95 for i in range(3))


def test_dual_descent_by_force():
    """The objective of the trained weights is the least one that a grid of weights and biases has."""
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.normal(size=(40, 2)) + np.repeat([[0.7, 0.2], [-0.7, -0.2]], 20, axis=0)
    y, cost = np.repeat([1.0, -1.0], 20), np.full(40, 0.7)
    w, b = quality.dual_descent([np.arange(2)] * 40, list(x), y, 2, cost, 3000, 0)
    objective = lambda w0, w1, b: 0.5 * (w0 * w0 + w1 * w1 + b * b) + sum(0.7 * np.maximum(0, 1 - t * (w0 * p + w1 * q + b)) for (p, q), t in zip(x, y, strict=True))
    grid = np.linspace(-4, 4, 81)
    assert objective(*w, b) <= objective(*np.meshgrid(grid, grid, grid)).min() + 1e-3


def test_quality_scores_by_force(spark):
    """Scores and log-count ratios against plain loops over sets of n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    t = quality.Training(held=0.0)
    model = quality.train_classifier(docs, labels, F.lit(True), t)
    again = quality.train_classifier(docs.repartition(5), labels.repartition(3), F.lit(True), t)
    assert (model.weights == again.weights).all() and (model.scale, model.shift) == (again.scale, again.shift)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.label for r in labels.collect() if r.doc_id in texts}
    grams = {d: set(quality.indicators([t])[0].tolist()) for d, t in texts.items()}
    count = {q: Counter(g for d, label in known.items() if label == q for g in grams[d]) for q in (0, 1)}
    dims = 1 << quality.BITS
    total = {q: sum(c.values()) + dims * t.smoothing for q, c in count.items()}
    for g in list(count[0] | count[1])[:500] + [1, 2, 3]:
        assert abs(model.ratios[g] - math.log((count[1][g] + t.smoothing) / total[1]) + math.log((count[0][g] + t.smoothing) / total[0])) < 1e-9
    for r in quality.score_documents(docs, model).collect():
        own = grams[r.doc_id]
        norm = math.sqrt(sum(model.ratios[g] ** 2 for g in own))
        margin = model.bias + (sum(model.weights[g] for g in own) / norm if norm else 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-(model.scale * margin + model.shift)))) < 1e-9


def test_repeated_ids_with_other_texts(spark):
    """Rows of one id are examples each, and models do not depend on the layout."""
    rows = [(i % 7, f"{'good words' if i % 2 else 'BAD %% ##'} {i}", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, label int")
    sample, prior = quality.labelled_sample(docs, labels, F.lit(True), quality.Training())
    assert sample.count() == 60 and prior == 3 / 7
    one, other = (langid.train_languages(d, F.lit(True)) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(6)))
    assert (one.weights == other.weights).all() and one.temperature == other.temperature


def test_languages_by_force(spark):
    """Document frequencies, TF-IDF, every step of the training and the predictions against plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("lang is not null and length(text) < 600").orderBy("doc_id").limit(30)
    t = langid.Training(epochs=2)
    model = langid.train_languages(docs, F.lit(True), t)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs, model).collect()}
    place = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit("sample")).alias("h")).collect()}
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id, r.lang, place[r.doc_id]))
    counts = [dict(zip(*(a.tolist() for a in next(iter(langid.gram_counts([r.text])))), strict=True)) for r in rows]
    df = Counter(g for c in counts for g in c)
    idf = lambda g: math.log((1 + len(rows)) / (1 + df[g])) + 1
    vectors = []
    for c in counts:
        v = {g: (1 + math.log(n)) * idf(g) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({g: x / norm for g, x in v.items()})
    langs = sorted({r.lang for r in rows})
    z, n = Counter(), Counter()

    def weight(g, k):
        if abs(z[g, k]) <= t.l1:
            return 0.0
        return -(z[g, k] - math.copysign(t.l1, z[g, k])) / ((t.beta + math.sqrt(n[g, k])) / t.alpha + t.l2)

    rng = np.random.Generator(np.random.PCG64(t.seed))
    held = rng.random(len(rows)) < t.held if len(rows) >= 8 * len(langs) else np.zeros(len(rows), bool)
    for _ in range(t.epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            v = vectors[i] | {"bias": 1.0}
            w = {(g, k): weight(g, k) for g in v for k in range(len(langs))}
            logit = [sum(x * w[g, k] for g, x in v.items()) for k in range(len(langs))]
            e = [math.exp(x - max(logit)) for x in logit]
            for k in range(len(langs)):
                p = e[k] / sum(e) - (langs[k] == rows[i].lang)
                for g, x in v.items():
                    step = (math.sqrt(n[g, k] + (x * p) ** 2) - math.sqrt(n[g, k])) / t.alpha
                    z[g, k] += x * p - step * w[g, k]
                    n[g, k] += (x * p) ** 2
    for g in list(df)[:300]:
        assert all(abs(model.weights[g][k] - weight(g, k)) < 1e-7 for k in range(len(langs)))
    for r, v in zip(rows, vectors, strict=True):
        logit = [(weight("bias", k) + sum(x * weight(g, k) for g, x in v.items())) / model.temperature for k in range(len(langs))]
        e = [math.exp(x - max(logit)) for x in logit]
        assert got[r.doc_id][0] == langs[int(np.argmax(logit))] and abs(got[r.doc_id][1] - max(e) / sum(e)) < 1e-6


def test_language_held_out(spark):
    got = queries.op9_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    rows = [(1, "hello there friend", "en"), (2, "bonjour mon ami", "fr"), (3, None, "en"), (4, "123 !!", "fr"), (5, "", None), (6, "hello friend", None), (None, "bonjour ami", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_score", F.lit("clash"))
    model = langid.train_languages(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3 and got[6][0] == "en"
    none = langid.train_languages(docs.where("lang is null"), F.lit(True))
    assert none is None and {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_temperature_cools_and_heats():
    z = np.array([[4.0, 0.0]] * 9 + [[0.0, 4.0]])
    y = np.zeros(10, int)
    assert langid.temperature(z, y) > 1 > langid.temperature(z / 10, np.repeat([0, 1], [9, 1]))


def rule_by_force(url: str | None) -> tuple[str, str, str | None]:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for r in queries.URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text


def test_url_rules_by_force(spark):
    odd = [None, "", "nourl", "x://", "http://A.NET", "http://a.net/", "http://NET/x", "http://example.net/en/1?x#y", "http://example.network/en/", "http://é.Org/fr/\n2", "a://b://example.com/de/", "http://example.com/de", "ftp://m.example.com/de/?a=1&b=2"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(100 + i, r.url) for i, r in enumerate(spark.read.parquet(f"{SF}/pages.parquet").collect())]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("label", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(frame, queries.URL_RULES).collect()}
    assert len(got) == len(rows)
    verdict = {r.text: r.verdict for r in queries.URL_RULES}
    for i, u in rows:
        host, path, rule = rule_by_force(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict[rule] if rule else got[i].verdict in ("allow", "block")


def test_url_features_by_force(spark):
    """Lexical features and suffix statistics, the latter without the row's own fold, against plain Python."""
    found = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + ["http://a-b.x.org/p//q?a=1&&b=22#f", "no url", ""]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id long, url string")
    rows = urls._ruled(frame, queries.URL_RULES, urls.Training(), "page_id", "url").withColumn("label", F.when(F.col("verdict") == "block", 1.0).when(F.col("verdict") == "allow", 0.0))
    stats, by_fold = urls.suffix_statistics(rows.select("suffix", "fold", "label"), 5)
    got = urls.with_suffixes(urls.lexical(rows), stats, by_fold, 5).collect()
    assert len(got) == len(found) and len({r.fold for r in got}) == 5
    entropy = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
    others = lambda r: [x for x in got if x.suffix == r.suffix and x.fold != r.fold]
    for r in got:
        u, parts = r.url, [p for p in r.path.split("/") if p]
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        rest = others(r)
        want = {
            "url_length": len(u), "host_length": len(r.host), "path_length": len(r.path), "depth": len(parts), "labels": r.host.count(".") + 1,
            "digits": sum(c in "0123456789" for c in u) / len(u) if u else 0, "host_digits": sum(c in "0123456789" for c in r.host) / len(r.host) if r.host else 0,
            "signs": sum(c in "-_" for c in r.host) / len(r.host) if r.host else 0, "entropy": entropy(u), "host_entropy": entropy(r.host),
            "params": len([p for p in query.split("&") if p]), "param_length": len(query), "fragment": "#" in u, "secure": u.startswith("https"),
            "longest": max(map(len, parts), default=0), "suffix_log": round(math.log2(1 + len(rest) * 1.25)), "suffix_block": math.floor((sum(x.verdict == "block" for x in rest) + 1) / (len(rest) + 4) * 16 + 0.5) / 16,
        }
        assert set(want) == set(urls.FEATURES)
        for k, v in want.items():
            assert abs(r[k] - v) < 1e-9, (k, u)


def test_url_trees_on_held_out_labels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    loss, right, base = urls.held_out_loss(pages, queries.URL_RULES)
    assert loss < 0.75 * base and right > 0.75
    labelled = spark.createDataFrame([(f"http://{'free-win-' * (i % 2)}h{i}.{'com' if i % 3 else 'org'}/{'9' * (i % 7)}", float(i % 2)) for i in range(600)], "url string, label double")
    loss, right, base = urls.held_out_loss(pages, [], labelled)
    assert loss < 0.4 * base and right > 0.95


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, queries.URL_RULES).count() == 0
    only = spark.createDataFrame([(1, "http://a.com/x"), (None, None), (1, "http://a.com/x")], "page_id long, url string")
    assert {r.verdict for r in urls.judge(only, queries.URL_RULES).collect()} == {"allow"}
    labelled = spark.createDataFrame([(f"http://{'spam-' * (i % 2)}x{i}.com/{i}", float(i % 2)) for i in range(60)], "url string, label double")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://spam-y.com/3"), (2, "http://y.com/3")], "page_id long, url string"), [], labelled).collect()}
    assert got == {1: "block", 2: "allow"}


def test_samples_stay_small_in_the_driver(spark):
    """The driver holds a few bytes for each n-gram of the sampled texts, not a Python number."""
    rng = np.random.Generator(np.random.PCG64(8))
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 3000))) for _ in range(200)]
    rows = [(i, t, "zh" if i % 2 else "ja", i % 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int").repartition(4).cache()
    docs.count()

    def bytes_a_gram(train, grams: int) -> float:
        tracemalloc.start()
        train()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak / grams

    of_quality = sum(map(len, quality.indicators(texts)))
    of_language = sum(len(found) for found, _ in langid.gram_counts(texts))
    assert min(of_quality, of_language) > 1_000_000
    assert bytes_a_gram(lambda: quality.train_classifier(docs.select("doc_id", "text"), docs.select("doc_id", "label"), F.lit(True), quality.Training(epochs=1)), of_quality) < 25
    assert bytes_a_gram(lambda: langid.train_languages(docs.select("doc_id", "text", "lang"), F.lit(True), langid.Training(epochs=1)), of_language) < 35
