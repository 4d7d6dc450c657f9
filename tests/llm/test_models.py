"""Quality classifier and language identification."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from llm_helpers import EDGE, MEDIUM, make, sentence
from tidewise.llm import language_id as G
from tidewise.llm import quality_model as M
from tidewise.llm.common import read


def test_quality_held_out_accuracy(spark):
    rows = M.op1_quality_model(spark, MEDIUM).join(read(spark, MEDIUM, "labels"), "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(right) > 80 and np.mean(right) >= 0.95
    low = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(low) <= 0.2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edges(spark, edge, empty):
    x = M.statistics(pa.array([t for _, t in EDGE], pa.string()))
    assert x.shape == (len(EDGE), len(M.FEATURES)) and np.isfinite(x).all() and not x[0].any() and not x[1].any()
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, 0), (7, 9, 1)], "doc_id long, quality int, toxic int")
    trees = M.train(edge, labels)
    rows = M.quality_scores(edge, trees).collect()
    assert len(rows) == len(EDGE) and all(r.held_out for r in rows if r.doc_id is None)
    none = M.train(empty, labels)
    assert {r.score for r in M.quality_scores(edge, none).collect()} == {0.5}
    assert M.quality_scores(empty, none).count() == 0


def test_labels_of_held_out_documents_are_not_learnt(spark):
    import zlib
    docs = make(spark, [(k, sentence(k, 30)) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    n = M.training_rows(docs, labels).count()
    assert n == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(60))


def brute_trees(x, y, trees, depth):
    """Scores of boosted trees that try every value of every feature as a threshold, node by node."""
    n, f = x.shape
    prior = (y.sum() + 1) / (n + 2)
    total = np.full(n, np.log(prior / (1 - prior)))

    def leaf(rows, g, h):
        return {i: -M.RATE * g[rows].sum() / (h[rows].sum() + M.SHRINK) for i in rows}

    def grow(rows, g, h, left):
        if left == 0 or not rows:
            return leaf(rows, g, h) if rows else {}
        best = (1e-9, None, None)
        for k in range(f):
            for cut in sorted(set(x[:, k])):
                a, b = [i for i in rows if x[i, k] <= cut], [i for i in rows if x[i, k] > cut]
                if h[a].sum() >= M.LEAST_WEIGHT and h[b].sum() >= M.LEAST_WEIGHT:
                    gain = sum(z * g[r].sum() ** 2 / (h[r].sum() + M.SHRINK) for z, r in ((1, a), (1, b), (-1, rows)))
                    if gain > best[0] + 1e-9:
                        best = (gain, a, b)
        if best[1] is None:
            return grow(rows, g, h, left - 1)
        return grow(best[1], g, h, left - 1) | grow(best[2], g, h, left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        out = grow(list(range(n)), p - y, p * (1 - p), depth)
        total = total + np.array([out[i] for i in range(n)])
    return 1 / (1 + np.exp(-total))


def test_splits_by_brute_force():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 9, size=(300, 3)).astype(np.float32)
        y = ((x[:, 0] > 4) ^ (x[:, 1] > 2) ^ (rng.random(300) < 0.2)).astype(np.float64)
        assert np.allclose(M.fit(x, y, trees=4, depth=3).score(x), brute_trees(x, y, 4, 3), atol=1e-9)


def test_sample_is_cut_by_hash_not_by_label(spark):
    docs = make(spark, [(k % 20, sentence(k, 30)) for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    whole = M.training_rows(docs, labels, 20)
    assert whole.count() > 20  # ids repeat
    trees = M.train(docs, labels, 20)
    kept = whole.orderBy("label").limit(20).select("label").distinct().count()
    assert kept == 1 and abs(trees.bias) < 2  # both labels were learnt


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = M.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    # the flattened walk equals a plain one, row by row
    def plain(row):
        total = trees.bias
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(trees.score(x[:50]), [plain(r) for r in x[:50]])


def test_language_held_out_accuracy(spark):
    rows = G.op4_language_id(spark, MEDIUM).join(read(spark, MEDIUM, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.05


def test_language_edges(spark, edge, empty):
    docs = make(spark, [(k, sentence(k, 40), "xx") for k in range(6)] + [(k, "der und die das " * 5, "de") for k in range(6, 12)]
                + [(20, "1 2 3 !", "xx"), (21, None, "xx"), (22, "the", None), (None, "zzz", "qq")], score=0, lang_pred="no", size=1, ce=2)
    model = G.train(docs)
    assert model.langs == ["de", "xx"]  # no language, no id: nothing learnt
    rows = {r.doc_id: r for r in G.identify(docs, model).collect()}
    assert rows[6].lang_pred == "de" and rows[0].lang_pred == "xx"
    assert rows[20].lang_pred == rows[21].lang_pred == "und" and rows[20].score == 0.0
    assert rows[22].lang_pred in ("de", "xx")
    out = G.identify(edge, model).collect()
    assert len(out) == len(EDGE) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 9)} == {"und"}
    nothing = G.train(empty)
    assert {r.lang_pred for r in G.identify(edge, nothing).collect()} == {"und"} and G.identify(empty, nothing).count() == 0


def test_rejection_limit_of_a_rare_language(spark, monkeypatch):
    """A language without a row among the calibration documents has a limit of its own documents."""
    monkeypatch.setattr(G, "CALIBRATION", 20)
    docs = make(spark, [(k, sentence(k, 30), "xx") for k in range(900)] + [(k, "καλημέρα κόσμε και καλή τύχη " * 3, "el") for k in (1000, 1001, 1002, 1003)])
    model = G.train(docs)
    assert model.langs == ["el", "xx"] and np.isfinite(model.limit).all()
    learnt = docs.filter(~G.held_out())
    rows = G._scored(learnt, model, ["lang"]).collect()
    for x, name in enumerate(model.langs):
        own = sorted(r.ce[x] for r in rows if r.lang == name)
        assert own[int(0.99 * len(own)) - 1] * G.SLACK <= model.limit[x] <= own[-1] * G.SLACK + 1e-9
    got = {r.doc_id: r for r in G.identify(make(spark, [(1, "καλημέρα κόσμε"), (2, "ψξζ ωφψ ξξξ βδγ")]), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "el" and got[2].rejected and not got[1].rejected


def test_one_pass_is_training_and_identification(spark, edge, empty):
    docs = edge.select("doc_id", "text", "lang").unionByName(make(spark, [(k, "der und die das " * 5, "de") for k in range(100, 112)]).select("doc_id", "text", "lang"))
    row = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert row(G.identify_own(docs)) == row(G.identify(docs, G.train(docs)))
    assert {r.lang_pred for r in G.identify_own(docs.withColumn("lang", F.lit(None))).collect()} == {"und"}
    assert G.identify_own(empty).count() == 0


def test_ranges_of_hashes():
    h = np.sort(np.random.default_rng(1).integers(-2**63, 2**63 - 1, 10_000))
    for n in (1, 3, 7, 1000):
        r = G._range_of(h, n)
        assert r.min() >= 0 and r.max() == n - 1 and (np.diff(r) >= 0).all()
    assert G._range_of(np.array([-2**63, 2**63 - 1]), 5).tolist() == [0, 4]


def test_spread_model_keeps_every_gram(spark, edge, monkeypatch):
    """With more n-grams than fit in arrays the results are those of all n-grams, not of the most frequent ones."""
    docs = make(spark, [(k, sentence(k, 40), "xx") for k in range(40)] + [(k, "漢字仮名交じり文の例です " + sentence(k, 5), "ja") for k in range(40, 60)]
                + [(k, "der und die das über " * 3 + sentence(k, 3), "de") for k in range(60, 66)] + [(80, "1 2 3 !", "xx"), (81, None, "xx"), (82, "", "de")])
    docs = docs.unionByName(edge.select(docs.columns))

    def all_rows():
        model = G.train(docs)
        return model, sorted(G.identify(docs, model).collect(), key=str)

    whole, want = all_rows()
    monkeypatch.setattr(G, "MODEL_GRAMS", 50)
    monkeypatch.setattr(G, "RANGE_NUMBERS", 2000)  # many ranges, several copies of each
    monkeypatch.setattr(G, "ASKED", 300)
    model, got = all_rows()
    assert isinstance(model, G.Spread) and not isinstance(whole, G.Spread) and model.langs == whole.langs and model.scale == whole.scale
    assert np.allclose(model.limit, whole.limit, rtol=1e-5) and len(got) == len(want) == docs.count()
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.cross_entropy or 0, 3))
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert (a.doc_id, a.held_out, a.lang_pred, a.rejected) == (b.doc_id, b.held_out, b.lang_pred, b.rejected)
        assert np.isclose(a.score, b.score, atol=1e-4) and np.isclose(a.cross_entropy or 0, b.cross_entropy or 0, rtol=1e-5)


def test_counts_of_a_corpus(spark):
    texts = [("a", "Abc abc, x"), ("b", "abc é"), ("a", None), ("a", "123")]
    got = {(r.lang, r.gram): r.n for r in G.corpus_counts(spark.createDataFrame(texts, "lang string, text string")).collect()}
    want = Counter()
    for lang, t in texts:
        for w in (t or "").lower().replace(",", " ").split():
            if w.isalpha():
                s = G.START * 3 + w + G.END
                want.update((lang, s[i:i + 4]) for i in range(len(s) - 3))
    assert got == dict(want)


def brute_kneser_ney(counts, letters):
    """p(gram) for grams of one language, by the textbook recursion."""
    top = {g: n for (_, g), n in counts.items()}
    by = {4: top}
    for k in (3, 2, 1):
        by[k] = Counter(g[1:] for g in by[k + 1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / letters
        table = by[k]
        ones, twos = (sum(v == x for v in table.values()) for x in (1, 2))
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9) if ones else 0.5
        own = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * p(gram[1:])
    return p


def test_kneser_ney_probabilities():
    counts = Counter()
    for w in ["abab", "abc", "bca", "cab", "aaa", "abab"]:
        s = G.START * 3 + w + G.END
        counts.update(("x", s[i:i + 4]) for i in range(len(s) - 3))
    model = G.build(pd.DataFrame([(x, g, n) for (x, g), n in counts.items()], columns=["lang", "gram", "n"]))
    letters = len({g[-1] for _, g in counts}) + 1
    p = brute_kneser_ney(counts, letters)
    for word in ["abab", "abc", "ccc", "zzb", "a"]:
        s = G.START * 3 + word + G.END
        want = sum(np.log(p(s[i:i + 4])) for i in range(len(s) - 3))
        assert abs(model.word_scores([word])[0, 0] - want) < 1e-4, word
    seen = sorted({g[-1] for _, g in counts})
    assert abs(sum(p("\x02ab" + c) for c in seen) + p("\x02ab?") - 1) < 1e-9
