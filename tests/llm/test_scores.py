"""Toxicity, quality network and quality rules: held-out accuracy, and awkward rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.llm import convnet, forest, toxicity
from gramforge.llm.common import labelled_sample
from tests.llm.conftest import AWKWARD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(rows, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect()}
    return [(r, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]


def test_toxicity_held_out(tables):
    docs, labels = tables
    rows = toxicity.judged(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    own = held_out(rows, labels, "toxic")
    assert np.mean([r.predicted == y for r, y in own]) > 0.9


def test_toxicity_model_smooths_by_shared_counts():
    ordinary = [(f"the house near river number {i} stays calm", 0) for i in range(60)]
    toxic = [(f"the house near gruk{s} number {i} stays calm", 1) for i, s in enumerate(["ta", "mo", "ri", "lu", "en"] * 12)]
    model = toxicity.fit([x for pair in zip(ordinary, toxic, strict=True) for x in pair])
    a, b, c = toxicity.word_scores(model, ["grukzz", "river", "qqqqqqqq"])
    assert a > 1 > b  # an expression never seen whole, against an ordinary word
    assert abs(c) < 1  # what neither class knows favours neither
    s = toxicity.Scorer(model).scores(["the house near grukolo stays calm", "the house near river stays calm", ""])
    assert s[0] > 0.5 > s[1] and s[2] < 0.5


def test_probabilities_sum_to_one():
    """The shared lower orders are distributions, so the ratio that cancels them is exact."""
    words = toxicity.gram_counts(toxicity.Counter({"abra": 3, "abba": 2, "baba": 1}))
    p = toxicity.shared_model(set(words))
    alphabet = {g[-1] for g in words}
    for h in {g[1:-1] for g in words}:
        seen = sum(p(h + x) for x in alphabet)
        assert seen <= 1 + 1e-9 and seen > 0.7


def test_log_likelihoods():
    """word_scores() and features against P(text given class), worked out directly from counts of each class."""
    rng = np.random.default_rng(2)
    texts = [["".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(60)] for _ in (0, 1)]
    count = [toxicity.Counter(t) for t in texts]
    model = toxicity.KneserNey(*toxicity.fit_counts(*count), np.zeros(5))
    order, pad = toxicity.ORDER, "\0" * (toxicity.ORDER - 1)
    grams = [[f"{pad}{w} "[i : i + order] for w in t for i in range(len(w) + 1)] for t in texts]
    levels = [sorted({g[k:] for g in set(grams[0]) | set(grams[1])}) for k in range(order)]  # types of each length

    def discount(values):
        values = list(values)
        one, two = values.count(1), values.count(2)
        return one / (one + 2 * two) if one and two else 0.5

    def shared(g):  # continuation counts of both classes together
        if not g:
            return 1 / (len({x for x in levels[-1]}) + 1)
        longer = levels[order - len(g) - 1]
        follow = lambda x: sum(y[1:] == x for y in longer)
        here = [x for x in levels[order - len(g)] if x[:-1] == g[:-1]]
        if not here:
            return shared(g[1:])
        d = discount(map(follow, levels[order - len(g)]))
        return (max(follow(g) - d, 0) + d * len(here) * shared(g[1:])) / sum(map(follow, here))

    def p(k, g):
        own = [x for x in grams[k] if x[:-1] == g[:-1]]
        d = discount(toxicity.Counter(grams[k]).values())
        if not own:
            return shared(g[1:])
        return (max(own.count(g) - d, 0) + d * len(set(own)) * shared(g[1:])) / len(own)

    words = [texts[0][0], texts[1][0], "abcabc", "zz", "a"]
    want = [sum(np.log(p(0, g) / p(1, g)) for g in (f"{pad}{w} "[i : i + order] for i in range(len(w) + 1))) for w in words]
    assert np.allclose(toxicity.word_scores(model, words), want)
    text, llr = " ".join(words * 3), sorted(want * 3)
    rate = np.clip(sum(llr) / len(text), -1, 1)
    assert np.allclose(toxicity.Scorer(model).features([text, "", "zz"])[0], [20 * rate, min(llr[-1], 30) / 5, min(np.mean(llr[-2:]), 30) / 5, np.log1p(15) / 4])


def test_toxicity_awkward(awkward, no_documents, spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, 0), (11, 1), (11, 0), (None, 1), (13, None)], "doc_id long, toxic int")
    rows = toxicity.judged(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.judged(no_documents, labels).count() == 0
    assert toxicity.judged(awkward, labels.limit(0)).filter("predicted = 0").count() == len(AWKWARD)
    model = toxicity.fit([])
    kept = toxicity.without_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)


def test_sample_is_bounded_and_consistent(awkward, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(11, 0), (12, 0), (12, 1)], "doc_id long, toxic int")
    got = labelled_sample(awkward, labels, "toxic", lambda c: F.lit(True), "doc_id", "text", 100, 10_000)
    assert sum(len(t) for t, _ in got) <= 10_000
    assert not any(t in (b"WORD", b"word") for t, _ in got)  # contradicting labels
    assert len(labelled_sample(awkward, labels, "toxic", lambda c: F.lit(True), "doc_id", "text", 2, 10_000)) <= 4


def test_network_held_out(tables):
    docs, labels = tables
    rows = convnet.judged(docs, labels).collect()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    own = held_out(rows, labels, "quality")
    assert np.mean([r.predicted == y for r, y in own]) > 0.9


def test_network_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    net = convnet.new_net(rng)
    texts, good, weight = [b"some words in a text " * 9, b"### *** ###", b""], np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    _, g = convnet.gradients(net, texts, good, weight)
    for name in ("out", "out_bias", "hidden", "hidden_bias", "bias", "filters", "embed"):
        value, slope = getattr(net, name), getattr(g, name)
        for at in [np.unravel_index(np.abs(slope).argmax(), slope.shape), np.unravel_index(slope.argmin(), slope.shape)]:
            before, step = value[at], 1e-2
            value[at] = before + step
            up = convnet.gradients(net, texts, good, weight)[0]
            value[at] = before - step
            down = convnet.gradients(net, texts, good, weight)[0]
            value[at] = before
            assert abs((up - down) / (2 * step) - slope[at]) < 0.05 * abs(slope[at]) + 2e-3, name


def test_network_forward_pass():
    """Against a plain convolution, position by position, of texts from empty to several slices of half chunks."""
    rng = np.random.default_rng(5)
    net = convnet.new_net(rng)
    net.bias, net.hidden_bias, net.out_bias = (rng.standard_normal(x.shape).astype(np.float32) * 0.1 for x in (net.bias, net.hidden_bias, net.out_bias))
    texts = [b"", b"a", b"short text", bytes(rng.integers(0, 256, 700, np.uint8)), "é漢 ".encode() * 90, b"x" * 128, b"y" * 129, bytes(rng.integers(32, 127, 140_000, np.uint8))]

    def plain(text):
        half = convnet.HALF * convnet.STRIDE
        n = max(2, -(-(len(text) + convnet.WIDTH) // half))
        codes = list(text) + [convnet.PAD] * (n * half - len(text))
        answers = [np.concatenate([net.embed[c] for c in codes[at : at + convnet.WIDTH]]) @ net.filters for at in range(0, n * half - convnet.WIDTH + 1, convnet.STRIDE)]
        worst = -np.inf
        for k in range(n - 1):  # chunks of two halves, overlapping by one
            best = np.max(answers[k * convnet.HALF : (k + 2) * convnet.HALF], axis=0)
            hidden = np.maximum(np.maximum(best + net.bias, 0) @ net.hidden + net.hidden_bias, 0)
            worst = max(worst, float(hidden @ net.out + net.out_bias[0]))
        return 1 / (1 + np.exp(worst))

    # what follows in a batch belongs to the next text: each alone and all together
    want = [plain(t) for t in texts]
    assert np.allclose(convnet.predict(net, texts[:3] + texts[4:]), want[:3] + want[4:], atol=1e-4)
    assert np.allclose([convnet.predict(net, [t])[0] for t in texts], want, atol=1e-4)


def test_network_sees_the_whole_text():
    rng = np.random.default_rng(0)
    clean = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)).encode()
    sample = [(clean(120), 1) for _ in range(60)] + [(clean(60) + b" $$$ ### %%% &&& ***" * 6 + clean(60), 0) for _ in range(60)]
    net = convnet.fit([x for pair in zip(sample[:60], sample[60:], strict=True) for x in pair], epochs=6)
    far = clean(5000) + b" $$$ ### %%% &&& ***" * 12
    assert convnet.predict(net, [clean(5000)])[0] > 0.5 > convnet.predict(net, [far])[0]


def test_network_awkward(awkward, no_documents, spark):
    labels = spark.createDataFrame([(3, 1), (13, 0), (11, 1), (11, 0), (None, 1)], "doc_id long, quality int")
    assert convnet.judged(awkward, labels).count() == len(AWKWARD)
    assert convnet.judged(no_documents, labels).count() == 0
    assert convnet.judged(awkward, labels.limit(0)).filter("score between 0 and 1").count() == len(AWKWARD)


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_statistics(text):
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_statistics():
    texts = [t or "" for _, t in AWKWARD] + ["a b c d e a b c d e f", "# | x\n# | x\n#|x", "a b c d a b c d a b c"]
    got = forest.statistics([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == plain_statistics(t), t[:60]


def test_path_lengths_by_walking():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    f = forest.grow(x, np.array([x.min(0) - 1, x.max(0) + 1]), trees=20)

    def walk(t, row):
        k = 0
        while f.feature[t, k] >= 0:
            k = 2 * k + 1 + int(row[f.feature[t, k]] > f.split[t, k])
        return f.path[t, k]

    want = [np.mean([walk(t, row) for t in range(20)]) for row in x[:20]]
    assert np.allclose(forest.mean_path(f, x)[:20], want)
    outlier = np.vstack([x.max(0) + 0.9, x.mean(0)])
    a, b = forest.mean_path(f, outlier)
    assert a < b


def test_rules_on_labels(tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in forest.judged(docs, labels).collect()}
    assert len(rows) == docs.count()
    y = {r.doc_id: r.quality for r in labels.collect()}
    good = [rows[i] for i in y if y[i] == 1 and not rows[i].base_failed]
    bad = [rows[i] for i in y if y[i] == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.2
    assert not any(r.kept and r.base_failed for r in rows.values())
    for r in rows.values():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_rules_awkward(awkward, no_documents, spark):
    labels = spark.createDataFrame([(3, 1), (13, 0)], "doc_id long, quality int")
    assert forest.judged(awkward, labels).count() == len(AWKWARD)
    assert forest.judged(no_documents, labels).count() == 0
    assert forest.judged(awkward, labels.limit(0)).filter("kept = base_failed").count() == 0


@pytest.fixture(scope="module")
def many_good():
    """More good rows than a sample of 4,000 holds; 40 of those that such a sample by hash leaves out are unlike the others."""
    rng = np.random.default_rng(3)
    plain = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(12))

    def rows(spark):
        ids = [r.id for r in spark.range(4700).orderBy(F.xxhash64("id")).collect()]
        good = [(i, plain() + (" ### ***" if 4000 <= k < 4040 else ""), 1) for k, i in enumerate(ids)]
        return good + [(i, plain() + " ###### $$$$$$ ||||||" * (1 + i % 5), 0) for i in range(5000, 5200)] + [(6000, "few words", 1)]

    return rows


def test_threshold_holds_for_every_labelled_row(spark, many_good):
    rows = many_good(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    kept = {r.doc_id: r.kept for r in forest.judged(docs, docs).collect()}
    assert np.mean([kept[i] for i, _, q in rows if q == 1 and i != 6000]) >= 1 - forest.MAX_LOSS
    assert np.mean([kept[i] for i, _, q in rows if q == 0]) < 0.2


def test_forest_of_every_labelled_row(spark, many_good):
    """Against a fit in numpy of all rows."""
    rows = many_good(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = forest.fit_on(docs.repartition(7), docs)
    s = forest.statistics([t.encode() for _, t, _ in rows])
    x, y, passing = forest.shares(s), np.array([q for *_, q in rows]), ~forest.base_failed(s)
    box = np.array([x.min(0), x.max(0)])
    own = x[passing & (y == 1)]
    want = forest.grow(own, box)
    assert len(own) == 4700 and (got.feature == want.feature).all() and np.allclose(got.path, want.path)
    # a good row is calibrated by the forest that doesn't hold it
    shape = forest.drawn(box)
    _, without = forest.grown(shape, forest.counts(shape, own))
    for k in (0, 4020, 4699):
        assert np.allclose(forest.mean_path(without, own[[k]]), forest.mean_path(forest.grow(np.delete(own, k, 0), box), own[[k]]))
    good, bad = (np.floor(forest.mean_path(f, z) * forest.STEPS) / forest.STEPS for f, z in ((without, own), (want, x[passing & (y == 0)])))
    gain = {at: (bad < at).mean() - (good < at).mean() for at in np.unique(np.concatenate([good, bad])) if (good < at).mean() <= forest.MAX_LOSS}
    assert gain[got.threshold] == max(gain.values())
