import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.op_pu_toxicity import PuModel, Rows, calibrate, features, first_sets, keep_clean, nonnegative_risk, over_all, score_toxicity, train, train_toxicity
from lodestone.llm.op_subword_langid import SubwordModel, bucket_counts, keep_accepted, letters, predict_language, slopes, softmax, subwords, train_language_model, training_rows
from tests.llm.conftest import ODD

STEMS = {"en": "the ing tion er and on", "de": "sch ung keit ein der ö", "fr": "eau ment que é le oi"}


def corpus(n=360, seed=1):
    r, rows, langs, toxic = random.Random(seed), [], {}, {}
    for i in range(100, 100 + n):
        lang = r.choice(sorted(STEMS))
        words = ["".join(r.choice(STEMS[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 80))]
        toxic[i] = int(r.random() < 0.25)
        if toxic[i]:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["clown", "idiot", "vequ" + words[0]]))
        rows.append((i, " ".join(words)))
        langs[i] = lang
    return rows, langs, toxic


def labels(spark, toxic, every=2):
    return spark.createDataFrame([(i, 1, t) for i, t in toxic.items() if i % every == 0], "doc_id long, quality int, toxic int")


def test_language_of_held_out_rows(documents):
    rows, langs, _ = corpus()
    df = documents(ODD + rows, langs)
    got = predict_language(df, train_language_model(df)).collect()
    assert len(got) == len(ODD) + len(rows)
    held = [x for x in got if x.doc_id in langs and x.held_out]
    assert {x.doc_id for x in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([x.lang_pred == langs[x.doc_id] for x in held]) > 0.97
    assert sum(x.rejected for x in held) <= 1
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert all(0 <= x.score <= 1 for x in got)
    kept = keep_accepted(df, train_language_model(df))
    assert kept.schema == df.schema and {x.doc_id for x in kept.collect()} >= {i for i in langs if not by[i].rejected}


def test_language_without_labels_or_rows(documents):
    df = documents([(1, "abc")]).withColumn("lang", F.lit(None).cast("string"))
    assert [x.lang_pred for x in predict_language(df, train_language_model(df)).collect()] == ["und"]
    empty = documents([])
    assert predict_language(empty, train_language_model(empty)).collect() == []


def test_subwords_stay_within_words():
    a, b = subwords(["über", "a"], 1 << 14), np.concatenate([subwords(["über"], 1 << 14), subwords(["a"], 1 << 14)])
    assert sorted(a.tolist()) == sorted(b.tolist())
    assert SubwordModel.train([]).languages == []


def test_toxicity_of_held_out_rows(spark, documents):
    rows, langs, toxic = corpus(600)
    df = documents(ODD[:9] + rows, langs)
    got = score_toxicity(df, train_toxicity(df, labels(spark, toxic))).collect()
    assert len(got) == len(rows) + 9 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    held = [x for x in got if x.doc_id in toxic and x.held_out]
    assert {x.doc_id for x in held} == {i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1}
    caught = np.mean([x.predicted for x in held if toxic[x.doc_id]])
    wrong = np.mean([x.predicted for x in held if not toxic[x.doc_id]])
    assert caught > 0.8 and wrong < 0.02


def test_toxicity_does_not_depend_on_other_columns(spark, documents):
    rows, langs, toxic = corpus(300)
    df, marks = documents(rows, langs), labels(spark, toxic)
    model = train_toxicity(df, marks)
    other = df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    assert score_toxicity(df, model).orderBy("doc_id").collect() == score_toxicity(other, train_toxicity(other, marks)).orderBy("doc_id").collect()
    kept = keep_clean(df, model)
    assert kept.schema == df.schema and 0 < kept.count() < len(rows)


def test_toxicity_without_toxic_rows(spark, documents):
    df = documents([(1, "a"), (2, None)])
    assert train_toxicity(df, labels(spark, {2: 0})) is None
    assert [x.score for x in score_toxicity(df, None).collect()] == [0.0, 0.0]
    assert score_toxicity(documents([]), None).collect() == []


def test_non_negative_risk_does_not_learn_unlabelled_toxic_rows_as_clean():
    r = np.random.default_rng(0)
    positive = [np.array([r.integers(0, 5)]) for _ in range(100)]
    unlabelled = [np.array([r.integers(0, 5)]) if r.random() < 0.3 else np.array([r.integers(5, 10)]) for _ in range(1000)]
    w, b = train(Rows(positive), Rows(unlabelled).mean_clean, 10, 0.3)
    assert (w >= 0).all() and w[:5].min() > w[5:].max() and 1 / (1 + np.exp(-(w[0] + b))) > 0.7 > 0.5 > 1 / (1 + np.exp(-(w[7] + b)))


def brute_risk(positive, unlabelled, prior, w, b):
    margin = lambda x: b + sum(w[i] for i in x)
    mean = lambda rows, sign: sum(np.log1p(np.exp(sign * margin(x))) for x in rows) / len(rows)
    return prior * mean(positive, -1), mean(unlabelled, 1) - prior * mean(positive, 1)


def test_risk_and_slopes_equal_brute_force():
    r = np.random.default_rng(4)
    draw = lambda n: [r.choice(6, size=r.integers(0, 4), replace=False) for _ in range(n)]
    positive, unlabelled = [*draw(30), *[range(6)] * 20], draw(80)
    signs = set()
    for prior, lift in ((0.1, 0), (0.6, 0), (0.9, 5)):
        w, b = r.normal(size=6) + lift, float(r.normal()) - lift
        missed, negative, slope = nonnegative_risk(Rows(positive), Rows(unlabelled).mean_clean, prior, w, b)
        want = brute_risk(positive, unlabelled, prior, w, b)
        assert np.allclose((missed, negative), want)
        signs.add(bool(negative >= 0))
        stepped = (lambda v: sum(brute_risk(positive, unlabelled, prior, v[:-1], v[-1]))) if negative >= 0 else (lambda v: -brute_risk(positive, unlabelled, prior, v[:-1], v[-1])[1])
        at, e = np.append(w, b), 1e-6
        assert np.allclose(slope, [(stepped(at + e * d) - stepped(at - e * d)) / (2 * e) for d in np.eye(7)], atol=1e-5)
    assert signs == {True, False}


def test_loss_over_all_sets_and_a_sample_that_stands_for_them(spark):
    r = np.random.default_rng(6)
    rows = [sorted(set(r.integers(0, 30, r.integers(0, 4)).tolist())) for _ in range(400)] + [[]] * 5000 + [[3]] * 600
    counted = {}
    for x in rows:
        counted[tuple(x)] = counted.get(tuple(x), 0) + 1
    sets = spark.createDataFrame([(list(x), n) for x, n in counted.items()], "held array<int>, n long").repartition(3)
    w, b = r.normal(size=30), -0.5
    loss, slope = over_all(sets, 30)(w, b)
    want_loss, want_slope = Rows(rows).mean_clean(w, b)
    assert np.isclose(loss, want_loss) and np.allclose(slope, want_slope)
    whole, part = first_sets(sets, 10_000), first_sets(sets, 100)
    assert whole.n.sum() == len(rows) and len(part.n) == 100 and abs(part.n.sum() / len(rows) - 1) < 0.1
    assert abs(part.mean_clean(w, b)[0] / want_loss - 1) < 0.1


def test_scores_equal_brute_force(documents):
    names = ["idiot", "idio-", "clow-", "über"]
    model = PuModel(names, np.array([1.0, 0.25, 2.0, 0.5]), -1.5)
    texts = [*(t for _, t in ODD), "Idiot! idiots über", "CLOWN clow clowns", "überall" * 2000]
    got = {x.doc_id: x for x in score_toxicity(documents(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        words = {w.lower() for w in __import__("re").findall(r"\w+", (t or "").lower())}
        held = {f for w in words for f in (w, w[:4] + "-" if len(w) >= 4 else w, w[:5] + "-" if len(w) >= 5 else w)}
        margin = -1.5 + sum(v for f, v in zip(names, (1.0, 0.25, 2.0, 0.5), strict=True) if f in held)
        assert abs(got[i].score - 1 / (1 + np.exp(-margin))) < 1e-12 and got[i].predicted == int(got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert features("idiot") == ("idiot", "idio-", "idiot-")


def test_calibration_separates_labelled_rows():
    margin = np.concatenate((np.full(500, -2.0), np.full(60, 0.2)))
    toxic = margin > 0
    factor, shift = calibrate(margin, toxic)
    p = 1 / (1 + np.exp(-(margin * factor + shift)))
    assert p[toxic].min() > 0.8 and p[~toxic].max() < 0.05 and factor > 0
    assert calibrate(margin, np.zeros(560, dtype=bool)) == (1.0, 0.0)


def test_letters_are_unicode_letters(documents):
    assert letters("² ½ ⅷ 12 _ ①") == [] and letters("Ab²c ⅷx ÉÈ 漢字 ªº") == ["ab", "c", "x", "éè", "漢字", "ªº"]
    df = documents([(1, "² ½"), (2, "ab ba"), (3, "ab ab")], {2: "en", 3: "en"})
    got = {x.doc_id: x.lang_pred for x in predict_language(df.filter("doc_id != 0"), train_language_model(df.withColumn("lang", F.when(F.col("doc_id") > 1, F.col("lang"))))).collect()}
    assert got[1] == "und" and got[2] == "en"


def test_predictions_equal_brute_force(documents):
    r = np.random.default_rng(8)
    model = SubwordModel(["a", "b", "c"], r.normal(size=(64, 3)), r.normal(size=3), 64, temperature=1.7, threshold=0.5)
    texts = [*(t for _, t in ODD), "über den Fluß", "a", "x" * 200, "la maison " * 3000]

    def hashed(gram):
        h = 0
        for c in gram:
            h = (h * 0x9E3779B1 + ord(c)) % (1 << 32)
        h = (h ^ (h >> 15)) * 0x85EBCA6B % (1 << 32)
        return (h ^ (h >> 13)) % 64

    for x in predict_language(documents(list(enumerate(texts))), model).collect():
        words = "".join(c if c.isalpha() else " " for c in (texts[x.doc_id] or "").lower()).split()
        grams = [hashed(b[i : i + n]) for w in words for b in [f"<{w}>"] for n in (2, 3, 4) for i in range(len(b) - n + 1)]
        if not grams:
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0, True)
            continue
        z = (sum(model.scores[g] for g in grams) / len(grams) + model.bias) / 1.7
        p = np.exp(z) / np.exp(z).sum()
        assert x.lang_pred == "abc"[p.argmax()] and abs(x.score - p.max()) < 1e-9 and x.rejected == (p.max() < 0.5)


def test_slopes_equal_brute_force():
    r = np.random.default_rng(9)
    mean, layer, bias, label, weight = r.normal(size=(5, 3)), r.normal(size=(3, 4)), r.normal(size=4), r.integers(0, 4, 5), r.random(5)
    loss = lambda m, w, b: -(np.log(softmax(m @ w + b)[np.arange(5), label]) * weight).sum()
    own = slopes(mean, layer, bias, label, weight)

    def steps(x, f, e=1e-6):
        out = np.zeros(x.shape)
        for i in np.ndindex(x.shape):
            d = np.zeros(x.shape)
            d[i] = e
            out[i] = (f(x + d) - f(x - d)) / (2 * e)
        return out

    assert np.allclose(own[0], steps(layer, lambda w: loss(mean, w, bias)), atol=1e-6)
    assert np.allclose(own[1], steps(bias, lambda b: loss(mean, layer, b)), atol=1e-6)
    assert np.allclose(own[2], steps(mean, lambda m: loss(m, layer, bias)), atol=1e-6)


def test_sample_holds_every_language_whole_texts_and_repeated_ids_once(documents):
    rows = [(i, f"wort{i} " * (1 + i % 400)) for i in range(300)] + [(7, "again")] * 50 + [(None, "none")] * 20
    langs = {i: f"l{i % 30}" for i in range(300)}
    got = training_rows(documents(rows, langs).withColumn("lang", F.coalesce("lang", F.lit("x"))), rows_per_language=4, most=93)
    by = {}
    for lang, at, share in got:
        by[lang] = by.get(lang, 0) + 1
        assert abs(share.sum() - 1) < 1e-5
    assert set(by) == {*langs.values(), "en"} and max(by.values()) == 3
    assert bucket_counts("ab " * 250_000).sum() == 250_000 * 6 and bucket_counts(None).sum() == 0
