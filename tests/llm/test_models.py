from __future__ import annotations

import zlib

import numpy as np
import pytest

from marketloom.llm import language, toxicity
from marketloom.llm.ngrams import Batch
from marketloom.llm.queries import op2_toxicity, op3_language

DIR = "/root/testdata/sf0.01"


def test_grams_stay_inside_their_text():
    batch = Batch(["ab", None, "", "Ça1"])
    keys, owner = batch.grams(3)
    alone = Batch(["ab"]).grams(3)[0].tolist()
    assert keys[owner == 0].tolist() == alone
    assert set(owner.tolist()) == {0, 3}
    assert Batch(["AB"]).grams(3)[0].tolist() == alone


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    grams = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(3)]
    model = language.LanguageFilter(["a", "b", "c"], grams, np.ones(3))
    for i, own in enumerate(grams):
        assert (model.languages_of(own) >> np.uint8(i) & 1).all()
    strange = model.languages_of(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    for i in range(3):
        assert abs((strange >> np.uint8(i) & 1).mean() - model.chance[i]) < 0.02


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op3_language(spark, DIR).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    docs = spark.createDataFrame([(1, None, "q"), (2, "123 !?", "q"), (3, "the dog", "q"), (3, "the dog", "q"), (4, "und die katze", "q"), (5, "", "q")], "doc_id long, text string, lang string")
    got = [r.found.lang for r in language.identify(docs, model).collect()]
    assert got == ["und", "und", "en", "en", "de", "und"]
    assert [r.found.lang for r in language.identify(docs, language.train(train.limit(0))).collect()] == ["und"] * 6
    assert language.identify(docs.limit(0), model).collect() == []


def test_logistic_fit_separates():
    begin, col = np.array([0, 1, 2, 2, 3, 5]), np.array([0, 0, 1, 1, 1])
    y = np.array([1.0, 1, 1, 0, 0])
    theta, _ = toxicity.fit_logistic(begin, col, np.ones(2), y, np.ones(5))
    assert theta[0] > 0.5 and theta[1] < -0.5
    before, toxicity.CHUNK = toxicity.CHUNK, 1
    try:
        assert toxicity.fit_logistic(begin, col, np.ones(2), y, np.ones(5))[0] == pytest.approx(theta)
    finally:
        toxicity.CHUNK = before


def test_toxic_words_are_learned(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    make = lambda bad: " ".join([*rng.choice(words, 30), *(["scoundrel"] if bad else [])])
    docs = [(i, make(i % 4 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    scores = model.scores([t for _, t in docs[300:]] + [None, ""])
    assert [s >= 0.5 for s in scores[:100]] == [i % 4 == 0 for i in range(300, 400)]
    assert scores[-1] == scores[-2] < 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == pytest.approx([0, 0, 0], abs=1e-6)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_query_columns(spark):
    rows = op2_toxicity(spark, DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_of_held_out_documents(spark):
    """Learned from four folds of five, the scores tell the toxic documents of the fifth from the others."""
    where = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in op2_toxicity(spark, where).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [h for h in held if h[2]], [h for h in held if not h[2]]
    assert len(toxic) > 50 and len(clean) > 500
    assert sum(p for _, p, _ in toxic) / len(toxic) > 0.7
    assert sum(p for _, p, _ in clean) / len(clean) < 0.01
    above = np.mean([[a > b for b, _, _ in clean] for a, _, _ in toxic])
    assert above > 0.95


def test_training_text_is_bounded(spark):
    docs = spark.createDataFrame([(i, "bad words here" if i % 2 else "good words there") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_chars=1000)
    low, high = model.scores(["good words there", "bad words here"])
    assert low < 0.5 < high


def test_one_long_text_takes_no_class_with_it(spark):
    docs = [(i, "bad words here" if i % 2 else "good words there") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    for long in (1, 3, 5, 199):  # wherever its hash puts it
        given = [(i, t * 1000 if i == long else t) for i, t in docs]
        model = toxicity.train(spark.createDataFrame(given, "doc_id long, text string"), labels, max_chars=5000)
        low, high = model.scores(["good words there", "bad words here"])
        assert low < 0.2 and high > 0.8
    only = spark.createDataFrame([(1, "bad words here " * 500)] + [d for d in docs if d[0] % 2 == 0], "doc_id long, text string")
    assert toxicity.train(only, labels, max_chars=5000).scores(["bad words here"])[0] > 0.1  # the last text of a class stays


def test_ratios_equal_plain_counts(spark):
    """The weights' features and the ratios follow from plain sets of n-grams; labels without a document count nowhere."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["aab", "abb", "bad", "ugly", "Ça"], 6)) + (" foul" if i % 3 == 0 and i % 2 else "")) for i in range(90)] + [(90, None), (91, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(92)] + [(1000 + i, 1) for i in range(500)]
    grams = lambda t: {int(g) for _, _, b in toxicity.features([t]) for g in b}

    def plain(text):
        bare = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        data = bare.encode()
        return {data[k : k + n] for n in toxicity.LENGTHS for k in range(len(data) - n + 1)} if text else set()

    for _, t in docs:
        assert len(grams(t)) == len(plain(t))  # no two of so few n-grams share a bucket
    toxic = [grams(t) for i, t in docs if i % 3 == 0]
    clean = [grams(t) for i, t in docs if i % 3]
    told = {}
    for g in set().union(*toxic, *clean):
        p, q = sum(g in d for d in toxic), sum(g in d for d in clean)
        r = np.log((p + 1) / (len(toxic) + 2)) - np.log((q + 1) / (len(clean) + 2))
        if abs(r) >= toxicity.SIGMAS * np.sqrt(1 / (p + 1) + 1 / (q + 1)):
            told[g] = r
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert told and set(np.flatnonzero(model.wanted)) == set(told)
    order = sorted(told)
    place = {g: k for k, g in enumerate(order)}
    rows = [(sorted(place[g] for g in grams(t) if g in told), int(i % 3 == 0)) for i, t in docs]
    begin = np.append(0, np.cumsum([len(r) for r, _ in rows]))
    y = np.array([v for _, v in rows], float)
    theta, intercept = toxicity.fit_logistic(begin, np.array([c for r, _ in rows for c in r], np.int64), np.array([told[g] for g in order]), y, np.ones(len(y)))
    for i, (_, t) in enumerate(docs):
        z = intercept + sum(theta[c] * told[order[c]] for c in rows[i][0])
        assert model.scores([t])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3)


def test_language_sample_is_bounded_and_never_empty(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id < 19990, 'big', 'small') as lang")
    rows = rows.union(rows.where("doc_id < 50"))
    kept = language.smallest_hashes(rows, 7).collect()
    assert sorted(r.lang for r in kept) == ["big"] * 7 + ["small"] * 7
    best = [r.doc_id for r in rows.where("lang = 'big'").selectExpr("doc_id", "xxhash64(doc_id) as h").distinct().orderBy("h").limit(7).collect()]
    assert sorted(r.doc_id for r in kept if r.lang == "big") == sorted(best)
    assert language.smallest_hashes(rows.limit(0), 7).collect() == []


def test_only_letters_make_a_language(spark):
    model = language.train(spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de")], "doc_id long, text string, lang string"))
    assert model.decide(["\u00b2", "\u00bd", "\u2167", "\u2460", "12_", "\u0301"])[0] == ["und"] * 6
    assert "und" not in model.decide(["\u00e9", "\u4e2d", "x", "\u02b0"])[0]


def test_filter_counts_equal_plain_sets(spark):
    """Which n-grams belong to which language, and the corrected counts, by plain dictionaries."""
    rng = np.random.default_rng(4)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(30))
    docs = [(i, make("abcde" if i % 2 else "cdefg"), "xx" if i % 2 else "yy") for i in range(40)]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    counts = {lang: {n: {} for n in language.LENGTHS} for lang in ("xx", "yy")}
    for _, t, lang in docs:
        data = f" {t} ".encode()
        for n in language.LENGTHS:
            for k in range(len(data) - n + 1):
                g = data[k : k + n]
                counts[lang][n][g] = counts[lang][n].get(g, 0) + 1
    part = {x: {n: {g: c / sum(own.values()) for g, c in own.items()} for n, own in counts[x].items()} for x in counts}
    belongs = lambda x, n, g: (p := part[x][n].get(g, 0)) >= language.LEAST and p >= language.SHARE * max(part[y][n].get(g, 0) for y in part)
    covers = [sum(p for n in language.LENGTHS for g, p in part[x][n].items() if belongs(x, n, g)) / len(language.LENGTHS) for x in ("xx", "yy")]
    assert model.covers == pytest.approx(covers)
    for _, t, _ in docs[:10]:
        data = f" {t} ".encode()
        all_grams = [(n, data[k : k + n]) for n in language.LENGTHS for k in range(len(data) - n + 1)]
        hits = np.array([sum(belongs(x, n, g) for n, g in all_grams) for x in ("xx", "yy")])
        by_chance = model.chance * (len(all_grams) - hits)
        raw = model.counts([t])[0] * model.covers * (1 - model.chance) + len(all_grams) * model.chance
        assert (raw >= hits - 1e-6).all() and (np.abs(raw - hits - by_chance) <= 5 * np.sqrt(by_chance + 1)).all()


def test_rows_without_an_id_are_scored(spark, tmp_path):
    docs = spark.createDataFrame([(i, "plain words" if i % 2 else "foul text", "en") for i in range(30)] + [(None, "plain words", "en")] * 2, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(30)] + [(None, 1, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    from marketloom.llm.queries import op11_quality

    for q in (op2_toxicity, op3_language, op11_quality):
        rows = q(spark, str(tmp_path)).collect()
        assert len(rows) == 32 and [r.held_out for r in rows if r.doc_id is None] == [False, False]
