"""The classifier and the language profiles: held-out accuracy and edge cases."""

import random
import zlib

import numpy as np

from dishlens.llm import language_id, toxicity


def folds(rows):
    return {r.doc_id: r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}


def test_language_of_held_out_texts(both, rows):
    got = {r.doc_id: r for r in language_id.identify(both).collect() if r.doc_id is not None}
    held = folds(rows)
    assert all(r.held_out == held[i] for i, r in got.items())
    judged = [r for r in rows if r.doc_id is not None and r.doc_id < 1_000_000 and held[r.doc_id]]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1_000_003].lang_pred == got[1_000_004].lang_pred == "und"


def test_every_labelled_row_teaches(spark, monkeypatch):
    """A language of one row among a thousand gets its profile, whatever a sample would hold."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 50, raising=False)
    monkeypatch.setattr(language_id, "HELD_GRAMS", 500, raising=False)
    texts = [(i, "common", f"some words of row {'abcdefghij'[i % 10]}") for i in range(1_000)] + [(1_000, "rare", "quite zonder oxen")]
    profiles = language_id.learn(spark.createDataFrame(texts, "key long, lang string, text string"))
    assert sorted(profiles) == ["common", "rare"]
    for lang, profile in profiles.items():
        values, count = np.unique(np.concatenate([language_id.grams(t) for _, name, t in texts if name == lang]), return_counts=True)
        assert profile.tolist() == values[np.lexsort((values, -count))][: language_id.LENGTH].tolist()


def test_distance_is_out_of_place():
    profiles = {"x": language_id.ranked("abc abc abd"), "y": language_id.ranked("xyz xyz xyw")}
    names, every, table = language_id._places(profiles)

    def brute(text, profile):
        own, there = language_id.ranked(text).tolist(), profile.tolist()
        return sum(abs(i - there.index(g)) if g in there else language_id.LENGTH for i, g in enumerate(own))

    for text in ("abd", "xyw abc", "qqq abc xyz xyz"):
        a, b = brute(text, profiles["x"]), brute(text, profiles["y"])
        assert language_id.nearest(text, names, every, table) == (("x" if a <= b else "y"), round(max(a, b) / (a + b), 6))
    assert language_id.nearest("123 ...", names, every, table) == ("und", 0.0)


def test_nothing_learned(odd):
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0


def sentences(n, seed):
    """Insults make a text toxic; one group is mentioned in toxic texts far more often than the others."""
    random.seed(seed)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{random.randrange(200)}" for _ in range(12)] + [random.choice(["idiot", "scum"])] * toxic
        if random.random() < (0.7 if toxic else 0.05):
            words.append("muslim")
        elif random.random() < 0.3:
            words.append(random.choice(["christian", "jewish"]))
        random.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    rows = sentences(1_500, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    plain, fair = (toxicity.learn(docs, labels, swap=s).scorer() for s in (0.0, 10.0))
    neutral = [f"w1 w2 {term} w3" for term in ("muslim", "christian", "jewish")]
    spread = [np.ptp([m(t) for t in neutral]) for m in (plain, fair)]
    assert spread[1] < spread[0] / 2
    assert fair(neutral[0]) < plain(neutral[0]) and fair(neutral[0]) < 0.5
    test = sentences(400, 2)
    assert np.mean([(fair(t) >= 0.5) == bool(y) for _, t, y in test]) > 0.97


def test_the_given_labels_give_swaps_that_bind(spark):
    """On given documents: there are swaps, they halve what terms put into held-out texts change, and accuracy stays."""
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    plain, fair = toxicity.learn(docs, labels, swap=0.0), toxicity.learn(docs, labels)
    assert fair.swaps > 200 and fair.swaps == plain.swaps
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in docs.select("doc_id", "text").collect() if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    logit = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))

    def change(model):
        score, out = model.scorer(), []
        for i, r in enumerate(held):
            group = toxicity.IDENTITIES[i % len(toxicity.IDENTITIES)]
            out.append(np.ptp([logit(score(f"{r.text} {term}")) for term in group]))
        return float(np.mean(out))

    accuracy = lambda model: np.mean([(model.scorer()(r.text) >= 0.5) == bool(known[r.doc_id]) for r in held])
    assert change(fair) <= change(plain) / 2
    assert accuracy(fair) >= accuracy(plain) - 1e-9 and accuracy(fair) > 0.9


def test_fit_equals_plain_descent(monkeypatch):
    """The Newton fit against many small steps down the same loss, with weighted rows and swaps."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(60)]
    toxic = (rng.random(60) < 0.4).astype(float)
    times = rng.integers(1, 4, 60).astype(float)
    changes = {(-1, 2): 3, (-3, 4, 5): 1}
    monkeypatch.setattr(toxicity, "RIDGE", 0.01)
    w, b = toxicity.fit(rows, toxic, 6, changes, 0.5, times)
    x = np.zeros((60, 7))
    x[:, 6] = 1
    for i, row in enumerate(rows):
        x[i, row] = 1
    swaps = np.array([[-1, 1, 0, 0, 0, 0, 0], [0, 0, -1, 1, 1, 0, 0]], float)
    v, part = np.zeros(7), times / times.sum()
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-x @ v))
        ridge = 0.01 * np.append(v[:6], 0)
        v -= 0.2 * (x.T @ (part * (p - toxic)) + ridge + 0.5 * 2 * swaps.T @ (np.array([0.75, 0.25]) * (swaps @ v)))
    assert np.allclose(np.append(w, b), v, atol=2e-3)


def test_repeated_teaching_rows_are_summed(spark, monkeypatch):
    """One labelled id with very many rows sends one row to the driver, and teaches as often as it stands there."""
    rows = sentences(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1])] * 2_000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.fit

    def watched(lists, *rest):
        seen.append((len(lists), rest[-1].sum()))
        return fit(lists, *rest)

    monkeypatch.setattr(toxicity, "fit", watched)
    model = toxicity.learn(docs, labels)
    taught = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))
    assert model.intercept is not None and seen[0][0] <= taught and seen[0][1] == taught + 2_000 * (zlib.crc32(b"1") % 5 != 0)


def test_swaps_of_a_drawn_term():
    for text in (None, "", "some words", "man woman person"):
        for gone, came in toxicity.drawn_swap(text, toxicity.IDENTITIES):
            terms = {t for group in toxicity.IDENTITIES for t in group}
            assert {f.partition("$")[0] for f in gone if "$" in f} <= terms and {f.partition("$")[0] for f in came if "$" in f} <= terms
    assert list(toxicity.drawn_swap("a b", (("a", "b"),))) == []


def test_scores_of_all_rows(spark, both, rows, labels):
    model = toxicity.Model({"idiot$*1": 5.0, "bad*2": 1.0}, -2.0)
    got = {r.doc_id: r for r in toxicity.score(both, model).collect() if r.doc_id is not None}
    held = folds(rows)
    assert all(r.held_out == held[i] and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert got[1_000_010].predicted == 1 and got[1_000_003].score == got[1_000_004].score
    kept = toxicity.keep_clean(both, model)
    assert kept.columns == both.columns
    assert 1_000_010 not in {r.doc_id for r in kept.select("doc_id").collect()}
    assert toxicity.score(both.limit(0), model).count() == 0


def test_held_out_labels_and_tables_without_labels_teach_nothing(spark, both, labels):
    assert toxicity.learn(both, labels.limit(0)) == toxicity.Model({}, None)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(binary(string(doc_id))) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert toxicity.learn(both, labels) == toxicity.learn(both, flipped)
    nothing = toxicity.score(both, toxicity.Model({}, None)).agg({"score": "max", "predicted": "max"}).first()
    assert tuple(nothing) == (0.0, 0)


def test_words_remembered_change_nothing(monkeypatch):
    model = toxicity.Model({"abcd*1": 1.0, "abcd*2": 2.0, "abcdx$*1": -0.5}, 0.1)
    text = "abcdx abcdy abc ABCDX abcdx"
    first = model.scorer()(text)
    monkeypatch.setattr(toxicity, "WORDS_REMEMBERED", 0)
    again = model.scorer()
    assert [again(text), again(text)] == [first, first] == [round(1 / (1 + np.exp(-2.6)), 9)] * 2
