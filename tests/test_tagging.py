from dishlens.functions import lexicon as lx
from dishlens.operators.tagging import tag_columns, tag_reviews, tag_whole_words
from dishlens.operators.terms import with_mentions

FACETS = list(lx.REVIEW_FACETS)


def tags(df):
    return {r.review_id: {f: r[f] for f in FACETS} for r in df.collect()}


def brute(text, facets):
    out = []
    for facet in facets:
        for e in lx.shipped_entries():
            if e.facet == facet and e.keyword.lower() in text.lower() and e.category not in out:
                out.append(e.category)
    return out


def test_sizes():
    assert len(lx.shipped_entries()) == 299
    assert len({(e.facet, e.category) for e in lx.shipped_entries()}) == 93


def test_both_ways_equal_brute_force(reviews):
    want = {r.review_id: {f: brute(r.review_text, lx.REVIEW_FACETS[f]) for f in FACETS} for r in reviews.collect()}
    assert tags(tag_columns(reviews, lx.shipped_entries())) == want
    assert tags(tag_reviews(reviews, lx.shipped_entries(), scan_from=0)) == want


def test_overlaps_and_upper_case_keyword(reviews):
    got = tags(tag_reviews(reviews, lx.shipped_entries()))
    assert got[1]["food_type"] == ["steak", "tea"]
    assert "bbq" in got[2]["food_type"]
    assert got[2]["price_level"] == ["expensive", "cheap"]
    assert got[7]["price_level"] == ["expensive", "budget"]
    assert got[3]["location"] == ["beachside", "hua_hin", "prachuap"]
    assert {"seafood"} <= set(got[3]["food_type"]) and "beachfront" in got[3]["atmosphere"]
    assert "good_view" in got[5]["atmosphere"] and "mall" in got[5]["location"] and "nan" in got[6]["location"]
    assert all(v == [] for f, v in got[4].items() if f != "location")


def test_unfolded_keyword_never_matches(reviews):
    got = tags(tag_reviews(reviews, lx.shipped_entries(), fold_keywords=False))
    assert "bbq" not in got[2]["food_type"]


def test_whole_words(reviews):
    got = tags(tag_whole_words(reviews, lx.shipped_entries()))
    assert got[1]["food_type"] == ["steak"]
    assert got[6]["food_type"] == ["coffee", "tea"] and got[6]["location"] == []
    assert got[2]["location"] == ["mall", "chiang_mai"]


def test_own_lexicon_table(spark, reviews):
    table = spark.createDataFrame([("cuisine_type", 1, "b", 0, "plain"), ("cuisine_type", 0, "a", 0, "room")], lx.SCHEMA)
    entries = lx.load_entries(table)
    assert tags(tag_reviews(reviews, entries))[4]["cuisine_type"] == ["a", "b"]


def test_mentions_in_one_pass_in_blocks_and_by_brute_force_agree(spark):
    texts = [(1, "abcd efgh ijkl mnop qrst uvwx"), (2, "nothing"), (3, "ABCDEFGH"), (4, None), (5, "ab"), (6, "uvwx abcd")]
    terms = [(5, "abcd"), (1, "uvwx"), (2, "mnop"), (3, "qrst"), (4, "ijkl"), (0, "efgh"), (9, "Bcde"), (8, "hing"), (6, "ab"), (7, "t")]
    df = spark.createDataFrame(texts, "review_id bigint, review_text string")
    dic = spark.createDataFrame(terms, "rank bigint, term string")
    want = {i: [t for _, t in sorted(terms) if x and t.lower() in x.lower()][:5] for i, x in texts}
    for terms_at_once, chars in ((200_000, 1_000), (3, 1_000), (200_000, 5), (1, 1)):
        done = with_mentions(df, dic, max_scan_terms=terms_at_once, max_scan_chars=chars)
        got = {r.review_id: r.mentioned_foods for r in done.collect()}
        assert got == want


def test_large_dictionaries_write_no_texts(spark, monkeypatch):
    from dishlens.operators import terms

    written, kept = [], terms.materialize
    monkeypatch.setattr(terms, "materialize", lambda df, name: written.append(df.columns) or kept(df, name))
    rows = [(i % 7, f"abcd efgh {'mnop ' * (i % 2)}{i % 5}") for i in range(60)] + [(None, None), (1, "")]
    df = spark.createDataFrame(rows, "review_id bigint, review_text string")
    dic = spark.createDataFrame([(0, "abcd"), (1, "efgh"), (2, "mnop"), (3, "fgh 1")], "rank bigint, term string")
    got = with_mentions(df, dic, max_mentions=2, max_scan_terms=1)
    want = sorted((str(i), str(x), [t for t in ("abcd", "efgh", "mnop", "fgh 1") if x and t in x][:2]) for i, x in rows)
    assert sorted((str(r.review_id), str(r.review_text), r.mentioned_foods) for r in got.collect()) == want
    assert written and all("review_text" not in columns for columns in written)


def test_texts_are_scanned_some_at_a_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    from dishlens.operators import terms

    df = spark.range(50).coalesce(1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("tea and cake "), "id")).alias("t"))
    listing = [terms.Listing("found", (("tea", ("tea", "te")), ("cake", ("cake",)), ("one", ("1",))), 2)]
    whole = [r.x for r in df.orderBy("id").select(terms.scan(F.col("t"), listing).alias("x")).collect()]
    monkeypatch.setattr(terms, "STEP_TEXTS", 3)
    assert [r.x for r in df.orderBy("id").select(terms.scan(F.col("t"), listing).alias("x")).collect()] == whole
    assert [r.found for r in whole[:3]] == [[], ["tea", "cake"], ["tea", "cake"]]
