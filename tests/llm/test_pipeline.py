"""The pipeline's stages against plain versions, and every registered query on the smallest tables."""

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from dishlens.llm import collocations, language_id, near_dedup, oracle, quality_rules, queries, simhash, substring_dedup, suffix_dedup, toxicity
from dishlens.sources.sinks import materialize

DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, documents, labels):
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), name)
        kept[name] = docs.collect()
        assert name == "sentencepiece" or docs.columns == documents.columns
    rows = documents.collect()
    scorer = toxicity.learn(documents, labels).scorer()
    clean = [r for r in rows if scorer(r.text) < 0.5]
    assert sorted(r.doc_id for r in kept["toxicity"]) == sorted(r.doc_id for r in clean)
    groups = collections.defaultdict(list)
    for r in clean:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(min(g)[1] for g in groups.values())
    from test_near_dedup import expected

    near = {i for i, _, least in expected(kept["exact_dedup"], 5) if i == least}
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(near)
    mixed = collections.Counter(r.doc_id for r in kept["mixing"])
    assert max(mixed.values()) <= 3 and set(mixed) <= near
    assert collections.Counter(r.doc_id for r in kept["sentencepiece"]) == mixed
    assert all(r.lossless for r in kept["sentencepiece"])


def test_stages_take_odd_and_empty_tables(spark, odd):
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, DIR), name)
        assert {"doc_id", "ids"} <= set(docs.columns)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(str(tuple(tidy(r[c]) for c in cols)) for r in df.collect())
    cur = db.execute(oracle.SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == sorted(str(tuple(tidy(r[have.index(c)]) for c in cols)) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op1", "op6", "op7", "op9", "op10", "op11", "op12"])
def test_columns_of_clashing_names_change_nothing(odd, name):
    """Every operator on rows with nulls, ties, repeats and extra columns, against the same rows without the extra columns."""
    run = {
        "op1": quality_rules.judge,
        "op6": near_dedup.near_duplicates,
        "op7": lambda docs: substring_dedup.digest(substring_dedup.dedupe_passages(docs)),
        "op9": language_id.identify,
        "op10": lambda docs: suffix_dedup.digest(suffix_dedup.dedupe_strings(docs)),
        "op11": collocations.frequent_phrases,
        "op12": simhash.near_duplicates,
    }[name]
    extra = odd.withColumns({c: F.lit("x") for c in ("words", "n", "route", "fp", "shard", "host", "key", "position", "size", "score")})
    plain = odd.select("doc_id", "text", "lang", "source")
    got = [sorted(str(sorted(r.asDict().items(), key=str)) for r in run(docs).collect()) for docs in (extra, plain)]
    assert got[0] and got[0] == got[1]


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
