from itertools import permutations

import pytest

from dishlens.llm import filter_audit as op

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text):
    words = text.encode().split()
    return (
        "A" * (len(words) < 200)
        + "B" * (100 * len(set(words)) < 50 * len(words))
        + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        + "D" * any(c in "#$%&*|" for c in text)
    )


def expected(rows, labels):
    key = lambda r: float("inf") if r.doc_id is None else r.doc_id
    least, good, toxic = {}, set(), set()
    for r in rows:
        least[r.text or ""] = min(least.get(r.text or "", float("inf")), key(r))
    for x in labels:
        good |= {x.doc_id} if x.quality == 1 else set()
        toxic |= {x.doc_id} if x.toxic == 1 else set()
    docs = [(r.lang or "", failed(r.text or "") + "E" * (key(r) > least[r.text or ""]), r.doc_id in good - {None}, r.doc_id in toxic - {None}) for r in rows]
    out = []
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fails = [d for d in mine if f in d[1]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), k + 1, len(left), len(gone), len(fails) - len(gone), sum(d[1] == f for d in fails), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [(*row[:9], shapley[row[9]]) for row in found]
    return sorted(out)


def written(df, path, files):
    df.repartition(files).write.mode("append").parquet(str(path))
    return str(path)


@pytest.fixture(scope="session")
def some_labels(spark, labels):
    extra = spark.createDataFrame([(1_000_001, 1, None), (1_000_001, 0, 1), (1_000_004, None, None), (None, 1, 1), (0, 1, 1)], labels.schema)
    return labels.unionByName(extra)


@pytest.mark.parametrize(("files", "per_batch"), [(5, 1), (5, 2), (1, None)])
def test_equals_brute_force(spark, both, rows, some_labels, tmp_path, files, per_batch):
    path = written(both, tmp_path / "docs.parquet", files)
    got = op.audit(spark, path, some_labels, files_per_batch=per_batch)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, some_labels.collect())


def test_smaller_ids_take_back_what_was_counted(spark, labels, tmp_path):
    """Batches in falling order of ids, so that every batch has smaller ids of texts seen before; then files that come later."""
    docs = spark.createDataFrame([(i, f"text {i % 7}" if i % 3 else None, ["en", None, "de"][i % 3]) for i in range(60)] + [(4, "text 4", "fr"), (4, "text 4", "en")], "doc_id long, text string, lang string")
    path, folder, seen = tmp_path / "docs.parquet", str(tmp_path / "state"), None
    for low in (45, 30, 15, 0):
        part = docs.where(f"doc_id >= {low} AND doc_id < {low + 15}")
        seen = part if seen is None else seen.unionByName(part)
        written(part, path, 2)
        got = op.audit(spark, str(path), labels, folder=folder, files_per_batch=1)
        assert sorted(tuple(r) for r in got.collect()) == expected(seen.collect(), labels.collect())
    again = op.audit(spark, str(path), labels, folder=folder)
    assert sorted(tuple(r) for r in again.collect()) == expected(docs.collect(), labels.collect())
    assert spark.read.parquet(f"{folder}/changes").where("n < 0").count()


def test_clashing_columns_and_empty_table(spark, odd, labels, tmp_path):
    path = written(odd.withColumnRenamed("copies", "mask"), tmp_path / "odd.parquet", 3)
    got = op.audit(spark, path, labels, files_per_batch=1)
    assert sorted(tuple(r) for r in got.collect()) == expected(odd.collect(), labels.collect())
    path = written(odd.limit(0), tmp_path / "none.parquet", 1)
    assert op.audit(spark, path, labels).count() == 0
    assert op.audit(spark, written(odd, tmp_path / "unlabelled.parquet", 1), labels.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0
