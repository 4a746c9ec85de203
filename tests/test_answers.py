import pytest

from dishlens.operators import answers

HITS = [
    (1, 1, 10, 0.885, 5, "x" * 301, ["thai", "isan", "french", "fusion"], ["tea"], ["nan", "mall", "trat"], ["a"]),
    (1, 2, 11, 0.125, None, " short one", [], [], [], []),
    (2, 1, 10, -0.01, 3, None, [], ["tea"], [], []),
]
SCHEMA = (
    "query_id bigint, rank int, row_id bigint, score double, star_rating int, review_text string, "
    "cuisine_type array<string>, food_type array<string>, location array<string>, mentioned_foods array<string>"
)


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(HITS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "อร่อย"), (2, "two"), (3, "none")], "query_id bigint, query string").cache()


def by_hand(query, hits):
    if not hits:
        return answers.NOT_FOUND
    lines = [f'จากการค้นหา "{query}" พบ {len(hits)} ร้านที่เกี่ยวข้อง:\n']
    for _, rank, _, score, rating, text, cuisine, food, location, _ in hits:
        rating, text = rating or 0, text or ""
        lines.append(f"\nร้านที่ {rank} (Rating: {rating}/5 {'*' * rating}, ความเกี่ยวข้อง: {score:.0%})")
        labels = [("ประเภทอาหาร", cuisine), ("แนวอาหาร", food), ("ที่ตั้ง", location)]
        parts = [f"{k}: {', '.join(v)}" for k, v in labels if v]
        lines += [" | ".join(parts)] if parts else []
        lines.append("รีวิว: " + text[:300].strip() + ("..." if len(text) > 300 else ""))
        lines.append("-" * 50)
    return "\n".join(lines)


def test_template(queries, hits):
    got = {r.query_id: r for r in answers.template_answers(queries, hits).collect()}
    for i, text in ((1, "อร่อย"), (3, "none")):
        mine = [h for h in HITS if h[0] == i]
        assert got[i].answer == by_hand(text, mine) and got[i].num_results == len(mine)
    assert got[2].num_results == 1


def test_prompt(queries, hits):
    got = {r.query_id: r.messages for r in answers.answer_prompts(queries, hits).collect()}
    assert got[3] is None
    assert [m.role for m in got[1]] == ["system", "user"]
    assert got[1][1].content == "คำถาม: อร่อย\n\nข้อมูลรีวิว:\nรีวิว 1 (Rating: 5/5): " + "x" * 301 + "\n\nรีวิว 2 (Rating: 0/5):  short one"


def test_router(spark, queries, hits):
    asked = queries.withColumn("use_model", queries.query_id != 2)
    got = {r.query_id: r for r in answers.routed_answers(asked, hits).collect()}
    assert got[1].answer is None and got[1].messages[0].role == "system"
    assert got[2].answer.startswith("จากการค้นหา") and got[2].messages is None
    assert got[3].answer == answers.NOT_FOUND


def test_cards(hits):
    rows = {(r.query_id, r["rank"]): r for r in answers.display_rows(hits).collect()}
    first = rows[(1, 1)]
    assert (first.cuisine_type_shown, first.location_shown) == (["thai", "isan", "french"], ["nan", "mall"])
    assert first.star_slots == "★★★★★" and first.relevance == "88.5%"
    assert rows[(1, 2)].star_slots == "☆☆☆☆☆" and rows[(2, 1)].review_shown == ""


def test_nested(queries, hits):
    nested = answers.nested_results(answers.template_answers(queries, hits), hits)
    got = {r.query_id: r for r in nested.collect()}
    assert [r["rank"] for r in got[1].results] == [1, 2] and got[3].results is None
    assert got[1].results[0].relevance_score == 0.885


def test_preview(spark):
    df = spark.createDataFrame([("y" * 501,), ("z",)], "a string")
    assert [r[0] for r in df.select(answers.answer_preview("a")).collect()] == ["y" * 500 + "...", "z"]
