"""Constants that results depend on, spelled out once more: the SQL of the registered queries reads some of them from the code."""

from collections import Counter

from dishlens.functions import lexicon as lx
from dishlens.functions import text as tx
from dishlens.operators import metrics, pairs
from dishlens.plans import suite
from dishlens.sources import catalog


def test_shares_of_the_pair_strategies():
    assert pairs.SHARES == {"query": 0.3, "similar": 0.4, "rating": 0.3}
    assert pairs.ATTEMPTS == {"query": 10, "similar": 5, "rating": 5}
    assert [pairs.quota(s, 2_000) for s in ("query", "similar", "rating")] == [600, 800, 600]
    assert [pairs.quota(s, 7) for s in ("query", "similar", "rating")] == [2, 2, 2]
    assert pairs.HIGH_RATING == 4


def test_verdicts():
    assert metrics.VERDICTS == (
        (5.0, "มีการปรับปรุงอย่างมีนัยสำคัญ", "แนะนำให้ใช้โมเดลที่ Finetuned"),
        (0.0, "มีการปรับปรุงเล็กน้อย", "สามารถใช้โมเดลที่ Finetuned ได้"),
        (-5.0, "ไม่มีการเปลี่ยนแปลงที่สำคัญ", "อาจใช้โมเดล Baseline ก็ได้"),
    )
    assert metrics.VERDICT_ELSE == ("ประสิทธิภาพลดลง", "ควรใช้โมเดล Baseline")


def test_titles_labels_and_queries():
    assert catalog.CATEGORY_TITLES == (
        ("cuisine", "ประเภทอาหาร (Cuisine)"),
        ("food_type", "ประเภทอาหาร/เมนู (Food Type)"),
        ("atmosphere_price", "บรรยากาศและราคา (Atmosphere/Price)"),
        ("location", "สถานที่ (Location)"),
        ("combined", "แบบผสม (Combined)"),
    )
    assert catalog.QUICK_QUERIES == ("อาหารญี่ปุ่นอร่อย", "ร้านอาหารทะเลสดๆ", "คาเฟ่บรรยากาศดีกรุงเทพ", "ร้านอาหารหรูหรา")
    assert Counter(row[0] for row in catalog.EVALUATION_QUERIES) == {"cuisine": 5, "food_type": 5, "atmosphere_price": 5, "location": 5, "combined": 6}
    assert catalog.RATING_LABELS[0][1] is None and [n for _, n in catalog.RATING_LABELS[1:]] == [1, 2, 3, 4, 5]


def test_lexicon_sizes():
    """93 categories and 299 keywords, by table."""
    entries = lx.shipped_entries()
    keywords = Counter(e.facet for e in entries)
    categories = Counter(facet for facet, _ in {(e.facet, e.category) for e in entries})
    assert sum(keywords.values()) == 299 and sum(categories.values()) == 93
    assert sorted(categories.values()) == [6, 6, 14, 15, 22, 30] and sorted(keywords.values()) == [22, 26, 42, 62, 67, 80]


def test_texts_and_weights():
    assert (tx.MIN_REVIEW_CHARS, tx.SEARCH_TEXT_CHARS, tx.ANSWER_EXCERPT_CHARS, tx.CARD_EXCERPT_CHARS, tx.PROMPT_EXCERPT_CHARS) == (20, 500, 300, 400, 400)
    assert suite.TUNED_WEIGHTS[:8] == [1.0, 1 + 1 / 7, 1 + 2 / 7, 1 + 3 / 7, 1 + 4 / 7, 1 + 5 / 7, 1 + 6 / 7, 1.0] and len(suite.TUNED_WEIGHTS) == 64
