import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("dishlens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


THAI = "ร้านนี้อาหารไทยอร่อยมาก บรรยากาศดี วิวสวย ริมทะเล หัวหิน"
REVIEWS = [
    (1, "The steak was great and the staff kind", 5),
    (2, "Inexpensive BBQ near the mall in Chiang Mai", 4),
    (3, THAI, 4),
    (4, "Nothing of note here, just a plain room", 2),
    (5, "A review of small sushi and ramen places", 3),
    (6, "Good coffee, good tea, banana cake too", 5),
    (7, "ร้านไม่แพง อาหารทะเลสด ชาบูอร่อย เดินทางง่าย", 4),
    (8, "Seafood buffet by the beach, worth the trip", 1),
]


@pytest.fixture(scope="session")
def reviews(spark):
    return spark.createDataFrame(REVIEWS, "review_id bigint, review_text string, star_rating int").cache()


@pytest.fixture(scope="session")
def processed(spark, reviews):
    from dishlens.plans.preprocess import process_reviews

    terms = spark.createDataFrame([(0, "steak"), (1, "sushi"), (2, "Coffee"), (3, "อาหารทะเล")], "rank bigint, term string")
    return process_reviews(reviews, terms).cache()
