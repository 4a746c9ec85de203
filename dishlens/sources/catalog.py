"""Constant relations: evaluation queries, sample queries, filter choices, category titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The evaluation queries as (category, query, description).
EVALUATION_QUERIES = (
    ("cuisine", "อาหารญี่ปุ่นอร่อย", "ค้นหาร้านอาหารญี่ปุ่นที่ได้รับความนิยม"),
    ("cuisine", "ร้านอาหารจีนแนะนำ", "ค้นหาร้านอาหารจีนที่แนะนำ"),
    ("cuisine", "อาหารอิตาลีดี", "ค้นหาร้านอาหารอิตาลีคุณภาพดี"),
    ("cuisine", "ร้านอาหารไทยรสเด็ด", "ค้นหาร้านอาหารไทยรสชาติจัดจ้าน"),
    ("cuisine", "อาหารอินเดียเผ็ด", "ค้นหาร้านอาหารอินเดียรสเผ็ด"),
    ("food_type", "อาหารทะเลสด", "ค้นหาร้านอาหารทะเลสดใหม่"),
    ("food_type", "พิซซ่าอร่อย", "ค้นหาร้านพิซซ่าอร่อย"),
    ("food_type", "ร้านเบเกอรี่ดี", "ค้นหาร้านเบเกอรี่คุณภาพดี"),
    ("food_type", "ร้านกาแฟบรรยากาศดี", "ค้นหาร้านกาแฟบรรยากาศดี"),
    ("food_type", "ก๋วยเตี๋ยวเส้นเล็ก", "ค้นหาร้านก๋วยเตี๋ยวเส้นเล็กอร่อย"),
    ("atmosphere_price", "ร้านอาหารหรูหรา", "ค้นหาร้านอาหารระดับหรู"),
    ("atmosphere_price", "ร้านข้างทางราคาถูก", "ค้นหาร้านข้างทางราคาประหยัด"),
    ("atmosphere_price", "ร้านบรรยากาศดีติดแอร์", "ค้นหาร้านอาหารบรรยากาศดีมีแอร์"),
    ("atmosphere_price", "คาเฟ่น่านั่ง", "ค้นหาคาเฟ่บรรยากาศน่านั่ง"),
    ("atmosphere_price", "ร้านอาหารราคานักศึกษา", "ค้นหาร้านอาหารราคาไม่แพง"),
    ("location", "ร้านอาหารเชียงใหม่", "ค้นหาร้านอาหารในเชียงใหม่"),
    ("location", "ร้านติดทะเลพัทยา", "ค้นหาร้านอาหารติดทะเลที่พัทยา"),
    ("location", "ร้านอาหารบนเขาใหญ่", "ค้นหาร้านอาหารบรรยากาศเขาใหญ่"),
    ("location", "ร้านอาหารกรุงเทพ", "ค้นหาร้านอาหารในกรุงเทพ"),
    ("location", "ร้านอาหารหัวหิน", "ค้นหาร้านอาหารในหัวหิน"),
    ("combined", "อาหารทะเลแบบไทยติดชายหาดพัทยา", "ค้นหาอาหารทะเลสไตล์ไทยริมหาดพัทยา"),
    ("combined", "ร้านอาหารญี่ปุ่นราคาไม่แพงเชียงใหม่", "ค้นหาร้านอาหารญี่ปุ่นราคาประหยัดในเชียงใหม่"),
    ("combined", "คาเฟ่บรรยากาศดีถ่ายรูปสวยกรุงเทพ", "ค้นหาคาเฟ่บรรยากาศดีถ่ายรูปสวยในกรุงเทพ"),
    ("combined", "ร้านก๋วยเตี๋ยวอร่อยราคาถูก", "ค้นหาร้านก๋วยเตี๋ยวอร่อยราคาไม่แพง"),
    ("combined", "ร้านอาหารไทยบรรยากาศดีวิวสวย", "ค้นหาร้านอาหารไทยบรรยากาศดีวิวสวย"),
    ("combined", "อาหารอิตาลีราคาหรูกรุงเทพ", "ค้นหาร้านอาหารอิตาลีระดับหรูในกรุงเทพ"),
)

# The category titles of the report, in its order.
CATEGORY_TITLES = (
    ("cuisine", "ประเภทอาหาร (Cuisine)"),
    ("food_type", "ประเภทอาหาร/เมนู (Food Type)"),
    ("atmosphere_price", "บรรยากาศและราคา (Atmosphere/Price)"),
    ("location", "สถานที่ (Location)"),
    ("combined", "แบบผสม (Combined)"),
)

# Sample queries by group.
SAMPLE_QUERIES = {
    "อาหารทะเล": ("อาหารทะเลสดๆ แถวพัทยา ราคาไม่แพง", "ร้านกุ้งเผาอร่อยในกรุงเทพ", "หอยนางรมสด ร้านไหนดี"),
    "อาหารญี่ปุ่น": ("ซูชิราคาถูก คุณภาพดี", "ร้านราเมนเจ้าอร่อย", "บุฟเฟ่ต์อาหารญี่ปุ่น"),
    "อาหารไทย": ("ต้มยำกุ้งรสเด็ด", "ร้านผัดไทยอร่อยๆ", "ข้าวซอยเชียงใหม่แท้ๆ"),
    "บรรยากาศ": ("ร้านอาหารบรรยากาศดี วิวสวย", "คาเฟ่เงียบสงบ นั่งทำงาน", "ร้านอาหารสำหรับเดท"),
    "ราคา": ("อาหารอร่อยราคาถูก", "บุฟเฟ่ต์ราคาหลักร้อย", "ร้านหรูราคาไม่แพง"),
}

# Queries of the quick demonstration.
QUICK_QUERIES = ("อาหารญี่ปุ่นอร่อย", "ร้านอาหารทะเลสดๆ", "คาเฟ่บรรยากาศดีกรุงเทพ", "ร้านอาหารหรูหรา")

# Labels offered as filters and the category each one stands for.
FILTER_LABELS = (
    ("cuisine_type", "ไทย", "thai"),
    ("cuisine_type", "ญี่ปุ่น", "japanese"),
    ("cuisine_type", "จีน", "chinese"),
    ("cuisine_type", "เกาหลี", "korean"),
    ("cuisine_type", "อิตาลี", "italian"),
    ("cuisine_type", "ฝรั่งเศส", "french"),
    ("cuisine_type", "อินเดีย", "indian"),
    ("cuisine_type", "เวียดนาม", "vietnamese"),
    ("food_type", "อาหารทะเล", "seafood"),
    ("food_type", "พิซซ่า", "pizza"),
    ("food_type", "ก๋วยเตี๋ยว", "noodle"),
    ("food_type", "กาแฟ", "coffee"),
    ("food_type", "เบเกอรี่", "bakery"),
    ("food_type", "สเต๊ก", "steak"),
    ("food_type", "แกง", "rice_curry"),
    ("food_type", "ของหวาน", "dessert"),
)
RATING_LABELS = (("ไม่กำหนด", None), ("1 ดาว", 1), ("2 ดาว", 2), ("3 ดาว", 3), ("4 ดาว", 4), ("5 ดาว", 5))


def evaluation_rows() -> list[tuple[int, str, str, str]]:
    return [(i, *row) for i, row in enumerate(EVALUATION_QUERIES)]


def evaluation_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(evaluation_rows(), "query_id bigint, category string, query string, description string")


def quick_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUICK_QUERIES)), "query_id bigint, query string")


def sample_queries(spark: SparkSession) -> DataFrame:
    """The samples with the defaults a click on one of them sets."""
    groups = spark.createDataFrame([(i, g, list(qs)) for i, (g, qs) in enumerate(SAMPLE_QUERIES.items())], "g int, grp string, qs array<string>")
    return groups.select("g", "grp", F.posexplode("qs").alias("pos", "query")).select(
        (F.col("g") * 3 + F.col("pos")).cast("bigint").alias("query_id"),
        "grp",
        "query",
        F.lit(5).alias("k"),
        F.lit("compare").alias("mode"),
        F.lit("").alias("cuisine_type"),
        F.lit("").alias("food_type"),
    )


def filter_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILTER_LABELS), "facet string, label string, category string")


def rating_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATING_LABELS), "label string, min_rating int")


def category_titles(spark: SparkSession) -> DataFrame:
    rows = [(i, k, t) for i, (k, t) in enumerate(CATEGORY_TITLES)]
    return spark.createDataFrame(rows, "title_rank int, category string, title string")


def resolve_filter_labels(queries: DataFrame) -> DataFrame:
    """Replace labels in the filter columns by the category they stand for; keys and blanks stay as they are."""
    labels = filter_labels(queries.sparkSession)
    for facet in ("cuisine_type", "food_type"):
        if facet in queries.columns:
            names = labels.where(F.col("facet") == facet).select(F.col("label").alias(facet), F.col("category").alias("_key"))
            queries = queries.join(F.broadcast(names), facet, "left").withColumn(facet, F.coalesce("_key", facet)).drop("_key")
    return queries
