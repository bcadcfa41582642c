"""Texts of profiles and requests by hand."""

from pyspark.sql import functions as F

from basketry.operators import profiles

COLUMNS = "article_id long, super_category string, l2_style_mood string, l2_occasion string, l2_perceived_quality int, l2_trendiness string, l2_season_fit string, l3_color_harmony string, l3_tone_season string, l3_coordination_role string, l3_style_lineage string, l3_visual_weight int, l3_slot6 string, l3_slot7 string"


def shop(spark):
    facts = spark.createDataFrame([
        (1, "Apparel", '["Casual","Edgy"]', '["Work"]', 2, "Current", "Summer", "Neon", None, "Basic", '["Punk"]', 2, "A-line", None),
        (2, "Apparel", '["Casual"]', None, 3, None, "Winter", "Neon", "Cool-Winter", "Accent", '["Punk","Grunge"]', 5, "H-line", "Long"),
        (3, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ], COLUMNS)
    txn = spark.createDataFrame([(7, 1, "2020-01-03", 1.0, 2), (7, 2, "2020-01-02", 1.0, 1), (7, 1, "2020-01-01", 1.0, 2), (8, 3, "2020-01-01", 1.0, 1), (8, 99, "2020-01-02", 1.0, 1)], "customer_id long, article_id long, t_dat string, price double, sales_channel_id int")
    articles = spark.createDataFrame([(1, "Dress"), (2, "Coat"), (3, None)], "article_id long, product_type_name string")
    return facts, txn, articles


def test_template_profiles(spark):
    facts, txn, _ = shop(spark)
    users = spark.createDataFrame([(7,), (8,), (9,), (9,)], "customer_id long")
    got = {r.customer_id: r for r in profiles.template_profiles(users, txn, facts).collect()}
    assert got[7].reasoning_text == (
        "(a) Style mood: Casual, Edgy. (b) Occasion: Work. (c) Quality-price: Mid-range (avg 2.3/5). (d) Trend: Current. (e) Season: Summer, Winter. "
        "(f) Form: A-line, H-line. (g) Color: Neon; Cool-Winter. (h) Coordination: Basic, Accent. (i) Identity: User with 3 purchase(s), limited history for deep analysis.."
    )
    assert got[8].reasoning_text.startswith("(a) Style mood: Unknown.") and "(f) Form: Insufficient data." in got[8].reasoning_text and got[8].n_purchases == 2
    assert got[9].reasoning_text.endswith("(i) Identity: New user with no purchase history.") and got[9].reasoning_json == "{}" and got[9].n_purchases == 0
    assert '"quality_price_tendency":"Mid-range (avg 2.3/5)"' in got[7].reasoning_json and {r.profile_source for r in got.values()} == {"template"}


def test_tenths_round_halves_up(spark):
    own = spark.createDataFrame([(9, 4), (11, 4), (7, 3), (0, 5), (20, 5)], "t int, n int")
    assert [r[0] for r in own.select(profiles.tenths(F.col("t"), F.col("n"))).collect()] == ["2.3", "2.8", "2.3", "0.0", "4.0"]


def test_request_messages(spark):
    facts, txn, articles = shop(spark)
    got = {r.customer_id: r.message for r in profiles.request_messages(txn, articles, facts, spark.createDataFrame([(7, 0.918, 4)], "customer_id long, diversity double, quintile int"), {"Apparel": {"l3_slot6": "Silhouette", "l3_slot7": "Proportion"}}, 2).collect()}
    assert got[7] == (
        "--- Customer Overview ---\nPurchases: 3 items, 2 unique types, diversity 0.92\nTop categories: Dress 67%, Coat 33%\nPrice position: avg 4.0/5, Online ratio: 67%\n"
        "\n--- Recent Items (L2 Attributes) ---\n1. Apparel | Style: Casual, Edgy | Occasion: Work | Quality: 2/5 | Trend: Current | Season: Summer\n2. Apparel | Style: Casual | Quality: 3/5 | Season: Winter\n"
        "\n--- Attribute Patterns (L3 Theory-Based) ---\nColor Harmony: Neon 100%\nTone Season: Cool-Winter 100%\nCoordination Role: Basic 67%, Accent 33%\nStyle Lineage: Punk 75%, Grunge 25%\nVisual Weight: mean 3.0, std 1.4\n"
        "Category-Specific:\n  Apparel (n=3): | Silhouette: A-line 67%, H-line 33% | Proportion: Long 100%"
    )
    assert got[8] == "--- Customer Overview ---\nPurchases: 2 items, 0 unique types, diversity 0.00\nPrice position: avg 3.0/5, Online ratio: 0%\n\n--- Recent Items (L2 Attributes) ---\n1. \n2. \n\n--- Attribute Patterns (L3 Theory-Based) ---"
