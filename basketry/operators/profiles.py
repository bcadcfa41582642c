"""User profiles with time decay, distributions, recent items and composed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordering import placed


def weighted(txn: DataFrame, half_life: float = 90.0) -> DataFrame:
    """Purchases with a weight that halves every ``half_life`` days before the last day."""
    last = txn.agg(F.max("t_dat").alias("_last"))
    return txn.crossJoin(F.broadcast(last)).withColumn("w", C.decay(F.col("t_dat"), F.col("_last"), half_life)).drop("_last")  # one row


def base_profiles(txn: DataFrame, articles: DataFrame, half_life: float = 90.0) -> DataFrame:
    """Counts, weighted mean price and online share of each user; unmatched articles stay."""
    own = weighted(txn, half_life).join(articles.select("article_id", "product_type_name"), "article_id", "left")
    return own.groupBy("customer_id").agg(
        F.count("*").alias("n_purchases"),
        F.count_distinct("article_id").alias("n_articles"),
        F.count_distinct("product_type_name").alias("n_types"),
        (F.sum(F.col("price") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("avg_price"),
        F.avg(F.when(F.col("sales_channel_id") == 2, 1.0).otherwise(0.0)).alias("online_ratio"),
    )


def distributions(rows: DataFrame, value: str, weight: str | None = "w", user: str = "customer_id") -> DataFrame:
    """(user, value, p): each value's share of the user's weight; nulls and 'None' are left
    out, also of the total."""
    own = rows.where(F.col(value).isNotNull() & (F.col(value) != "None"))
    sums = own.groupBy(user, F.col(value).alias("value")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("w"))
    return sums.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy(user))).drop("w")


def top_shares(dist: DataFrame, k: int = 10, user: str = "customer_id") -> DataFrame:
    """The k largest shares of each user, shares kept as of the whole; shares that agree to
    nine digits go by value."""
    place = F.row_number().over(W.partitionBy(user).orderBy(F.desc(F.round("p", 9)), "value"))
    return dist.withColumn("place", place).where(F.col("place") <= k)


def as_json(top: DataFrame, to: str, digits: int = 4, user: str = "customer_id") -> DataFrame:
    """One JSON object of rounded shares for each user, largest first."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "p"))), lambda x: F.struct(x["value"], F.round(x["p"], digits)))
    return top.groupBy(user).agg(F.to_json(F.map_from_entries(pairs)).alias(to))


def diversity(dist: DataFrame, user: str = "customer_id") -> DataFrame:
    """Normalised Shannon entropy of each user's shares; 0 for a single value."""
    h = -F.sum(F.col("p") * F.log2("p"))
    return dist.groupBy(user).agg(F.when(F.count("*") > 1, h / F.log2(F.count("*"))).otherwise(0.0).alias("diversity"))


def tastes(txn: DataFrame, facts: DataFrame, columns: list[str], half_life: float = 90.0, k: int = 10, user: str = "customer_id") -> DataFrame:
    """(user, avg_price, online_ratio, the columns, diversity): what ``base_profiles``, the maps of
    ``top_shares`` of each column and the ``diversity`` of the first one tell. Purchases are dealt by
    user once; all columns are counted, shared out and ranked in the tasks that hold the user."""
    own = weighted(txn, half_life).join(facts.select("article_id", *columns), "article_id", "left").repartition(user)
    entries = F.array(*[F.struct(F.lit(c).alias("what"), v.cast("string").alias("value")) for c, v in [("", F.lit("")), *((c, F.col(c)) for c in columns)]])
    each = F.explode(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "None"))).alias("e")
    sums = own.select(user, "w", "price", F.when(F.col("sales_channel_id") == 2, 1.0).otherwise(0.0).alias("online"), each).groupBy(user, "e.what", "e.value").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("e.what") == "", F.col("price") * F.col("w"))).alias("paid"), F.avg("online").alias("online"))
    dist = sums.withColumn("p", F.when(F.col("what") != "", F.col("w")) / F.sum("w").over(W.partitionBy(user, "what")))
    place = F.row_number().over(W.partitionBy(user, "what").orderBy(F.desc(F.round("p", 9)), "value"))
    top = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("place") <= k, F.struct("value", "p")))))
    h = F.when(F.count("*") > 1, -F.sum(F.col("p") * F.log2("p")) / F.log2(F.count("*"))).otherwise(0.0)
    by = dist.withColumn("place", place).groupBy(user, "what").agg(top.alias("top"), h.alias("h"), F.max("paid").alias("paid"), F.max("w").alias("w"), F.max("online").alias("online"))
    of = lambda c, x: F.first(F.when(F.col("what") == c, F.col(x)), ignorenulls=True)
    return by.groupBy(user).agg((of("", "paid") / F.nullif(of("", "w"), F.lit(0.0))).alias("avg_price"), of("", "online").alias("online_ratio"), *[of(c, "top").alias(c) for c in columns], of(columns[0], "h").alias("diversity"))


def price_quintiles(profiles: DataFrame, user: str = "customer_id") -> DataFrame:
    """1 to 5 by place of the mean price, ties by user; null prices get null."""
    priced = profiles.where("avg_price is not null")
    n = priced.agg(F.count("*").alias("n"))
    own = placed(priced.select(user, "avg_price"), F.col("avg_price"), F.col(user)).crossJoin(F.broadcast(n))  # one row
    own = own.select(user, C.quintile(F.col("place") + 1, F.col("n")).cast("long").alias("quintile"))
    return profiles.select(user).join(own, user, "left")


def recent_items(txn: DataFrame, k: int | None = 20, users: DataFrame | None = None) -> DataFrame:
    """The last k purchases (all without k) of each user, newest first, ties by article and price."""
    own = txn if users is None else txn.join(users.select("customer_id").distinct(), "customer_id", "left_semi")
    place = F.row_number().over(W.partitionBy("customer_id").orderBy(F.desc("t_dat"), "article_id", "price", "sales_channel_id"))
    own = own.withColumn("place", place)
    return own if k is None else own.where(F.col("place") <= k)


def recent_with_facts(txn: DataFrame, articles: DataFrame, facts: DataFrame, columns: list[str], k: int = 20, users: DataFrame | None = None) -> DataFrame:
    """``recent_items`` with the article's type and its facts; purchases of articles without
    either stay, with nulls."""
    own = recent_items(txn, k, users).join(articles.select("article_id", "product_type_name"), "article_id", "left")
    return own.join(facts.select("article_id", *columns), "article_id", "left").select("customer_id", "place", "article_id", "t_dat", "product_type_name", *columns)


def recent_lists(recent: DataFrame, columns: list[str], user: str = "customer_id") -> DataFrame:
    """(user, items): structs of ``columns`` in order of place, nulls kept, so that all fields stay aligned."""
    items = F.array_sort(F.collect_list(F.struct("place", *columns)))
    return recent.groupBy(user).agg(F.transform(items, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("items"))


def style_profiles(txn: DataFrame, facts: DataFrame, columns: list[str], by: str | None = "super_category") -> DataFrame:
    """(customer_id, scope, attribute, value, p): shares of attribute values of a user's
    purchases, over all (``shared``) and within each value of ``by``."""
    own = txn.join(facts, "article_id")
    long = own.select("customer_id", F.col(by).alias("scope") if by else F.lit("shared").alias("scope"), F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("customer_id", "scope", "x.*").where("value is not null")
    n = long.groupBy("customer_id", "scope", "attribute", "value").agg(F.count("*").alias("n"))
    shared = n.groupBy("customer_id", "attribute", "value").agg(F.sum("n").alias("n")).withColumn("scope", F.lit("shared"))
    every = n.unionByName(shared) if by else n
    total = F.sum("n").over(W.partitionBy("customer_id", "scope", "attribute"))
    return every.withColumn("p", F.col("n") / total).drop("n")


def visual_weight(txn: DataFrame, facts: DataFrame) -> DataFrame:
    """Mean and population deviation of the visual weight of each user's purchases."""
    own = txn.join(facts.select("article_id", "l3_visual_weight"), "article_id").groupBy("customer_id")
    return own.agg(F.avg("l3_visual_weight").alias("mean_weight"), F.stddev_pop("l3_visual_weight").alias("sd_weight"))


def sparse_profiles(users: DataFrame, txn: DataFrame, facts: DataFrame, column: str, k: int = 3) -> DataFrame:
    """Most frequent values of a JSON list attribute for each user, as text; users without
    any get ``Insufficient data``."""
    values = txn.join(facts.select("article_id", C.json_list(F.col(column)).alias("v")), "article_id").select("customer_id", F.explode("v").alias("value"))
    top = top_shares(distributions(values, "value", None), k)
    text = top.groupBy("customer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), ", ").alias("text"))
    return users.select("customer_id").distinct().join(text, "customer_id", "left").withColumn("text", F.coalesce("text", F.lit("Insufficient data")))


def quality_words(mean: Column) -> Column:
    """Band of a mean quality, with one decimal."""
    band = F.when(mean <= 2, "budget").when(mean <= 3.5, "mid-range").otherwise("premium")
    return F.when(mean.isNull(), "Insufficient data").otherwise(F.format_string("%s (%.1f)", band, mean))


def profile_texts(profiles: DataFrame) -> DataFrame:
    """One line of text of each profile: parts that are null are left out."""
    parts = [
        F.concat(F.lit("(a) purchases: "), F.col("n_purchases").cast("string")),
        F.concat(F.lit("(b) types: "), F.col("n_types").cast("string")),
        F.concat(F.lit("(c) channel: "), F.when(F.col("online_ratio") >= 0.5, "online").otherwise("store")),
    ]
    return profiles.select("customer_id", F.concat_ws("; ", *parts).alias("text"))


def merged_profiles(profiles: DataFrame, active: DataFrame, sparse: DataFrame) -> DataFrame:
    """Profiles with a text and where it comes from: that of ``active`` (customer_id, text),
    else the template of ``sparse``, else none."""
    own = profiles.join(active.select("customer_id", F.col("text").alias("_a")), "customer_id", "left").join(sparse.select("customer_id", F.col("text").alias("_s")), "customer_id", "left")
    source = F.when(F.col("_a").isNotNull(), "model").when(F.col("_s").isNotNull(), "template").otherwise("none")
    return own.select(*profiles.columns, F.coalesce("_a", "_s", F.lit("")).alias("text"), source.alias("profile_source"), F.col("_a").isNotNull().alias("is_active"))

# fixed values: fields of a profile with their labels, in their order
FIELDS = [
    ("style_mood_preference", "Style mood"),
    ("occasion_preference", "Occasion"),
    ("quality_price_tendency", "Quality-price"),
    ("trend_sensitivity", "Trend"),
    ("seasonal_pattern", "Season"),
    ("form_preference", "Form"),
    ("color_tendency", "Color"),
    ("coordination_tendency", "Coordination"),
    ("identity_summary", "Identity"),
]
# fixed values: attributes that fields name the most frequent values of, and how many
NAMED = {"l2_style_mood": 3, "l2_occasion": 3, "l2_trendiness": 1, "l2_season_fit": 2, "l3_color_harmony": 2, "l3_tone_season": 2, "l3_coordination_role": 2, "l3_slot6": 2}
LISTS = ("l2_style_mood", "l2_occasion")


def tenths(total: Column, n: Column) -> Column:
    """total / n with one digit, as text; exact halves go up. Whole numbers, so that it doesn't
    depend on how a quotient is stored."""
    t = F.floor((20 * total + n) / (2 * n)).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def quality_tendency(total: Column, n: Column) -> Column:
    """The band of a mean quality of 1 to 5; Unknown without any."""
    band = F.when(total <= 2 * n, "Budget-conscious").when(2 * total <= 7 * n, "Mid-range").otherwise("Quality-oriented")
    return F.when(n > 0, F.concat(band, F.lit(" (avg "), tenths(total, n), F.lit("/5)"))).otherwise("Unknown")


def template_profiles(users: DataFrame, txn: DataFrame, facts: DataFrame, user: str = "customer_id") -> DataFrame:
    """(user, n_purchases, the nine fields, reasoning_text, reasoning_json, profile_source) of
    users with little history, from the facts of what they bought, whole quality scales included.

    A field names the most frequent values of an attribute, of equals the first in code-point
    order. Users without a purchase have Unknown fields and an empty JSON object.
    """
    wanted = users.select(user).distinct()
    own = txn.select(user, "article_id").join(wanted, user, "left_semi").join(facts.select("article_id", "l2_perceived_quality", *NAMED), "article_id", "left")
    quality = F.col("l2_perceived_quality").cast("long")
    sums = own.groupBy(user).agg(F.count("*").alias("n_purchases"), F.sum(quality).alias("_q"), F.count(quality).alias("_nq"))
    value = lambda c: C.json_list(F.col(c)) if c in LISTS else F.array(F.col(c).cast("string"))
    under = lambda c: lambda v: F.struct(F.lit(c).alias("field"), v.alias("value"))
    each = F.concat(*[F.transform(value(c), under(c)) for c in NAMED])
    n = own.select(user, F.explode(each).alias("x")).select(user, "x.*").where("value is not null").groupBy(user, "field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(user, "field").orderBy(F.desc("n"), "value"))
    most = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    top = n.withColumn("place", place).where(F.col("place") <= F.element_at(most, F.col("field")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), ", ")
    texts = top.groupBy(user, "field").agg(names.alias("text")).groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("_t"))
    own = wanted.join(sums, user, "left").join(texts, user, "left")
    bought = F.coalesce("n_purchases", F.lit(0))
    of = lambda c, none: F.coalesce(F.try_element_at("_t", F.lit(c)), F.lit(none))
    colour = F.concat_ws("; ", F.try_element_at("_t", F.lit("l3_color_harmony")), F.try_element_at("_t", F.lit("l3_tone_season")))
    fields = {
        "style_mood_preference": of("l2_style_mood", "Unknown"),
        "occasion_preference": of("l2_occasion", "Unknown"),
        "quality_price_tendency": quality_tendency(F.coalesce("_q", F.lit(0)), F.coalesce("_nq", F.lit(0))),
        "trend_sensitivity": of("l2_trendiness", "Unknown"),
        "seasonal_pattern": of("l2_season_fit", "Unknown"),
        "form_preference": F.when(bought > 0, of("l3_slot6", "Insufficient data")).otherwise("Unknown"),
        "color_tendency": F.when(colour != "", colour).otherwise("Unknown"),
        "coordination_tendency": of("l3_coordination_role", "Unknown"),
        "identity_summary": F.when(bought > 0, F.concat(F.lit("User with "), bought.cast("string"), F.lit(" purchase(s), limited history for deep analysis."))).otherwise("New user with no purchase history."),
    }
    out = own.select(user, bought.alias("n_purchases"), *[v.alias(k) for k, v in fields.items()])
    json = F.when(F.col("n_purchases") > 0, F.to_json(F.struct(*fields))).otherwise("{}")
    return out.withColumns({"reasoning_text": nine_fields(F.struct(*fields)), "reasoning_json": json, "profile_source": F.lit("template")})


def nine_fields(profile: Column) -> Column:
    """A profile's nine fields as one text: (a) Style mood: ... (i) Identity: ...; what is missing
    is Unknown. Every field gets a full stop but the template's sentence for new users, which has its own."""
    new = profile["identity_summary"] == "New user with no purchase history."
    parts = []
    for k, (name, label) in enumerate(FIELDS):
        end = F.when(new, "").otherwise(".") if name == "identity_summary" else F.lit(".")
        parts.append(F.concat(F.lit(f"({chr(97 + k)}) {label}: "), F.coalesce(profile[name], F.lit("Unknown")), end))
    return F.concat_ws(" ", *parts)


# fixed values: how recent items and attribute patterns are named in a request
PATTERNS = [("l3_color_harmony", "Color Harmony"), ("l3_tone_season", "Tone Season"), ("l3_coordination_role", "Coordination Role"), ("l3_style_lineage", "Style Lineage")]


def percents(shares: Column, most: int) -> Column:
    """Shares (value, n, total), largest first, as "value 42%, ..."; exact halves go up."""
    one = lambda s: F.concat(s["value"], F.lit(" "), F.floor((200 * s["n"] + s["total"]) / (2 * s["total"])).cast("string"), F.lit("%"))
    return F.array_join(F.transform(F.slice(shares, 1, most), one), ", ")


def request_messages(txn: DataFrame, articles: DataFrame, facts: DataFrame, standing: DataFrame, slots: dict[str, dict[str, str]], k: int = 20, user: str = "customer_id") -> DataFrame:
    """(user, message): what a model is told of each user: an overview, the last ``k`` items with
    how they are perceived, and the shares of style attributes, over all and by category.

    ``standing``: (user, diversity, quintile), of which missing ones are 0 and 3. ``slots``: for each category the labels of its own attributes (l3_slot6, l3_slot7). Parts
    without a value are left out; lines are in a fixed order, so a rerun gives the same text.
    """
    columns = ["super_category", "l2_style_mood", "l2_occasion", "l2_perceived_quality", "l2_trendiness", "l2_season_fit", "l3_visual_weight", "l3_slot6", "l3_slot7", *(c for c, _ in PATTERNS)]
    known = txn.join(articles.select("article_id", "product_type_name"), "article_id", "left")
    known = known.join(facts.select("article_id", *columns, F.lit(True).alias("_has")), "article_id", "left").repartition(user)
    recent = recent_items(known, None)
    whole = lambda a, b: F.floor((200 * a + b) / (2 * b)).cast("string")
    overview = [
        F.lit("--- Customer Overview ---"),
        F.concat(F.lit("Purchases: "), F.col("_n").cast("string"), F.lit(" items, "), F.col("_k").cast("string"), F.lit(" unique types, diversity "), F.format_string("%.2f", F.coalesce("_diversity", F.lit(0.0)))),
        F.when(F.size("_types") > 0, F.concat(F.lit("Top categories: "), percents(F.col("_types"), 5))),
        F.concat(F.lit("Price position: avg "), F.format_string("%.1f", F.coalesce("_quintile", F.lit(3.0))), F.lit("/5, Online ratio: "), whole(F.col("_online"), F.col("_n")), F.lit("%")),
    ]
    members = lambda c: F.array_join(F.slice(C.json_list(F.col(c)), 1, 3), ", ")
    some = lambda label, x, end="": F.when(x.isNotNull() & (x != ""), F.concat(F.lit(label), x, F.lit(end)))
    text = lambda c: F.col(c).cast("string")
    item = F.concat_ws(" | ", some("", text("super_category")), some("Style: ", members("l2_style_mood")), some("Occasion: ", members("l2_occasion")), some("Quality: ", text("l2_perceived_quality"), "/5"), some("Trend: ", text("l2_trendiness")), some("Season: ", text("l2_season_fit")))
    line = F.concat(F.col("place").cast("string"), F.lit(". "), item)
    # (what, category, value, n, place): a purchase's lines and values, of which each user's are counted; all in the tasks that hold the user
    entry = lambda what, value, category=None, place=None: F.struct(F.lit(what).alias("what"), (F.lit(None).cast("string") if category is None else category).alias("category"), value.cast("string").alias("value"), (F.lit(0) if place is None else place).cast("int").alias("place"))
    has, category = F.col("_has"), F.col("super_category")
    one = [entry("all", F.lit("")), entry("online", F.when(F.col("sales_channel_id") == 2, "")), entry("type", F.col("product_type_name")), entry("item", F.when(F.col("place") <= k, line), place=F.col("place"))]
    one += [entry("bought", F.when(has, "")), entry("weight", F.when(has, F.col("l3_visual_weight").cast("long"))), entry("category", F.when(has & category.isNotNull(), ""), category)]
    one += [entry(c, F.when(has & category.isNotNull(), F.col(c)), category) for c in ("l3_slot6", "l3_slot7")]
    one += [entry(c, F.when(has, F.col(c))) for c, _ in PATTERNS if c != "l3_style_lineage"]
    lineage = F.transform(F.when(has, C.json_list(F.col("l3_style_lineage"))), lambda v: entry("l3_style_lineage", v))
    entries = F.concat(F.array(*one), F.coalesce(lineage, F.array().cast("array<struct<what:string,category:string,value:string,place:int>>")))
    n = recent.select(user, F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e")).select(user, "e.*").groupBy(user, "what", "category", "value", "place").agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(W.partitionBy(user, "what", "category")))
    listed = n.groupBy(user, "what", "category").agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("n")).alias("minus"), "value", "n", "total"))).alias("x"))
    # one row of a user: what names a single list, and the lists of its categories
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("x")))
    single = ["all", "online", "type", "item", "bought", "weight", *(c for c, _ in PATTERNS)]
    by = listed.groupBy(user, "category").agg(*[of(w).alias(f"_{w}") for w in [*single, "category", "l3_slot6", "l3_slot7"]])
    named = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for cat, labels in slots.items() for x in (cat, labels[c])]), F.col("super_category")), F.lit(c[3:].capitalize()))
    own = F.concat_ws(" | ", F.concat(F.lit("  "), F.col("super_category"), F.lit(" (n="), F.col("_category")[0]["n"].cast("string"), F.lit("):")), *[F.when(F.size(f"_{c}") > 0, F.concat(named(c), F.lit(": "), percents(F.col(f"_{c}"), 3))) for c in ("l3_slot6", "l3_slot7")])
    by = by.withColumnRenamed("category", "super_category").withColumn("_line", F.when(F.col("super_category").isNotNull(), F.struct("super_category", own.alias("line"))))
    out = by.groupBy(user).agg(*[F.max(f"_{w}").alias(f"_{w}") for w in single], F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["line"]), "\n").alias("_categories"))
    out = out.join(standing.select(user, F.col("diversity").alias("_diversity"), F.col("quintile").cast("double").alias("_quintile")), user, "left")
    total = lambda f: F.aggregate("_weight", F.lit(0).cast("long"), lambda a, w: a + w["n"] * f(w["value"].cast("long")))
    # of whole numbers, so that it doesn't depend on the order of rows
    out = out.withColumns({"_n": F.col("_all")[0]["n"], "_k": F.when(F.col("_type").isNull(), 0).otherwise(F.size("_type")), "_online": F.coalesce(F.col("_online")[0]["n"], F.lit(0)), "_types": F.col("_type"), "_items": F.array_join(F.transform("_item", lambda x: x["value"]), "\n")})
    out = out.withColumns({"_w": total(lambda w: w), "_w2": total(lambda w: w * w), "_nw": F.col("_weight")[0]["total"]})
    out = out.withColumns({"_sd": F.sqrt((F.col("_nw") * F.col("_w2") - F.col("_w") * F.col("_w")).cast("double")) / F.col("_nw"), "_categories": F.nullif("_categories", F.lit(""))})
    patterns = [F.when(F.size(f"_{c}") > 0, F.concat(F.lit(f"{label}: "), percents(F.col(f"_{c}"), 5))) for c, label in PATTERNS]
    weight = F.when(F.col("_nw") > 0, F.concat(F.lit("Visual Weight: mean "), tenths(F.col("_w"), F.col("_nw")), F.lit(", std "), F.format_string("%.1f", F.col("_sd"))))
    message = F.concat_ws("\n", *overview, F.lit("\n--- Recent Items (L2 Attributes) ---"), "_items", F.lit("\n--- Attribute Patterns (L3 Theory-Based) ---"), *patterns, weight, F.when(F.col("_categories").isNotNull(), F.concat(F.lit("Category-Specific:\n"), F.col("_categories"))))
    return out.select(user, message.alias("message"))
