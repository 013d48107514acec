"""A registry of published records: duplicates merged, categories by terms, and the rules they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import absolute_url, categories, stripped_tags

# The terms of each category, and the category of questions that are no records.
CATEGORIES = {
    "unqualified_or_scoped_advice": ["投资顾问", "投资建议", "荐股", "证券推荐", "无资质", "从业资格", "证券投资咨询"],
    "suitability_and_access": ["适当性", "风险承受", "风险等级", "风险揭示", "风险测评", "交易权限", "知识测评"],
    "misleading_or_guaranteed_marketing": ["承诺收益", "变相承诺", "保本保息", "虚假宣传", "误导性", "夸大宣传", "业务推广", "营销"],
    "complaint_workflow": ["客户投诉", "投诉处理", "客户纠纷", "投诉纠纷"],
    "public_or_social_channel": ["公众媒体", "直播", "微信", "自媒体", "公众号"],
    "recordkeeping_and_review": ["留痕", "客户回访", "合规审核", "内部控制"],
    "privacy_or_customer_information": ["个人信息", "客户信息", "信息泄露", "信息保护"],
    "inside_information": ["内幕信息", "内幕交易"],
    "market_manipulation": ["市场操纵", "操纵市场"],
    "conflict_of_interest": ["利益冲突"],
}
PROXY = "official_investor_question_proxy"


def registry(found: DataFrame) -> DataFrame:
    """One record for each (channel, manuscript): fields of its first arrival, and the sets of queries, categories and terms over all.

    ``found`` is (arrival, channel, manuscript, query, title, url, published, content); a
    null manuscript is told by its address. Records without any category are left out. Sets
    are bounded by the numbers of queries and terms, which do not grow with the records.
    """
    url = absolute_url(F.coalesce("url", F.lit("")))
    rows = found.withColumn("url", url).withColumn("key", F.coalesce(F.col("manuscript").cast("string"), "url"))
    # Stripped once, in a projection of its own, before every term is looked for in it.
    rows = rows.withColumns({"title": stripped_tags(F.coalesce("title", F.lit(""))), "content": stripped_tags(F.coalesce("content", F.lit("")))})
    rows = rows.withColumn("all", F.concat("title", F.lit("\n"), "content"))
    title, content, tags = F.col("title"), F.col("content"), categories(F.col("all"), CATEGORIES)
    first = F.struct(
        title.alias("title"), "url", F.substring(F.coalesce(F.col("published").cast("string"), F.lit("")), 1, 10).alias("published_date"),
        F.sha2(content.cast("binary"), 256).alias("content_sha256"),
    )
    terms = F.flatten(F.transform(F.col("tags"), lambda c: F.transform(c["evidence"], lambda e: F.struct(c["category"].alias("category"), e.alias("term")))))
    rows = rows.select("channel", "key", "arrival", "query", first.alias("first"), tags.alias("tags")).withColumn("terms", terms)
    merged = rows.groupBy("channel", "key").agg(
        F.min_by("first", "arrival").alias("first"), F.array_sort(F.collect_set("query")).alias("query_terms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("evidence"),
    )
    named = F.when(F.col("first.url") != "", F.col("first.url")).otherwise(F.concat_ws(":", "channel", "key"))
    merged = merged.withColumn("categories", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["category"])))).where("size(categories) > 0")
    record_id = F.substring(F.sha2(named.cast("binary"), 256), 1, 20)
    return merged.select(record_id.alias("record_id"), F.col("channel").alias("source_channel"), "first.*", "query_terms", "categories", "evidence")


def latest(records: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest records, those of one day in the order a reader expects of addresses."""
    return records.orderBy(F.desc("published_date"), F.collate("url", "UNICODE"), "url").limit(k)


def counts(records: DataFrame, column: str) -> DataFrame:
    """(value, n): records of each channel, or of each category they have."""
    value = F.explode(column) if records.schema[column].dataType.typeName() == "array" else F.col(column)
    return records.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def _present(rules: DataFrame, category_counts: DataFrame) -> DataFrame:
    """(rule_id, categories, present, proxy): which of a rule's categories have records, and whether it has the proxy."""
    each = rules.select("rule_id", "categories", F.explode_outer("categories").alias("value"))
    known = category_counts.where("n > 0").select("value", F.lit(True).alias("known"))
    found = each.join(known, "value", "left").groupBy("rule_id").agg(
        F.first("categories").alias("categories"), F.array_sort(F.collect_set(F.when(F.col("known") & (F.col("value") != PROXY), F.col("value")))).alias("present"),
        F.coalesce(F.bool_or(F.col("value") == PROXY), F.lit(False)).alias("proxy"),
    )
    return found


def rule_coverage(scenarios: DataFrame, rules: DataFrame, category_counts: DataFrame) -> DataFrame:
    """(rule_id, scenario_support, external_categories, record_categories_present, covered_by_records, covered_by_anchors) of every controlling rule.

    ``rules`` is (rule_id, categories), unique; a rule it lacks has none.
    """
    used = scenarios.select(F.explode("label.controlling_rule_ids").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("scenario_support"))
    joined = used.join(_present(rules, category_counts), "rule_id", "left")
    nothing = F.array().cast("array<string>")
    present = F.coalesce("present", nothing)
    return joined.select(
        "rule_id", "scenario_support", F.coalesce("categories", nothing).alias("external_categories"), present.alias("record_categories_present"),
        (F.size(present) > 0).alias("covered_by_records"), ((F.size(present) > 0) | F.coalesce("proxy", F.lit(False))).alias("covered_by_anchors"),
    )


def scenario_coverage(scenarios: DataFrame, rules: DataFrame, category_counts: DataFrame) -> DataFrame:
    """(scenario_count, with_record_category, with_any_anchor): a scenario counts if any of its rules does."""
    known = _present(rules, category_counts).select("rule_id", (F.size("present") > 0).alias("recorded"), ((F.size("present") > 0) | F.col("proxy")).alias("anchored"))
    each = scenarios.select("scenario_id", F.explode_outer("label.controlling_rule_ids").alias("rule_id")).join(known, "rule_id", "left")

    def any_of(column: str) -> Column:
        return F.coalesce(F.bool_or(column), F.lit(False))

    one = each.groupBy("scenario_id").agg(any_of("recorded").alias("recorded"), any_of("anchored").alias("anchored"))
    return one.agg(F.count("*").alias("scenario_count"), F.count_if("recorded").alias("with_record_category"), F.count_if("anchored").alias("with_any_anchor"))
