"""Queries over texts, views, requests, raters and keywords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import canonical, text
from plumbline.functions.labels import SQL_BLANK, plain_label, sql_plain
from plumbline.operators import agreement, keywords, lexical, registry, style, validators, views
from plumbline.operators.scoring import ACTIONS
from plumbline.scratch import Scratch
from plumbline.sources.tables import table

#: Texts that trip each pattern of personal data, or come near it.
PLANTED = (
    "电话 13800138000。", "call 1380013800", "证件 11010519491231002X", "账号 6222021234567890123 转入", "order 12345678901", "write to a.b+c@example.org, please", "证a@example.org", "host 10.0.0.1.",
    "version 1.2.3", "API_KEY = x", "password：x", "passwd:x", "我的身份证号是保密的", "银行卡号：略", "账号 为", "手机坏了", "全角 １３８００１３８０００", "a 13912345678 b 13912345678",
)
MARKED = ("see C:\\users\\x", "at /home/x/y.z", "the request_payload field", "nothing here", "AUTHORIZATION: Bearer z", "192.168.4.7 and 8.8.8.8", "172.32.1.1")
STATE_KEYS = ("jurisdiction", "institution", "assistant", "customer", "suitability", "product", "request", "interaction", "data", "market_integrity", "evidence")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", "suite", F.posexplode("dialogue").alias("turn", "t"))
    return rows.select("scenario_id", "suite", "turn", F.col("t.text").alias("text"))


def privacy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each kind in dialogue turns and documents, and in how many records."""
    turns = _turns(spark, sf_dir).select(F.lit("scenarios").alias("place"), F.col("scenario_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("place"), F.col("doc_id").cast("string").alias("id"), "text")
    # The corpus holds no personal data, so every pattern also reads texts that hold some.
    planted = spark.createDataFrame([("planted", str(i), t) for i, t in enumerate(PLANTED)], "place string, id string, text string")
    found = text.findings(turns.unionAll(docs).unionAll(planted), ["place", "id"], "text")
    return found.groupBy("place", "kind").agg(F.count("*").alias("n_findings"), F.count_distinct("id").alias("n_records"))


def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a release, and planted ones, by the policy they break."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("place"), F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    planted = spark.createDataFrame([("planted", f"p/{i}{'.zip' if i == 0 else '.txt'}", t) for i, t in enumerate((*PLANTED, *MARKED))], "place string, path string, text string")
    found = text.policy_findings(docs.unionAll(planted).withColumn("key", F.struct("place", "path")), "key", "path", "text", ["p/3.txt"])
    return found.groupBy("key.place", "finding").agg(F.count("*").alias("n"))


def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each category, how many terms were evidence, and when they were made."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "created_at", F.explode(text.categories(F.col("text"), registry.CATEGORIES)).alias("c"))
    return rows.groupBy(F.col("c.category").alias("category")).agg(
        F.count("*").alias("n"), F.sum(F.size("c.evidence")).alias("n_terms"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each source: texts, distinct texts, wrong lengths, date range."""
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy(plain_label("source").alias("source")).agg(
        F.count("*").alias("n"), F.count("text").alias("n_texts"), F.count_distinct("text").alias("n_distinct"),
        F.count_if(~F.length("text").eqNullSafe(F.col("n_chars").cast("int"))).alias("n_wrong_length"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated document texts as one record: first kind by arrival, all sources and languages."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    found = rows.groupBy(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 20).alias("record_id")).agg(
        F.count("*").alias("n"), F.min_by("doc_kind", "doc_id").alias("first_kind"),
        F.array_sort(F.collect_set(plain_label("source"))).alias("sources"), F.array_sort(F.collect_set(plain_label("lang"))).alias("langs"),
    )
    return found.where("n > 1")


def tag_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tags, without them."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike("<[^>]*>"))
    return rows.select("doc_id", F.length(text.stripped_tags(F.col("text"))).alias("n_chars"))


def normalized_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of every dialogue."""
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", text.dialogue_line(F.col("dialogue")).alias("line"))
    return rows.select("scenario_id", text.normalized("line").alias("text"))


def clause_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios that share runs of 24 characters with rule commentary."""
    turns = _turns(spark, sf_dir).select("scenario_id", text.compacted("text").alias("text"))
    clauses = table(spark, sf_dir, "documents").where(plain_label("source") == "rule_commentary").select("doc_id", text.compacted("text").alias("text"))
    return text.overlap_counts(turns, "scenario_id", clauses, "doc_id", 24, Scratch(spark))


def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses parsed again, against what was stored."""
    rows = table(spark, sf_dir, "event_ledger").select("delivery_no", "result.parsed_action", "result.response_content", "api_error", "status")
    rows = rows.withColumn("p", canonical.parsed_action(ACTIONS)("response_content"))
    rows = rows.withColumn("again", canonical.event_status(F.col("api_error"), F.col("p.action"), F.col("p.errors")))
    return rows.groupBy("status", "again", F.col("p.action").eqNullSafe(F.col("parsed_action")).alias("same_action")).agg(F.count("*").alias("n"))


def lexical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between scenarios by their dialogues, of each type with their scores."""
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", text.dialogue_line(F.col("dialogue")).alias("line"))
    return lexical.lexical_edges(rows, "scenario_id", "line", Scratch(spark))


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, invalid parses and tokens of each status."""
    rows = table(spark, sf_dir, "event_ledger")
    return rows.groupBy("status").agg(
        F.count("*").alias("n"), F.count("api_error").alias("n_errors"), F.count_if(F.col("result.parsed_action").isNull()).alias("n_unparsed"),
        F.sum("usage.completion_tokens").alias("completion_tokens"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.total_tokens").alias("total_tokens"),
    )


def reused_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later runs that repeat their first run's request, and those that need a new one."""
    rows = table(spark, sf_dir, "event_ledger").where("job_id IS NOT NULL AND run_generation IS NOT NULL")
    rank = F.struct("received_at", "delivery_no")
    runs = rows.groupBy("job_id", "run_generation").agg(F.min_by("request_sha256", rank).alias("request"))
    first = runs.where("run_generation = 1").select("job_id", F.col("request").alias("first_request"))
    later = runs.where("run_generation > 1").join(first, "job_id", "left")
    kind = F.when(F.col("request") == F.col("first_request"), "reused").otherwise("incremental")
    return later.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def relation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of keys of relation specifications, and whether each is the allowed one."""
    return validators.key_sets(table(spark, sf_dir, "scenarios"), "relation_spec", ["relation", "turns"])


def state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of objects of the states, and whether each is the allowed one."""
    return validators.key_sets(table(spark, sf_dir, "scenarios"), "state", STATE_KEYS)


def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States whose evidence object has other keys than its one fixed leaf."""
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", F.get_json_object("state", "$.evidence").alias("evidence"))
    return validators.unexpected_keys(rows, "scenario_id", "evidence", ["rule_evidence_status"])


def broken_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues a prefix guard would refuse."""
    return views.broken_dialogues(table(spark, sf_dir, "scenarios"))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search results: the source is the channel, the text tells the manuscript, the language is the query."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    return rows.select(
        F.col("doc_id").alias("arrival"), F.coalesce(plain_label("source"), F.lit("none")).alias("channel"), F.sha2(F.col("text").cast("binary"), 256).alias("manuscript"),
        F.coalesce(plain_label("lang"), F.lit("none")).alias("query"), F.concat(F.lit("<b>"), F.coalesce("doc_kind", F.lit("")), F.lit("</b>")).alias("title"),
        F.concat(F.lit("//records/"), F.col("doc_id").cast("string")).alias("url"), F.col("created_at").cast("date").alias("published"), F.col("text").alias("content"),
    )


def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the registry, each once, with all its queries, categories and terms."""
    found = registry.registry(_published(spark, sf_dir))
    return found.withColumn("evidence", F.transform("evidence", lambda e: F.concat(e["category"], F.lit(":"), e["term"])))


def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest records."""
    return registry.latest(registry.registry(_published(spark, sf_dir)), 20).select("record_id", "published_date", "url")


def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each channel and of each category."""
    found = registry.registry(_published(spark, sf_dir))
    both = [registry.counts(found, c).select(F.lit(c).alias("column"), "value", "n") for c in ("source_channel", "categories")]
    return both[0].unionAll(both[1])


def _rule_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule with two categories by its number; some have the proxy, and some a category without records."""
    names = F.array(*[F.lit(c) for c in (*registry.CATEGORIES, registry.PROXY, "no_such_category")])
    number = F.regexp_extract("rule_id", "([0-9]+)$", 1).cast("int")
    rules = table(spark, sf_dir, "scenarios").select(F.explode("label.controlling_rule_ids").alias("rule_id")).distinct()
    return rules.where(number % 5 != 0).select("rule_id", F.array(names[number % 12], names[(number + 5) % 12]).alias("categories"))


def _category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.counts(registry.registry(_published(spark, sf_dir)), "categories")


def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of each controlling rule and which of its categories have records."""
    return registry.rule_coverage(table(spark, sf_dir, "scenarios"), _rule_categories(spark, sf_dir), _category_counts(spark, sf_dir))


def scenario_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with a rule that has records, or any public anchor."""
    return registry.scenario_coverage(table(spark, sf_dir, "scenarios"), _rule_categories(spark, sf_dir), _category_counts(spark, sf_dir))


def job_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose copied columns differ from the scenario's, by column."""
    jobs, rows = table(spark, sf_dir, "evaluation_jobs"), table(spark, sf_dir, "scenarios")
    pairs = {"family_id": "family_id", "component_id": "leakage_component_id", "design_component_id": "component_id", "suite": "suite", "split": "split"}
    s = rows.select("scenario_id", *[F.col(c).alias(f"s_{i}") for i, c in enumerate(pairs.values())])
    joined = jobs.join(s, "scenario_id", "left")
    return joined.agg(F.count("*").alias("n"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"s_{i}"))).alias(f"n_{c}") for i, c in enumerate(pairs)])


def gold_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose stored digest of the label is the digest of the scenario's label."""
    rows = table(spark, sf_dir, "scenarios").select("scenario_id", canonical.string_digest(F.col("label.primary_action")).alias("computed"))
    joined = table(spark, sf_dir, "evaluation_jobs").join(rows, "scenario_id")
    return joined.groupBy(F.lower("gold_action_sha256").eqNullSafe(F.col("computed")).alias("same")).agg(F.count("*").alias("n"))


def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table of the evaluation."""
    names = ("scenarios", "evaluation_jobs", "event_ledger", "lexical_edges", "documents")
    return validators.cardinalities({n: table(spark, sf_dir, n) for n in names})


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ratings: each consecutive five of a part, in order, are five raters of one item; a rest of fewer is no item."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "q")) - 1
    whole = F.count("*").over(Window.partitionBy("l_partkey"))
    rows = rows.withColumns({"place": place, "n": whole}).where("place < n - n % 5")
    item = F.concat_ws("-", F.col("l_partkey").cast("string"), F.floor(F.col("place") / 5).cast("string"))
    return rows.select(item.alias("item"), (F.col("place") % 5).alias("rater"), (F.col("q") % 4).alias("choice"), (F.col("q") % 5 + 1).alias("score"), (F.col("q") % 3 != 0).alias("accepts"), (F.col("q") % 17 == 0).alias("defect"))


def rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleiss' kappa of the panel."""
    found = agreement.fleiss_kappa(_panel(spark, sf_dir), "item", "choice")
    return found.select("items", "raters", "equal", *[F.round(c, 12).alias(c) for c in ("observed", "expected", "kappa")])


def rater_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraclass correlation of the panel's scores."""
    found = agreement.intraclass(_panel(spark, sf_dir), "item", "rater", "score")
    return found.select("items", "raters", F.round("icc_single", 9).alias("icc_single"), F.round("icc_average", 9).alias("icc_average"))


def panel_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items were confirmed, revised or left unresolved, and how many go to another round."""
    found = agreement.panel_decisions(_panel(spark, sf_dir), "item", "choice", "accepts", "score")
    again = (~F.col("unanimous")) | (F.col("decision") == "unresolved")
    return found.groupBy("decision").agg(F.count("*").alias("n"), F.count_if(again).alias("n_again"), F.sum("votes").alias("votes"))


def panel_second_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that go to a second round, by reason."""
    panel = _panel(spark, sf_dir)
    acceptable = panel.groupBy("item").agg(F.array(F.lit(0).cast("long"), F.min("choice") + 1).alias("acceptable"))
    return agreement.second_round(panel, "item", "choice", "defect", acceptable).groupBy("reason").agg(F.count("*").alias("n"))


def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score, share of accepting ratings and defects of the panel."""
    return agreement.rating_summary(_panel(spark, sf_dir), "item", "score", "accepts", "defect")


def panel_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings per item of the panel."""
    return agreement.panel_design(_panel(spark, sf_dir), "item", "rater")


def panel_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unanimous, four-of-five and within-one items of the panel."""
    return agreement.broad_agreement(_panel(spark, sf_dir), "item", "choice", "score")


def vote_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose votes by quantity do not add up to five."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_quantity").cast("long") % 4).cast("string").alias("c")).agg(F.count("*").alias("v"))
    maps = rows.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("votes"))
    return agreement.wrong_vote_totals(maps, "l_partkey", "votes")


def defect_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score interval of the share of returned line items by year."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"))
    counts = rows.agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    low, high = agreement.wilson(F.col("k"), F.col("n"))
    return counts.select("year", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scenarios")
    joined = F.array_join(F.transform("dialogue", lambda t: t["text"]), " ")
    return rows.select("scenario_id", plain_label("split").alias("split"), F.col("label.primary_action").alias("label"), F.coalesce(joined, F.lit("")).alias("text"))


def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest tokens of each label, from development scenarios."""
    found = keywords.log_odds(_labelled(spark, sf_dir).where("split = 'development'"), "text", "label")
    return found.select("label", "token", "df_in", "df_out", F.round("weight", 9).alias("weight"))


def keyword_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the keyword baseline does on heldout scenarios."""
    rows = _labelled(spark, sf_dir)
    learned = rows.where("split = 'development'")
    weights, labels = keywords.log_odds(learned, "text", "label"), keywords.label_counts(learned, "label")
    held = rows.where("split = 'heldout'")
    found = keywords.predict(held, "scenario_id", "text", weights, labels, "label").join(held.select("scenario_id", "label"), "scenario_id")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("n_correct"))


def style_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length profile of the documents of each kind."""
    return style.length_profile(table(spark, sf_dir, "documents"), "doc_kind", F.length("text"))


def style_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each kind ask, exclaim, quote or hold a number."""
    markers = {"question": "[?？؟]", "exclamation": "[!！]", "quotation": "[“”「」«»\"]", "number": "[0-9]"}
    return style.marker_rates(table(spark, sf_dir, "documents"), "doc_kind", F.col("text"), markers)


def style_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every expert document the most alike legal extract, by pairs of characters."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", plain_label("source").alias("source"))
    found = style.nearest(rows.where("source = 'expert_rounds'"), rows.where("source = 'legal_extracts'"), 2, Scratch(spark))
    return found.select("id", "neighbour", F.round("similarity", 12).alias("similarity"))


def style_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of single characters and pairs between two sources."""
    rows = table(spark, sf_dir, "documents").withColumn("source", plain_label("source")).where("source IN ('service_desk_log', 'app_chat_export')")
    out = None
    for n in (1, 2):
        one = style.jensen_shannon(style.character_counts(rows, F.col("source"), F.col("text"), n), "service_desk_log", "app_chat_export").select(F.lit(n).alias("n"), "*")
        out = one if out is None else out.unionAll(one)
    return out


_RE2 = {
    "mainland_mobile_number": r"(^|[^\p{Nd}])1[3-9]\p{Nd}{9}($|[^\p{Nd}])",
    "mainland_identity_number": r"(^|[^\p{Nd}])\p{Nd}{17}[\p{Nd}Xx]($|[^\p{Nd}])",
    "long_account_like_number": r"(^|[^\p{Nd}])\p{Nd}{12,19}($|[^\p{Nd}])",
    "email_address": r"(?i)(^|[^\p{L}\p{N}_.])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}($|[^\p{L}\p{N}_.])",
    "ipv4_address": r"(^|[^\p{Nd}])(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}($|[^\p{Nd}])",
    "credential_assignment": r"(?i)(?:password|passwd|api[_-]?key|access[_-]?token|secret[_-]?key)\s*[:=]",
    "explicit_chinese_identifier_disclosure": r"(?:身份证(?:号|号码)?|手机(?:号|号码)?|银行卡号|账户号|账号)\s*(?:是|为|[:：])",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KINDS = " UNION ALL ".join(f"SELECT place, id, '{k}' AS kind FROM texts WHERE regexp_matches(text, {_quoted(p)})" for k, p in _RE2.items())
_PLANTED = ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(PLANTED))
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, created_at, '{c}' AS category, {' + '.join(f'CAST(contains(text, {_quoted(w)}) AS INTEGER)' for w in words)} AS k FROM documents" for c, words in registry.CATEGORIES.items()
)
_PANEL = """
numbered AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT)) - 1 AS place,
  count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem),
panel AS (SELECT l_partkey || '-' || (place // 5) AS item, place % 5 AS rater, q % 4 AS choice, q % 5 + 1 AS score, q % 3 <> 0 AS accepts, q % 17 = 0 AS defect FROM numbered WHERE place < n - n % 5)"""
_SINGLE = r"regexp_extract_all(regexp_replace(lower(text), '[0-9]+(?:[./:-][0-9]+)*', '<num>', 'g'), '(<num>|[a-z]+|[\x{4e00}-\x{9fff}])', 1)"
_TOKENS = f"list_distinct(list_transform({_SINGLE}, lambda t: 'u:' || t) || list_transform(range(1, len({_SINGLE})), lambda i: 'b:' || {_SINGLE}[i] || {_SINGLE}[i + 1]))"
_KEYWORDS = f"""
base AS (SELECT scenario_id, {sql_plain("split")} AS split, label.primary_action AS label,
  coalesce(array_to_string(list_filter(list_transform(dialogue, lambda t: t.text), lambda t: t IS NOT NULL), ' '), '') AS text FROM scenarios),
dev AS (SELECT * FROM base WHERE split = 'development'),
n AS (SELECT label, count(*) AS n_label, (SELECT count(*) FROM dev) AS total FROM dev GROUP BY label),
each AS (SELECT label, unnest({_TOKENS}) AS token FROM dev),
inside AS (SELECT token, label, count(*) AS df_in FROM each GROUP BY ALL),
dfs AS (SELECT token, CAST(sum(df_in) AS BIGINT) AS df FROM inside GROUP BY token HAVING sum(df_in) >= 5),
grid AS (SELECT n.label, dfs.token, coalesce(df_in, 0) AS df_in, df - coalesce(df_in, 0) AS df_out, n_label, total
  FROM dfs CROSS JOIN n LEFT JOIN inside ON inside.token = dfs.token AND inside.label = n.label),
weighted AS (SELECT label, token, df_in, df_out,
  ln((df_in + CAST(0.5 AS DOUBLE)) / (n_label + 1)) - ln((df_out + CAST(0.5 AS DOUBLE)) / (total - n_label + 1)) AS weight FROM grid)"""
_WILSON = "(k / CAST(n AS DOUBLE) + {z2} / (2.0 * n) {sign} {z} * sqrt(k / CAST(n AS DOUBLE) * (1.0 - k / CAST(n AS DOUBLE)) / n + {z2} / (4.0 * n * n))) / (1.0 + {z2} / n)"
_Z = "CAST(1.959963984540054 AS DOUBLE)"
_Z2 = f"({_Z} * {_Z})"

_TAGS = " ".join(f"|| CASE WHEN contains(c, '{w}') THEN ['{k}:{w}'] ELSE [] END" for k, ws in registry.CATEGORIES.items() for w in ws)
_PLAIN_TEXT = f"trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '{SQL_BLANK}+', ' ', 'g'), ' ')"
_REGISTRY = f"""
docs AS (SELECT doc_id, coalesce({sql_plain("source")}, 'none') AS channel, sha256(text) AS k, coalesce({sql_plain("lang")}, 'none') AS q, coalesce(doc_kind, '') AS title,
  'https://records/' || doc_id AS url, CAST(CAST(created_at AS DATE) AS VARCHAR) AS d, {_PLAIN_TEXT} AS content FROM documents WHERE text IS NOT NULL AND text <> ''),
tagged AS (SELECT *, [] {_TAGS} AS tags FROM (SELECT *, title || chr(10) || content AS c FROM docs)),
merged AS (SELECT channel, k, arg_min(title, doc_id) AS title, arg_min(url, doc_id) AS url, coalesce(arg_min(d, doc_id), '') AS published_date, sha256(arg_min(content, doc_id)) AS content_sha256,
  list_sort(list(DISTINCT q)) AS query_terms, list_sort(list_distinct(flatten(list(tags)))) AS evidence FROM tagged GROUP BY channel, k),
registry AS (SELECT substr(sha256(url), 1, 20) AS record_id, channel AS source_channel, title, url, published_date, content_sha256, query_terms,
  list_sort(list_distinct(list_transform(evidence, lambda e: split_part(e, ':', 1)))) AS categories, evidence FROM merged WHERE len(evidence) > 0)"""
_NAMES = "[" + ", ".join(f"'{c}'" for c in (*registry.CATEGORIES, registry.PROXY, "no_such_category")) + "]"
_COVERED = f"""{_REGISTRY},
used AS (SELECT scenario_id, unnest(label.controlling_rule_ids) AS rule_id FROM scenarios),
numbered AS (SELECT DISTINCT rule_id, CAST(regexp_extract(rule_id, '([0-9]+)$', 1) AS INTEGER) AS i FROM used),
known AS (SELECT DISTINCT unnest(categories) AS c FROM registry),
rules AS (SELECT rule_id, CASE WHEN i % 5 <> 0 THEN [{_NAMES}[i % 12 + 1], {_NAMES}[(i + 5) % 12 + 1]] ELSE [] END AS cs FROM numbered),
present AS (SELECT rule_id, cs, list_sort(list_filter(cs, lambda x: list_contains(ks, x))) AS p FROM rules, (SELECT list(c) AS ks FROM known))"""

SQL = {
    "registry_records": f"WITH {_REGISTRY} SELECT * FROM registry",
    "registry_latest": f"WITH {_REGISTRY} SELECT record_id, published_date, url FROM registry ORDER BY published_date DESC, url LIMIT 20",
    "registry_counts": f"""WITH {_REGISTRY} SELECT 'source_channel' AS "column", source_channel AS value, count(*) AS n FROM registry GROUP BY 2
UNION ALL SELECT 'categories', c, count(*) FROM (SELECT unnest(categories) AS c FROM registry) GROUP BY 2""",
    "rule_coverage": f"""WITH {_COVERED} SELECT rule_id, count(*) AS scenario_support, any_value(cs) AS external_categories, any_value(p) AS record_categories_present, any_value(len(p) > 0) AS covered_by_records,
  any_value(len(p) > 0 OR list_contains(cs, '{registry.PROXY}')) AS covered_by_anchors FROM used JOIN present USING (rule_id) GROUP BY rule_id""",
    "scenario_coverage": f"""WITH {_COVERED}, s AS (SELECT scenario_id, bool_or(len(p) > 0) AS a, bool_or(len(p) > 0 OR list_contains(cs, '{registry.PROXY}')) AS b FROM used JOIN present USING (rule_id) GROUP BY scenario_id)
SELECT (SELECT count(*) FROM scenarios) AS scenario_count, count(*) FILTER (a) AS with_record_category, count(*) FILTER (b) AS with_any_anchor FROM s""",
    "relation_keys": """SELECT list_sort(coalesce(json_keys(relation_spec), [])) AS keys, list_sort(coalesce(json_keys(relation_spec), [])) = ['relation', 'turns'] AS exact, count(*) AS n FROM scenarios GROUP BY ALL""",
    "state_keys": f"""SELECT list_sort(coalesce(json_keys(state), [])) AS keys, list_sort(coalesce(json_keys(state), [])) = [{", ".join(f"'{x}'" for x in sorted(STATE_KEYS))}] AS exact, count(*) AS n
FROM scenarios GROUP BY ALL""",
    "evidence_keys": """WITH k AS (SELECT scenario_id, coalesce(json_keys(state, '$.evidence'), []) AS ks FROM scenarios),
d AS (SELECT scenario_id, list_sort(list_filter(ks, lambda x: x <> 'rule_evidence_status')) AS unexpected, CASE WHEN list_contains(ks, 'rule_evidence_status') THEN [] ELSE ['rule_evidence_status'] END AS absent FROM k)
SELECT * FROM d WHERE len(unexpected) > 0 OR len(absent) > 0""",
    "panel_second_round": f"""WITH {_PANEL}, c AS (SELECT item, choice, count(*) AS v FROM panel GROUP BY ALL),
t AS (SELECT item, arg_min(choice, (-v, choice)) AS mode, count(*) AS kinds FROM c GROUP BY item), f AS (SELECT item, bool_or(defect) AS flawed, min(choice) + 1 AS second FROM panel GROUP BY item),
r AS (SELECT CASE WHEN kinds > 1 THEN 'not unanimous' WHEN mode NOT IN (0, second) THEN 'outside the acceptable actions' WHEN flawed THEN 'defect' END AS reason FROM t JOIN f USING (item))
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "panel_summary": f"""WITH {_PANEL}, d AS (SELECT item, count(*) FILTER (defect) AS d FROM panel GROUP BY item)
SELECT (SELECT count(*) FROM d) AS items, count(*) AS ratings, CAST(sum(score) AS DOUBLE) / count(*) AS mean_score, CAST(count(*) FILTER (accepts) AS DOUBLE) / count(*) AS match_rate,
  count(*) FILTER (defect) AS defects, (SELECT count(*) FROM d WHERE d > 0) AS defect_items FROM panel""",
    "privacy_findings": f"""WITH texts AS (SELECT 'scenarios' AS place, scenario_id AS id, unnest(dialogue).text AS text FROM scenarios
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents UNION ALL SELECT 'planted', CAST(i AS VARCHAR), t FROM (VALUES {_PLANTED}) v(i, t)), found AS ({_KINDS})
SELECT place, kind, count(*) AS n_findings, count(DISTINCT id) AS n_records FROM found GROUP BY place, kind""",
    "document_categories": f"WITH hits AS ({_HITS}) SELECT category, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_terms, min(created_at) AS first_at, max(created_at) AS last_at FROM hits WHERE k > 0 GROUP BY category",
    "document_sources": f"""SELECT {sql_plain("source")} AS source, count(*) AS n, count(text) AS n_texts, count(DISTINCT text) AS n_distinct,
  count(*) FILTER (length(text) IS DISTINCT FROM n_chars) AS n_wrong_length, min(created_at) AS first_at, max(created_at) AS last_at FROM documents GROUP BY 1""",
    "merged_records": f"""SELECT substr(sha256(text), 1, 20) AS record_id, count(*) AS n, min_by(doc_kind, doc_id) AS first_kind,
  list_sort(list_distinct(list({sql_plain("source")}))) AS sources, list_sort(list_distinct(list({sql_plain("lang")}))) AS langs
FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1""",
    "tag_stripped": f"""SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '{SQL_BLANK}+', ' ', 'g'))) AS INTEGER) AS n_chars
FROM documents WHERE regexp_matches(text, '<[^>]*>')""",
    "ledger_totals": """SELECT status, count(*) AS n, count(api_error) AS n_errors, count(*) FILTER (result.parsed_action IS NULL) AS n_unparsed,
  CAST(sum(usage.completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(usage.prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(usage.total_tokens) AS BIGINT) AS total_tokens
FROM event_ledger GROUP BY status""",
    "reused_requests": """WITH runs AS (SELECT job_id, run_generation, request_sha256, row_number() OVER (PARTITION BY job_id, run_generation ORDER BY received_at, delivery_no) AS rn
  FROM event_ledger WHERE job_id IS NOT NULL AND run_generation IS NOT NULL)
SELECT CASE WHEN b.request_sha256 = a.request_sha256 THEN 'reused' ELSE 'incremental' END AS kind, count(*) AS n
FROM runs b LEFT JOIN runs a ON a.job_id = b.job_id AND a.run_generation = 1 AND a.rn = 1 WHERE b.run_generation > 1 AND b.rn = 1 GROUP BY 1""",
    "broken_dialogues": """SELECT scenario_id, problem FROM (SELECT scenario_id, CASE WHEN dialogue IS NULL OR len(dialogue) = 0 THEN 'empty'
  WHEN lower(trim(dialogue[len(dialogue)].role, ' ')) IS DISTINCT FROM 'customer' THEN 'last_turn' WHEN len(list_distinct(dialogue)) < len(dialogue) THEN 'repeated_turn' END AS problem FROM scenarios)
WHERE problem IS NOT NULL""",
    "job_agreement": """SELECT count(*) AS n, count(*) FILTER (j.family_id IS DISTINCT FROM s.family_id) AS n_family_id, count(*) FILTER (j.component_id IS DISTINCT FROM s.leakage_component_id) AS n_component_id,
  count(*) FILTER (j.design_component_id IS DISTINCT FROM s.component_id) AS n_design_component_id, count(*) FILTER (j.suite IS DISTINCT FROM s.suite) AS n_suite,
  count(*) FILTER (j.split IS DISTINCT FROM s.split) AS n_split FROM evaluation_jobs j LEFT JOIN scenarios s USING (scenario_id)""",
    "gold_digests": """SELECT lower(gold_action_sha256) IS NOT DISTINCT FROM sha256('"' || label.primary_action || '"') AS same, count(*) AS n
FROM evaluation_jobs JOIN scenarios USING (scenario_id) GROUP BY 1""",
    "record_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("scenarios", "evaluation_jobs", "event_ledger", "lexical_edges", "documents")),
    "rater_kappa": f"""WITH {_PANEL}, cells AS (SELECT item, choice, count(*) AS c FROM panel GROUP BY ALL),
items AS (SELECT item, sum(c) AS r, sum(c * c) AS sq FROM cells GROUP BY item), w AS (SELECT count(*) AS items, sum(sq) AS sq, sum(r) AS n FROM items),
s AS (SELECT sum(t * t) AS tt FROM (SELECT sum(c) AS t FROM cells GROUP BY choice)),
v AS (SELECT items, CAST(sq - n AS DOUBLE) / CAST(n * 4 AS DOUBLE) AS o, CAST(tt AS DOUBLE) / CAST(n * n AS DOUBLE) AS e FROM w, s)
SELECT items, CAST(5 AS BIGINT) AS raters, true AS equal, round(o, 12) AS observed, round(e, 12) AS expected, round((o - e) / (1.0 - e), 12) AS kappa FROM v""",
    "rater_icc": f"""WITH {_PANEL}, a AS (SELECT count(*) AS n, sum(s) AS g, sum(q) AS q, sum(s * s) AS rr FROM (SELECT sum(score) AS s, sum(score * score) AS q FROM panel GROUP BY item)),
b AS (SELECT sum(s * s) AS cc FROM (SELECT sum(score) AS s FROM panel GROUP BY rater)),
t AS (SELECT CAST(n AS DOUBLE) AS n, CAST(5 AS DOUBLE) AS k, CAST(q AS DOUBLE) AS q, CAST(rr AS DOUBLE) AS rr, CAST(cc AS DOUBLE) AS cc, CAST(g AS DOUBLE) * CAST(g AS DOUBLE) / (CAST(n AS DOUBLE) * 5) AS m FROM a, b),
u AS (SELECT n, k, (rr / k - m) / (n - 1) AS msr, (cc / n - m) / (k - 1) AS msc, (q - m - (rr / k - m) - (cc / n - m)) / ((n - 1) * (k - 1)) AS mse FROM t)
SELECT CAST(n AS BIGINT) AS items, CAST(k AS BIGINT) AS raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 9) AS icc_single, round((msr - mse) / (msr + (msc - mse) / n), 9) AS icc_average FROM u""",
    "panel_decisions": f"""WITH {_PANEL}, top AS (SELECT item, max(c) AS votes FROM (SELECT item, choice, count(*) AS c FROM panel GROUP BY ALL) GROUP BY item),
rest AS (SELECT item, count(*) FILTER (accepts) AS accept, count(*) FILTER (NOT accepts) AS reject, median(score) AS confidence, count(DISTINCT choice) = 1 AS unanimous FROM panel GROUP BY item),
d AS (SELECT *, CASE WHEN votes >= 4 AND confidence >= 4 AND accept >= 4 THEN 'confirm' WHEN votes >= 4 AND confidence >= 4 AND reject >= 4 THEN 'revise' ELSE 'unresolved' END AS decision FROM top JOIN rest USING (item))
SELECT decision, count(*) AS n, count(*) FILTER (NOT unanimous OR decision = 'unresolved') AS n_again, CAST(sum(votes) AS BIGINT) AS votes FROM d GROUP BY decision""",
    "panel_design": f"""WITH {_PANEL}, i AS (SELECT item, count(*) AS k, count(DISTINCT rater) AS r FROM panel GROUP BY item)
SELECT k AS ratings_per_item, count(*) AS n_items, min(r) AS least_raters FROM i GROUP BY k""",
    "panel_agreement": f"""WITH {_PANEL}, v AS (SELECT item, max(c) AS top, count(*) AS kinds FROM (SELECT item, choice, count(*) AS c FROM panel GROUP BY ALL) GROUP BY item),
s AS (SELECT item, max(score) - min(score) AS span, sum(score) AS total, count(*) AS k FROM panel GROUP BY item)
SELECT count(*) AS items, count(*) FILTER (kinds = 1) AS unanimous, count(*) FILTER (top >= 4) AS four_agree, count(*) FILTER (span <= 1) AS within_one,
  CAST(sum(total) AS DOUBLE) / CAST(sum(k) AS DOUBLE) AS mean_score FROM v JOIN s USING (item)""",
    "vote_totals": "SELECT l_partkey, count(*) AS total FROM lineitem GROUP BY l_partkey HAVING count(*) <> 5",
    "style_markers": """SELECT doc_kind, count(text) AS n, count(*) FILTER (regexp_matches(text, '[?？؟]')) AS n_question, count(*) FILTER (regexp_matches(text, '[!！]')) AS n_exclamation,
  count(*) FILTER (regexp_matches(text, '[“”「」«»"]')) AS n_quotation, count(*) FILTER (regexp_matches(text, '[0-9]')) AS n_number FROM documents GROUP BY doc_kind""",
    "style_neighbours": f"""WITH d AS (SELECT doc_id, {sql_plain("source")} AS source, list_distinct([substr(text, CAST(i AS INTEGER), 2) FOR i IN range(1, length(text))]) AS g FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id AS id, len(g) AS na, unnest(g) AS gram FROM d WHERE source = 'expert_rounds'), b AS (SELECT doc_id AS neighbour, len(g) AS nb, unnest(g) AS gram FROM d WHERE source = 'legal_extracts'),
s AS (SELECT id, neighbour, count(*) AS c, na, nb FROM a JOIN b USING (gram) GROUP BY id, neighbour, na, nb)
SELECT id, neighbour, round(c / CAST(na + nb - c AS DOUBLE), 12) AS similarity FROM s
QUALIFY row_number() OVER (PARTITION BY id ORDER BY c / CAST(na + nb - c AS DOUBLE) DESC, neighbour) = 1""",
    "defect_interval": f"""WITH c AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT year, k, n, round({_WILSON.format(z=_Z, z2=_Z2, sign="-")}, 9) AS low, round({_WILSON.format(z=_Z, z2=_Z2, sign="+")}, 9) AS high FROM c""",
    "keyword_weights": f"""WITH {_KEYWORDS} SELECT label, token, df_in, df_out, round(weight, 9) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, token) AS place FROM weighted) WHERE place <= 100""",
    "keyword_accuracy": f"""WITH {_KEYWORDS},
top AS (SELECT label, token, weight FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, token) AS place FROM weighted) WHERE place <= 100),
held AS (SELECT scenario_id, label, text FROM base WHERE split = 'heldout'),
seen AS (SELECT scenario_id, unnest({_TOKENS}) AS token FROM held),
scores AS (SELECT scenario_id, top.label AS guess, sum(weight) AS score FROM seen JOIN top USING (token) GROUP BY ALL),
priors AS (SELECT label AS guess, ln((n_label + 1) / CAST(total + (SELECT count(*) FROM n) AS DOUBLE)) AS prior FROM n),
totals AS (SELECT h.scenario_id, h.label, p.guess, round(p.prior + coalesce(s.score, 0), 9) AS total
  FROM held h CROSS JOIN priors p LEFT JOIN scores s ON s.scenario_id = h.scenario_id AND s.guess = p.guess),
best AS (SELECT scenario_id, label, guess FROM totals QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY total DESC, guess) = 1)
SELECT label, count(*) AS n, count(*) FILTER (label = guess) AS n_correct FROM best GROUP BY label""",
    "style_divergence": f"""WITH d AS (SELECT {sql_plain("source")} AS source, text FROM documents WHERE text IS NOT NULL),
g AS ({" UNION ALL ".join(f"SELECT {n} AS n, source, unnest([substr(text, CAST(i AS INTEGER), {n}) FOR i IN range(1, length(text) + {2 - n})]) AS gram FROM d WHERE source IN ('service_desk_log', 'app_chat_export') AND length(text) >= {n}" for n in (1, 2))}),
w AS (SELECT n, gram, count(*) FILTER (source = 'service_desk_log') AS a, count(*) FILTER (source = 'app_chat_export') AS b FROM g GROUP BY n, gram),
p AS (SELECT n, a / CAST(sum(a) OVER (PARTITION BY n) AS DOUBLE) AS p, b / CAST(sum(b) OVER (PARTITION BY n) AS DOUBLE) AS q FROM w)
SELECT n, round(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 9) AS bits, count(*) AS vocabulary FROM p GROUP BY n""",
    "style_lengths": """SELECT doc_kind, count(text) AS n, CAST(sum(length(text)) AS BIGINT) AS total, quantile_cont(CAST(length(text) AS DOUBLE), 0.1) AS q10,
  quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS median, quantile_cont(CAST(length(text) AS DOUBLE), 0.9) AS q90 FROM documents GROUP BY doc_kind""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        privacy_findings, policy_findings, document_categories, document_sources, merged_records, tag_stripped, normalized_dialogues, clause_overlap, lexical_edges, parsed_responses,
        ledger_totals, reused_requests, relation_keys, state_keys, evidence_keys, broken_dialogues,
        registry_records, registry_latest, registry_counts, rule_coverage, scenario_coverage, job_agreement, gold_digests, record_counts, rater_kappa, rater_icc, panel_decisions, panel_second_round, panel_summary, panel_design, panel_agreement, vote_totals, defect_interval,
        keyword_weights, keyword_accuracy, style_lengths, style_markers, style_neighbours, style_divergence,
    )
}
