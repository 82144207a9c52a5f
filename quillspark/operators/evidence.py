"""Evidence: caps, tenants, weights, safety, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .planning import any_of


def cap_per_source(rows: DataFrame, request: str, source: str, score: str, key: str, caps: dict[str, int], default: int = 10) -> DataFrame:
    """The best rows of each source of a request."""
    most = F.coalesce(*(F.when(F.col(source) == k, n) for k, n in caps.items()), F.lit(default))
    r = F.row_number().over(Window.partitionBy(request, source).orderBy(F.desc(score), key))
    return rows.withColumn("rank", r).where(F.col("rank") <= most)


def tenant_rows(rows: DataFrame, doc: str, user: Column) -> DataFrame:
    """Rows that are public or belong to user: ids like user_content:<user>:<type>:<hash> are private."""
    parts = F.split(F.col(doc), ":")
    private = (F.size(parts) >= 4) & (parts[0] == "user_content")
    return rows.where(~F.coalesce(private, F.lit(False)) | (parts[1] == user))


def weighted(score: Column, source: Column, weights: dict[str, float], personal: Column | None = None) -> Column:
    w = F.coalesce(*(F.when(source == k, F.lit(float(v))) for k, v in weights.items()), F.lit(1.0))
    return F.coalesce(score, F.lit(0.0)) * w * (F.lit(1.0) if personal is None else personal)


def flag_unsafe(rows: DataFrame, text: str, score: str, forbidden: list[str], factor: float = 0.3) -> DataFrame:
    """Adds hits (the forbidden terms within text) and multiplies the score of rows that have any."""
    hits = F.filter(F.array(*map(F.lit, forbidden)), lambda t: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(t)))
    return rows.withColumn("hits", hits).withColumn(score, F.when(F.size("hits") > 0, F.col(score) * factor).otherwise(F.col(score)))


def citations(text: Column) -> Column:
    """Numbers cited as [来源n] or [证据n], each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(来源|证据)(\d+)\]"), 2), lambda x: x.cast("int")))


# fixed values: words of questions about a user's own data, weights of it by intent, sentences for triples
PERSONAL = ("我", "我的", "本人", "适合我", "按我的", "根据我的", "my")
OWN_DATA = ("我保存", "我存的", "我记录", "我记的", "我的饮食计划", "我的菜单", "我的菜谱", "我的食谱", "我的饮食记录", "我的体检", "我的体检报告", "我的化验", "我的化验单", "我的训练计划", "昨天记录", "上次记录", "之前保存", "保存的饮食计划", "保存的菜单", "保存的菜谱", "保存的体检报告", "保存的化验单", "saved")
OWNER = ("我的", "我保存", "我记录", "保存的", "记录的", "之前", "上次", "昨天", "今天")
CONTENT_WORDS = {"recipe": ("菜谱", "食谱", "菜单", "做法"), "meal_plan": ("饮食计划", "餐单", "膳食计划", "减脂计划"), "workout_plan": ("训练计划", "健身计划", "运动计划"), "food_log": ("饮食记录", "吃了什么", "昨天吃", "今天吃", "记录的饮食"), "body_metrics": ("体重", "体脂", "身高", "腰围", "身体指标", "体测"), "lab_report": ("化验单", "体检报告", "检查报告", "血糖", "血脂", "尿酸")}
CONTENT_NAMES = {"recipe": "菜谱", "meal_plan": "饮食计划", "workout_plan": "健身训练计划", "food_log": "饮食记录", "body_metrics": "身体指标记录", "lab_report": "化验单/体检报告"}
CONTENT_WEIGHTS = {
    "diet_advice": {"meal_plan": 1.25, "food_log": 1.2, "body_metrics": 1.2, "workout_plan": 1.15, "lab_report": 1.25},
    "recipe_recommend": {"recipe": 1.2, "meal_plan": 1.15, "food_log": 1.1},
    "recipe_instruction": {"recipe": 1.2},
    "meal_record_analysis": {"food_log": 1.3, "meal_plan": 1.15, "body_metrics": 1.1},
    "disease_diet": {"lab_report": 1.3, "body_metrics": 1.2, "meal_plan": 1.1, "food_log": 1.1},
    "safety_check": {"lab_report": 1.3, "body_metrics": 1.2},
    "profile_management": {"body_metrics": 1.15, "lab_report": 1.15},
}
SOURCE_WEIGHTS = {"text2sql": 1.15, "relation": 1.05, "semantic": 0.95}
SENTENCES = {"相宜": "{s}和{o}相宜", "相克": "{s}和{o}相克", "禁忌": "{s}对{o}有禁忌", "适宜": "{s}适宜{o}", "不宜": "{s}不宜{o}", "含有": "{s}含有{o}", "属于": "{s}属于{o}", "别名": "{s}的别名是{o}", "类别": "{s}属于{o}类别", "富含": "{s}富含{o}", "含量": "{s}的{o}", "作用": "{s}有{o}的作用", "推荐摄入": "{s}推荐摄入{o}"}
SIMILAR, GRAM, STRONG_WEIGHT, OTHER_WEIGHT, PERSONAL_WEIGHT = 0.85, 2, 10.0, 2.0, 1.1
MISSING = "我没有找到你已保存的{x}，所以不能假装基于这些个人数据来回答。你可以先把相关内容发给我并说明“保存”，我保存后再基于它分析。"
MISSING_ANY = "我没有找到你明确提到的已保存个人数据，所以不能假装基于历史记录来回答。你可以先把相关内容发给我并说明“保存”，我保存后再基于它分析。"


def policy(query: Column) -> Column:
    """struct(mode, required, types) of a question: strong if it asks for saved data, weak if it is about its user."""
    low = F.lower(query)
    types = F.when(any_of(query, OWNER), F.array_compact(F.array(*(F.when(any_of(query, words), k) for k, words in CONTENT_WORDS.items())))).otherwise(F.array().cast("array<string>"))
    strong = (F.size(types) > 0) | any_of(low, OWN_DATA)
    mode = F.when(strong, "strong").when(any_of(low, PERSONAL), "weak").otherwise("none")
    return F.struct(mode.alias("mode"), strong.alias("required"), F.when(strong, types).otherwise(F.array().cast("array<string>")).alias("types"))


def owner(doc: Column, metadata: Column) -> Column:
    """struct(user_id, content_type) of a user's own content, by its document's id or its metadata (map); null for public
    content."""
    parts = F.split(F.coalesce(doc, metadata["source_doc_id"], F.lit("")), ":")
    by_id = F.when((parts[0] == "user_content") & (F.size(parts) >= 4), F.struct(F.get(parts, 1).alias("user_id"), F.get(parts, 2).alias("content_type")))
    held = (metadata["source_type"] == "user_saved_content") | (F.coalesce(metadata["user_content_type"], F.lit("")) != "")
    by_meta = F.when(held, F.struct(F.coalesce(metadata["user_id"], F.lit("")).alias("user_id"), F.coalesce(metadata["user_content_type"], F.lit("")).alias("content_type")))
    return F.coalesce(by_id, by_meta)


def visible(own: Column, user: Column) -> Column:
    """Public, without a named owner, or the user's own."""
    return own.isNull() | (own["user_id"] == "") | (own["user_id"] == user)


def content_weight(own: Column, rules: Column, intent: Column, query: Column) -> Column:
    """Weight of a user's own content; 1 for public content."""
    kind = own["content_type"]
    asked = (F.size(rules["types"]) == 0) | F.array_contains(rules["types"], kind)
    table = F.coalesce(*(F.when((intent == i) & (kind == k), w) for i, ws in CONTENT_WEIGHTS.items() for k, w in ws.items()))
    plain = F.coalesce(table, F.when(any_of(F.lower(query), PERSONAL), PERSONAL_WEIGHT), F.lit(1.0))
    return F.when(own.isNull(), 1.0).when(rules["required"] & asked, STRONG_WEIGHT).when(rules["required"], OTHER_WEIGHT).otherwise(plain)


def sentence(subject: Column, predicate: Column, object_: Column) -> Column:
    """A triple as text: by the sentence of its predicate, else its parts in turn."""
    made = [F.when(predicate == k, F.replace(F.replace(F.lit(v), F.lit("{s}"), subject), F.lit("{o}"), object_)) for k, v in SENTENCES.items()]
    return F.coalesce(*made, F.concat(subject, predicate, object_))


def evidence_text(item: Column) -> Column:
    """What a reranker reads of an item: its content, its triple as a sentence, or its value."""
    text = lambda k: F.coalesce(item[k], F.lit(""))
    triple = (text("subject") != "") & (text("predicate") != "")
    return F.when(text("content") != "", text("content")).when(triple, sentence(text("subject"), text("predicate"), text("object"))).otherwise(text("value"))


def grams(text: Column, n: int = GRAM) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?d)^\s+|\s+$", "")
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def distinct_items(items: Column) -> Column:
    """items: array(struct(..., _key, _grams)) in order. An item goes if one before it that stays has the same key (null:
    none), or, of two without a key, grams whose Jaccard similarity is 0.85 or more. Bounded by the caps of the sources."""

    def like(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x["_grams"], y["_grams"]))
        near = (F.size(x["_grams"]) > 0) & (F.size(y["_grams"]) > 0) & (both >= SIMILAR * (F.size(x["_grams"]) + F.size(y["_grams"]) - both))
        return F.when(x["_key"].isNotNull(), F.coalesce(x["_key"] == y["_key"], F.lit(False))).otherwise(near)

    return F.aggregate(items, F.slice(items, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: like(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def rerank(rows: DataFrame, request: str, model_score: Column | None = None) -> DataFrame:
    """The evidence of requests, weighted, without near copies, best first. rows: request, key (unique in a request),
    query, intent, user_id, source_type, score, content, subject, predicate, object, value, source_doc_id, metadata (map).
    The best of each source are taken by its cap in order of key; other users' content goes first. model_score: a model's
    score of evidence_text instead of score. Adds rerank_score, own, mode, status and rank."""
    caps = {"semantic": 10, "relation": 15, "text2sql": 10}
    order = F.coalesce(*(F.when(F.col("source_type") == k, i) for i, k in enumerate(caps)), F.lit(9))
    capped = cap_per_source(rows.withColumn("_same", F.lit(0)), request, "source_type", "_same", "key", caps).drop("rank", "_same")
    r = capped.withColumns({"_own": owner(F.col("source_doc_id"), F.col("metadata")), "_policy": policy(F.coalesce("query", F.lit("")))}).where(visible(F.col("_own"), F.coalesce("user_id", F.lit("default"))))
    w = content_weight(F.col("_own"), F.col("_policy"), F.col("intent"), F.coalesce("query", F.lit("")))
    r = r.withColumn("rerank_score", weighted(F.col("score") if model_score is None else model_score, F.col("source_type"), SOURCE_WEIGHTS, w))
    triple = F.coalesce(F.col("predicate"), F.lit("")) != ""
    r = r.withColumns({"own": F.col("_own.content_type"), "mode": F.col("_policy.mode"), "_pinned": F.col("_policy.required"), "_at": order, "_key": F.when(triple, F.concat_ws("|", F.coalesce("subject", F.lit("")), "predicate", F.coalesce("object", F.lit("")))), "_grams": F.when(triple, F.array().cast("array<string>")).otherwise(grams(F.col("content")))})
    names = [c for c in (*rows.columns, "rerank_score", "own", "mode", "_pinned", "_at", "_key", "_grams") if c not in (request, "_at", "key")]
    before = lambda x, y: F.when((x["_at"] < y["_at"]) | ((x["_at"] == y["_at"]) & (x["key"] < y["key"])), -1).otherwise(1)
    held = r.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("_at", "key", *names)), before).alias("_items")).withColumn("_kept", distinct_items(F.col("_items")))
    out = held.select(request, F.exists("_kept", lambda x: x["own"].isNotNull()).alias("_found"), F.inline("_kept"))
    status = F.when(~F.col("_pinned"), "not_required").when(F.col("_found"), "private_content_found").otherwise("private_content_missing")
    best = Window.partitionBy(request).orderBy(F.when(F.col("_pinned") & F.col("own").isNotNull(), 0).otherwise(1), F.desc("rerank_score"), "_at", "key")
    return out.withColumns({"status": status, "rank": F.row_number().over(best)}).drop("_found", "_pinned", "_at", "_key", "_grams")


def flag_for_user(rows: DataFrame, request: str, text: str, score: str, allergies: str, factor: float = 0.3) -> DataFrame:
    """rows with hits (the allergies, an array column, that its text names), snippet (120 characters, of flagged rows),
    score lowered by factor and rank by it. Rows without text are never flagged."""
    t = F.coalesce(F.col(text), F.lit(""))
    hits = F.filter(F.coalesce(allergies, F.array().cast("array<string>")), lambda a: (a != "") & F.contains(t, a))
    r = rows.withColumn("hits", hits).withColumns({"snippet": F.when(F.size("hits") > 0, F.substring(t, 1, 120)), score: F.when(F.size("hits") > 0, F.coalesce(score, F.lit(0.5)) * factor).otherwise(F.col(score))})
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), "rank")))


def block_of(rank: Column, item: Column, score: Column) -> Column:
    """The text of one source for an answer: its number, type, content (600 characters), triple or value, and score."""
    text = lambda k: F.coalesce(item[k], F.lit(""))
    triple = F.concat(text("subject"), F.lit(" --("), text("predicate"), F.lit(")--> "), text("object"))
    value = F.concat(text("entity"), F.lit(": "), text("attribute"), F.lit(" = "), text("value"))
    body = F.when(text("content") != "", F.substring(text("content"), 1, 600)).when((text("subject") != "") & (text("predicate") != ""), triple).when(text("entity") != "", value)
    head = F.concat(F.lit("[来源"), rank.cast("string"), F.lit("] (类型: "), F.coalesce(item["source_type"], F.lit("unknown")), F.lit(")"))
    return F.concat_ws("\n", head, body, F.when(score.isNotNull(), F.concat(F.lit("(相关度: "), F.format_string("%.3f", score), F.lit(")"))))


def cited(answers: DataFrame, evidence: DataFrame, request: str, answer: str) -> DataFrame:
    """request, source_id, source_type, content of the sources that an answer cites and that exist, each once. evidence
    has request, rank, source_type, content, subject, predicate and object."""
    asked = answers.select(request, F.posexplode(citations(F.col(answer))).alias("at", "rank"))
    e = evidence.select(request, "rank", "source_type", F.coalesce(F.nullif(F.substring("content", 1, 200), F.lit("")), F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object")))).alias("content"))
    return asked.join(e, [request, "rank"]).select(request, F.col("rank").alias("source_id"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "content")


def missing_answer(rules: Column, found: Column) -> Column:
    """The answer where saved data is asked for and none is found; null otherwise."""
    names = F.transform(rules["types"], lambda t: F.coalesce(*(F.when(t == k, v) for k, v in CONTENT_NAMES.items()), t))
    said = F.when(F.size(names) > 0, F.replace(F.lit(MISSING), F.lit("{x}"), F.array_join(names, "、"))).otherwise(MISSING_ANY)
    return F.when(rules["required"] & ~found, said)


def context_id(item: Column, rank: Column) -> Column:
    """The first of evidence_id, chunk_id, source_id, id that an item has, else its rank."""
    return F.coalesce(*(F.nullif(item[k].cast("string"), F.lit("")) for k in ("evidence_id", "chunk_id", "source_id", "id")), rank.cast("string"))


def context_text(item: Column) -> Column:
    """Content, triple or value of an item as one line; null if it has none."""

    def line(*keys: str) -> Column:
        parts = [F.coalesce(item[k], F.lit("")) for k in keys]
        return F.nullif(F.trim(F.concat_ws(" ", *parts)), F.lit(""))

    return F.coalesce(F.nullif(item["content"], F.lit("")), line("subject", "predicate", "object"), line("entity", "attribute", "value"))


def summaries(evidence: DataFrame, request: str, most: int = 8, chars: int = 160) -> DataFrame:
    """request, source_type, chunk_id, score, preview of the first sources of a request, for its log."""
    preview = F.coalesce(F.nullif(F.substring("content", 1, chars), F.lit("")), F.substring(F.trim(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object")))), 1, chars))
    return evidence.where(F.col("rank") <= most).select(request, "rank", F.coalesce("source_type", F.lit("")).alias("source_type"), F.col("key").alias("chunk_id"), F.col("rerank_score").alias("score"), preview.alias("preview"))


def recent(events: Column, most: int = 20) -> Column:
    """The last `most` of an array."""
    return F.slice(events, F.greatest(F.size(events) - most + 1, F.lit(1)), most)
