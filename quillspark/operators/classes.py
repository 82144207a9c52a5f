"""Category of a document by rules: terms, table headers, structure and strong patterns, all within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_list, document_text, let, strip, table_headers, title
from .planning import any_of, strings
from .text import occurrences

# fixed values: categories in order, their terms, table headers and patterns, and the limits
CATEGORIES = ("personal", "daily", "nutrition", "recipe", "medical")
TERMS = {
    "personal": ("个人信息", "用户", "偏好", "过敏", "体重", "身高", "年龄", "BMI", "profile", "allergy", "preference"),
    "daily": ("每日", "今日", "记录", "早餐", "午餐", "晚餐", "加餐", "日期", "daily", "meal log", "breakfast", "lunch", "dinner"),
    "nutrition": ("热量", "蛋白质", "脂肪", "碳水", "维生素", "矿物质", "营养成分", "含量", "nutrition", "nutrient", "protein", "calorie", "sodium"),
    "recipe": ("做法", "步骤", "配料", "食材", "烹饪", "菜谱", "用料", "调料", "recipe", "ingredient", "cook", "method"),
    "medical": ("建议", "禁忌", "适宜", "不宜", "患者", "症状", "疾病", "医嘱", "高血压", "糖尿病", "痛风", "肾病", "妊娠", "孕妇", "儿童", "老人", "药物", "诊疗指南", "临床", "风险", "限钠", "控糖", "hypertension", "diabetes", "gout", "kidney disease", "pregnancy", "medication", "contraindication", "clinical", "guideline"),
}
HEADERS = {
    "nutrition": ("热量", "蛋白质", "脂肪", "碳水", "碳水化合物", "钠", "含量", "单位", "NRV", "energy", "protein", "fat", "carbohydrate", "sodium"),
    "recipe": ("食材", "用量", "配料", "调料", "步骤", "ingredient", "amount", "step"),
    "daily": ("日期", "早餐", "午餐", "晚餐", "摄入量", "时间", "date", "breakfast", "lunch", "dinner"),
    "personal": ("姓名", "年龄", "身高", "体重", "过敏源", "过敏史", "BMI", "name", "age", "height", "weight"),
    "medical": ("疾病", "症状", "禁忌", "风险", "限制", "指南", "诊疗", "临床", "人群", "disease", "symptom", "contraindication", "risk", "guideline", "clinical"),
}
STRONG = {
    "personal": r"(?d)(姓名|年龄|身高|体重|BMI|过敏史|过敏源).{0,20}(姓名|年龄|身高|体重|BMI|过敏史|过敏源)",
    "recipe": r"(步骤\s*[0-9]|第\s*[0-9]+\s*步|[0-9]+[.、]\s*(将|把|加入|倒入|煮|炒))",
    "medical": r"(诊疗指南|临床指南|疾病|禁忌|高血压|糖尿病|痛风|肾病|药物)",
}
STEP = r"(步骤\s*[0-9]|第\s*[0-9]+\s*步|[0-9]+[.、]\s*(?:将|把|用|加|倒|煮|炒))"
#: no match of a pattern is without one of these
SIGNS = {
    "personal": ("姓名", "年龄", "身高", "体重", "BMI", "过敏史", "过敏源"),
    "recipe": ("步骤", "第", "将", "把", "加入", "倒入", "煮", "炒"),
    "medical": ("诊疗指南", "临床指南", "疾病", "禁忌", "高血压", "糖尿病", "痛风", "肾病", "药物"),
}
STEP_SIGNS = ("步骤", "第", "将", "把", "用", "加", "倒", "煮", "炒")
LEAST, SECOND, MODEL_BELOW, MARGIN, MODEL_CHARS = 0.30, 0.2, 0.45, 2, 100
#: order of the categories that only headers or only the structure score
_HEADER_ORDER, _STRUCTURE_ORDER = tuple(HEADERS), ("nutrition", "daily", "recipe")


def strong_category(text: Column) -> Column:
    return F.coalesce(*(F.when(any_of(text, SIGNS[k]) & text.rlike(p), k) for k, p in STRONG.items()))


def header_score(blocks: Column, category: str) -> Column:
    """Three for each header of a table that is a sign of the category; every header counts if one does in lower case."""
    sign = strings(*HEADERS[category])

    def hits(block: Column) -> Column:
        headers = F.array_distinct(F.transform(table_headers(block["content"]), strip))
        low = F.transform(headers, F.lower)
        one = F.filter(headers, lambda h: F.array_contains(sign, h))
        return F.when(F.arrays_overlap(low, sign), F.size(headers)).otherwise(F.size(one)) * 3

    tables = F.filter(blocks, lambda b: b["kind"] == "table")
    return F.aggregate(F.transform(tables, hits), F.lit(0), lambda a, x: a + x)


def _scored(blocks: Column, body: Column, low: Column, strong: Column) -> Column:
    """array(struct(score, before, name)) of the categories that score, best first."""
    n = F.greatest(F.size(blocks), F.lit(1))
    tables = F.size(F.filter(blocks, lambda b: b["kind"] == "table")) / n
    lists = F.size(F.filter(blocks, lambda b: b["kind"] == "list")) / n
    steps = F.when(any_of(body, STEP_SIGNS), F.size(F.regexp_extract_all(body, F.lit(STEP), F.lit(1)))).otherwise(0)
    shapes = {"nutrition": F.when(tables > 0.5, 2).otherwise(0), "daily": F.when(tables > 0.5, 1).otherwise(0), "recipe": F.when(lists > 0.3, 2).otherwise(0) + F.when(steps >= 3, 5).otherwise(0)}

    def of(i: int, k: str) -> Column:
        terms = sum((occurrences(low, t.lower()) for t in TERMS[k][1:]), occurrences(low, TERMS[k][0].lower()))
        parts = F.struct(terms.alias("terms"), header_score(blocks, k).alias("heads"), shapes.get(k, F.lit(0)).alias("shape"), F.coalesce(strong == k, F.lit(False)).alias("strong"))
        late = 20 + (_STRUCTURE_ORDER.index(k) if k in shapes else 9)

        def score(x: Column) -> Column:
            at = F.when(x["strong"], -1).when(x["terms"] > 0, i).when(x["heads"] > 0, 10 + _HEADER_ORDER.index(k)).otherwise(late)
            return F.struct((F.when(x["strong"], 10).otherwise(0) + x["terms"] + x["heads"] + x["shape"]).cast("long").alias("score"), (-at).alias("before"), F.lit(k).alias("name"))

        return let(parts, score)

    return F.sort_array(F.filter(F.array(*(of(i, k) for i, k in enumerate(CATEGORIES))), lambda s: s["score"] > 0), asc=False)


def classify(blocks: Column, body: Column, label: Column) -> Column:
    """struct(category, confidence, secondary, method, scores, needs_model) of a document: its blocks, its text and tables
    (body), its title and file name (label). Equal scores go by the order in which the rules name a category: strong
    pattern, terms, table headers, structure. needs_model: too unsure for the rules alone."""
    zero = F.lit(0).cast("long")

    def judged(strong: Column, ranked: Column) -> Column:
        def result(t: Column) -> Column:
            share = F.coalesce(t["s1"] / F.nullif(t["total"], zero), F.lit(0.0))
            category = F.when(share < LEAST, "unknown").otherwise(F.get(ranked, 0)["name"])
            secondary = F.transform(F.filter(F.slice(ranked, 2, 2), lambda s: s["score"] / t["total"] >= SECOND), lambda s: s["name"])
            unsure = (category == "unknown") | (F.round(share, 4) < MODEL_BELOW) | (t["s1"] - t["s2"] < MARGIN)
            return F.struct(
                category.alias("category"),
                F.round(share, 4).alias("confidence"),
                secondary.alias("secondary"),
                F.when(F.coalesce(strong == category, F.lit(False)), "rule_strong").otherwise("rule").alias("method"),
                F.transform(ranked, lambda s: F.struct(s["name"].alias("category"), s["score"].alias("score"))).alias("scores"),
                ((F.length(strip(body)) >= MODEL_CHARS) & unsure).alias("needs_model"),
            )

        sums = F.struct(F.aggregate(ranked, zero, lambda a, s: a + s["score"]).alias("total"), F.coalesce(F.get(ranked, 0)["score"], zero).alias("s1"), F.coalesce(F.get(ranked, 1)["score"], zero).alias("s2"))
        return let(sums, result)

    def whole(text: Column) -> Column:
        parts = F.struct(F.lower(text).alias("low"), strong_category(text).alias("strong"))
        return let(parts, lambda p: let(_scored(blocks, body, p["low"], p["strong"]), lambda ranked: judged(p["strong"], ranked)))

    return let(F.concat_ws("\n", label, body), whole)


def classified(docs: DataFrame, text: str, name: str | None = None) -> DataFrame:
    """docs with blocks, body (text and tables) and the fields of classify. name: a column with the file name."""
    d = docs.withColumn("blocks", block_list(F.col(text))).withColumn("body", document_text(F.col("blocks")))
    label = F.concat_ws(" ", F.nullif(title(F.col("blocks")), F.lit("")), *([F.col(name)] if name else []))
    d = d.withColumn("_class", classify(F.col("blocks"), F.col("body"), label))
    return d.select(*docs.columns, "blocks", "body", "_class.*")
