"""Intents, entities and routes of questions, by ordered rules over literals of the plan: one narrow pass, no join."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import occurrences

# fixed values: intents, routes, terms, entity names and patterns that the rules know, in the order that decides
INTENTS = ("nutrition_fact", "nutrition_compare", "nutrition_filter", "ingredient_knowledge", "recipe_recommend", "recipe_instruction", "disease_diet", "profile_management", "meal_record_analysis", "food_image_analysis", "content_save", "safety_check", "diet_advice", "general")
ROUTES = ("semantic", "relation", "text2sql")
DISEASES = ("痛风", "糖尿病", "高血压", "高血脂", "脂肪肝", "贫血", "肾病", "胃病", "胃炎", "肠胃炎", "乳糖不耐", "胆固醇", "尿酸", "胰岛素")
NUTRIENTS = ("蛋白质", "脂肪", "碳水", "碳水化合物", "热量", "能量", "卡路里", "钠", "盐", "糖", "膳食纤维", "钙", "铁", "锌", "钾", "嘌呤")
FILTER_TERMS = ("有哪些", "筛选", "推荐", "找", "列出", "食物", "食材")
MANAGEMENT = ("记住", "记录", "保存", "帮我记", "以后", "更新", "改成", "删除")
RECIPE_TERMS = ("怎么做", "做法", "步骤", "烹饪", "怎么炒", "怎么煮", "教程")
SAFETY_TERMS = ("能不能吃", "可以吃", "适合吃", "能吃吗", "安全吗", "可不可以吃")
NUMERIC = r"(?i)(大于|小于|超过|低于|不少于|不超过|高于|少于|>=|<=|>|<|[0-9]+\s*(g|克|毫克|mg|kcal|千卡|大卡))"
PROFILE = (r"我.*(过敏|不能吃|不吃|忌口)", r"(我是|我属于).*(素食|乳糖不耐|孕妇|健身|减脂|增肌)", r"(我的目标|我想|计划).*(减脂|减肥|增肌|控糖|控盐|控制体重)", r"(我喜欢|我不喜欢|我讨厌|我偏好)")
UNNAMED = r"(这个|它|那个).*(能不能|可以|热量|营养|怎么吃)"
ENTITIES = {
    "ingredient": ("番茄", "鸡蛋", "黄瓜", "菠菜", "豆腐", "牛肉", "猪肉", "鸡肉", "鱼", "虾", "白菜", "土豆", "胡萝卜", "洋葱", "大蒜", "姜", "牛奶", "酸奶", "苹果", "香蕉", "米饭", "面条", "燕麦", "花生", "坚果"),
    "dish": ("番茄炒蛋", "西红柿炒鸡蛋", "宫保鸡丁", "鱼香肉丝", "麻婆豆腐", "沙拉", "粥"),
    "nutrient": ("蛋白质", "脂肪", "碳水", "碳水化合物", "热量", "能量", "维生素", "钙", "铁", "锌", "钠", "钾", "膳食纤维", "糖", "嘌呤"),
    "symptom": ("糖尿病", "高血压", "高血脂", "痛风", "贫血", "脂肪肝", "肾病", "乳糖不耐", "尿酸"),
    "person": ("孕妇", "儿童", "老人", "老年人", "青少年", "运动员", "素食者"),
}
SAVE_TERMS = ("保存", "存一下", "记一下", "帮我记", "记录一下", "save", "remember")
CONTENT_TERMS = {
    "recipe": ("菜谱", "食谱", "做法", "步骤", "食材", "配料", "调料", "烹饪", "recipe", "ingredient"),
    "meal_plan": ("饮食计划", "菜单", "一周菜单", "早餐", "午餐", "晚餐", "加餐", "meal plan", "menu"),
    "workout_plan": ("训练计划", "健身计划", "力量训练", "有氧", "深蹲", "卧推", "跑步", "组", "次数", "workout", "training", "exercise"),
    "food_log": ("饮食记录", "今天吃了", "早餐吃", "午餐吃", "晚餐吃", "摄入", "food log", "ate"),
    "body_metrics": ("体重", "身高", "BMI", "体脂", "腰围", "血压", "心率", "body weight", "body fat"),
    "lab_report": ("体检", "化验", "报告", "血糖", "血脂", "尿酸", "肌酐", "胆固醇", "甘油三酯", "lab report", "blood test"),
}
CONTENT_PATTERNS = {
    "recipe": r"(步骤\s*[0-9]|第\s*[0-9]+\s*步|食材[:：]|配料[:：])",
    "meal_plan": r"(周[一二三四五六日天]|星期[一二三四五六日天]|早餐|午餐|晚餐).{0,20}(早餐|午餐|晚餐)",
    "workout_plan": r"(训练|健身|workout).{0,30}(组|次数|分钟|有氧|力量)",
    "food_log": r"(今天|昨日|昨天).{0,10}(吃了|早餐|午餐|晚餐)",
    "body_metrics": r"(体重|身高|BMI|体脂|腰围|血压)[:：]?\s*[0-9]+",
    "lab_report": r"(体检报告|化验单|血糖|血脂|尿酸|肌酐|胆固醇)",
}
CONSTRAINTS = {"protein": ("protein", "蛋白质"), "fat": ("fat", "脂肪"), "calorie": ("calorie", "calories", "热量", "能量"), "sodium": ("sodium", "钠"), "sugar": ("sugar", "糖"), "carbohydrate": ("carbohydrate", "carb", "碳水")}
STRUCTURED = ("大于", "小于", "低于", "高于", "超过", "少于", "排名", "最多", "最少", "protein", "fat", "calorie", "sodium", "sugar")
ASK_UNSURE = "我不太确定你的具体意图。你是想查营养信息、推荐饮食、比较食材，还是确认某种食材是否适合你？"
ASK = {"safety_check": "你想确认哪种食材或菜品是否适合你？", "nutrition_filter": "你想按哪个营养指标和数值范围筛选？"}
ASK_OTHER = "你想查询的具体食材、菜品或目标是什么？"
UNSURE_BELOW = 0.65


def any_of(text: Column, terms) -> Column:
    return reduce(or_, (F.contains(text, F.lit(t)) for t in terms))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def disease(q: Column) -> Column:
    return any_of(q, DISEASES)


def numeric(q: Column) -> Column:
    return q.rlike(NUMERIC)


def clear_numeric(q: Column) -> Column:
    return numeric(q) & (any_of(q, NUTRIENTS) | any_of(q, FILTER_TERMS))


def profile_signal(q: Column) -> Column:
    return reduce(or_, (q.rlike(p) for p in PROFILE))


def manages_profile(q: Column) -> Column:
    return profile_signal(q) & any_of(q, MANAGEMENT)


def asks_recipe(q: Column) -> Column:
    return any_of(q, RECIPE_TERMS)


def asks_safety(q: Column) -> Column:
    return any_of(q, SAFETY_TERMS)


def entities(q: Column) -> Column:
    """array(struct(name, type)) of the known names within q, in the order of ENTITIES."""
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for t, names in ENTITIES.items() for n in names))
    return F.filter(known, lambda e: F.contains(q, e["name"]))


def has_food(found: Column) -> Column:
    return F.exists(found, lambda e: e["type"].isin("ingredient", "dish"))


def asks_to_save(q: Column) -> Column:
    return any_of(q, SAVE_TERMS) | any_of(F.lower(q), SAVE_TERMS)


def content_class(text: Column, explicit: Column | None = None) -> Column:
    """struct(content_type, confidence, score): five for the strong pattern of a type and one for each occurrence of its
    terms; among equals those with a strong pattern, then the first type. Null type without any; an explicit type that
    is known wins with confidence 1."""
    low = F.lower(text)
    scored = []
    for k, (name, terms) in enumerate(CONTENT_TERMS.items()):
        strong = text.rlike(CONTENT_PATTERNS[name]).cast("int")
        score = sum((occurrences(low, t.lower()) for t in terms), strong * 5)
        scored.append(F.struct(score.cast("long").alias("score"), strong.alias("strong"), F.lit(-k).alias("at"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    total = sum((s["score"] for s in scored[1:]), scored[0]["score"])
    found = F.struct(F.when(total > 0, best["name"]).alias("content_type"), F.when(total > 0, F.round(best["score"] / total, 4)).otherwise(0.0).alias("confidence"), F.when(total > 0, best["score"]).otherwise(F.lit(0).cast("long")).alias("score"))
    if explicit is None:
        return found
    given = F.struct(explicit.alias("content_type"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("score"))
    return F.when(explicit.isin(*CONTENT_TERMS), given).otherwise(found)


def _plan(intent, confidence, routes, signal) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct((intent if isinstance(intent, Column) else F.lit(intent)).alias("intent"), c.alias("confidence"), strings(*routes).alias("routes"), signal.alias("has_profile_signal"))


def strong_rule(q: Column, found: Column, content: Column) -> Column:
    """struct(intent, confidence, routes, has_profile_signal) of the first rule that holds; null if none does. found:
    entities(q); content: content_class(q)."""
    signal, no, yes = profile_signal(q), F.lit(False), F.lit(True)
    return (
        F.when(asks_to_save(q) & content["content_type"].isNotNull(), _plan("content_save", content["confidence"], (), no))
        .when(manages_profile(q), _plan("profile_management", 0.99, (), yes))
        .when(clear_numeric(q), _plan("nutrition_filter", 0.98, ("text2sql",), signal))
        .when(disease(q) & (asks_safety(q) | has_food(found)), _plan("disease_diet", 0.97, ("semantic", "relation"), signal))
        .when(asks_recipe(q) & has_food(found), _plan("recipe_instruction", 0.96, ("semantic",), signal))
        .when(asks_safety(q) & has_food(found), _plan("safety_check", 0.95, ("semantic", "relation"), signal))
    )


def fallback_plan(q: Column) -> Column:
    """The plan where no model answers, with confidence 0.55."""
    signal = profile_signal(q)
    return (
        F.when(manages_profile(q), _plan("profile_management", 0.55, (), signal))
        .when(disease(q), _plan("disease_diet", 0.55, ("semantic", "relation"), signal))
        .when(numeric(q), _plan("nutrition_filter", 0.55, ("text2sql",), signal))
        .when(asks_recipe(q), _plan("recipe_instruction", 0.55, ("semantic",), signal))
        .when(asks_safety(q), _plan("safety_check", 0.55, ("semantic", "relation"), signal))
        .otherwise(_plan("general", 0.55, ("semantic",), signal))
    )


def clean_routes(routes: Column) -> Column:
    """Known routes, each once, in order. Null: none."""
    return F.array_distinct(F.filter(F.coalesce(routes, strings()), lambda r: r.isin(*ROUTES)))


def ensure_routes(routes: Column, *required: str) -> Column:
    return F.concat(routes, F.array_except(strings(*required), routes))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def clean_entities(found: Column) -> Column:
    """Entities with a name and a known type."""
    kinds = (*ENTITIES, "cooking_method")
    trimmed = F.transform(F.coalesce(found, F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.struct(F.trim(F.coalesce(e["name"], F.lit(""))).alias("name"), F.trim(F.coalesce(e["type"], F.lit(""))).alias("type")))
    return F.filter(trimmed, lambda e: (e["name"] != "") & e["type"].isin(*kinds))


def checked_plans(requests: DataFrame, query: str, found: str, intent: str, routes: str, confidence: str, asks: str, question: str, signal: str) -> DataFrame:
    """requests with a model's plans within the rules: intent, routes, clarification_needed, clarification_question and
    has_profile_signal. The arguments name the columns of the question, its entities and the model's plan. Each rule is a
    column of its own, so that the plan grows with the rules, not with their product; write the result before it is
    filtered or joined, or the optimiser looks through all of them."""
    c, q = F.col, F.col(query)
    d = requests.withColumns({"_i": F.when(c(intent).isin(*INTENTS), c(intent)).otherwise("general"), "_r": clean_routes(c(routes)), "_sick": disease(q), "_number": numeric(q), "_recipe": asks_recipe(q), "_profile": profile_signal(q), "_manages": manages_profile(q), "_safety": asks_safety(q), "_known": F.size(entities(q)) > 0})

    def rule(d: DataFrame, holds: Column, new_intent: Column, new_routes: Column) -> DataFrame:
        return d.withColumns({"_i": F.when(holds, new_intent).otherwise(c("_i")), "_r": F.when(holds, new_routes).otherwise(c("_r"))})

    def turned(old: tuple[str, ...], new: str) -> Column:
        return F.when(c("_i").isin(*old), new).otherwise(c("_i"))

    d = rule(d, c("_sick"), turned(("general", "diet_advice", "nutrition_fact"), "disease_diet"), ensure_routes(c("_r"), "semantic", "relation"))
    d = rule(d, c("_number"), turned(("general", "nutrition_fact"), "nutrition_filter"), ensure_routes(c("_r"), "text2sql"))
    d = rule(d, c("_recipe"), turned(("general", "recipe_recommend"), "recipe_instruction"), ensure_routes(c("_r"), "semantic"))
    d = rule(d, c("_manages"), F.lit("profile_management"), strings())
    d = rule(d, c("_safety") & ~c("_i").isin("disease_diet", "profile_management"), F.lit("safety_check"), ensure_routes(c("_r"), "semantic", "relation"))
    d = rule(d, (F.size("_r") == 0) & ~c("_i").isin("profile_management", "content_save", "general"), c("_i"), strings("semantic"))
    named = F.exists(c(found), lambda e: e["name"] != "")
    unclear = ~named & (c("_i").isin("nutrition_fact", "nutrition_compare", "nutrition_filter", "safety_check") | q.rlike(UNNAMED))
    strong = c("_sick") | clear_numeric(q) | c("_manages") | ((c("_recipe") | c("_safety")) & c("_known"))
    d = d.withColumn("_unclear", unclear).withColumn("_unsure", ~c("_unclear") & (clamp(c(confidence)) < UNSURE_BELOW) & ~strong & ~c("_i").isin("profile_management", "content_save"))
    own = F.coalesce(*(F.when(c("_i") == k, v) for k, v in ASK.items()), F.lit(ASK_OTHER))
    text = F.when(c("_unclear"), F.coalesce(F.nullif(c(question), F.lit("")), own)).when(c("_unsure"), ASK_UNSURE).otherwise(F.coalesce(c(question), F.lit("")))
    out = {"intent": c("_i"), "routes": c("_r"), "clarification_needed": c(asks) | c("_unclear") | c("_unsure"), "clarification_question": text, "has_profile_signal": c(signal) | c("_profile")}
    return d.select(*(x for x in requests.columns if x not in out), *(v.alias(k) for k, v in out.items()))


def constraints(q: Column) -> Column:
    """The nutrients that a question names, and structured_query if it compares or ranks."""
    low = F.lower(q)
    names = [F.when(any_of(low, terms) | any_of(q, terms), name) for name, terms in CONSTRAINTS.items()]
    return F.array_compact(F.array(*names, F.when(any_of(q, STRUCTURED) | any_of(low, STRUCTURED), "structured_query")))
