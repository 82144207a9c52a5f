"""Facts of texts as entity, attribute and value, and the triples that follow from them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .blocks import let
from .planning import any_of

# fixed values: patterns of facts, relations by the name of an attribute (the first that it holds), types of objects
ENTITY = (r"([一-鿿A-Za-z]{1,20})营养", r"([一-鿿A-Za-z]{1,20})每\s*100\s*克", r"([一-鿿A-Za-z]{1,20})含")
NO_ENTITY = ("每", "适合", "一般", "高蛋白", "低碳水")
AMOUNTS = {"protein": r"(?i)蛋白质\s*([0-9]+(?:\.[0-9]+)?)\s*(克|g)", "fat": r"(?i)脂肪\s*([0-9]+(?:\.[0-9]+)?)\s*(克|g)", "carbs": r"(?i)(?:碳水化合物|碳水)\s*([0-9]+(?:\.[0-9]+)?)\s*(克|g)", "calories": r"(?i)(?:热量|能量)\s*([0-9]+(?:\.[0-9]+)?)\s*(千卡|kcal|大卡)"}
QUALITIES = {"suitable_for": r"适合([^。；\n]+)", "dietary_feature": r"(高蛋白|低碳水|低脂|低糖|低盐)"}
#: no match of a pattern is without all of these (entities) or one of these (amounts, qualities)
ENTITY_SIGNS = (("营养",), ("每", "100", "克"), ("含",))
AMOUNT_SIGNS = {"protein": ("蛋白质",), "fat": ("脂肪",), "carbs": ("碳水",), "calories": ("热量", "能量")}
QUALITY_SIGNS = {"suitable_for": ("适合",), "dietary_feature": ("高蛋白", "低碳水", "低脂", "低糖", "低盐")}
MEASURE = r"([一-鿿]+[A-Za-z]*[0-9]*)\s*[:：]?\s*([0-9.]+)\s*(g|mg|μg|kcal|kJ|%)?"
RELATIONS = {"禁忌": "contraindicated_for", "contraindications": "contraindicated_for", "不宜": "contraindicated_for", "适宜人群": "suitable_for", "suitable_for": "suitable_for", "推荐食材": "recommends", "主要食材": "contains", "related_entities": "related_to", "烹饪方法": "cooked_by", "替代": "can_replace", "代替": "can_replace", "搭配": "pairs_with", "相克": "conflicts_with", "分类": "belongs_to", "category": "belongs_to", "来源": "source_of"}
OBJECT_TYPES = {"contraindicated_for": "symptom", "suitable_for": "person", "recommends": "ingredient", "contains": "ingredient", "cooked_by": "cooking_method", "can_replace": "ingredient", "pairs_with": "ingredient", "conflicts_with": "ingredient", "belongs_to": "category", "source_of": "nutrient"}
LITERAL_TYPES = {"nutrient_value": ("热量", "蛋白质", "脂肪", "碳水", "能量", "每"), "category": ("分类", "类别", "类型"), "description": ("难度", "用时", "时间"), "cooking_method": ("烹饪", "做法")}
CONFLICT = r"([一-鿿]{2,6})\s*[和与跟]\s*([一-鿿]{2,6})\s*(?:相克|不宜同食|不能一起|禁止搭配)"
REPLACE = r"([一-鿿]{2,6})\s*(?:可以)?\s*(?:替代|代替|换成)\s*([一-鿿]{2,6})"
LEAST_CHARS, MOST_CHARS = 20, 100


def primary_entity(text: Column) -> Column:
    """The name before the first pattern that finds one; null without."""

    def name(pattern: str, signs: tuple[str, ...]) -> Column:
        found = F.when(reduce(and_, (F.contains(text, F.lit(w)) for w in signs)), F.regexp_extract(text, pattern, 1))
        return let(found, lambda n: F.when((n != "") & ~n.isin(*NO_ENTITY), n))

    return F.coalesce(*(name(p, w) for p, w in zip(ENTITY, ENTITY_SIGNS)))


def rule_facts(text: Column) -> Column:
    """array(struct(attr, value, confidence)): the first amount of each nutrient, every quality."""

    def amount(attr: str, pattern: str) -> Column:
        # the groups are taken from what was found, not from the text again
        found = F.when(any_of(text, AMOUNT_SIGNS[attr]), F.regexp_extract(text, pattern, 0))
        return let(found, lambda m: F.when(m != "", F.struct(F.lit(attr).alias("attr"), F.concat(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)).alias("value"), F.lit(0.9).alias("confidence"))))

    def quality(attr: str, pattern: str) -> Column:
        found = F.when(any_of(text, QUALITY_SIGNS[attr]), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda v: F.struct(F.lit(attr).alias("attr"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value"), F.lit(0.75).alias("confidence")))

    return F.concat(F.array_compact(F.array(*(amount(a, p) for a, p in AMOUNTS.items()))), *(quality(a, p) for a, p in QUALITIES.items()))


def extract_facts(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, entity, seq, attr, value, confidence of the chunks that name an entity. Everything is one expression under an
    outer generator, so that no filter above it has it evaluated again."""

    def of(t: Column) -> Column:
        return let(primary_entity(t), lambda n: F.when(n.isNotNull(), F.transform(rule_facts(t), lambda x: F.struct(n.alias("entity"), x["attr"].alias("attr"), x["value"].alias("value"), x["confidence"].alias("confidence")))))

    rows = chunks.select(key, F.posexplode_outer(let(F.coalesce(F.col(text), F.lit("")), of)).alias("seq", "_x"))
    return rows.where("seq is not null").select(key, "_x.entity", "seq", "_x.attr", "_x.value", "_x.confidence")


def merge_facts(facts: DataFrame, key: str) -> DataFrame:
    """entity, attr, value, confidence: an entity that one chunk names keeps its facts; of one that several name, each
    attribute keeps its most confident value, the earliest among equals (of the first chunk its last one). Two
    aggregates and a join by entity, no window, so AQE can split a common entity."""
    facts = cut(facts)  # read for the spans, the single ones and the others
    spans = facts.groupBy("entity").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    j = facts.join(spans, "entity")
    alone = j.where("_first = _last").select("entity", "attr", "value", "confidence")
    of_chunk = F.when(F.col(key) == F.col("_first"), F.struct(F.lit(0.0).alias("c"), F.col("seq").alias("s"))).otherwise(F.struct(F.col("confidence").alias("c"), (-F.col("seq")).alias("s")))
    each = j.where("_first < _last").groupBy("entity", "attr", key).agg(F.max_by(F.struct("value", "confidence"), of_chunk).alias("_v"))
    best = each.groupBy("entity", "attr").agg(F.max_by("_v", F.struct(F.col("_v.confidence"), -F.col(key))).alias("_v"))
    return alone.unionByName(best.select("entity", "attr", "_v.value", "_v.confidence"))


def measures(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, amount, unit of everything that looks like a name, a number and a unit."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.arrays_zip(*(F.regexp_extract_all(t, F.lit(MEASURE), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "amount"), (3, "unit"))))
    return chunks.select(key, F.inline(parts))


def ingredients(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, amount: the lines of fewer than 30 characters, without list marks, cut at the first white space."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[- ]+", ""))
    words = F.transform(F.filter(lines, lambda x: (x != "") & (F.length(x) < 30)), lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    rows = F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.struct(F.get(w, 0).alias("name"), F.array_join(F.slice(w, F.lit(2), F.size(w)), " ").alias("amount")))
    return chunks.select(key, F.inline(rows))


def first_values(facts: DataFrame) -> DataFrame:
    """(entity, attr, value, seq): the first value of each attribute that isn't empty."""
    return facts.where("value <> ''").groupBy("entity", "attr").agg(F.min_by("value", "seq").alias("value"))


def attributes_of(value: Column) -> Column:
    """array(struct(attr, value, confidence)) of a JSON value in any of its shapes: {attributes: [{attr, value,
    confidence}]}, {attributes: {name: value}}, or amount, unit, type and role. Empty values are left out, lists joined,
    a missing confidence is 0.8."""
    kind = "array<struct<attr:string,value:string,confidence:double>>"
    inner, own = F.get_json_object(value, "$.attributes"), F.coalesce(F.get_json_object(value, "$.confidence").try_cast("double"), F.lit(0.8))
    listed = F.transform(F.from_json(inner, kind), lambda a: F.struct(a["attr"].alias("attr"), a["value"].alias("value"), F.coalesce(a["confidence"], F.lit(0.8)).alias("confidence")))
    pairs = F.filter(F.map_entries(F.from_json(inner, "map<string,string>")), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "[]", "{}"))

    def text(v: Column) -> Column:
        return F.when(F.startswith(v, F.lit("[")), F.array_join(F.filter(F.from_json(v, "array<string>"), lambda x: x != ""), "、")).otherwise(v)

    named = F.transform(pairs, lambda e: F.struct(e["key"].alias("attr"), text(e["value"]).alias("value"), own.alias("confidence")))
    flat = F.array_compact(F.array(*(F.when(F.coalesce(F.get_json_object(value, f"$.{k}"), F.lit("")) != "", F.struct(F.lit(k).alias("attr"), F.get_json_object(value, f"$.{k}").alias("value"), own.alias("confidence"))) for k in ("amount", "unit", "type", "role"))))
    none = F.array().cast(kind)
    return F.when(F.startswith(inner, F.lit("[")), listed).otherwise(F.concat(F.when(F.startswith(inner, F.lit("{")), named).otherwise(none), flat)).cast(kind)


def relation_of(attr: Column) -> Column:
    """The relation that an attribute's name stands for; null if it is a plain attribute."""
    return F.coalesce(*(F.when(F.contains(attr, F.lit(k)), r) for k, r in RELATIONS.items()))


def object_type(relation: Column) -> Column:
    return F.coalesce(*(F.when(relation == k, t) for k, t in OBJECT_TYPES.items()), F.lit("unknown"))


def literal_type(attr: Column) -> Column:
    return F.coalesce(*(F.when(any_of(attr, terms), t) for t, terms in LITERAL_TYPES.items()), F.lit("property"))


def triples_of_facts(facts: DataFrame, known: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """(entity, attr, value, confidence, seq) -> subject, predicate, object, object_type, confidence, seq. An attribute
    that stands for a relation gives a triple for each known entity (entity) within its value, one with the value cut to
    100 characters if there is none. Values are matched by an equi-join of their substrings, of the lengths that known
    names have, instead of a nested loop; lengths: those of the names, collected if not given (at most one for each
    length)."""
    names = known.select("entity").where("entity <> ''").distinct()
    sizes = lengths if lengths is not None else sorted(r[0] for r in names.select(F.length("entity")).distinct().collect())
    f = facts.where("attr <> '' and value <> ''").withColumn("_r", relation_of(F.col("attr")))
    plain = f.where("_r is null").select(F.col("entity").alias("subject"), F.col("attr").alias("predicate"), F.substring("value", 1, MOST_CHARS).alias("object"), literal_type(F.col("attr")).alias("object_type"), "confidence", "seq")
    rel = f.where("_r is not null")
    n = F.length("value")

    def parts(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("value"), i, F.lit(k))))

    cut = F.array_distinct(F.flatten(F.array_compact(F.array(*map(parts, sizes))))) if sizes else F.array().cast("array<string>")
    inside = rel.select("*", F.explode_outer(cut).alias("_s")).join(names.select(F.col("entity").alias("_n")), F.col("_s") == F.col("_n"), "left")
    key = ["entity", "attr", "value", "confidence", "seq", "_r"]
    found = inside.groupBy(*key).agg(F.array_sort(F.collect_set("_n")).alias("_f"))
    objects = F.when(F.size("_f") > 0, F.col("_f")).otherwise(F.array(F.substring("value", 1, MOST_CHARS)))
    linked = found.select(F.col("entity").alias("subject"), F.col("_r").alias("predicate"), F.explode(objects).alias("object"), F.when(F.size("_f") > 0, object_type(F.col("_r"))).otherwise("description").alias("object_type"), "confidence", "seq")
    return plain.unionByName(linked)


def text_triples(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, subject, predicate, object: pairs that a chunk of 20 characters or more says to conflict or to replace each
    other."""
    t = F.col(text)

    def pairs(pattern: str, predicate: str) -> Column:
        a, b = (F.regexp_extract_all(t, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.zip_with(a, b, lambda x, y: F.struct(x.alias("subject"), F.lit(predicate).alias("predicate"), y.alias("object")))

    return chunks.where(F.length(t) >= LEAST_CHARS).select(key, F.inline(F.concat(pairs(CONFLICT, "conflicts_with"), pairs(REPLACE, "can_replace"))))


def first_of(triples: DataFrame, seq: str) -> DataFrame:
    """One row of each subject, predicate, object: the first by seq."""
    rest = [c for c in triples.columns if c not in ("subject", "predicate", "object")]
    best = triples.groupBy("subject", "predicate", "object").agg(F.min_by(F.struct(*rest), seq).alias("_b"))
    return best.select("subject", "predicate", "object", "_b.*")


CONTENT_CATEGORIES = {"recipe": "recipe", "meal_plan": "daily", "workout_plan": "personal", "food_log": "daily", "body_metrics": "personal", "lab_report": "medical"}  # fixed values


def stamp_user_content(rows: DataFrame, user: str, session: str, content_type: str, text: str) -> DataFrame:
    """Adds source_doc_id (user_content:<user>:<type>:<12 hex digits of the text's SHA-256>), doc_category and metadata."""
    kind = F.col(content_type)
    doc = F.concat_ws(":", F.lit("user_content"), F.col(user), kind, F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 12))
    category = F.coalesce(*(F.when(kind == k, v) for k, v in CONTENT_CATEGORIES.items()), F.lit("unknown"))
    meta = F.create_map(F.lit("user_id"), F.col(user), F.lit("session_id"), F.col(session), F.lit("user_content_type"), kind, F.lit("source_type"), F.lit("user_saved_content"), F.lit("visibility"), F.lit("private"))
    return rows.withColumns({"source_doc_id": doc, "doc_category": category, "metadata": meta})
