"""Imports: records of food databases and rule files as entities, nutrients, aliases and triples, and their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_list, document_text
from .graph import canonical_id

# fixed values: names and keys of nutrients
NUTRIENTS = {"energy": "energy_kcal", "energy_kcal": "energy_kcal", "calories": "energy_kcal", "protein": "protein_g", "total lipid (fat)": "fat_g", "fat": "fat_g", "carbohydrate, by difference": "carbohydrate_g", "carbohydrates": "carbohydrate_g", "carbohydrate": "carbohydrate_g", "fiber, total dietary": "fiber_g", "fiber": "fiber_g", "sugars, total including nlea": "sugar_g", "sugars": "sugar_g", "sugar": "sugar_g", "sodium, na": "sodium_mg", "sodium": "sodium_mg", "potassium, k": "potassium_mg", "calcium, ca": "calcium_mg", "iron, fe": "iron_mg"}
LABEL_NUTRIENTS = {"energy-kcal_100g": "energy_kcal", "energy_100g": "energy_kj", "proteins_100g": "protein_g", "fat_100g": "fat_g", "carbohydrates_100g": "carbohydrate_g", "fiber_100g": "fiber_g", "sugars_100g": "sugar_g", "sodium_100g": "sodium_g", "salt_100g": "salt_g"}
FOOD = "fdcId string, fdc_id string, description string, name string, foodNutrients array<struct<nutrientName:string,name:string,amount:string,value:string,nutrient:struct<name:string,nutrientName:string>>>, nutrients array<struct<nutrientName:string,name:string,amount:string,value:string,nutrient:struct<name:string,nutrientName:string>>>"
PRODUCT = "product_name string, product_name_en string, code string, _id string, generic_name string, brands string, ingredients_text string, ingredients_text_en string, categories string, nutriments map<string,string>"


def _some(*values: Column) -> Column:
    """The first value that isn't null or empty; empty if all are."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def nutrient_name(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in NUTRIENTS.items() for x in kv))
    return F.coalesce(F.element_at(known, F.lower(F.trim(name))), canonical_id(name))


def last_of(items: Column, key: str) -> Column:
    """array without the items whose key comes again later."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y[key] == x[key]))


def foods(records: DataFrame, json: str) -> DataFrame:
    """entity_id, name, fdc_id, nutrients (array(struct(nutrient, amount))) of food records; those without a name go. An
    amount of zero counts as missing, so that value is taken; of a nutrient that comes again the last amount holds."""
    r = records.select(F.from_json(json, FOOD).alias("r")).select("r.*")
    name = F.trim(_some(F.col("description"), F.col("name")))
    listed = F.when(F.size("foodNutrients") > 0, F.col("foodNutrients")).otherwise(F.coalesce("nutrients", F.array().cast(r.schema["nutrients"].dataType)))

    def one(x: Column) -> Column:
        amount = F.when(x["amount"].isNotNull() & ~x["amount"].isin("", "0", "0.0"), x["amount"]).otherwise(x["value"])
        return F.struct(_some(x["nutrientName"], x["name"], x["nutrient"]["name"], x["nutrient"]["nutrientName"]).alias("raw"), amount.alias("amount"))

    kept = F.filter(F.transform(listed, one), lambda x: (x["raw"] != "") & (F.coalesce(x["amount"], F.lit("")) != ""))
    r = r.withColumns({"_name": name, "_n": F.transform(kept, lambda x: F.struct(nutrient_name(x["raw"]).alias("nutrient"), x["amount"].alias("amount")))}).where("_name <> ''")
    return r.select(canonical_id(F.col("_name"), "usda").alias("entity_id"), F.col("_name").alias("name"), _some(F.col("fdcId"), F.col("fdc_id")).alias("fdc_id"), last_of(F.col("_n"), "nutrient").alias("nutrients"))


def products(records: DataFrame, json: str) -> DataFrame:
    """entity_id, name, barcode, brand, ingredients, categories, aliases, nutrients of labelled products; zero is kept."""
    r = records.select(F.from_json(json, PRODUCT).alias("r")).select("r.*")
    name, code, brand = F.trim(_some(F.col("product_name"), F.col("product_name_en"))), F.trim(_some(F.col("code"), F.col("_id"))), F.trim(_some(F.col("brands")))
    r = r.withColumns({"_name": name, "_code": code, "_brand": brand}).where("_name <> ''")
    generic = F.trim(_some(F.col("generic_name")))
    aliases = F.array_compact(F.array("_name", F.nullif(generic, F.lit("")), F.when(F.col("_brand") != "", F.trim(F.concat_ws(" ", "_brand", "_name")))))
    amounts = [F.when(F.coalesce(F.element_at("nutriments", k), F.lit("")) != "", F.struct(F.lit(v).alias("nutrient"), F.element_at("nutriments", k).alias("amount"))) for k, v in LABEL_NUTRIENTS.items()]
    entity = F.when(F.col("_code") != "", F.concat(F.lit("off_"), "_code")).otherwise(canonical_id(F.col("_name"), "off"))
    return r.select(entity.alias("entity_id"), F.col("_name").alias("name"), F.col("_code").alias("barcode"), F.col("_brand").alias("brand"), _some(F.col("ingredients_text"), F.col("ingredients_text_en")).alias("ingredients"), _some(F.col("categories")).alias("categories"), aliases.alias("aliases"), F.array_compact(F.array(*amounts)).alias("nutrients"))


def complete_products(records: DataFrame, json: str, order: str, limit: int = 0) -> DataFrame:
    """Records with a product name and nutriments; the first `limit` of them by order if it isn't 0."""
    has = (F.coalesce(F.get_json_object(json, "$.product_name"), F.lit("")) != "") & ~F.coalesce(F.get_json_object(json, "$.nutriments"), F.lit("")).isin("", "{}")
    kept = records.where(has)
    return kept.orderBy(order).limit(limit) if limit else kept


def compounds(rows: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(food, compound, food_type, compound_type, confidence: strings) -> (entities, triples). An id that comes several
    times, as a food or a compound, is what it was first. Rows without a food or a compound go."""
    r = rows.withColumns({"_f": F.trim(_some(F.col("food"))), "_c": F.trim(_some(F.col("compound"))), "confidence": F.coalesce(F.nullif("confidence", F.lit("")).cast("double"), F.lit(0.8))}).where("_f <> '' and _c <> ''")
    r = r.withColumns({"_fid": canonical_id(F.col("_f")), "_cid": canonical_id(F.col("_c")), "_ft": F.coalesce(F.nullif("food_type", F.lit("")), F.lit("food")), "_ct": F.coalesce(F.nullif("compound_type", F.lit("")), F.lit("compound"))})
    ends = F.array(F.struct(F.col("_fid").alias("entity_id"), F.col("_f").alias("name"), F.col("_ft").alias("entity_type"), F.lit(0).alias("_end")), F.struct(F.col("_cid").alias("entity_id"), F.col("_c").alias("name"), F.col("_ct").alias("entity_type"), F.lit(1).alias("_end")))
    entities = r.select(F.col(seq).alias("_seq"), "confidence", F.inline(ends)).groupBy("entity_id").agg(F.min_by(F.struct("name", "entity_type", "confidence"), F.struct("_seq", "_end")).alias("_e")).select("entity_id", "_e.*")
    triples = r.select(F.col("_fid").alias("subject"), F.lit("contains").alias("predicate"), F.col("_cid").alias("object"), F.col("_ft").alias("subject_type"), F.col("_ct").alias("object_type"), "confidence", F.col(seq).alias("seq"))
    return entities, triples


def relation_rules(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object, subject_type, object_type, confidence, rule_type: strings) as triples; incomplete
    rows go, confidence is 0.85 where it is missing."""
    spo = {c: F.trim(_some(F.col(c))) for c in ("subject", "predicate", "object")}
    other = {c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in ("subject_type", "object_type")}
    r = rows.withColumns(spo | other | {"confidence": F.coalesce(F.nullif("confidence", F.lit("")).cast("double"), F.lit(0.85)), "rule_type": _some(F.col("rule_type"))})
    return r.where("subject <> '' and predicate <> '' and object <> ''")


def merge_batches(batches: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def flat_metadata(base: Column, extra: Column) -> Column:
    """One map of both; extra holds where both have a key."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def distinct_names(names: Column) -> Column:
    """Names without white space around them, each once, in order, none empty."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def batch_rows(entities: DataFrame, profiles: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key-value rows, triples, aliases) of entities (entity_id, name, entity_type, aliases, language, source,
    confidence), profiles (entity_id, entity_type, nutrients: map, confidence) and relations (subject, predicate, object,
    subject_type, object_type, confidence)."""
    kinds = entities.select("entity_id", "entity_type", F.lit("_entity_type").alias("attribute"), F.to_json(F.struct(F.col("entity_type").alias("type"), "name", "aliases")).alias("value"), "confidence")
    amounts = profiles.select("entity_id", "entity_type", F.lit("nutrients").alias("attribute"), F.to_json(flat_metadata(F.col("nutrients"), F.create_map(F.lit("basis"), F.lit("per_100g")))).alias("value"), "confidence")
    triples = relations.select("subject", "predicate", "object", "confidence", F.create_map(F.lit("subject_type"), F.col("subject_type"), F.lit("object_type"), F.col("object_type")).alias("metadata"))
    names = distinct_names(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    aliases = entities.select(F.col("entity_id").alias("canonical_entity_id"), F.explode(names).alias("alias"), F.lit("name").alias("alias_type"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))
    return kinds.unionByName(amounts), triples, aliases


def with_ids(rows: DataFrame, seq: str, name: str, start: int = 0, bucket: int = 1 << 16) -> DataFrame:
    """rows with ids start + 1, start + 2, ... in the order of seq (whole numbers, no two equal): ranks within buckets of
    neighbouring numbers, and the sums of counts before them within buckets of buckets, three levels of these. So no task
    sorts all rows, and the last level has 65,536 rows at most, however far apart the numbers lie."""
    before = (Window.unboundedPreceding, -1)
    levels = [F.floor(F.col(seq) / bucket).alias("_b1"), F.floor(F.col(seq) / bucket / 65536).alias("_b2"), F.floor(F.col(seq) / bucket / 65536 / 65536).alias("_b3")]
    if bucket == 1 << 16:  # exact for all long numbers
        levels = [F.shiftright(F.col(seq).cast("long"), 16 * k).alias(f"_b{k}") for k in (1, 2, 3)]
    r = rows.select("*", *levels)
    counts = r.groupBy("_b1", "_b2", "_b3").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_o1", F.sum("_n").over(Window.partitionBy("_b2", "_b3").orderBy("_b1").rowsBetween(*before)))
    second = counts.groupBy("_b2", "_b3").agg(F.sum("_n").alias("_n")).withColumn("_o2", F.sum("_n").over(Window.partitionBy("_b3").orderBy("_b2").rowsBetween(*before)))
    third = counts.groupBy("_b3").agg(F.sum("_n").alias("_n")).withColumn("_o3", F.sum("_n").over(Window.orderBy("_b3").rowsBetween(*before)))
    zero = F.lit(0)
    joined = offsets.join(second.drop("_n"), ["_b2", "_b3"]).join(third.drop("_n"), "_b3")
    offsets = joined.select("_b1", "_b2", "_b3", (F.coalesce("_o1", zero) + F.coalesce("_o2", zero) + F.coalesce("_o3", zero)).alias("_off"))
    ranked = r.withColumn("_r", F.row_number().over(Window.partitionBy("_b1", "_b2", "_b3").orderBy(seq)))
    return ranked.join(offsets, ["_b1", "_b2", "_b3"]).withColumn(name, (F.col("_off") + F.col("_r") + start).cast("long")).drop("_b1", "_b2", "_b3", "_r", "_off")


def remapped(rows: DataFrame, ids: DataFrame, temporary: str, name: str) -> DataFrame:
    """rows with the id (name) that ids has for their temporary one; null where it has none."""
    return rows.join(ids.select(temporary, name), temporary, "left").drop(temporary)


def typed_metadata(metadata: Column, subject_type: Column, object_type: Column) -> Column:
    return flat_metadata(F.coalesce(metadata, F.create_map().cast("map<string,string>")), F.create_map(F.lit("subject_type"), subject_type, F.lit("object_type"), object_type))


def parsed_files(files: DataFrame) -> DataFrame:
    """(path, text) of read_directory -> path, blocks, body, category and the rest of the classes: the first half of a
    batch import; chunks and facts follow from them."""
    from .classes import classified

    named = files.withColumn("_name", F.regexp_extract("path", r"([^/]+)$", 1))
    return classified(named, "text", "_name").drop("_name")


def inline_text(spark, text: str, source: str = "input") -> DataFrame:
    """path, text, blocks and body of a text that comes from no file."""
    d = spark.createDataFrame([(source, text)], "path string, text string").withColumn("blocks", block_list(F.col("text")))
    return d.withColumn("body", document_text(F.col("blocks")))
