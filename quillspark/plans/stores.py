"""Queries of imports, stores and lookups over the sales tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import imports as N
from ..operators import retrieval as R
from ..sources import records as S
from ..sources.samples import REQUESTS_SQL, pick, requests, sql_list
from ..sources.tables import ATTRIBUTES_SQL, TRIPLES_SQL, attributes, table, triples
from .retrieval import BM25

ENTITIES = ("supplier_1", "supplier_2", "nation_3", "part_7")
NAMES = ("Protein", "Total lipid (fat)", " sodium, NA ", "Vitamin B-12", "calories", "Iron, Fe")
FILES = ("Nutrition_label.png", "IMG_1.jpg", "my recipe 步骤.png", "fridge.jpg", "体检 report.png", "lunch 餐盒 外卖.jpeg", "x.bmp")
OCR = ("", "营养成分表 能量 蛋白质 脂肪 钠 每100克 nrv 含量表", "目录", "医院 报告 检查 诊断书 患者 张三 请遵医嘱 复查", "hello", "配料 步骤 做法 烹饪 先切再炒后加水煮熟即可食用")


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ENTITIES], "entity string")


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def n2_nutrient_name(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).select("p_partkey", N.nutrient_name(pick(NAMES, F.col("p_partkey"))).alias("nutrient"), N.nutrient_name(F.col("p_type")).alias("other"))


def _food(spark: SparkSession, sf: str) -> DataFrame:
    n, null = F.col("p_partkey"), F.lit(None).cast("string")

    def item(nutrient_name, name, amount, value, nested):
        return F.struct(nutrient_name.alias("nutrientName"), name.alias("name"), amount.alias("amount"), value.alias("value"), F.struct(nested.alias("name")).alias("nutrient"))

    items = F.array(
        item(F.lit("Protein"), null, F.col("p_size").cast("string"), null, null),
        item(null, F.lit("Total lipid (fat)"), F.lit("0"), (F.col("p_size") * 2).cast("string"), null),
        item(null, null, F.when(n % 2 == 0, F.lit("7")), null, F.lit("Protein")),
        item(F.lit("Odd thing!"), null, F.lit(""), null, null),
    )
    return _part(spark, sf).select(F.to_json(F.struct(n.alias("fdcId"), F.when(n % 7 > 0, F.col("p_name")).otherwise("").alias("description"), F.when(n % 14 > 0, F.col("p_brand")).alias("name"), items.alias("foodNutrients"))).alias("json"))


def n3_foods(spark: SparkSession, sf: str) -> DataFrame:
    f = N.foods(_food(spark, sf), "json")
    return f.select("entity_id", "name", "fdc_id", F.array_join(F.transform("nutrients", lambda x: F.concat_ws("=", x["nutrient"], x["amount"])), ",").alias("nutrients"))


def _product(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    amounts = F.create_map(F.lit("proteins_100g"), F.col("p_size").cast("string"), F.lit("salt_100g"), F.lit("0"), F.lit("other"), F.lit("1"))
    fields = F.struct(F.when(n % 5 > 0, F.col("p_name")).alias("product_name"), F.when(n % 10 > 0, F.lit("Plain")).alias("product_name_en"), F.when(n % 3 > 0, n.cast("string")).alias("code"), F.when(n % 4 == 0, F.col("p_type")).alias("generic_name"), F.when(n % 2 == 0, F.col("p_brand")).alias("brands"), F.when(n % 6 > 0, amounts).alias("nutriments"))
    return _part(spark, sf).select("p_partkey", F.to_json(fields).alias("json"))


def n4_products(spark: SparkSession, sf: str) -> DataFrame:
    p = N.products(_product(spark, sf), "json")
    return p.select("entity_id", "name", "barcode", "brand", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.transform("nutrients", lambda x: F.concat_ws("=", x["nutrient"], x["amount"])), ",").alias("nutrients"))


def n6_complete_products(spark: SparkSession, sf: str) -> DataFrame:
    return N.complete_products(_product(spark, sf), "json", "p_partkey", 50).select("p_partkey")


def _compounds(spark: SparkSession, sf: str):
    n = F.col("p_partkey")
    rows = _part(spark, sf).select(n, F.when(n % 11 > 0, F.col("p_brand")).alias("food"), F.col("p_type").alias("compound"), F.when(n % 2 == 0, "").otherwise("grain").alias("food_type"), F.lit(None).cast("string").alias("compound_type"), F.when(n % 3 > 0, (F.col("p_size") / 50).cast("string")).alias("confidence"))
    return N.compounds(rows, "p_partkey")


def n7_compounds(spark: SparkSession, sf: str) -> DataFrame:
    e, t = _compounds(spark, sf)
    return e.select("entity_id", "name", "entity_type", F.round("confidence", 6).alias("confidence")).unionByName(t.select(F.concat_ws(">", "subject", "object").alias("entity_id"), F.col("predicate").alias("name"), F.concat_ws(">", "subject_type", "object_type").alias("entity_type"), F.round("confidence", 6).alias("confidence")))


def n8_relation_rules(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    rows = _part(spark, sf).select(n, F.concat(F.lit(" "), "p_brand").alias("subject"), F.when(n % 4 > 0, "pairs_with").alias("predicate"), F.when(n % 6 > 0, F.col("p_type")).otherwise(" ").alias("object"), F.when(n % 2 > 0, "food").alias("subject_type"), F.lit("").alias("object_type"), F.when(n % 3 > 0, "0.5").otherwise("").alias("confidence"), F.lit(None).cast("string").alias("rule_type"))
    return N.relation_rules(rows).select("p_partkey", "subject", "predicate", "object", "subject_type", "object_type", "confidence", "rule_type")


def n5_n10_k12_import_batch(spark: SparkSession, sf: str) -> DataFrame:
    n, source = F.col("p_partkey"), F.lit("test")
    e = _part(spark, sf).select(F.concat(F.lit("part_"), n.cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.lit("food").alias("entity_type"), F.array(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("aliases"), F.lit(None).cast("string").alias("language"), source.alias("source"), F.when(n % 2 == 0, 0.5).alias("confidence"))
    e = N.merge_batches([e.where("confidence is null"), e.where("confidence is not null")])
    p = _part(spark, sf).select(F.concat(F.lit("part_"), n.cast("string")).alias("entity_id"), F.lit("food").alias("entity_type"), F.create_map(F.lit("protein_g"), F.col("p_size").cast("string"), F.lit("basis"), F.lit("x")).alias("nutrients"), F.lit(0.9).alias("confidence"))
    r = _compounds(spark, sf)[1]
    kv, t, a = N.batch_rows(e, p, r)
    meta = N.flat_metadata(F.create_map(F.lit("source"), source, F.lit("language"), F.lit("en")), F.create_map(F.lit("language"), F.lit("zh"), F.lit("fdc_id"), F.lit("1")))
    return kv.select(F.lit("kv").alias("kind"), F.col("entity_id").alias("a"), F.col("attribute").alias("b"), F.coalesce(F.get_json_object("value", "$.name"), F.concat_ws("/", F.get_json_object("value", "$.basis"), F.get_json_object("value", "$.protein_g"))).alias("c")).unionByName(t.select(F.lit("triple").alias("kind"), F.col("subject").alias("a"), F.col("metadata")["subject_type"].alias("b"), F.col("object").alias("c"))).unionByName(a.select(F.lit("alias").alias("kind"), F.col("canonical_entity_id").alias("a"), F.col("alias").alias("b"), F.concat_ws("/", "source", meta["language"], meta["source"], F.format_number("confidence", 2)).alias("c")))


def k1_k3_insert_ids(spark: SparkSession, sf: str) -> DataFrame:
    return N.with_ids(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "chunk_id", 100, 64)


def k7_k8_store_result(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("temp_id"), F.size("embedding").cast("long").alias("dim"))
    chunks = N.with_ids(S.with_embeddings(v.select("temp_id"), v, "temp_id"), "temp_id", "chunk_id")
    facts = table(spark, sf, "events").select(F.col("event_id").alias("temp_id"), F.col("event_type").alias("predicate"))
    out = N.remapped(facts, chunks, "temp_id", "chunk_id").withColumn("m", N.typed_metadata(F.lit(None).cast("map<string,string>"), F.lit("food"), F.col("predicate")))
    return out.groupBy("predicate", F.col("chunk_id").isNull().alias("unmapped")).agg(F.count("*").alias("n"), F.max("chunk_id").alias("last_id"), F.max(F.col("m")["object_type"]).alias("object_type"))


def s11_s12_image_route(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", S.image_route(pick(FILES, n), F.when(n % 13 > 0, F.col("n_chars") * 100), F.when(n % 4 == 3, F.col("text")).otherwise(pick(OCR, n))).alias("r"))
    return d.select("doc_id", "r.kind", "r.subtype", F.round("r.confidence", 6).alias("confidence"), "r.decision", "r.reason", S.image_parser(F.col("r"), F.when(n % 2 == 0, "document").when(n % 5 == 0, "natural")).alias("parser"))


def s14_s16_chunk_lookups(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf).withColumn("chunk_id", F.col("seq"))
    by_doc = S.rows_where(t, "subject", "supplier_1", "chunk_id", "object").withColumn("how", F.lit("doc"))
    point = S.rows_where(t, "chunk_id", 7, "subject", "predicate", "object").withColumn("how", F.lit("id"))
    scan = S.rows_where(t, "predicate", "located_in", "chunk_id", "subject").withColumn("how", F.lit("scan"))
    return by_doc.unionByName(point).unionByName(scan).select("how", "subject", "predicate", "object", "chunk_id")


def r2_r6_entity_attributes(spark: SparkSession, sf: str) -> DataFrame:
    a = attributes(spark, sf)
    one = G.attributes_by_entity(a, "part_7").withColumn("how", F.lit("one"))
    return one.unionByName(G.attributes_by_entities(a, _entities(spark, sf)).withColumn("how", F.lit("list"))).select("how", "entity", "attribute", "value")


def r3_triples_where(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf)
    parts = [G.triples_where(t, "subject", "supplier_1"), G.triples_where(t, "object", "nation_3"), G.triples_where(t, "predicate", "located_in", 50)]
    return N.merge_batches([p.withColumn("how", F.lit(i)) for i, p in enumerate(parts)]).select("how", *G.SPO, "seq")


def r5_triples_by_entities(spark: SparkSession, sf: str) -> DataFrame:
    return G.triples_by_entities(triples(spark, sf), _entities(spark, sf), 50)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    entity = F.concat(F.lit("part_"), n.cast("string"))
    kind = _part(spark, sf).select(entity.alias("entity"), F.lit("_entity_type").alias("attribute"), F.to_json(F.struct(F.lit("food").alias("type"))).alias("value"), n.alias("seq")).where("seq % 2 = 0")
    one = _part(spark, sf).select(entity.alias("entity"), F.lit("a").alias("attribute"), F.to_json(F.struct(F.array(F.struct(F.lit("brand").alias("attr"), F.col("p_brand").alias("value"), F.lit(0.5).alias("confidence"))).alias("attributes"))).alias("value"), (n + 1).alias("seq"))
    two = _part(spark, sf).select(entity.alias("entity"), F.lit("b").alias("attribute"), F.to_json(F.struct(F.struct("p_type", "p_size").alias("attributes"))).alias("value"), (n + 2).alias("seq")).where("seq % 3 = 0")
    return kind.unionByName(one).unionByName(two)


def r9_entity_info(spark: SparkSession, sf: str) -> DataFrame:
    i = G.entity_info(_pairs(spark, sf), _part(spark, sf).select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("entity")))
    return i.select("entity", "entity_type", F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["attr"], a["value"])), ",").alias("attributes"))


def r11_format_relations(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf).withColumn("predicate", F.when(F.col("predicate") == "located_in", "belongs_to").when(F.col("seq") % 5 == 0, "pairs_with").otherwise(F.col("predicate")))
    return G.format_relations(t).groupBy("predicate", "label", "priority").agg(F.count("*").alias("n"))


def r7_full_report(spark: SparkSession, sf: str) -> DataFrame:
    pairs = attributes(spark, sf).unionByName(attributes(spark, sf).where("attribute = 'name' and seq % 2 = 0").withColumns({"attribute": F.lit("_entity_type"), "value": F.lit("food")}))
    r = G.full_report(pairs, triples(spark, sf))
    return r.select("entity", "type", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("attributes"), F.size("relations_as_subject").cast("long").alias("n_out"), F.md5(F.array_join(F.array_sort("relations_as_subject"), "|")).alias("out_md5"), F.md5(F.array_join(F.array_sort("relations_as_object"), "|")).alias("in_md5"))


def r14_popular(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


def v12_discover(spark: SparkSession, sf: str) -> DataFrame:
    e = requests(spark, sf).select((F.col("n") / 12).cast("long").alias("request"), "request_id", "query")
    d = R.discover(e, "request", "request_id", "query", F.array(F.lit("番茄"), F.lit("痛风")))
    return d.select("request", F.array_join(F.transform("discovered", lambda x: F.concat_ws(":", x["name"], x["type"])), ",").alias("discovered"))


def v16_embed(spark: SparkSession, sf: str) -> DataFrame:
    e = R.embed(table(spark, sf, "documents"), "doc_id", "text")
    return e.select("doc_id", F.size("dense").cast("long").alias("n_dense"), F.size("sparse").cast("long").alias("n_sparse"), F.round(F.aggregate("sparse", F.lit(0.0), lambda a, x: a + x["weight"]), 4).alias("weight"))


def _img_case(options: dict, col: str) -> str:
    hits = {k: " + ".join(f"contains({col}, '{w.lower()}')::int" for w in words) for k, words in options.items()}
    best = "greatest(" + ", ".join(f"({v}) * 10 + {9 - i}" for i, v in enumerate(hits.values())) + ")"
    return best, list(options)


DOC_BEST, DOC_KINDS = _img_case(S.DOCUMENT_NAMES, "fname")
NAT_BEST, NAT_KINDS = _img_case(S.NATURAL_NAMES, "fname")
OCR_BEST, OCR_KINDS = _img_case(S.OCR_TERMS, "ocr")
IMAGES = f"""img AS (SELECT doc_id, lower({sql_list(FILES)}[doc_id % {len(FILES)} + 1]) AS fname, CASE WHEN doc_id % 13 > 0 THEN n_chars * 100 END AS bytes, trim(lower(regexp_replace(coalesce(CASE WHEN doc_id % 4 = 3 THEN text ELSE {sql_list(OCR)}[doc_id % {len(OCR)} + 1] END, ''), '\\s+', ' ', 'g'))) AS ocr FROM documents),
i2 AS (SELECT *, {DOC_BEST} AS db, {NAT_BEST} AS nb, {OCR_BEST} AS ob, length(regexp_replace(ocr, '\\s+', '', 'g')) AS chars FROM img),
i3 AS (SELECT *, db // 10 AS dh, {sql_list(DOC_KINDS)}[10 - db % 10] AS dk, nb // 10 AS nh, {sql_list(NAT_KINDS)}[10 - nb % 10] AS nk, ob // 10 AS oh, CASE WHEN ob // 10 = 0 THEN 'pdf_page' ELSE {sql_list(OCR_KINDS)}[10 - ob % 10] END AS ok FROM i2),
i4 AS (SELECT *, ocr <> '' AND (oh > 0 OR chars >= 18) AS probed, least(0.93::double, 0.58::double + CASE WHEN chars >= 18 THEN 0.12::double ELSE 0 END + least(oh, 5) * 0.06::double + CASE WHEN ok IN ('nutrition_table', 'medical_report') AND oh >= 2 THEN 0.08::double ELSE 0 END) AS oc, chars >= 18 AND CASE ok WHEN 'nutrition_table' THEN oh >= 3 WHEN 'medical_report' THEN oh >= 2 WHEN 'recipe' THEN oh >= 3 ELSE oh >= 3 AND chars >= 40 END AS strong FROM i3),
i5 AS (SELECT doc_id, CASE WHEN dh > 0 THEN 'filename_strong_document_match' WHEN probed AND strong THEN 'ocr_strong_document_match' WHEN probed THEN 'ocr_weak_document_hint' WHEN nh > 0 THEN 'filename_natural_hint' WHEN bytes IS NULL THEN 'stat_failed' WHEN bytes < 81920 THEN 'weak_small_file_document_hint' ELSE 'no_strong_lightweight_signal' END AS reason, dk, ok, nk, oc FROM i4),
i6 AS (SELECT doc_id, reason, CASE reason WHEN 'filename_natural_hint' THEN 'natural' WHEN 'stat_failed' THEN 'unknown' WHEN 'no_strong_lightweight_signal' THEN 'unknown' ELSE 'document' END AS kind, CASE reason WHEN 'filename_strong_document_match' THEN dk WHEN 'ocr_strong_document_match' THEN ok WHEN 'ocr_weak_document_hint' THEN ok WHEN 'filename_natural_hint' THEN nk WHEN 'weak_small_file_document_hint' THEN 'pdf_page' ELSE 'unknown' END AS subtype, round(CASE reason WHEN 'filename_strong_document_match' THEN 0.9 WHEN 'ocr_strong_document_match' THEN oc WHEN 'ocr_weak_document_hint' THEN oc WHEN 'filename_natural_hint' THEN 0.78 WHEN 'stat_failed' THEN 0 WHEN 'weak_small_file_document_hint' THEN 0.55 ELSE 0.35 END, 6) AS confidence, CASE WHEN reason IN ('filename_strong_document_match', 'ocr_strong_document_match') THEN 'direct_document' ELSE 'vision_required' END AS decision FROM i5)"""
SLUG = "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '_+', '_', 'g'), '_')"


def _slug(c: str) -> str:
    return SLUG.format(c=c)


def _nutrient(c: str) -> str:
    return f"CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.NUTRIENTS.items()) + f" ELSE coalesce(nullif({_slug(c)}, ''), 'unknown') END"


COMPOUND_ROWS = f"cr AS (SELECT p_partkey AS seq, p_brand AS f, p_type AS c, {_slug('p_brand')} AS fid, {_slug('p_type')} AS cid, CASE WHEN p_partkey % 2 = 0 THEN 'food' ELSE 'grain' END AS ft, 'compound' AS ct, CASE WHEN p_partkey % 3 > 0 THEN p_size / 50.0::double ELSE 0.8 END AS confidence FROM part WHERE p_partkey % 11 > 0)"
IN_ENTITIES = "(" + ", ".join(f"'{x}'" for x in ENTITIES) + ")"
EXTRA_PAIRS = "pairs AS (SELECT * FROM attributes UNION ALL SELECT entity, '_entity_type', 'food', seq FROM attributes WHERE attribute = 'name' AND seq % 2 = 0)"
DISCOVER = sql_list(f"{k}:{v}" for k, v in R.DISCOVERABLE.items())

SQL = {
    "n2_nutrient_name": f"SELECT p_partkey, {_nutrient(f'{sql_list(NAMES)}[p_partkey % {len(NAMES)} + 1]')} AS nutrient, {_nutrient('p_type')} AS other FROM part",
    "n3_foods": f"WITH n AS (SELECT *, CASE WHEN p_partkey % 7 > 0 THEN p_name WHEN p_partkey % 14 > 0 THEN p_brand ELSE '' END AS name FROM part) SELECT 'usda_' || {_slug('name')} AS entity_id, name, p_partkey::varchar AS fdc_id, CASE WHEN p_partkey % 2 = 0 THEN 'fat_g=' || p_size * 2 || ',protein_g=7' ELSE 'protein_g=' || p_size || ',fat_g=' || p_size * 2 END AS nutrients FROM n WHERE name <> ''",
    "n4_products": f"WITH n AS (SELECT *, CASE WHEN p_partkey % 5 > 0 THEN p_name WHEN p_partkey % 10 > 0 THEN 'Plain' ELSE '' END AS name, CASE WHEN p_partkey % 3 > 0 THEN p_partkey::varchar ELSE '' END AS code, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS brand FROM part) SELECT CASE WHEN code <> '' THEN 'off_' || code ELSE 'off_' || {_slug('name')} END AS entity_id, name, code AS barcode, brand, concat_ws('|', name, CASE WHEN p_partkey % 4 = 0 THEN p_type END, CASE WHEN brand <> '' THEN brand || ' ' || name END) AS aliases, CASE WHEN p_partkey % 6 > 0 THEN 'protein_g=' || p_size || ',salt_g=0' ELSE '' END AS nutrients FROM n WHERE name <> ''",
    "n6_complete_products": "SELECT p_partkey FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 6 > 0 ORDER BY p_partkey LIMIT 50",
    "n7_compounds": f"WITH {COMPOUND_ROWS}, e AS (SELECT fid AS id, f AS name, ft AS t, confidence, seq, 0 AS k FROM cr UNION ALL SELECT cid, c, ct, confidence, seq, 1 FROM cr) SELECT id AS entity_id, min_by(name, (seq, k)) AS name, min_by(t, (seq, k)) AS entity_type, round(min_by(confidence, (seq, k)), 6) AS confidence FROM e GROUP BY 1 UNION ALL SELECT fid || '>' || cid, 'contains', ft || '>' || ct, round(confidence, 6) FROM cr",
    "n8_relation_rules": "SELECT p_partkey, p_brand AS subject, 'pairs_with' AS predicate, p_type AS object, CASE WHEN p_partkey % 2 > 0 THEN 'food' ELSE 'unknown' END AS subject_type, 'unknown' AS object_type, CASE WHEN p_partkey % 3 > 0 THEN 0.5 ELSE 0.85 END::double AS confidence, '' AS rule_type FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 6 > 0",
    "n5_n10_k12_import_batch": f"WITH {COMPOUND_ROWS} SELECT 'kv' AS kind, 'part_' || p_partkey AS a, '_entity_type' AS b, p_name AS c FROM part UNION ALL SELECT 'kv', 'part_' || p_partkey, 'nutrients', 'per_100g/' || p_size FROM part UNION ALL SELECT 'triple', fid, ft, cid FROM cr UNION ALL SELECT 'alias', 'part_' || p_partkey, unnest(list_distinct([p_name, p_brand])), 'test/zh/test/' || CASE WHEN p_partkey % 2 = 0 THEN '0.50' ELSE '0.80' END FROM part",
    "k1_k3_insert_ids": "SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) + 100 AS chunk_id FROM documents",
    "k7_k8_store_result": "WITH c AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS chunk_id FROM embeddings) SELECT event_type AS predicate, chunk_id IS NULL AS unmapped, count(*) AS n, max(chunk_id) AS last_id, max(event_type) AS object_type FROM events LEFT JOIN c ON event_id = vec_id GROUP BY 1, 2",
    "s11_s12_image_route": f"WITH {IMAGES} SELECT doc_id, kind, subtype, confidence, decision, reason, CASE WHEN decision = 'direct_document' THEN 'layout' WHEN doc_id % 2 = 0 THEN 'layout' WHEN doc_id % 5 = 0 THEN 'vision' WHEN kind = 'document' THEN 'layout' ELSE 'layout' END AS parser FROM i6",
    "s14_s16_chunk_lookups": f"WITH {TRIPLES_SQL} SELECT how, subject, predicate, object, seq AS chunk_id FROM (SELECT 'doc' AS how, * FROM triples WHERE subject = 'supplier_1' UNION ALL SELECT 'id', * FROM triples WHERE seq = 7 UNION ALL SELECT 'scan', * FROM triples WHERE predicate = 'located_in')",
    "r2_r6_entity_attributes": f"WITH {ATTRIBUTES_SQL} SELECT 'one' AS how, entity, attribute, value FROM attributes WHERE entity = 'part_7' UNION ALL SELECT 'list', entity, attribute, min_by(value, seq) FROM attributes WHERE entity IN {IN_ENTITIES} GROUP BY entity, attribute",
    "r3_triples_where": f"WITH {TRIPLES_SQL} SELECT 0 AS how, subject, predicate, object, seq FROM triples WHERE subject = 'supplier_1' UNION ALL SELECT 1, subject, predicate, object, seq FROM triples WHERE object = 'nation_3' UNION ALL SELECT * FROM (SELECT 2, subject, predicate, object, seq FROM triples WHERE predicate = 'located_in' ORDER BY seq, subject, predicate, object LIMIT 50)",
    "r5_triples_by_entities": f"WITH {TRIPLES_SQL}, t AS (SELECT * FROM triples WHERE subject IN {IN_ENTITIES} OR object IN {IN_ENTITIES}) SELECT subject, predicate, object, min_by(confidence, (seq, confidence)) AS confidence, min(seq) AS seq FROM t GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 50",
    "r9_entity_info": "SELECT 'part_' || p_partkey AS entity, CASE WHEN p_partkey % 2 = 0 THEN 'food' ELSE 'unknown' END AS entity_type, 'brand=' || p_brand || CASE WHEN (p_partkey + 2) % 3 = 0 THEN ',p_type=' || p_type || ',p_size=' || p_size ELSE '' END AS attributes FROM part",
    "r11_format_relations": f"WITH {TRIPLES_SQL}, t AS (SELECT CASE WHEN predicate = 'located_in' THEN 'belongs_to' WHEN seq % 5 = 0 THEN 'pairs_with' ELSE predicate END AS predicate FROM triples) SELECT predicate, CASE predicate WHEN 'belongs_to' THEN '类别' WHEN 'pairs_with' THEN '相宜搭配' ELSE predicate END AS label, CASE WHEN predicate = 'pairs_with' THEN 'high' ELSE 'normal' END AS priority, count(*) AS n FROM t GROUP BY ALL",
    "r7_full_report": f"WITH {TRIPLES_SQL}, {ATTRIBUTES_SQL}, {EXTRA_PAIRS}, l AS (SELECT entity, attribute, max_by(value, seq) AS value FROM pairs GROUP BY ALL), a AS (SELECT entity, coalesce(max(value) FILTER (WHERE attribute = '_entity_type'), 'unknown') AS type, string_agg(attribute || '=' || value, '|' ORDER BY attribute) AS attributes FROM l GROUP BY 1), o AS (SELECT subject AS entity, count(*) AS n, string_agg(predicate || ':' || object, '|' ORDER BY predicate || ':' || object) AS s FROM triples GROUP BY 1), i AS (SELECT object AS entity, string_agg(predicate || ':' || subject, '|' ORDER BY predicate || ':' || subject) AS s FROM triples GROUP BY 1) SELECT a.entity, type, attributes, coalesce(o.n, 0) AS n_out, md5(coalesce(o.s, '')) AS out_md5, md5(coalesce(i.s, '')) AS in_md5 FROM a LEFT JOIN o USING (entity) LEFT JOIN i USING (entity)",
    "r14_popular": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    "v12_discover": f"WITH {REQUESTS_SQL}, t AS (SELECT n // 12 AS request, request_id, query, row_number() OVER (PARTITION BY n // 12 ORDER BY request_id) AS r FROM requests), x AS (SELECT request, coalesce(string_agg(query, chr(10) ORDER BY request_id) FILTER (WHERE r <= 5), '') AS x FROM t GROUP BY 1) SELECT request, coalesce(array_to_string(list_filter({DISCOVER}, lambda d: split_part(d, ':', 1) NOT IN ('番茄', '痛风') AND contains(x, split_part(d, ':', 1)))[1:8], ','), '') AS discovered FROM x",
    "v16_embed": f"WITH {BM25}, w AS (SELECT doc_id, count(*) AS n, sum(weight) AS s FROM bm WHERE weight > 0 GROUP BY 1), h AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::bigint % 384 AS idx, sum(CASE WHEN ('0x' || substr(md5(token), 9, 2))::bigint % 2 = 0 THEN 1 ELSE -1 END) AS s FROM alltok GROUP BY ALL HAVING s <> 0), d AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1) SELECT documents.doc_id, coalesce(d.n, 0) AS n_dense, coalesce(w.n, 0) AS n_sparse, round(coalesce(w.s, 0), 4) AS weight FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN w USING (doc_id)",
}
QUERIES = {f.__name__: f for f in (n2_nutrient_name, n3_foods, n4_products, n6_complete_products, n7_compounds, n8_relation_rules, n5_n10_k12_import_batch, k1_k3_insert_ids, k7_k8_store_result, s11_s12_image_route, s14_s16_chunk_lookups, r2_r6_entity_attributes, r3_triples_where, r5_triples_by_entities, r9_entity_info, r11_format_relations, r7_full_report, r14_popular, v12_discover, v16_embed)}
