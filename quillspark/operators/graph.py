"""Lookups over triples and attributes, and writes as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

SPO = ["subject", "predicate", "object"]


def first_triples(triples: DataFrame) -> DataFrame:
    """One row of each subject, predicate, object: the most confident, the first by seq among equals. An aggregate, so
    copies shrink before the shuffle."""
    best = F.max_by(F.struct("confidence", "seq"), F.struct(F.col("confidence"), -F.col("seq"))).alias("_b")
    return triples.groupBy(*SPO).agg(best).select(*SPO, "_b.confidence", "_b.seq")


def triples_of(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples with one of entities (entity) at either end, copies of a triple included: two equi-joins, since OR would
    be a nested loop, the second without the rows of the first."""
    e = F.broadcast(entities.select("entity").distinct()) if _few(entities) else entities.select("entity").distinct()
    by_subject = triples.join(e, triples.subject == e.entity, "left_semi")
    by_object = triples.join(e, triples.object == e.entity, "left_semi")
    return by_subject.union(by_object.join(e, by_object.subject == e.entity, "left_anti"))


def _few(entities: DataFrame) -> bool:
    """Whether the plan itself holds the rows of entities, as a list of names does."""
    return entities._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation"


def neighbours(triples: DataFrame, entities: DataFrame, predicates: tuple[str, ...] = ()) -> DataFrame:
    """entity: the other ends of the triples of entities that aren't among them; with predicates, of those alone."""
    near = triples_of(triples, entities)
    near = near.where(F.col("predicate").isin(*predicates)) if predicates else near
    found = near.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    return found.join(entities.select("entity"), "entity", "left_anti")


def one_hop(triples: DataFrame, entities: DataFrame, direct: int = 80, expand: int = 5, expanded: int = 30, allowed: list[str] | None = None) -> DataFrame:
    """subject, predicate, object, hop: the top `direct` triples of entities by confidence, then those of the first
    `expand` neighbours in order of name, `expanded` at most, of allowed predicates, without those seen. Rows are
    filtered before they are grouped; the near ones, `direct` at most, are taken to the driver once and held by the
    plan."""
    top = [F.desc("confidence"), *map(F.col, SPO)]
    held = first_triples(triples_of(triples, entities)).orderBy(*top).limit(direct)
    near = triples.sparkSession.createDataFrame([tuple(r) for r in held.collect()], held.schema)
    more = near.select(F.explode(F.array("subject", "object")).alias("entity")).distinct().join(entities.select("entity"), "entity", "left_anti").orderBy("entity").limit(expand)
    far = triples.where(F.col("predicate").isin(allowed)) if allowed else triples
    far = first_triples(triples_of(far, more)).join(F.broadcast(near), SPO, "left_anti")
    return near.select(*SPO, F.lit(0).alias("hop")).union(far.orderBy(*top).limit(expanded).select(*SPO, F.lit(1)))


def _ends(triples: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """entity, the triple and its confidence: the first `most` triples with each wanted entity at either end, in order of
    subject, predicate and object. No request can use more of an entity, and so a common entity is `most` rows."""
    e = wanted.select("entity").distinct()
    both = [triples.join(e.hint("merge"), triples[c] == e["entity"]).select("entity", *SPO, "confidence") for c in ("subject", "object")]
    once = both[0].union(both[1]).groupBy("entity", *SPO).agg(F.max("confidence").alias("confidence"))
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy(*SPO))).where(F.col("_r") <= most).drop("_r")


def relations_of_requests(triples: DataFrame, requests: DataFrame, expand_by: tuple[str, ...] | None = None, direct: int = 80, expand: int = 5, expanded: int = 30) -> DataFrame:
    """request, subject, predicate, object, confidence, hop of every request at once. requests: request and entity, a row
    each. A request has the first `direct` triples of its entities, each once, hop 0; then those among the first
    `expanded` triples of its first `expand` other ends, by name, of triples by the predicates of expand_by, that it
    doesn't have yet, hop 1. Joins are by entity alone, and of every entity only its first triples take part."""
    asked = requests.select("request", "entity").where("entity is not null").distinct()

    def first(wanted: DataFrame, most: int) -> DataFrame:
        # files of many like rows are small beside the rows: a broadcast by their size would not fit the driver
        found = wanted.hint("merge").join(_ends(triples, wanted, most), "entity").groupBy("request", *SPO).agg(F.max("confidence").alias("confidence"))
        return found.withColumn("_r", F.row_number().over(Window.partitionBy("request").orderBy(*SPO))).where(F.col("_r") <= most).drop("_r")

    near = cut(first(asked, direct))
    ends = near.where(F.col("predicate").isin(*(expand_by or EXPAND))).select("request", F.explode(F.array("subject", "object")).alias("entity")).distinct()
    other = ends.join(asked.hint("merge"), ["request", "entity"], "left_anti")
    other = other.withColumn("_r", F.row_number().over(Window.partitionBy("request").orderBy("entity"))).where(F.col("_r") <= expand).drop("_r")
    far = first(cut(other), expanded).join(near.hint("merge"), ["request", *SPO], "left_anti")
    return near.withColumn("hop", F.lit(0)).unionByName(far.withColumn("hop", F.lit(1)))


def relation_evidence(pairs: DataFrame, triples: DataFrame, entities: DataFrame, direct: int = 80, expand: int = 5, expanded: int = 30) -> tuple[DataFrame, DataFrame]:
    """(relations, infos): the formatted triples of entities and of their neighbours by the predicates of EXPAND, and the
    attributes of both, with hop."""
    hops = one_hop(triples, entities, direct, expand, expanded, list(EXPAND))
    more = hops.where("hop = 0").where(F.col("predicate").isin(*EXPAND)).select(F.explode(F.array("subject", "object")).alias("entity")).distinct().join(entities.select("entity"), "entity", "left_anti").orderBy("entity").limit(expand)
    infos = entity_info(pairs, entities).withColumn("hop", F.lit(0)).union(entity_info(pairs, more).withColumn("hop", F.lit(1)))
    return format_relations(hops), infos


def entity_report(attributes: DataFrame, triples: DataFrame) -> DataFrame:
    """entity, n_attributes, name (the last by seq), n_out, n_in of every entity that has attributes. Distinct triples are
    grouped once, both of their ends counted from there in one aggregate."""
    a = attributes.groupBy("entity").agg(F.count_distinct("attribute").alias("n_attributes"), F.max_by("value", F.when(F.col("attribute") == "name", F.col("seq"))).alias("name"))
    ends = triples.select(*SPO).distinct().select(F.inline(F.array(F.struct(F.col("subject").alias("entity"), F.lit(1).alias("_o"), F.lit(0).alias("_i")), F.struct(F.col("object").alias("entity"), F.lit(0).alias("_o"), F.lit(1).alias("_i")))))
    degrees = ends.groupBy("entity").agg(F.sum("_o").alias("n_out"), F.sum("_i").alias("n_in"))
    zero = F.lit(0).cast("long")
    return a.join(degrees, "entity", "left").select("entity", "n_attributes", "name", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))


def canonical_id(name, prefix: str = ""):
    """Lower case, runs of other characters than letters, digits and _ as one _, none at the ends; `unknown` if empty
    and without prefix; the prefix is added unless there."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_]+", "_"), "_+", "_")
    slug = F.regexp_replace(slug, "^_|_$", "")
    if prefix:
        return F.when(slug.startswith(f"{prefix}_"), slug).otherwise(F.concat(F.lit(f"{prefix}_"), slug))
    return F.when(slug == "", "unknown").otherwise(slug)


def resolve_alias(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """name, entity: the most confident entity of each alias, the smallest id among equals."""
    best = aliases.groupBy("alias").agg(F.max_by("entity", F.struct(F.col("confidence"), -F.col("id"))).alias("entity"))
    return names.select("name").distinct().join(best, F.col("name") == F.col("alias")).select("name", "entity")


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity, alias, confidence, seq and any others, such as source, alias_type, language): the largest confidence, of
    the others the last values."""
    rest = [c for c in old.columns if c not in ("entity", "alias", "confidence", "seq")]
    return old.unionByName(new).groupBy("entity", "alias").agg(*(F.max_by(c, "seq").alias(c) for c in rest), F.max("confidence").alias("confidence"), F.max("seq").alias("seq"))


def upsert_logs(logs: DataFrame, key: list[str], order: list[str], fixed: list[str], changing: list[str]) -> DataFrame:
    """One row per key: the first values of the fixed columns, the last of the changing ones."""
    at = F.struct(*order)
    return logs.groupBy(*key).agg(*(F.min_by(c, at).alias(c) for c in fixed), *(F.max_by(c, at).alias(c) for c in changing))


def delete_keys(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key), key, "left_anti")


def insert_absent(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*new.columns))).where("_r = 1").drop("_r")
    return rows.unionByName(delete_keys(first, rows, key))


def attributes_by_entity(pairs: DataFrame, entity: str) -> DataFrame:
    """All key-value rows of one entity, in order."""
    return pairs.where(F.col("entity") == entity).orderBy("seq")


def triples_where(triples: DataFrame, end: str, value: str, limit: int | None = None) -> DataFrame:
    """Triples whose subject, object or predicate is value, in order; the first `limit` of them."""
    found = triples.where(F.col(end) == value).orderBy("seq", *SPO)
    return found if limit is None else found.limit(limit)


def triples_by_entities(triples: DataFrame, entities: DataFrame, limit: int = 50) -> DataFrame:
    """Each triple with one of entities at either end once (the first by seq), the first `limit` by subject, predicate,
    object. Rows are filtered before they are grouped."""
    e = entities.select("entity").distinct()
    ends = triples.join(e, triples.subject == e.entity, "left_semi").union(triples.join(e, triples.object == e.entity, "left_semi"))
    first = ends.groupBy(*SPO).agg(F.min_by(F.struct("confidence", "seq"), F.struct("seq", "confidence")).alias("_b")).select(*SPO, "_b.*")
    return first.orderBy(*SPO).limit(limit)


def attributes_by_entities(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each entity of entities and attribute: the first by seq."""
    kept = pairs.join(entities.select("entity").distinct(), "entity", "left_semi")
    return kept.groupBy("entity", "attribute").agg(F.min_by(F.struct("value", "seq"), "seq").alias("_b")).select("entity", "attribute", "_b.*")


def entity_info(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, entity_type (of its _entity_type row, else unknown), attributes: those of its JSON values that have any,
    in order of the attribute."""
    from .facts import attributes_of

    p = attributes_by_entities(pairs, entities)
    kind = F.max(F.when(F.col("attribute") == "_entity_type", F.coalesce(F.get_json_object("value", "$.type"), F.lit("unknown"))))
    held = F.when(F.get_json_object("value", "$.attributes").isNotNull(), attributes_of(F.col("value")))
    listed = F.array_sort(F.collect_list(F.when(F.size(held) > 0, F.struct("attribute", held.alias("a")))))
    info = p.groupBy("entity").agg(F.coalesce(kind, F.lit("unknown")).alias("entity_type"), F.flatten(F.transform(listed, lambda x: x["a"])).alias("attributes"))
    return info.where(F.size("attributes") > 0)


# fixed values: names of relations, and those that come first
LABELS = {"contraindicated_for": "禁忌", "suitable_for": "适宜人群", "pairs_with": "相宜搭配", "conflicts_with": "相克", "can_replace": "替代", "recommends": "推荐食材", "contains": "包含", "belongs_to": "类别", "source_of": "来源", "cooked_by": "烹饪方法", "related_to": "关联"}
HIGH = ("contraindicated_for", "conflicts_with", "pairs_with")
EXPAND = ("contraindicated_for", "conflicts_with", "pairs_with", "can_replace", "recommends", "suitable_for")


def format_relations(triples: DataFrame) -> DataFrame:
    """triples with label and priority."""
    label = F.coalesce(*(F.when(F.col("predicate") == k, v) for k, v in LABELS.items()), F.col("predicate"))
    return triples.withColumns({"label": label, "priority": F.when(F.col("predicate").isin(*HIGH), "high").otherwise("normal")})


def full_report(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """entity, type, attributes (map, the last value by seq), relations_as_subject and relations_as_object (arrays of
    "predicate:entity", in order of seq) of every entity that has attributes. Copies of a triple are all listed."""
    kind = F.max_by(F.when(F.col("attribute") == "_entity_type", F.col("value")), F.when(F.col("attribute") == "_entity_type", F.col("seq")))
    last = pairs.groupBy("entity", "attribute").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    a = last.groupBy("entity").agg(F.coalesce(kind, F.lit("unknown")).alias("type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("attributes"))

    def relations(end: str, other: str, name: str) -> DataFrame:
        # equal lines are counted first, so that copies of a triple are one row with a number
        lines = triples.groupBy(F.col(end).alias("entity"), F.concat_ws(":", "predicate", other).alias("_l")).agg(F.min("seq").alias("_s"), F.count("*").cast("int").alias("_n"))
        listed = F.array_sort(F.collect_list(F.struct("_s", "_l", "_n")))
        return lines.groupBy("entity").agg(F.flatten(F.transform(listed, lambda x: F.array_repeat(x["_l"], x["_n"]))).alias(name))

    out = a.join(relations("subject", "object", "relations_as_subject"), "entity", "left").join(relations("object", "subject", "relations_as_object"), "entity", "left")
    none = F.array().cast("array<string>")
    return out.select("entity", "type", "attributes", F.coalesce("relations_as_subject", none).alias("relations_as_subject"), F.coalesce("relations_as_object", none).alias("relations_as_object"))
