"""Routing of requests: one step of the router as columns over a table of states, and the bounded run of steps.

A state row has: intent, query (strings), entities (names, array<string>), planned, executed, fallbacks (array<string>),
next_route (string, empty at first), steps, semantic_retries (int), semantic (array<double>, a score or null for each
item found), relation_texts (array<string>), relation_scores (array<double>), sql_rows (int), reason (string, of the
last failed SQL), discovered (array<string>, entities found in semantic evidence), errors (array<string>). A step is a
narrow projection; a run is at most `MAX_STEPS` + 1 of them without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planning import ROUTES, clean_routes, strings

# fixed values: routes that an intent needs, routes after a failure, search terms and predicates of an intent, limits
REQUIRED = {"disease_diet": ("semantic", "relation"), "safety_check": ("semantic", "relation"), "nutrition_filter": ("text2sql",), "recipe_instruction": ("semantic",)}
HIGH_RISK = ("disease_diet", "safety_check")
TERMS = {
    "disease_diet": ("diet advice", "risk", "contraindication", "suitable", "avoid"),
    "safety_check": ("allergy", "contraindication", "risk", "safety"),
    "recipe_instruction": ("recipe", "pairing", "nutrition", "suitable pairing", "conflict"),
    "nutrition_filter": ("nutrition facts", "protein", "fat", "calories", "sodium", "sugar"),
}
OTHER_TERMS, RETRY_TERMS = ("nutrition", "diet", "food"), ("nutrition", "diet", "food", "pairing")
PREDICATES = {
    "disease_diet": ("contraindicated_for", "suitable_for", "conflicts_with", "recommends"),
    "safety_check": ("contraindicated_for", "conflicts_with", "contains"),
    "recipe_instruction": ("pairs_with", "conflicts_with", "contains", "cooked_by"),
    "nutrition_filter": ("contains", "source_of", "belongs_to"),
}
OTHER_PREDICATES = ("related_to", "contains")
MAX_STEPS, COVERAGE, ENOUGH, FEW, SOME, GOOD, POOR = 6, 0.6, 15, 8, 12, 0.75, 0.45
ASK_RISK = "这个问题涉及健康风险，我需要更多背景或明确的食材/疾病信息后再回答。"
ENDS = ("rerank", "answer", "clarify")


def by_intent(intent: Column, table: dict[str, tuple[str, ...]], other: tuple[str, ...] = ()) -> Column:
    return F.coalesce(*(F.when(intent == k, strings(*v)) for k, v in table.items()), strings(*other))


def after_planner(intent: Column, planned: Column, clarification_needed: Column, has_profile_signal: Column) -> Column:
    """clarify, confirm or dispatch."""
    confirm = (intent == "profile_management") & has_profile_signal & (F.size(planned) == 0)
    return F.when(clarification_needed, "clarify").when(confirm, "confirm").otherwise("dispatch")


def unknown_routes(planned: Column) -> Column:
    return F.filter(planned, lambda r: ~r.isin(*ROUTES))


def missing_routes(intent: Column, planned: Column, executed: Column) -> Column:
    """Routes that the intent needs and that are neither planned nor done."""
    return F.array_except(by_intent(intent, REQUIRED), F.array_union(executed, planned))


def covered(names: Column, texts: Column) -> Column:
    """Names that stand in one of the texts."""
    return F.filter(names, lambda n: F.exists(texts, lambda t: F.contains(t, n)))


def coverage(names: Column, texts: Column) -> Column:
    """Share of the names, each counted once, that texts cover."""
    once = F.array_distinct(names)
    return F.size(covered(once, texts)) / F.greatest(F.size(once), F.lit(1))


def fallback_route(route: Column, reason: Column, blocked: Column) -> Column:
    """The first route after a failed one that isn't blocked; null if none is left."""
    candidates = F.when((route == "text2sql") & (reason == "schema_mismatch"), strings("relation", "semantic")).when(route.isin("text2sql", "relation"), strings("semantic")).when(route == "semantic", strings("relation")).otherwise(strings())
    return F.get(F.filter(candidates, lambda r: ~F.array_contains(blocked, r)), 0)


def _mean(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)


def sufficient(semantic: Column) -> Column:
    """Enough semantic evidence: 15 items; or 8 whose first eight have a mean score of 0.75 (12 where none has one)."""
    n, scores = F.size(semantic), F.array_compact(F.slice(semantic, 1, FEW))
    return F.when(n >= ENOUGH, True).when(n < FEW, False).when(F.size(scores) == 0, n >= SOME).otherwise(F.round(_mean(scores), 9) >= GOOD)


def low_quality(semantic: Column, relation: Column, sql_rows: Column) -> Column:
    """Fewer than two items, or a best score below 0.45 (false where no item has one)."""
    scores = F.array_compact(F.concat(semantic, relation))
    return (F.size(semantic) + F.size(relation) + sql_rows < 2) | F.coalesce(F.array_max(scores) < POOR, F.lit(False))


def item_score(rerank: Column, score: Column, similarity: Column, confidence: Column, distance: Column) -> Column:
    """The first score that an item has, or 1 less its distance, 0 at least."""
    return F.coalesce(rerank, score, similarity, confidence, F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1 - distance)))


def compose_query(query: Column, *parts: Column) -> Column:
    """The words of query and the items of parts, each once, joined by a space."""
    words = F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: w != "")
    items = [F.filter(F.transform(p, lambda x: F.trim(x)), lambda x: x != "") for p in parts]
    return F.array_join(F.array_distinct(F.concat(words, *items)), " ")


def route_context(intent: Column, query: Column, names: Column, missing: Column) -> Column:
    """struct(semantic_query, expanded_query, terms, predicates) that the routes of a request search with."""
    terms = by_intent(intent, TERMS, OTHER_TERMS)
    return F.struct(compose_query(query, names, terms).alias("semantic_query"), compose_query(query, names, missing, by_intent(intent, TERMS, RETRY_TERMS)).alias("expanded_query"), terms.alias("terms"), by_intent(intent, PREDICATES, OTHER_PREDICATES).alias("predicates"))


def merge_names(old: Column, new: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(old, new), lambda x: F.trim(x)), lambda x: x != ""))


def start(requests: DataFrame) -> DataFrame:
    """The state of requests (intent, query, entities, planned) before the first step."""
    none, scores = strings(), F.array().cast("array<double>")
    empty = {"executed": none, "fallbacks": none, "next_route": F.lit(""), "steps": F.lit(0), "semantic_retries": F.lit(0), "semantic": scores, "relation_texts": none, "relation_scores": scores, "sql_rows": F.lit(0), "reason": F.lit(""), "discovered": none, "errors": none, "decision": F.lit("")}
    return requests.withColumns(empty)


def step(states: DataFrame) -> DataFrame:
    """One step: cleans the plan, adds routes that the intent, new entities, uncovered entities or a failure ask for,
    judges, and takes the next route or ends in rerank, answer or clarify. Ended rows stay as they are."""
    c = F.col
    going = ~c("next_route").isin(*ENDS)
    s = states.withColumn("_steps", c("steps") + 1).withColumn("_p", clean_routes(c("planned")))
    s = s.withColumn("_missing", missing_routes(c("intent"), c("_p"), c("executed"))).withColumn("_p", F.concat("_missing", "_p"))
    found = (c("next_route") == "semantic") & (F.size("discovered") > 0)
    adds = found & ~F.array_contains(F.concat("executed", "_p"), "relation")
    s = s.withColumn("_found", found).withColumn("_adds", adds).withColumn("_p", F.when(c("_adds"), F.concat(strings("relation"), "_p")).otherwise(c("_p")))
    gap = (c("next_route") == "relation") & (F.size("entities") > 0) & (F.round(coverage(c("entities"), c("relation_texts")), 9) < COVERAGE)
    again = F.array_contains(F.concat("executed", "_p"), "semantic")
    s = s.withColumn("_again", gap & again & (c("semantic_retries") < 1)).withColumn("_gap", (gap & ~again) | c("_again")).withColumn("_p", F.when(c("_gap"), F.concat(strings("semantic"), "_p")).otherwise(c("_p")))
    empty = F.when(c("next_route") == "semantic", F.size("semantic") == 0).when(c("next_route") == "relation", F.size("relation_texts") == 0).when(c("next_route") == "text2sql", c("sql_rows") == 0).otherwise(False)
    failed = empty & (F.size("executed") > 0) & (F.get("executed", F.size("executed") - 1) == c("next_route"))
    s = s.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    s = s.withColumn("_fallback", F.when(c("_failed"), fallback_route(c("next_route"), c("reason"), F.concat("executed", "_p", "fallbacks"))))
    s = s.withColumn("_p", F.when(c("_fallback").isNotNull(), F.concat(F.array("_fallback"), "_p")).otherwise(c("_p")))
    any_found = (F.size("semantic") > 0) | (F.size("relation_texts") > 0) | (c("sql_rows") > 0)
    none_left = F.size("_p") == 0
    early = sufficient(c("semantic")) & ~none_left & ~c("intent").isin(*HIGH_RISK) & F.array_contains("executed", "semantic")
    decision = (
        F.when(c("_steps") > MAX_STEPS, "max_router_steps_exceeded")
        .when(early, "semantic_evidence_sufficient")
        .when(none_left & ~any_found & c("intent").isin(*HIGH_RISK), "high_risk_no_evidence")
        .when(none_left & ~any_found, "no_evidence_degraded_answer")
        .when(none_left & low_quality(c("semantic"), c("relation_scores"), c("sql_rows")), "low_quality_evidence_degraded_answer")
        .when(none_left, "ready_for_rerank")
        .otherwise("continue_routing")
    )
    s = s.withColumn("_decision", decision).withColumn("_any", any_found)
    s = s.withColumn("_p", F.when(c("_decision").isin("max_router_steps_exceeded", "semantic_evidence_sufficient"), strings()).otherwise(c("_p")))
    end = F.when(~c("_any") & c("intent").isin("profile_management", "content_save"), "answer").otherwise("rerank")
    s = s.withColumn("_next", F.when(c("_decision") == "high_risk_no_evidence", "clarify").when(F.size("_p") > 0, F.get("_p", 0)).otherwise(end))
    goes = c("_next").isin(*ROUTES)
    said = F.array_compact(
        F.array(
            F.when(F.size(unknown_routes(c("planned"))) > 0, "invalid_route_filtered"),
            F.when(F.size("_missing") > 0, "intent_route_enforced"),
            F.when(c("_adds") | c("_gap"), "dynamic_route_added"),
            F.when(c("_failed"), "route_failed_or_empty"),
            F.when(c("_decision") == "max_router_steps_exceeded", c("_decision")).when(c("_decision") == "semantic_evidence_sufficient", "early_converged"),
        )
    )
    new = {
        "planned": F.when(goes, F.slice("_p", 2, 99)).otherwise(c("_p")),
        "executed": F.when(goes, F.concat("executed", F.array("_next"))).otherwise(c("executed")),
        "fallbacks": F.when(c("_fallback").isNotNull(), F.concat("fallbacks", F.array("_fallback"))).otherwise(c("fallbacks")),
        "entities": F.when(c("_found"), merge_names(c("entities"), c("discovered"))).otherwise(c("entities")),
        "errors": F.concat("errors", said),
        "semantic_retries": F.when(c("_again"), c("semantic_retries") + 1).otherwise(c("semantic_retries")),
        "decision": c("_decision"),
        "steps": c("_steps"),
        "next_route": c("_next"),
    }
    out = s.withColumns({k: F.when(going, v).otherwise(c(k)) for k, v in new.items()})
    return out.select(*states.columns)


def _whole(states: DataFrame) -> DataFrame:
    return states


def run(requests: DataFrame, retrieve: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame] = _whole) -> DataFrame:
    """Steps requests until all have ended. retrieve sets the evidence columns of the rows whose next_route it serves;
    it is a projection or a join by the key of requests. Every row ends within MAX_STEPS + 1 steps. cut ends the lineage
    of each step's states, by checkpoint() or a written table: give it where retrieve joins, or where the result is
    filtered or joined, so that the optimiser need not look through all steps at once. Where it is given, the steps that
    would find all rows ended aren't made."""
    states = start(requests)
    for _ in range(MAX_STEPS + 1):
        states = cut(step(states))
        if cut is not _whole and not states.where(~F.col("next_route").isin(*ENDS)).limit(1).count():
            return states
        states = retrieve(states)
    return cut(states)


def envelope(requests: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, semantic, relation, text2sql: struct(status, count) of what each route found: success, empty or error. found
    has key, route and error (null if none); requests without rows get empty."""
    counts = found.groupBy(key).agg(*(F.count_if((F.col("route") == r) & F.col("error").isNull()).alias(f"_n_{r}") for r in ROUTES), *(F.max(F.when(F.col("route") == r, F.col("error"))).alias(f"_e_{r}") for r in ROUTES))
    j = requests.select(key).join(counts, key, "left")
    return j.select(key, *(F.struct(F.when(F.col(f"_e_{r}").isNotNull(), "error").when(F.coalesce(f"_n_{r}", F.lit(0)) > 0, "success").otherwise("empty").alias("status"), F.when(F.col(f"_e_{r}").isNotNull(), 0).otherwise(F.coalesce(f"_n_{r}", F.lit(0))).cast("long").alias("count")).alias(r) for r in ROUTES))
