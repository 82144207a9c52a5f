"""Queries of the planner and the router over the requests, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import routing as R
from ..sources.samples import REQUESTS_SQL, requests, sql_list, sql_text

#: what a model may have planned: the planner and the router get one of each by the request's number
INTENTS = ("disease_diet", "safety_check", "nutrition_filter", "recipe_instruction", "general", "diet_advice", "profile_management", "bogus")
PLANS = ((), ("semantic",), ("relation", "semantic"), ("text2sql", "bogus"), ("semantic", "semantic", "relation"), ("text2sql", "semantic"))
DONE = ((), ("semantic",), ("relation",), ("text2sql",), ("semantic", "relation"))
PREDICTED = (*P.INTENTS, "bogus")


def _of(options, n, cast="array<string>"):
    cols = F.array(*(P.strings(*o) if isinstance(o, tuple) else F.lit(o) for o in options))
    return F.element_at(cols, (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def _sql_of(options, n) -> str:
    return "[" + ", ".join(f"{sql_list(o)}::varchar[]" if isinstance(o, tuple) else sql_text(o) for o in options) + f"][({n}) % {len(options)} + 1]"


def _joined(c):
    return F.array_join(c, ",")


def c7_c8_content_class(spark: SparkSession, sf: str) -> DataFrame:
    explicit = F.when(F.col("n") % 10 == 0, "food_log").when(F.col("n") % 10 == 1, "other")
    r = requests(spark, sf).withColumn("c", P.content_class(F.col("query"), explicit))
    return r.select("request_id", "c.*", P.asks_to_save(F.col("query")).alias("asks_to_save"))


def c9_strong_rules(spark: SparkSession, sf: str) -> DataFrame:
    r = requests(spark, sf).withColumn("e", P.entities(F.col("query"))).withColumn("c", P.content_class(F.col("query")))
    r = r.withColumn("p", P.strong_rule(F.col("query"), F.col("e"), F.col("c"))).where("p is not null")
    return r.select("request_id", "p.intent", "p.confidence", _joined(F.col("p.routes")).alias("routes"), "p.has_profile_signal")


def c10_c14_entities(spark: SparkSession, sf: str) -> DataFrame:
    e = F.transform(P.entities(F.col("query")), lambda x: F.concat(x["name"], F.lit(":"), x["type"]))
    return requests(spark, sf).select("request_id", _joined(e).alias("entities"), _joined(P.constraints(F.col("query"))).alias("constraints"))


def c11_c13_checked_plan(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    r = requests(spark, sf).withColumn("e", F.when(n % 3 == 0, F.array().cast("array<struct<name:string,type:string>>")).otherwise(P.entities(F.col("query"))))
    r = r.withColumns({"i": _of(PREDICTED, F.floor(n / 24)), "r": _of(PLANS, F.floor(n / 7)), "k": (n % 14) / 10.0 - 0.2, "a": n % 11 == 0, "t": F.when(n % 22 == 0, "which?").otherwise(""), "s": n % 13 == 0})
    p = P.checked_plans(r, "query", "e", "i", "r", "k", "a", "t", "s")
    return p.select("request_id", "intent", _joined(F.col("routes")).alias("routes"), "clarification_needed", "clarification_question", "has_profile_signal")


def c12_fallback_plan(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).withColumn("p", P.fallback_plan(F.col("query"))).select("request_id", "p.intent", "p.confidence", _joined(F.col("p.routes")).alias("routes"), "p.has_profile_signal")


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    return requests(spark, sf).select("request_id", "n", "query", _of(INTENTS, n).alias("intent"), F.transform(P.entities(F.col("query")), lambda x: x["name"]).alias("entities"), _of(PLANS, F.floor(n / 8)).alias("planned"))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """States in the middle of a run, their evidence derived from the request's number."""
    n = F.col("n")
    s = R.start(_planned(spark, sf)).withColumn("executed", _of(DONE, F.floor(n / 48))).withColumn("next_route", F.coalesce(F.get("executed", F.size("executed") - 1), F.lit("")))
    return _evidence(s.withColumn("steps", (F.floor(n / 5) % 8).cast("int")), done=True)


def _evidence(s: DataFrame, done: bool = False) -> DataFrame:
    n = F.col("n")
    has = (lambda r: F.array_contains("executed", r)) if done else (lambda r: F.col("next_route") == r)
    scores = F.transform(F.when(n % 17 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), n % 17)), lambda i: F.when((n + i) % 9 != 0, ((n * 7 + i * 13) % 100) / 100.0))
    texts = F.transform(F.slice("entities", 1, (n % 3).cast("int")), lambda x: F.concat(x, F.lit(" contains x")))
    new = {
        "semantic": F.when(has("semantic"), scores).otherwise(F.col("semantic")),
        "discovered": F.when(has("semantic") & (n % 3 == 0) & (n % 17 > 0), P.strings("番茄", "菠菜")).otherwise(F.col("discovered")),
        "relation_texts": F.when(has("relation"), texts).otherwise(F.col("relation_texts")),
        "relation_scores": F.when(has("relation"), F.transform(texts, lambda _: (n % 10) / 10.0)).otherwise(F.col("relation_scores")),
        "sql_rows": F.when(has("text2sql"), (n % 3).cast("int")).otherwise(F.col("sql_rows")),
        "reason": F.when(has("text2sql") & (n % 5 == 0), "schema_mismatch").otherwise(F.col("reason")),
    }
    return s.withColumns(new)


def f2_after_planner(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    return _planned(spark, sf).select("request_id", R.after_planner(F.col("intent"), F.col("planned"), n % 5 == 0, n % 2 == 0).alias("decision"))


def f4_f6_clean_routes(spark: SparkSession, sf: str) -> DataFrame:
    s = _states(spark, sf).withColumn("p", P.clean_routes(F.col("planned")))
    return s.select("request_id", _joined(F.col("p")).alias("cleaned"), _joined(R.unknown_routes(F.col("planned"))).alias("invalid"), _joined(R.missing_routes(F.col("intent"), F.col("p"), F.col("executed"))).alias("enforced"))


def f5_fallback_route(spark: SparkSession, sf: str) -> DataFrame:
    s = _states(spark, sf)
    return s.select("request_id", R.fallback_route(F.col("next_route"), F.col("reason"), F.concat("executed", "planned")).alias("fallback"))


def f7_f8_entity_gaps(spark: SparkSession, sf: str) -> DataFrame:
    s = _states(spark, sf)
    return s.select("request_id", _joined(R.covered(F.col("entities"), F.col("relation_texts"))).alias("covered"), F.round(R.coverage(F.col("entities"), F.col("relation_texts")), 6).alias("coverage"), _joined(R.merge_names(F.col("entities"), F.col("discovered"))).alias("merged"))


def f9_f10_f11_judgement(spark: SparkSession, sf: str) -> DataFrame:
    s = _states(spark, sf)
    n, null = F.col("n"), F.lit(None).cast("double")
    score = R.item_score(F.when(n % 5 == 0, 0.9), F.when(n % 5 == 1, 0.8), F.when(n % 5 == 2, 0.7), null, F.when(n % 5 == 3, (n % 20) / 10.0))
    return s.select("request_id", R.sufficient(F.col("semantic")).alias("sufficient"), R.low_quality(F.col("semantic"), F.col("relation_scores"), F.col("sql_rows")).alias("low_quality"), F.round(score, 6).alias("score"))


def f12_route_context(spark: SparkSession, sf: str) -> DataFrame:
    s = _states(spark, sf)
    missing = F.array_except(F.col("entities"), R.covered(F.col("entities"), F.col("relation_texts")))
    s = s.withColumn("c", R.route_context(F.col("intent"), F.col("query"), F.col("entities"), missing))
    return s.select("request_id", "c.semantic_query", "c.expanded_query", _joined(F.col("c.terms")).alias("terms"), _joined(F.col("c.predicates")).alias("predicates"))


def _state_columns(s: DataFrame) -> DataFrame:
    lists = ("entities", "planned", "executed", "fallbacks", "errors")
    return s.select("request_id", "next_route", "decision", "steps", "semantic_retries", *(_joined(F.col(x)).alias(x) for x in lists))


def f3_router_step(spark: SparkSession, sf: str) -> DataFrame:
    return _state_columns(R.step(_states(spark, sf)))


def f1_f14_router_run(spark: SparkSession, sf: str) -> DataFrame:
    return _state_columns(R.run(_planned(spark, sf), _evidence))


def f15_route_envelope(spark: SparkSession, sf: str) -> DataFrame:
    r = requests(spark, sf)
    found = r.where("n % 4 > 0").select("request_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") % 4)).alias("i"), "n")
    found = found.select("request_id", F.element_at(P.strings(*P.ROUTES), ((F.col("n") + F.col("i")) % 3 + 1).cast("int")).alias("route"), F.when((F.col("n") + F.col("i")) % 12 == 0, "boom").alias("error"))
    e = R.envelope(r, found, "request_id")
    return e.select("request_id", *(F.concat_ws(":", f"{x}.status", F.col(f"{x}.count").cast("string")).alias(x) for x in P.ROUTES))


def f16_initial_state(spark: SparkSession, sf: str) -> DataFrame:
    return _state_columns(R.start(_planned(spark, sf)))


def _any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_text(t)})" for t in terms) + ")"


def _match(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {sql_text(pattern)})"


def _times(col: str, term: str) -> str:
    return f"(length({col}) - length(replace({col}, {sql_text(term)}, ''))) // {len(term)}"


def _case(col: str, table: dict, other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in table.items()) + f" ELSE {other} END"


NAMES = [(n, t) for t, names in P.ENTITIES.items() for n in names]
FOUND = f"list_filter({sql_list(f'{n}:{t}' for n, t in NAMES)}, lambda x: contains(query, split_part(x, ':', 1)))"
FOUND_NAMES = f"list_filter({sql_list(n for n, _ in NAMES)}, lambda x: contains(query, x))"
SIGNALS = f"""{REQUESTS_SQL},
cs AS (SELECT *, {", ".join(f"5 * {_match('query', P.CONTENT_PATTERNS[k])}::int AS st_{k}, {' + '.join(_times('lower(query)', t.lower()) for t in terms)} AS kw_{k}" for k, terms in P.CONTENT_TERMS.items())} FROM requests),
ct AS (SELECT *, {' + '.join(f'st_{k} + kw_{k}' for k in P.CONTENT_TERMS)} AS total, greatest({", ".join(f"(st_{k} + kw_{k}) * 100 + (st_{k} > 0)::int * 10 + {9 - i}" for i, k in enumerate(P.CONTENT_TERMS))}) AS top FROM cs),
sig AS (SELECT request_id, user_id, n, query, CASE WHEN total > 0 THEN {sql_list(P.CONTENT_TERMS)}[10 - top % 10] END AS ctype, CASE WHEN total > 0 THEN round((top // 100) / total::double, 4) ELSE 0 END AS cconf, CASE WHEN total > 0 THEN top // 100 ELSE 0 END::bigint AS cscore,
 {_any('query', P.SAVE_TERMS)} OR {_any('lower(query)', P.SAVE_TERMS)} AS saves, {_any('query', P.DISEASES)} AS sick, {_match('query', P.NUMERIC)} AS number, {_match('query', P.NUMERIC)} AND ({_any('query', P.NUTRIENTS)} OR {_any('query', P.FILTER_TERMS)}) AS clear_number,
 {' OR '.join(_match('query', p) for p in P.PROFILE)} AS signal, ({' OR '.join(_match('query', p) for p in P.PROFILE)}) AND {_any('query', P.MANAGEMENT)} AS manages, {_any('query', P.RECIPE_TERMS)} AS recipe, {_any('query', P.SAFETY_TERMS)} AS safety,
 len({FOUND}) > 0 AS known, len(list_filter({FOUND}, lambda x: split_part(x, ':', 2) IN ('ingredient', 'dish'))) > 0 AS food FROM ct)"""
PLANNED = f"""{REQUESTS_SQL},
planned_requests AS (SELECT request_id, n, query, {_sql_of(INTENTS, 'n')} AS intent, {FOUND_NAMES} AS entities, {_sql_of(PLANS, 'n // 8')} AS planned FROM requests)"""
NONE, NUMBERS = "[]::varchar[]", "[]::double[]"
START = f"{NONE} AS executed, {NONE} AS fallbacks, '' AS next_route, 0 AS steps, 0 AS semantic_retries, {NUMBERS} AS semantic, {NONE} AS relation_texts, {NUMBERS} AS relation_scores, 0 AS sql_rows, '' AS reason, {NONE} AS discovered, {NONE} AS errors, '' AS decision"
COLUMNS = "request_id, n, query, intent, entities, planned, executed, fallbacks, next_route, steps, semantic_retries, semantic, relation_texts, relation_scores, sql_rows, reason, discovered, errors, decision"
SCORES = "list_transform(range(1, n % 17 + 1), lambda i: CASE WHEN (n + i) % 9 <> 0 THEN ((n * 7 + i * 13) % 100) / 100.0::double END)"
TEXTS = "list_transform(entities[1:n % 3], lambda x: x || ' contains x')"
V = sql_list(P.ROUTES)


def _sql_evidence(src: str, dst: str, done: bool = False) -> str:
    def has(r: str) -> str:
        return f"list_contains(executed, '{r}')" if done else f"next_route = '{r}'"

    return f"""{dst} AS (SELECT * REPLACE (CASE WHEN {has('semantic')} THEN {SCORES} ELSE semantic END AS semantic, CASE WHEN {has('semantic')} AND n % 3 = 0 AND n % 17 > 0 THEN ['番茄', '菠菜'] ELSE discovered END AS discovered,
 CASE WHEN {has('relation')} THEN {TEXTS} ELSE relation_texts END AS relation_texts, CASE WHEN {has('relation')} THEN list_transform({TEXTS}, lambda x: (n % 10) / 10.0::double) ELSE relation_scores END AS relation_scores,
 CASE WHEN {has('text2sql')} THEN (n % 3)::int ELSE sql_rows END AS sql_rows, CASE WHEN {has('text2sql')} AND n % 5 = 0 THEN 'schema_mismatch' ELSE reason END AS reason) FROM {src})"""


STATES = f"""{PLANNED},
st0 AS (SELECT *, {START} FROM planned_requests),
st1 AS (SELECT * REPLACE ({_sql_of(DONE, 'n // 48')} AS executed, coalesce({_sql_of(DONE, 'n // 48')}[-1], '') AS next_route, (n // 5 % 8)::int AS steps) FROM st0),
{_sql_evidence('st1', 'states', True)}"""
COVERED = "list_filter(entities, lambda x: len(list_filter(relation_texts, lambda t: contains(t, x))) > 0)"
ENTITIES_ONCE = "list_filter(entities, lambda x, i: list_position(entities, x) = i)"
COVER = f"len({COVERED}) / greatest(len({ENTITIES_ONCE}), 1)::double"
MERGED = "list_filter(list_concat(entities, discovered), lambda x, i: list_position(list_concat(entities, discovered), x) = i)"
KNOWN_SCORES = "list_filter(semantic[1:8], lambda x: x IS NOT NULL)"
ENOUGH = f"CASE WHEN len(semantic) >= 15 THEN true WHEN len(semantic) < 8 THEN false WHEN len({KNOWN_SCORES}) = 0 THEN len(semantic) >= 12 ELSE round(list_sum({KNOWN_SCORES}) / len({KNOWN_SCORES}), 9) >= 0.75 END"
LOW = "(len(semantic) + len(relation_scores) + sql_rows < 2 OR coalesce(list_max(list_filter(list_concat(semantic, relation_scores), lambda x: x IS NOT NULL)) < 0.45, false))"
REQUIRED = _case("intent", R.REQUIRED, NONE)


def _sql_fallback(blocked: str) -> str:
    return f"list_filter(CASE WHEN next_route = 'text2sql' AND reason = 'schema_mismatch' THEN ['relation', 'semantic'] WHEN next_route IN ('text2sql', 'relation') THEN ['semantic'] WHEN next_route = 'semantic' THEN ['relation'] ELSE {NONE} END, lambda r: NOT list_contains({blocked}, r))[1]"


def _sql_step(src: str, dst: str) -> str:
    d = dst
    return f"""{d}_a AS (SELECT *, next_route NOT IN ('rerank', 'answer', 'clarify') AS going, list_filter(planned, lambda r: list_contains({V}, r)) AS f0 FROM {src}),
{d}_b AS (SELECT *, list_filter(f0, lambda r, i: list_position(f0, r) = i) AS p0 FROM {d}_a),
{d}_c AS (SELECT *, list_filter({REQUIRED}, lambda r: NOT list_contains(list_concat(executed, p0), r)) AS miss FROM {d}_b),
{d}_d AS (SELECT *, list_concat(miss, p0) AS p1, next_route = 'semantic' AND len(discovered) > 0 AS found FROM {d}_c),
{d}_e AS (SELECT *, found AND NOT list_contains(list_concat(executed, p1), 'relation') AS adds FROM {d}_d),
{d}_f AS (SELECT *, CASE WHEN adds THEN list_concat(['relation'], p1) ELSE p1 END AS p2, next_route = 'relation' AND len(entities) > 0 AND round({COVER}, 9) < 0.6 AS gap0 FROM {d}_e),
{d}_g AS (SELECT *, list_contains(list_concat(executed, p2), 'semantic') AS again0 FROM {d}_f),
{d}_h AS (SELECT *, gap0 AND again0 AND semantic_retries < 1 AS again, gap0 AND (NOT again0 OR semantic_retries < 1) AS gap FROM {d}_g),
{d}_i AS (SELECT *, CASE WHEN gap THEN list_concat(['semantic'], p2) ELSE p2 END AS p3, coalesce(CASE next_route WHEN 'semantic' THEN len(semantic) = 0 WHEN 'relation' THEN len(relation_texts) = 0 WHEN 'text2sql' THEN sql_rows = 0 ELSE false END AND len(executed) > 0 AND executed[-1] = next_route, false) AS failed FROM {d}_h),
{d}_j AS (SELECT *, CASE WHEN failed THEN {_sql_fallback('list_concat(list_concat(executed, p3), fallbacks)')} END AS fb FROM {d}_i),
{d}_k AS (SELECT *, CASE WHEN fb IS NOT NULL THEN list_concat([fb], p3) ELSE p3 END AS p4, len(semantic) > 0 OR len(relation_texts) > 0 OR sql_rows > 0 AS has FROM {d}_j),
{d}_l AS (SELECT *, CASE WHEN steps + 1 > 6 THEN 'max_router_steps_exceeded' WHEN {ENOUGH} AND len(p4) > 0 AND intent NOT IN ('disease_diet', 'safety_check') AND list_contains(executed, 'semantic') THEN 'semantic_evidence_sufficient'
 WHEN len(p4) = 0 AND NOT has AND intent IN ('disease_diet', 'safety_check') THEN 'high_risk_no_evidence' WHEN len(p4) = 0 AND NOT has THEN 'no_evidence_degraded_answer' WHEN len(p4) = 0 AND {LOW} THEN 'low_quality_evidence_degraded_answer' WHEN len(p4) = 0 THEN 'ready_for_rerank' ELSE 'continue_routing' END AS dec FROM {d}_k),
{d}_m AS (SELECT *, CASE WHEN dec IN ('max_router_steps_exceeded', 'semantic_evidence_sufficient') THEN {NONE} ELSE p4 END AS p5 FROM {d}_l),
{d}_n AS (SELECT *, CASE WHEN dec = 'high_risk_no_evidence' THEN 'clarify' WHEN len(p5) > 0 THEN p5[1] WHEN NOT has AND intent IN ('profile_management', 'content_save') THEN 'answer' ELSE 'rerank' END AS nx FROM {d}_m),
{d} AS (SELECT * EXCLUDE (going, f0, p0, miss, p1, found, adds, p2, gap0, again0, again, gap, p3, failed, fb, p4, has, dec, p5, nx) REPLACE (CASE WHEN NOT going THEN planned WHEN list_contains({V}, nx) THEN p5[2:] ELSE p5 END AS planned, CASE WHEN going AND list_contains({V}, nx) THEN list_concat(executed, [nx]) ELSE executed END AS executed,
 CASE WHEN going AND fb IS NOT NULL THEN list_concat(fallbacks, [fb]) ELSE fallbacks END AS fallbacks, CASE WHEN going AND found THEN {MERGED} ELSE entities END AS entities, CASE WHEN going AND again THEN semantic_retries + 1 ELSE semantic_retries END AS semantic_retries,
 CASE WHEN going THEN dec ELSE decision END AS decision, CASE WHEN going THEN steps + 1 ELSE steps END AS steps, CASE WHEN going THEN nx ELSE next_route END AS next_route,
 CASE WHEN going THEN list_concat(errors, list_filter([CASE WHEN len(f0) < len(planned) THEN 'invalid_route_filtered' END, CASE WHEN len(miss) > 0 THEN 'intent_route_enforced' END, CASE WHEN adds OR gap THEN 'dynamic_route_added' END, CASE WHEN failed THEN 'route_failed_or_empty' END, CASE dec WHEN 'max_router_steps_exceeded' THEN dec WHEN 'semantic_evidence_sufficient' THEN 'early_converged' END], lambda x: x IS NOT NULL)) ELSE errors END AS errors) FROM {d}_n)"""


def _csv(col: str, name: str | None = None) -> str:
    return f"coalesce(array_to_string({col}, ','), '') AS {name or col}"


STATE_OUT = "request_id, next_route, decision, steps, semantic_retries, " + ", ".join(map(_csv, ("entities", "planned", "executed", "fallbacks", "errors")))
RUN = ",\n".join(_sql_step(f"r{k}", f"q{k}") + ",\n" + _sql_evidence(f"q{k}", f"r{k + 1}") for k in range(R.MAX_STEPS + 1))
WORDS = "list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')"


def _compose(*parts: str) -> str:
    whole = WORDS
    for p in parts:
        whole = f"list_concat({whole}, {p})"
    return f"array_to_string(list_filter({whole}, lambda w, i: list_position({whole}, w) = i), ' ')"


ENSURE = "list_concat({r}, list_filter({x}, lambda y: NOT list_contains({r}, y)))"


def _ensure(r: str, *names: str) -> str:
    return ENSURE.format(r=r, x=sql_list(names))


ROUTE_CLEAN = f"list_filter(list_filter({{x}}, lambda r: list_contains({V}, r)), lambda r, i: list_position(list_filter({{x}}, lambda y: list_contains({V}, y)), r) = i)"
SQL = {
    "c7_c8_content_class": f"WITH {SIGNALS} SELECT request_id, CASE WHEN n % 10 = 0 THEN 'food_log' ELSE ctype END AS content_type, CASE WHEN n % 10 = 0 THEN 1.0 ELSE cconf END AS confidence, CASE WHEN n % 10 = 0 THEN 0 ELSE cscore END AS score, saves AS asks_to_save FROM sig",
    "c9_strong_rules": f"""WITH {SIGNALS}, i AS (SELECT *, CASE WHEN saves AND ctype IS NOT NULL THEN 'content_save' WHEN manages THEN 'profile_management' WHEN clear_number THEN 'nutrition_filter' WHEN sick AND (safety OR food) THEN 'disease_diet' WHEN recipe AND food THEN 'recipe_instruction' WHEN safety AND food THEN 'safety_check' END AS intent FROM sig)
SELECT request_id, intent, CASE intent WHEN 'content_save' THEN cconf WHEN 'profile_management' THEN 0.99 WHEN 'nutrition_filter' THEN 0.98 WHEN 'disease_diet' THEN 0.97 WHEN 'recipe_instruction' THEN 0.96 ELSE 0.95 END AS confidence, CASE WHEN intent IN ('content_save', 'profile_management') THEN '' WHEN intent = 'nutrition_filter' THEN 'text2sql' WHEN intent = 'recipe_instruction' THEN 'semantic' ELSE 'semantic,relation' END AS routes, CASE intent WHEN 'content_save' THEN false WHEN 'profile_management' THEN true ELSE signal END AS has_profile_signal FROM i WHERE intent IS NOT NULL""",
    "c10_c14_entities": f"WITH {REQUESTS_SQL} SELECT request_id, {_csv(FOUND, 'entities')}, concat_ws(',', {', '.join(f'''CASE WHEN {_any('lower(query)', t)} THEN '{k}' END''' for k, t in P.CONSTRAINTS.items())}, CASE WHEN {_any('query', P.STRUCTURED)} OR {_any('lower(query)', P.STRUCTURED)} THEN 'structured_query' END) AS constraints FROM requests",
    "c11_c13_checked_plan": f"""WITH {SIGNALS}, a AS (SELECT *, {_sql_of(PREDICTED, 'n // 24')} AS i0, {ROUTE_CLEAN.format(x=_sql_of(PLANS, 'n // 7'))} AS r0, n % 3 <> 0 AND known AS named FROM sig),
b AS (SELECT *, CASE WHEN i0 = 'bogus' THEN 'general' ELSE i0 END AS i1 FROM a),
c AS (SELECT *, CASE WHEN sick AND i1 IN ('general', 'diet_advice', 'nutrition_fact') THEN 'disease_diet' ELSE i1 END AS i2, CASE WHEN sick THEN {_ensure('r0', 'semantic', 'relation')} ELSE r0 END AS r1 FROM b),
d AS (SELECT *, CASE WHEN number AND i2 IN ('general', 'nutrition_fact') THEN 'nutrition_filter' ELSE i2 END AS i3, CASE WHEN number THEN {_ensure('r1', 'text2sql')} ELSE r1 END AS r2 FROM c),
e AS (SELECT *, CASE WHEN recipe AND i3 IN ('general', 'recipe_recommend') THEN 'recipe_instruction' ELSE i3 END AS i4, CASE WHEN recipe THEN {_ensure('r2', 'semantic')} ELSE r2 END AS r3 FROM d),
f AS (SELECT *, CASE WHEN manages THEN 'profile_management' ELSE i4 END AS i5, CASE WHEN manages THEN {NONE} ELSE r3 END AS r4 FROM e),
g AS (SELECT *, CASE WHEN safety AND i5 NOT IN ('disease_diet', 'profile_management') THEN 'safety_check' ELSE i5 END AS i6, CASE WHEN safety AND i5 NOT IN ('disease_diet', 'profile_management') THEN {_ensure('r4', 'semantic', 'relation')} ELSE r4 END AS r5 FROM f),
h AS (SELECT *, CASE WHEN len(r5) = 0 AND i6 NOT IN ('profile_management', 'content_save', 'general') THEN ['semantic'] ELSE r5 END AS r6, NOT named AND (i6 IN ('nutrition_fact', 'nutrition_compare', 'nutrition_filter', 'safety_check') OR {_match('query', P.UNNAMED)}) AS unclear FROM g),
k AS (SELECT *, NOT unclear AND greatest(0, least(1, (n % 14) / 10.0::double - 0.2::double)) < 0.65 AND NOT (sick OR clear_number OR manages OR (recipe AND known) OR (safety AND known)) AND i6 NOT IN ('profile_management', 'content_save') AS unsure, CASE WHEN n % 22 = 0 THEN 'which?' ELSE '' END AS q0 FROM h)
SELECT request_id, i6 AS intent, {_csv('r6', 'routes')}, n % 11 = 0 OR unclear OR unsure AS clarification_needed, CASE WHEN unclear THEN coalesce(nullif(q0, ''), CASE i6 WHEN 'safety_check' THEN {sql_text(P.ASK['safety_check'])} WHEN 'nutrition_filter' THEN {sql_text(P.ASK['nutrition_filter'])} ELSE {sql_text(P.ASK_OTHER)} END) WHEN unsure THEN {sql_text(P.ASK_UNSURE)} ELSE q0 END AS clarification_question, n % 13 = 0 OR signal AS has_profile_signal FROM k""",
    "c12_fallback_plan": f"WITH {SIGNALS}, i AS (SELECT *, CASE WHEN manages THEN 'profile_management' WHEN sick THEN 'disease_diet' WHEN number THEN 'nutrition_filter' WHEN recipe THEN 'recipe_instruction' WHEN safety THEN 'safety_check' ELSE 'general' END AS intent FROM sig) SELECT request_id, intent, 0.55::double AS confidence, CASE WHEN intent = 'profile_management' THEN '' WHEN intent IN ('disease_diet', 'safety_check') THEN 'semantic,relation' WHEN intent = 'nutrition_filter' THEN 'text2sql' ELSE 'semantic' END AS routes, signal AS has_profile_signal FROM i",
    "f2_after_planner": f"WITH {PLANNED} SELECT request_id, CASE WHEN n % 5 = 0 THEN 'clarify' WHEN intent = 'profile_management' AND n % 2 = 0 AND len(planned) = 0 THEN 'confirm' ELSE 'dispatch' END AS decision FROM planned_requests",
    "f4_f6_clean_routes": f"WITH {STATES}, c AS (SELECT *, {ROUTE_CLEAN.format(x='planned')} AS p FROM states) SELECT request_id, {_csv('p', 'cleaned')}, {_csv(f'list_filter(planned, lambda r: NOT list_contains({V}, r))', 'invalid')}, {_csv(f'list_filter({REQUIRED}, lambda r: NOT list_contains(list_concat(executed, p), r))', 'enforced')} FROM c",
    "f5_fallback_route": f"WITH {STATES} SELECT request_id, {_sql_fallback('list_concat(executed, planned)')} AS fallback FROM states",
    "f7_f8_entity_gaps": f"WITH {STATES} SELECT request_id, {_csv(COVERED, 'covered')}, round({COVER}, 6) AS coverage, {_csv(MERGED, 'merged')} FROM states",
    "f9_f10_f11_judgement": f"WITH {STATES} SELECT request_id, {ENOUGH} AS sufficient, {LOW} AS low_quality, round(CASE n % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 WHEN 3 THEN greatest(0, 1 - (n % 20) / 10.0::double) END, 6) AS score FROM states",
    "f12_route_context": f"WITH {STATES} SELECT request_id, {_compose('entities', _case('intent', R.TERMS, sql_list(R.OTHER_TERMS)))} AS semantic_query, {_compose('entities', f'list_filter(entities, lambda x: NOT list_contains({COVERED}, x))', _case('intent', R.TERMS, sql_list(R.RETRY_TERMS)))} AS expanded_query, {_csv(_case('intent', R.TERMS, sql_list(R.OTHER_TERMS)), 'terms')}, {_csv(_case('intent', R.PREDICATES, sql_list(R.OTHER_PREDICATES)), 'predicates')} FROM states",
    "f3_router_step": f"WITH {STATES}, {_sql_step('states', 'q')} SELECT {STATE_OUT} FROM q",
    "f1_f14_router_run": f"WITH {PLANNED}, r0 AS (SELECT *, {START} FROM planned_requests), {RUN} SELECT {STATE_OUT} FROM r{R.MAX_STEPS + 1}",
    "f15_route_envelope": f"WITH {REQUESTS_SQL}, f AS (SELECT request_id, n, unnest(range(1, n % 4 + 1)) AS i FROM requests), g AS (SELECT request_id, {V}[(n + i) % 3 + 1] AS route, CASE WHEN (n + i) % 12 = 0 THEN 'boom' END AS error FROM f), c AS (SELECT request_id, route, count(*) FILTER (WHERE error IS NULL) AS k, max(error) AS e FROM g GROUP BY ALL), x AS (SELECT r.request_id, v.route, CASE WHEN c.e IS NOT NULL THEN 'error:0' WHEN coalesce(c.k, 0) > 0 THEN 'success:' || c.k ELSE 'empty:0' END AS s FROM requests r CROSS JOIN (SELECT unnest({V}) AS route) v LEFT JOIN c ON c.request_id = r.request_id AND c.route = v.route) SELECT request_id, max(s) FILTER (WHERE route = 'semantic') AS semantic, max(s) FILTER (WHERE route = 'relation') AS relation, max(s) FILTER (WHERE route = 'text2sql') AS text2sql FROM x GROUP BY 1",
    "f16_initial_state": f"WITH {PLANNED}, r0 AS (SELECT *, {START} FROM planned_requests) SELECT {STATE_OUT} FROM r0",
}
QUERIES = {f.__name__: f for f in (c7_c8_content_class, c9_strong_rules, c10_c14_entities, c11_c13_checked_plan, c12_fallback_plan, f2_after_planner, f4_f6_clean_routes, f5_fallback_route, f7_f8_entity_gaps, f9_f10_f11_judgement, f12_route_context, f3_router_step, f1_f14_router_run, f15_route_envelope, f16_initial_state)}
