"""Memory of conversations (tiers, summaries, context, retention), of answers and of users' profiles. Each conversation
is one window partition; turns are short rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from . import vector_index
from .imports import with_ids
from .planning import any_of
from .text import token_count


def tiers(turns: DataFrame, session: str, order: list[str], hot: int = 30, warm: int = 120) -> DataFrame:
    """Adds tier: the newest `hot` turns of a session, the `warm` before them, and the rest as cold."""
    r = F.row_number().over(Window.partitionBy(session).orderBy(*(F.desc(c) for c in order)))
    return turns.withColumn("_r", r).withColumn("tier", F.when(F.col("_r") <= hot, "hot").when(F.col("_r") <= hot + warm, "warm").otherwise("cold")).drop("_r")


def _line(role: str, text: str, most: int | None = None) -> Column:
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \t\n\r]+", " ")
    return F.concat(F.col(role), F.lit(": "), whole if most is None else F.substring(whole, 1, most))


def tail_within(lines: DataFrame, session: str, order: list[str], line: str, budget: int) -> DataFrame:
    """The last lines of each session whose tokens, summed from the end, stay within budget; the last one always."""
    w = Window.partitionBy(session).orderBy(*(F.desc(c) for c in order))
    kept = lines.withColumn("_sum", F.sum(token_count(F.col(line))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(w))
    return kept.where((F.col("_sum") <= budget) | (F.col("_r") == 1)).drop("_sum", "_r")


def _joined(lines: DataFrame, session: str, order: list[str], line: str, out: str) -> DataFrame:
    at = F.array_sort(F.collect_list(F.struct(*order, line)))
    return lines.groupBy(session).agg(F.array_join(F.transform(at, lambda x: x[line]), "\n").alias(out))


def context(turns: DataFrame, session: str, order: list[str], role: str, text: str, hot: int = 30, warm: int = 120, budget: int = 3000) -> DataFrame:
    """session, context: warm turns cut to 240 characters and trimmed to max(400, budget / 3) tokens, then the hot ones
    trimmed to budget; the collected lines are bounded by hot and budget."""
    t = tiers(turns, session, order, hot, warm)
    w = tail_within(t.where("tier = 'warm'").withColumn("_line", _line(role, text, 240)), session, order, "_line", max(400, budget // 3))
    h = tail_within(t.where("tier = 'hot'").withColumn("_line", _line(role, text)), session, order, "_line", budget)
    both = _joined(h, session, order, "_line", "_hot").join(_joined(w, session, order, "_line", "_warm"), session, "left")
    return both.select(session, F.concat_ws("\n", "_warm", "_hot").alias("context"))


def retain(turns: DataFrame, session: str, order: list[str], cap: int = 2000) -> DataFrame:
    """turns with tier: of each session that has more than cap turns, the oldest cold ones go until cap is met."""
    n = F.count("*").over(Window.partitionBy(session))
    r = F.row_number().over(Window.partitionBy(session, "tier").orderBy(*order))
    return turns.withColumn("_n", n).withColumn("_r", r).where((F.col("tier") != "cold") | (F.col("_r") > F.col("_n") - cap)).drop("_n", "_r")


def archive(turns: DataFrame, now: Column) -> DataFrame:
    """turns with tier and archived_at: cold turns keep the time when they were first archived, or get now; the others
    have none."""
    return turns.withColumn("archived_at", F.when(F.col("tier") == "cold", F.coalesce("archived_at", now)))


def hot_context(turns: DataFrame, session: str, order: list[str], limit: int = 30) -> DataFrame:
    """The last `limit` hot turns of each session, with place: 1 for the oldest of them."""
    newest = F.row_number().over(Window.partitionBy(session).orderBy(*(F.desc(c) for c in order)))
    kept = turns.where("tier = 'hot'").withColumn("_r", newest).where(F.col("_r") <= limit).drop("_r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def said(role: Column, text: Column, most: int | None = None) -> Column:
    """A turn as a line: who spoke, then its text; with most, on one line and cut to that many characters."""
    who = F.when(role == "user", "用户").otherwise("助手")
    t = F.coalesce(text, F.lit(""))
    if most is not None:
        t = F.substring(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^ | $", ""), 1, most)
    return F.concat(who, F.lit(": "), t)


def tokens_of(text: Column) -> Column:
    """Estimated tokens, one at least."""
    return F.greatest(token_count(text), F.lit(1))


def trimmed(text: Column, budget: int) -> Column:
    """text if its tokens are within budget; else its last lines that are, the last one always. Within the row: sums from
    the end are made in one fold over the lines."""
    lines = F.reverse(F.split(text, "\n", -1))
    state = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(False).alias("full")),
        lambda s, x: F.when(s["full"] | ((s["n"] > 0) & (s["sum"] + tokens_of(x) > budget)), F.struct(s["n"].alias("n"), s["sum"].alias("sum"), F.lit(True).alias("full"))).otherwise(F.struct((s["n"] + 1).alias("n"), (s["sum"] + tokens_of(x)).alias("sum"), F.lit(False).alias("full"))),
    )
    kept = F.array_join(F.reverse(F.slice(lines, F.lit(1), state["n"])), "\n")
    return F.when(tokens_of(text) <= budget, text).otherwise(kept)


def summarise(turns: DataFrame, session: str, order: str, role: str, text: str, budget: int = 3000) -> DataFrame:
    """session, summary, source_start, source_end, n_messages, n_tokens of the warm turns of each session: lines of 240
    characters, trimmed to max(400, budget / 3) tokens."""
    line = F.struct(F.col(order).alias("o"), said(F.col(role), F.col(text), 240).alias("l"))
    s = turns.where("tier = 'warm'").groupBy(session).agg(F.array_sort(F.collect_list(line)).alias("_l"), F.min(order).alias("source_start"), F.max(order).alias("source_end"), F.count("*").alias("n_messages"))
    s = s.withColumn("summary", trimmed(F.array_join(F.transform("_l", lambda x: x["l"]), "\n"), max(400, budget // 3)))
    return s.select(session, "summary", "source_start", "source_end", "n_messages", tokens_of(F.col("summary")).alias("n_tokens"))


def refresh(turns: DataFrame, summaries: DataFrame, session: str, order: str, role: str, text: str, batch: int = 10, budget: int = 3000) -> DataFrame:
    """The summaries after new turns: (session, summary, source_start, source_end, n_messages, n_tokens, pending,
    version). A session without a summary, or with `batch` warm turns outside its range, gets a new one; another keeps
    its own with the number of those pending; one without warm turns loses it."""
    warm = turns.where("tier = 'warm'").join(summaries.select(session, F.col("source_start").alias("_a"), F.col("source_end").alias("_b")), session, "left")
    outside = ~F.coalesce(F.col(order).between(F.col("_a"), F.col("_b")), F.lit(False))
    changed = warm.groupBy(session).agg(F.count_if(outside).alias("_n"))
    new = summarise(turns, session, order, role, text, budget)
    old = summaries.select(session, *(F.col(c).alias(f"_{c}") for c in ("summary", "source_start", "source_end", "n_messages", "n_tokens", "version")))
    j = new.join(changed, session).join(old, session, "left")
    makes = F.col("_version").isNull() | (F.col("_n") >= batch)
    kept = [F.when(makes, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("summary", "source_start", "source_end", "n_messages", "n_tokens")]
    return j.select(session, *kept, F.when(makes, 0).otherwise(F.col("_n")).cast("long").alias("pending"), F.when(makes, F.coalesce("_version", F.lit(0)) + 1).otherwise(F.col("_version")).cast("long").alias("version"))


def pending(turns: DataFrame, summaries: DataFrame, session: str, order: str) -> DataFrame:
    """Warm turns after the range of their session's summary; none where there is no summary."""
    return turns.where("tier = 'warm'").join(summaries.select(session, F.col("source_end").alias("_end")), session).where(F.col(order) > F.col("_end")).drop("_end")


def full_context(turns: DataFrame, summaries: DataFrame, session: str, order: str, role: str, text: str, limit: int = 30, budget: int = 3000) -> DataFrame:
    """session, context: the summary, the warm turns after it and the last hot turns, trimmed to budget."""

    def joined(rows: DataFrame, name: str) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said(F.col(role), F.col(text)).alias("l"))))
        return rows.groupBy(session).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias(name))

    hot = joined(hot_context(turns, session, [order], limit), "_hot")
    late = joined(pending(turns, summaries, session, order), "_late")
    j = hot.join(summaries.select(session, "summary"), session, "left").join(late, session, "left")
    whole = F.concat_ws("\n\n", F.concat(F.lit("温层历史摘要:\n"), F.nullif("summary", F.lit(""))), F.concat(F.lit("尚未归入温层摘要的较早对话:\n"), "_late"), F.concat(F.lit("最近对话:\n"), "_hot"))
    return j.select(session, trimmed(whole, budget).alias("context"))


def expire(turns: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """turns without the cold ones that were archived more than `days` days before now."""
    gone = (F.col("tier") == "cold") & (F.col("archived_at") < now - F.make_dt_interval(F.lit(days)))
    return turns.where(~F.coalesce(gone, F.lit(False)))


def without_session(turns: DataFrame, session: str, value) -> DataFrame:
    """turns, or summaries, without those of a session."""
    return turns.where(~F.col(session).eqNullSafe(F.lit(value)))


def add_turns(turns: DataFrame, new: DataFrame, session: str, order: list[str], now: Column, hot: int = 30, warm: int = 120, cap: int = 2000, days: int = 180) -> DataFrame:
    """turns (with tier and archived_at) after new ones came: tiers, archive times and retention in turn."""
    both = turns.drop("tier").unionByName(new, allowMissingColumns=True)
    return retain(expire(archive(tiers(both, session, order, hot, warm), now), now, days), session, order, cap)


# fixed values: intents whose answers may, or must not, be used again, words of answers that failed, limits
SAFE_INTENTS, UNSAFE_INTENTS = ("nutrition_info", "ingredient_knowledge", "recipe_recommend", "general"), ("disease_diet", "diet_advice")
FAILED = ("抱歉", "生成遇到问题", "图片分析失败", "信息不足", "无法回答", "不知道")
CONTEXT_FROM, SAME_FROM, REUSE_FROM, LEAST_QUALITY, LEAST_CHARS, MOST_CITATIONS = 0.82, 0.92, 0.94, 0.65, 80, 20


def quality(answer: Column, citations: Column, tags: Column, evidence: Column) -> Column:
    """struct(score, reasons) of an answer: is it worth keeping? citations and tags are arrays, evidence a number."""
    a = F.coalesce(answer, F.lit(""))
    n, long = F.size(citations), F.length(F.regexp_replace(a, r"^\s+|\s+$", "")) >= LEAST_CHARS
    specific = ~F.coalesce(F.get(tags, 0), F.lit("")).isin("", "general")
    failed, unsafe = any_of(a, FAILED), F.arrays_overlap(tags, F.array(*map(F.lit, UNSAFE_INTENTS)))
    parts = [F.when(n > 0, F.least(F.lit(0.35), 0.2 + 0.05 * n)), F.when(long, 0.25).otherwise(-0.2), F.when(evidence > 0, F.least(F.lit(0.15), evidence * 0.03)), F.when(specific, 0.1), F.when(failed, -0.4), F.when(unsafe, -0.05)]
    score = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    reasons = F.array_compact(F.array(F.when(n > 0, "has_citations").otherwise("no_citations"), F.when(long, "sufficient_length").otherwise("too_short"), F.when(evidence > 0, "has_evidence"), F.when(specific, "specific_intent"), F.when(failed, "low_quality_phrase"), F.when(unsafe, "sensitive_intent")))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), reasons.alias("reasons"))


def safe_to_reuse(intent: Column) -> Column:
    return F.coalesce(intent.isin(*SAFE_INTENTS) & ~intent.isin(*UNSAFE_INTENTS), F.lit(False))


def reuse_policy(score: Column, tags: Column) -> Column:
    """direct_reuse, context_only or ignore."""
    return F.when((score >= REUSE_FROM) & safe_to_reuse(F.get(tags, 0)), "direct_reuse").when(score >= CONTEXT_FROM, "context_only").otherwise("ignore")


def reusable(score: Column, tags: Column, intent: Column) -> Column:
    """Whether the answer may be given again as it is, for a question of an intent (null: that of the answer)."""
    return (score >= REUSE_FROM) & safe_to_reuse(F.coalesce(F.nullif(intent, F.lit("")), F.get(tags, 0)))


def merged_list(old: Column, new: Column) -> Column:
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))


def store_answers(entries: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """entries (id, question, answer, entities, tags, citations: arrays, quality, hits) with new ones, one for each new
    question. new: the same without id and hits, with new_id. matches: (new_id, id, similarity) of the most similar
    entries. A new answer whose quality is below 0.65 is dropped; one whose question is the same (0.92) as an entry's is
    merged into it: the better text, lists without repeats, 20 citations at most, one more hit; of several the best one's
    text, then the smallest new_id's. The rest are added with the ids after the largest."""
    good = new.where(F.col("quality") >= LEAST_QUALITY)
    best = matches.where(F.col("similarity") >= SAME_FROM).groupBy("new_id").agg(F.max_by("id", F.struct("similarity", -F.col("id"))).alias("id"))
    hit = good.join(best, "new_id")
    lists = ("entities", "tags", "citations")
    grouped = hit.groupBy("id").agg(F.max_by(F.struct("question", "answer", "quality"), F.struct("quality", -F.col("new_id"))).alias("_b"), F.count("*").alias("_k"), *(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("new_id", c))), lambda x: x[c])).alias(f"_{c}") for c in lists))
    j = entries.join(grouped, "id", "left")
    newer = F.coalesce(F.col("_b.quality") >= F.col("quality"), F.lit(False))
    old = {c: F.when(newer, F.col(f"_b.{c}")).otherwise(F.col(c)) for c in ("question", "answer", "quality")}
    merged = {c: F.when(F.col("_k") > 0, merged_list(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)) for c in lists}
    merged["citations"] = F.when(F.col("_k") > 0, F.slice(merged["citations"], 1, MOST_CITATIONS)).otherwise(F.col("citations"))
    kept = j.select("id", *((old | merged)[c].alias(c) for c in ("question", "answer", "entities", "tags", "citations", "quality")), (F.col("hits") + F.coalesce("_k", F.lit(0))).alias("hits"))
    last = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    added = with_ids(good.join(best, "new_id", "left_anti"), "new_id", "_id").crossJoin(F.broadcast(last))
    added = added.select((F.col("_id") + F.col("_last")).alias("id"), "question", "answer", "entities", "tags", "citations", "quality", F.lit(0).cast("long").alias("hits"))
    return kept.unionByName(added)


def founders(new: DataFrame, pairs: DataFrame) -> DataFrame:
    """new_id of the new questions that become entries if all come one after the other: those that no earlier such one
    equals. pairs: (new_id, earlier), questions that are the same. Decided in rounds: who has only merged earlier ones
    left is one, who has one of them isn't; a round for each step of the longest chain of decisions."""
    open_ = new.select("new_id")
    kept, edges = [], cut(pairs.select("new_id", "earlier"))
    while True:
        blocked = edges.select("new_id").distinct()
        found = cut(open_.join(blocked, "new_id", "left_anti"))
        kept.append(found)
        merged = edges.join(found.select(F.col("new_id").alias("earlier")), "earlier", "left_semi").select("new_id").distinct()
        left = cut(open_.join(found, "new_id", "left_anti").join(merged, "new_id", "left_anti"))
        # what was merged blocks nobody; what is a founder has merged those that it blocked
        edges = cut(edges.join(left, "new_id", "left_semi").join(left.select(F.col("new_id").alias("earlier")), "earlier", "left_semi"))
        open_ = left
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, kept)


def store_batch(entries: DataFrame, new: DataFrame, vectors: DataFrame, new_vectors: DataFrame, cells: int = 128) -> DataFrame:
    """store_answers() with its own search: new questions are compared with the entries' and with each other's, by the
    vectors (id, vector) and (new_id, vector), as if they came one after the other in order of new_id. A question goes to the
    most similar of the entries and of the earlier questions that became one (0.92; the entry, then the first, of equals);
    an entry keeps the vector of the question that it began with."""
    good = cut(new.where(F.col("quality") >= LEAST_QUALITY))
    mine = new_vectors.join(good.select("new_id"), "new_id", "left_semi").select((F.col("new_id") * 2 + 1).alias("key"), "vector")
    every = vectors.join(entries.select("id"), "id", "left_semi").select((F.col("id") * 2).alias("key"), "vector").unionByName(mine)
    found = vector_index.within(vector_index.build(every, "key", "vector", "cosine", cells), mine, "key", "vector", SAME_FROM)
    # of two new questions the later one is compared with the earlier
    same = cut(found.where("key % 2 = 0 or key < query").select(F.expr("query div 2").alias("new_id"), F.expr("key div 2").alias("other"), (F.col("key") % 2 == 1).alias("is_new"), F.col("value").alias("similarity")))
    stored = same.where("not is_new").select("new_id").distinct()
    free = good.join(stored, "new_id", "left_anti")
    earlier = same.where("is_new and other < new_id").join(stored, "new_id", "left_anti").join(stored.select(F.col("new_id").alias("other")), "other", "left_anti")
    begun = cut(founders(free, earlier.select("new_id", F.col("other").alias("earlier"))))
    last = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    first = with_ids(good.join(begun, "new_id", "left_semi"), "new_id", "_id").crossJoin(F.broadcast(last))
    first = cut(first.withColumn("id", (F.col("_id") + F.col("_last")).cast("long")).withColumn("hits", F.lit(0).cast("long")))
    targets = same.where("not is_new").select("new_id", F.col("other").alias("id"), "similarity")
    targets = targets.unionByName(same.where("is_new and other < new_id").join(first.select(F.col("new_id").alias("other"), "id"), "other").select("new_id", "id", "similarity"))
    rest = good.join(begun, "new_id", "left_anti")
    return store_answers(entries.unionByName(first.select(*entries.columns)), rest, targets.join(begun, "new_id", "left_anti"))


def count_hits(entries: DataFrame, found: DataFrame) -> DataFrame:
    """entries with a hit more for each row of found (id)."""
    n = found.groupBy("id").agg(F.count("*").alias("_n"))
    return entries.join(n, "id", "left").withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).drop("_n")


def rate(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """entries with the last rating (id, rating, seq) of each that has one."""
    r = ratings.groupBy("id").agg(F.max_by("rating", "seq").alias("_r"))
    return entries.join(r, "id", "left").withColumn("rating", F.coalesce("_r", "rating")).drop("_r")


def entries_found(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Whole entries of a search's result (id, similarity)."""
    return found.join(entries, "id")


# fixed values: the lists of a profile, their names in it, and words that confirm
FIELDS = {"allergies": "过敏源", "dietary_restrictions": "饮食限制", "health_goals": "健康目标", "favorite_ingredients": "偏好食材", "disliked_ingredients": "不喜欢的食材"}
KINDS = {"allergy": "allergies", "dietary_restriction": "dietary_restrictions", "health_goal": "health_goals", "favorite_ingredient": "favorite_ingredients", "disliked_ingredient": "disliked_ingredients"}
YES = ("是", "对", "嗯", "可以", "好", "保存", "确认", "是的", "对的", "好的", "可以呢", "嗯嗯")
NO_PROFILE = "暂无用户画像信息"


def profiles(log: DataFrame) -> DataFrame:
    """One row for each user of an append-only log (user_id, seq, field, key, value, op): op append adds a value to a
    list, op set replaces it by the value's parts between commas; field notes holds the last value; other fields are
    preferences, the last value of each key. Values have no white space around them, none is empty, each comes once."""
    v = F.trim(F.coalesce("value", F.lit("")))
    lists = log.where(F.col("field").isin(*FIELDS)).withColumn("_v", F.when(F.col("op") == "set", F.transform(F.split("value", ","), lambda x: F.trim(x))).otherwise(F.array(v)))
    since = lists.groupBy("user_id", "field").agg(F.max(F.when(F.col("op") == "set", F.col("seq"))).alias("_from"))
    now = lists.join(since, ["user_id", "field"]).where(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")))
    # first places of the values are found before any list is made, so a long log needn't fit in a row
    firsts = now.select("user_id", "field", "seq", F.posexplode("_v").alias("_i", "_x")).where("_x <> ''").groupBy("user_id", "field", "_x").agg(F.min(F.struct("seq", "_i")).alias("_at"))
    made = firsts.groupBy("user_id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("_at", "_x")))), lambda x: x["_x"]).alias(f) for f in FIELDS))
    last = log.where(~F.col("field").isin(*FIELDS)).groupBy("user_id", "field", F.when(F.col("field") == "preferences", F.col("key")).alias("_key")).agg(F.max_by("value", "seq").alias("_v"))
    other = last.groupBy("user_id").agg(F.max(F.when(F.col("field") == "notes", F.col("_v"))).alias("notes"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field") == "preferences", F.struct("_key", "_v"))))).alias("preferences"))
    out = log.select("user_id").distinct().join(made, "user_id", "left").join(other, "user_id", "left")
    return out.select("user_id", *(F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in FIELDS), F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("preferences", F.create_map().cast("map<string,string>")).alias("preferences"))


def profile_text() -> Column:
    """A profile as one line, from the columns of profiles()."""
    parts = [F.when(F.size(f) > 0, F.concat(F.lit(f"{name}："), F.array_join(f, "、"))) for f, name in FIELDS.items()]
    return F.coalesce(F.nullif(F.concat_ws("；", *parts, F.when(F.col("notes") != "", F.concat(F.lit("备注："), "notes"))), F.lit("")), F.lit(NO_PROFILE))


def ingredient_check(allergies: Column, ingredient: Column) -> Column:
    """struct(safe, reason, type): unsafe if the user is allergic to it. Restrictions name no ingredient, so they never
    match."""
    bad = F.coalesce(F.array_contains(allergies, ingredient), F.lit(False))
    return F.struct((~bad).alias("safe"), F.when(bad, F.concat(F.lit("过敏源: "), ingredient)).otherwise("").alias("reason"), F.when(bad, "allergy").alias("type"))


def short(answer: Column, most: int = 180) -> Column:
    """An answer on one line, cut to `most` characters with dots."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", " "), "^ | $", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), " $", ""), F.lit("...")))


def memory_prompt(history: Column, profile: Column, question: Column, answer: Column, similarity: Column, policy: Column, intent: Column) -> Column:
    """What an answer is told of a user: the last turns, the profile and an earlier answer, in full if it may be used
    again and its intent is safe, else in short."""
    direct = (policy == "direct_reuse") & ((F.coalesce(intent, F.lit("")) == "") | safe_to_reuse(intent))
    said_before = F.concat(F.lit("Q: "), question, F.lit("\n"), F.when(direct, F.concat(F.lit("A: "), answer)).otherwise(F.concat(F.lit("摘要: "), short(answer))), F.lit("\n相似度: "), F.format_string("%.3f", similarity))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("## 最近对话历史\n"), F.nullif(history, F.lit(""))),
        F.concat(F.lit("## 用户画像\n"), F.nullif(F.nullif(profile, F.lit(NO_PROFILE)), F.lit(""))),
        F.when(question.isNotNull(), F.concat(F.when(direct, "## 可强参考的历史问答\n").otherwise("## 仅供理解意图的历史问答\n"), said_before)),
    )


def confirmation(candidates: Column) -> Column:
    """struct(candidates, question): what is asked before lasting preferences are kept; null without any. candidates:
    array(struct(type, value, evidence)); temporary ones and those without a type or a value go."""
    lasting = F.filter(candidates, lambda c: (F.coalesce(c["type"], F.lit("")) != "") & (F.coalesce(c["value"], F.lit("")) != "") & (c["type"] != "temporary_preference"))
    names = {k: FIELDS[f] for k, f in KINDS.items()}

    def line(c: Column) -> Column:
        label = F.coalesce(*(F.when(c["type"] == k, v) for k, v in names.items()), c["type"])
        why = F.when(F.coalesce(c["evidence"], F.lit("")) != "", F.concat(F.lit("（根据："), c["evidence"], F.lit("）"))).otherwise("")
        return F.concat(F.lit("- "), label, F.lit("："), c["value"], why)

    asked = F.concat(F.lit("我注意到以下可能和您个人相关的信息：\n"), F.array_join(F.transform(lasting, line), "\n"), F.lit("\n\n是否将这些信息保存到您的个人档案？(是/否)"))
    return F.when(F.size(lasting) > 0, F.struct(lasting.alias("candidates"), asked.alias("question")))


def affirmative(reply: Column) -> Column:
    t = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", "")
    return reduce(or_, (F.startswith(t, F.lit(w)) for w in YES))


def confirmed_writes(pending: DataFrame, user: str, seq: str, candidates: str, reply: str) -> DataFrame:
    """Rows of the profile log (user_id, seq, field, key, value, op) for the candidates that a user has confirmed."""
    rows = pending.where(affirmative(F.col(reply))).select(F.col(user).alias("user_id"), F.col(seq).alias("seq"), F.explode(candidates).alias("_c"))
    field = F.coalesce(*(F.when(F.col("_c.type") == k, f) for k, f in KINDS.items()))
    return rows.select("user_id", "seq", field.alias("field"), F.lit(None).cast("string").alias("key"), F.col("_c.value").alias("value"), F.lit("append").alias("op")).where("field is not null")
