"""Chunks of a document by its category. Each chunker maps blocks to array(struct(chunk_type, content, label)) within
the row; label is the recipe's name, the table's class, the conditions and groups, the date or the user. Chunks of more
than 512 tokens are split by sentences, with folds over arrays of sentences in the row; the functions of one text
(sentences, split_by_similarity, split_by_clauses) give the same for strings."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_text, document_text, islands, let, strip, strip_variable, table_headers, table_rows, title
from .planning import any_of, strings
from .text import token_count

# fixed values: terms and patterns of the chunkers, sizes in tokens
RECIPE_INFO = ("菜名", "名称", "用时", "难度", "适合", "人群", "简介")
RECIPE_INGREDIENTS = ("食材", "配料", "原料", "调料", "用量")
RECIPE_STEP = r"(?d)^(步?骤?\s*[0-9]+[：:]?|[0-9]+[\.、]\s*|第\s*[0-9]+\s*步)"
NUTRIENTS = {
    "macro": ("能量", "热量", "蛋白质", "脂肪", "碳水化合物", "膳食纤维", "糖"),
    "vitamin": ("维生素A", "维生素B", "维生素C", "维生素D", "维生素E", "维生素K", "叶酸", "烟酸"),
    "mineral": ("钙", "铁", "锌", "镁", "钾", "钠", "磷", "硒", "铜", "碘"),
    "other": ("胆固醇", "水分", "灰分", "酒精"),
}
NUTRIENT_SPLIT = "热量|蛋白质|脂肪|碳水化合物|维生素|矿物质|纤维|钠|钙|铁"
CONDITIONS = ("糖尿病", "高血压", "高血脂", "痛风", "肾病", "肝病", "胃病", "心脏病", "肥胖", "贫血", "骨质疏松", "肿瘤", "癌症")
CROWDS = ("患者", "儿童", "孕妇", "老年人", "青少年", "婴幼儿", "运动员", "素食者", "减肥", "增重", "术后")
ADVICE = {"contraindication": ("禁忌", "不宜", "禁止", "不可"), "recommendation": ("建议", "推荐", "适宜", "每日", "摄入"), "dosage": ("用量", "剂量", "克", "毫克", "ml")}
DATES = (r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?", r"[0-9]{8}", r"(今|昨|前|明)天")
MEALS = {"早餐": "breakfast", "午餐": "lunch", "晚餐": "dinner", "加餐": "snack"}
USER_ID = (r"(?i)用户[ID编号]?\s*[:：]\s*([a-zA-Z0-9_-]+)", r"(?i)user[_\s]?id\s*[:：]\s*([a-zA-Z0-9_-]+)")
PERSONAL = {"allergy": ("过敏", "不耐受", "禁忌"), "preference": ("喜欢", "偏好", "口味", "不喜欢"), "health": ("血压", "血糖", "血脂", "BMI", "体重", "身高")}
MOST_TOKENS, LEAST_TOKENS, OVERLAP_TOKENS, SIMILARITY, SHORT_TOKENS, DIM = 512, 100, 50, 0.5, 80, 384
CONTINUES = "并且|而且|以及|同时|此外|另外|还有|或|或者|和|与|及|但|但是|然而|不过|则|就|才|还|也|又|都|只|只要|因为|所以|因此|如果|虽然|即使"
#: No conjunction sorts before it.
FIRST_CJK = "一"

_CHUNK = "array<struct<chunk_type:string,content:string,label:string>>"


def _chunk(kind, content: Column, label: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("chunk_type"), content.alias("content"), label.cast("string").alias("label"))


def _present(chunks: list[Column]) -> Column:
    return F.filter(F.array(*chunks), lambda c: ~c["content"].rlike(r"(?d)^\s*$")).cast(_CHUNK)


def _texts(blocks: Column, *kinds: str) -> Column:
    """Texts of the blocks of some kinds; tables as rows without a rule."""
    kept = F.filter(blocks, lambda b: b["kind"].isin(*kinds)) if kinds else blocks
    return F.filter(F.transform(kept, lambda b: block_text(b, rule=False)), lambda t: t != "")


def _or_whole(chunks: Column, body: Column, kind: str, label: Column) -> Column:
    return let(chunks, lambda c: F.when(F.size(c) > 0, c).otherwise(_present([_chunk(kind, body, label)])))


def recipe_name(blocks: Column) -> Column:
    """The first line of fewer than 20 characters that is no heading, among the first three of each text block."""
    lines = F.flatten(F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: F.slice(F.split(b["content"], "\n", -1), 1, 3)))
    short = F.filter(F.transform(lines, strip), lambda x: (x != "") & (F.length(x) < 20) & ~F.startswith(x, F.lit("#")))
    return F.coalesce(F.get(short, 0), F.nullif(title(blocks), F.lit("")), F.lit("未知菜谱"))


def recipe_steps(blocks: Column) -> Column:
    """Steps begin at blocks and lines with a step's mark; what stands before the first one is a step too."""
    return _steps(_texts(blocks))


def _steps(texts: Column) -> Column:
    mark = RECIPE_STEP.replace("^", r"^\s*", 1)

    def units(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")
        return F.when(text.rlike(mark), F.array(text)).otherwise(lines)

    runs = let(F.flatten(F.transform(texts, units)), lambda every: islands(every, F.transform(every, lambda u: u.rlike(mark))))
    return F.filter(F.transform(runs, strip), lambda x: x != "")


def recipe_chunks(blocks: Column, body: Column, name: Column) -> Column:
    """The basics, the ingredients and each step; name: recipe_name(blocks)."""

    def made(texts: Column) -> Column:
        def parts(terms) -> Column:
            return F.array_join(F.filter(texts, lambda t: any_of(t, terms)), "\n\n")

        steps = F.transform(_steps(texts), lambda s: _chunk("recipe_step", s, name))
        return F.concat(_present([_chunk("recipe_basic", parts(RECIPE_INFO), name), _chunk("recipe_ingredients", parts(RECIPE_INGREDIENTS), name)]), steps.cast(_CHUNK))

    return _or_whole(let(_texts(blocks), made), body, "recipe_full", name)


def nutrient_parts(text: Column) -> Column:
    """Splits before each nutrient that is named."""
    return F.filter(F.split(F.regexp_replace(text, f"({NUTRIENT_SPLIT})", "\x01$1"), "\x01", -1), lambda x: ~x.rlike(r"(?d)^\s*$"))


def nutrition_chunks(blocks: Column) -> Column:
    """Tables by the class of nutrients in their headers and first five rows; the text that names a nutrient and all
    lists as one chunk, split at the nutrients if it is too long."""
    def table(b: Column) -> Column:
        head = F.concat_ws(" ", F.array_join(table_headers(b["content"]), " "), F.array_join(F.transform(F.slice(table_rows(b["content"]), 1, 5), lambda r: F.array_join(r, " ")), " "))
        kind = F.coalesce(*(F.when(any_of(head, terms), k) for k, terms in NUTRIENTS.items()), F.lit("macro"))
        return _chunk(F.concat(F.lit("nutrition_"), kind), block_text(b), kind)

    tables = F.transform(F.filter(blocks, lambda b: b["kind"] == "table"), table)
    names = [n for terms in NUTRIENTS.values() for n in terms]
    kept = F.filter(blocks, lambda b: (b["kind"] == "list") | ((b["kind"] == "text") & any_of(b["content"], names)))
    text = F.array_join(F.transform(kept, lambda b: b["content"]), "\n\n")
    parts = F.when(token_count(text) > MOST_TOKENS, nutrient_parts(text)).otherwise(F.array(text))
    return F.concat(tables.cast(_CHUNK), F.filter(F.transform(parts, lambda p: _chunk("nutrition_text", p, F.lit(""))), lambda c: c["content"] != "").cast(_CHUNK))


def medical_label(body: Column) -> Column:
    """The conditions and the groups of people that a text names."""
    return F.concat_ws("|", *(F.array_join(F.filter(strings(*terms), lambda t: F.contains(body, t)), ",") for terms in (CONDITIONS, CROWDS)))


def medical_chunks(blocks: Column, body: Column, label: Column) -> Column:
    """A chunk for each kind of advice; label: medical_label(body)."""

    def section(t: Column) -> Column:
        return F.coalesce(*(F.when(any_of(t, terms), k) for k, terms in ADVICE.items()), F.lit("general"))

    texts = F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: F.struct(section(b["content"]).alias("k"), b["content"].alias("t")))

    def made(found: Column) -> Column:
        return _present([_chunk(f"medical_{k}", F.array_join(F.transform(F.filter(found, lambda x: x["k"] == k), lambda x: x["t"]), "\n\n"), label) for k in (*ADVICE, "general")])

    return _or_whole(let(texts, made), body, "medical_general", label)


def user_id(text: Column, doc: Column) -> Column:
    """The user that a text names; else the first eight characters of its document's id."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in USER_ID), F.substring(doc.cast("string"), 1, 8))


def personal_chunks(blocks: Column, body: Column, label: Column) -> Column:
    """A section lasts until a block names another one; the first is the profile. label: user_id(body, ...)."""

    def mark(t: Column) -> Column:
        return F.coalesce(*(F.when(any_of(t, terms), k[0]) for k, terms in PERSONAL.items()), F.lit(""))

    texts = F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: F.struct(mark(b["content"]).alias("m"), b["content"].alias("t")))
    joined = let(texts, lambda found: islands(F.transform(found, lambda x: F.when(x["m"] == "", x["t"]).otherwise(F.concat(x["m"], F.lit("\x02"), x["t"]))), F.transform(found, lambda x: x["m"] != "")))

    def of(runs: Column, letter: str) -> Column:
        held = F.filter(runs, lambda r: F.substring(r, 1, 2) == f"{letter}\x02") if letter else F.filter(runs, lambda r: F.substring(r, 2, 1) != "\x02")
        return F.array_join(F.transform(held, lambda r: F.substring(r, 3, 2**31 - 1)) if letter else held, "\n")

    def made(runs: Column) -> Column:
        return _present([_chunk(f"personal_{k}", of(runs, "" if k == "profile" else k[0]), label) for k in ("profile", "preference", "allergy", "health")])

    return _or_whole(let(joined, made), body, "personal_profile", label)


def first_date(text: Column) -> Column:
    """The first date of the first form that occurs; of "yesterday" and the like only the first character."""
    return F.coalesce(*(let(F.regexp_extract(text, p, 1 if "天" in p else 0), lambda d: F.nullif(d, F.lit(""))) for p in DATES))


def meals(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(k)), v) for k, v in MEALS.items())))


def daily_chunks(blocks: Column, label: Column) -> Column:
    """The blocks of each date, in order; those without one belong to label, the document's first date or today. Blocks
    are sorted by date and joined in runs, so many dates cost no more than few."""
    dated = F.transform(blocks, lambda b, i: let(block_text(b, rule=False), lambda t: F.struct(F.coalesce(first_date(t), label).alias("d"), i.alias("i"), t.alias("t"))))

    def marked(rows: Column) -> Column:
        return F.transform(rows, lambda r, i: F.struct((~r["d"].eqNullSafe(F.get(rows, i - 1)["d"])).alias("s"), r["d"].alias("d"), r["t"].alias("t")))

    rows = let(F.sort_array(F.filter(dated, lambda r: (r["t"] != "") & r["d"].isNotNull())), marked)
    runs = let(rows, lambda found: islands(F.transform(found, lambda r: F.when(r["s"], F.concat(r["d"], F.lit("\x02"), r["t"])).otherwise(r["t"])), F.transform(found, lambda r: r["s"])))
    return F.transform(runs, lambda x: _chunk("daily_record", F.regexp_replace(x, r"(?s)^[^\x02]*\x02", ""), F.substring_index(x, "\x02", 1))).cast(_CHUNK)


def plain_chunks(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: _chunk(b["kind"], block_text(b), F.lit(""))).cast(_CHUNK)


def chunked(docs: DataFrame, key: str, blocks: str, body: str, kind: str | Column, today: str) -> DataFrame:
    """key, chunk_type, content, label by one chunker (recipe, nutrition, medical, personal, daily, or blocks as they
    are), which kind names for all documents or for each: one narrow pass over all of them. Names and labels are columns
    first, so they aren't computed for each chunk. today: the date of daily records that have none."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    b, text = F.col(blocks), F.col(body)
    label = F.when(kind == "recipe", recipe_name(b)).when(kind == "medical", medical_label(text)).when(kind == "personal", user_id(text, F.col(key))).when(kind == "daily", F.coalesce(first_date(text), F.lit(today)))
    d = docs.withColumn("_kind", kind).withColumn("_label", label)
    args = (b, text, F.col("_label"))
    by = {"recipe": recipe_chunks(*args), "nutrition": nutrition_chunks(b), "medical": medical_chunks(*args), "personal": personal_chunks(*args), "daily": daily_chunks(b, F.col("_label"))}
    made = F.coalesce(*(F.when(F.col("_kind") == k, v) for k, v in by.items()), plain_chunks(b))
    return d.select(key, F.explode(made).alias("_c")).select(key, "_c.*")


def for_storage(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"optimized_for": F.lit("storage"), "version": F.lit("1.0")})


def for_display(chunks: DataFrame, kind: str = "chunk_type") -> DataFrame:
    shown = F.when(F.col(kind).isin("table", "list"), F.col(kind)).when(F.col(kind) == "recipe_step", "step").otherwise("text")
    return chunks.withColumns({"optimized_for": F.lit("display"), "display_format": shown})


def grade(tokens: Column) -> Column:
    """Grade of a chunk by its length."""
    return F.when(tokens < 50, "poor").when(tokens > 1000, "fair").when(tokens.between(100, 512), "excellent").otherwise("good")


def _tokens(text: str) -> int:
    return int(len(text) * 0.7)


def sentences(text: str) -> list[str]:
    """Sentences with their end marks, without white space around them."""
    return [s for s in (p.strip() for p in re.split(r"(?<=[。！？；\n])", text)) if s]


def hashed_similarity(a: str, b: str) -> float:
    """Cosine of two sentences by the signed hashes of their words and CJK characters."""

    def weights(s: str) -> Counter:
        w: Counter = Counter()
        for t in re.findall(r"[A-Za-z]+|[一-鿿]", s) or [s]:
            d = hashlib.md5(t.encode()).digest()
            w[int.from_bytes(d[:4], "big") % DIM] += 1 - 2 * (d[4] & 1)
        return w

    x, y = weights(a), weights(b)
    size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / size if size else 0.0


def _pieces(text: str, most: int) -> list[str]:
    width = int(most * 0.7)
    return [text[i : i + width] for i in range(0, len(text), width)]


def _tail(parts: list[str], budget: int) -> list[str]:
    """The last parts whose tokens stay within budget."""
    kept, used = 0, 0
    for p in reversed(parts):
        used += _tokens(p)
        if used > budget:
            break
        kept += 1
    return parts[len(parts) - kept :]


def split_by_similarity(text: str, least: int = LEAST_TOKENS, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS, similarity: float = SIMILARITY) -> list[str]:
    """Breaks between sentences that are less alike than `similarity`; a part of fewer than `least` tokens joins the one
    before it, one of more than `most` is cut by length; every part but the first begins with the last sentences of the
    part before it, `overlap` tokens at most."""
    found = sentences(text)
    if len(found) < 2:
        return found
    groups = [[found[0]]]
    for a, b in zip(found, found[1:], strict=False):
        if hashed_similarity(a, b) < similarity:
            groups.append([])
        groups[-1].append(b)
    parts: list[str] = []
    for part in map("".join, groups):
        n = _tokens(part)
        if n > most:
            parts += _pieces(part, most)
        elif n < least and parts:
            parts[-1] += part
        else:
            parts.append(part)
    return parts[:1] + ["".join(_tail(sentences(a), overlap)) + b for a, b in zip(parts, parts[1:], strict=False)]


def split_by_clauses(text: str, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS, least: int = SHORT_TOKENS) -> list[str]:
    """Packs clauses into parts of at most `most` tokens. A clause that begins with a conjunction stays with the one
    before it; a part after a full one begins with its last clauses; short parts join the one before them."""
    units: list[str] = []
    for clause in (c.strip() for s in sentences(text) for c in re.split(r"(?<=[，、；：])", s)):
        if clause and units and re.match(CONTINUES, clause):
            units[-1] += "，" + clause
        elif clause:
            units.append(clause)
    parts: list[str] = []
    held: list[str] = []
    for unit in units:
        if _tokens(unit) > most:
            parts += ["".join(held)] * bool(held) + _pieces(unit, most)
            held = []
        elif sum(map(_tokens, held)) + _tokens(unit) > most:
            parts.append("".join(held))
            held = [*_tail(held, overlap), unit]
        else:
            held.append(unit)
    parts += ["".join(held)] * bool(held)
    out = parts[:1]
    for p in parts[1:]:
        if _tokens(p) < least:
            out[-1] += p
        else:
            out.append(p)
    return out


def _not_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip_variable), lambda x: x != "")


def _split_after(text: Column, marks: str, more: str = "") -> Column:
    """text (a variable) split after each of marks and more; null, without running the pattern, where no mark stands."""
    return F.when(reduce(or_, (F.contains(text, F.lit(m)) for m in marks)), F.split(text, f"(?<=[{marks}{more}])"))


def sentence_list(text: Column) -> Column:
    # without other marks lines are split, which takes no pattern; a line's end would be stripped
    return _not_blank(let(F.coalesce(text, F.lit("")), lambda t: F.coalesce(_split_after(t, "。！？；", "\\n"), F.split(t, "\n", -1))))


def _codes(sentence: Column) -> Column:
    """The hashes of a sentence's words and CJK characters, each times two, and one more where its sign is minus."""
    tokens = F.regexp_extract_all(sentence, F.lit("([A-Za-z]+|[一-鿿])"), F.lit(1))

    def code(t: Column) -> Column:
        # eight digits for the place, two for the sign: one number
        return let(F.conv(F.substring(F.md5(t), 1, 10), 16, 10).cast("long"), lambda h: (F.shiftright(h, 8) % DIM) * 2 + h % 2)

    return F.transform(F.when(F.size(tokens) > 0, tokens).otherwise(F.array(sentence)), code)


def _square(codes: Column) -> Column:
    """The squared length of the vector of a list of codes: in order, equal hashes stand together and are summed in one pass."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("at"), zero.alias("x"), zero.alias("xx"))

    def add(s: Column, c: Column) -> Column:
        at, sign = F.shiftright(c, 1), 1 - 2 * (c % 2)
        # adding d to x changes x^2 by d (2 x + d)
        return let(F.when(s["at"] == at, s["x"]).otherwise(zero), lambda x: F.struct(at.alias("at"), (x + sign).alias("x"), (s["xx"] + sign * (2 * x + sign)).alias("xx")))

    return F.aggregate(F.sort_array(codes), start, add, lambda s: s["xx"])


def _similarity(a: Column, b: Column) -> Column:
    """Cosine of two sentences, struct(c: codes, xx: their squared length): |a + b|^2 is |a|^2 + |b|^2 + 2 ab."""
    product = (_square(F.concat(a["c"], b["c"])) - a["xx"] - b["xx"]) / 2
    return F.coalesce(F.try_divide(product, F.sqrt((a["xx"] * b["xx"]).cast("double"))), F.lit(0.0))


def _runs(items: Column, begins: Column, sep: str) -> Column:
    """Items joined from each that begins a run (an array of booleans) to the next."""
    starts = F.filter(F.transform(begins, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    return let(starts, lambda s: F.transform(s, lambda a, k: F.array_join(F.slice(items, a, F.coalesce(F.get(s, k + 1), F.size(items) + 1) - a), sep)))


def _cut_up(text: Column, most: int) -> Column:
    width = int(most * 0.7)
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int")), lambda i: F.substring(text, i * width + 1, F.lit(width)))


def _with_last(parts: Column, more: Column) -> Column:
    return F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.concat(F.element_at(parts, -1), more)))


def _last_within(parts: Column, budget: int) -> Column:
    """The last parts whose tokens stay within budget."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"))

    def add(s: Column, x: Column) -> Column:
        return let(s["used"] + token_count(x), lambda used: F.struct(used.alias("used"), F.when(used <= budget, s["kept"] + 1).otherwise(s["kept"]).alias("kept")))

    kept = F.aggregate(F.reverse(parts), start, add, lambda s: s["kept"])
    return let(kept, lambda k: F.slice(parts, F.size(parts) - k + 1, k))


def similarity_parts(text: Column, least: int = LEAST_TOKENS, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS, similarity: float = SIMILARITY) -> Column:
    """The parts of split_by_similarity(), as an array."""

    def add(parts: Column, group: Column) -> Column:
        n = token_count(group)
        return F.when(n > most, F.concat(parts, _cut_up(group, most))).when((n < least) & (F.size(parts) > 0), _with_last(parts, group)).otherwise(F.concat(parts, F.array(group)))

    def of(found: Column) -> Column:
        codes = F.transform(found, lambda s: let(_codes(s), lambda c: F.struct(c.alias("c"), _square(c).alias("xx"))))
        begins = let(codes, lambda c: F.transform(c, lambda x, i: (i == 0) | (_similarity(F.get(c, i - 1), x) < similarity)))
        parts = F.aggregate(_runs(found, begins, ""), F.array().cast("array<string>"), add)
        return let(parts, lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.array_join(let(sentence_list(F.get(p, i - 1)), lambda s: _last_within(s, overlap)), ""), x))))

    return let(sentence_list(text), lambda found: F.when(F.size(found) < 2, found).otherwise(of(found)))


def clause_parts(text: Column, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS, least: int = SHORT_TOKENS) -> Column:
    """The parts of split_by_clauses(), as an array."""
    clauses = F.flatten(F.transform(sentence_list(text), lambda s: _not_blank(F.coalesce(_split_after(s, "，、；："), F.array(s)))))
    none = F.array().cast("array<string>")

    def pack(s: Column, unit: Column) -> Column:
        return let(token_count(unit), lambda n: packed_with(s, unit, n))

    def packed_with(s: Column, unit: Column, n: Column) -> Column:
        held = F.when(F.size(s["held"]) > 0, F.array(F.array_join(s["held"], ""))).otherwise(none)
        alone = F.struct(F.concat(s["parts"], held, _cut_up(unit, most)).alias("parts"), none.alias("held"), F.lit(0).alias("used"))
        kept = let(_last_within(s["held"], overlap), lambda k: F.struct(F.concat(s["parts"], held).alias("parts"), F.concat(k, F.array(unit)).alias("held"), (F.aggregate(k, F.lit(0), lambda a, x: a + token_count(x)) + n).alias("used")))
        on = F.struct(s["parts"].alias("parts"), F.concat(s["held"], F.array(unit)).alias("held"), (s["used"] + n).alias("used"))
        return F.when(n > most, alone).when(s["used"] + n > most, kept).otherwise(on)

    def join_short(parts: Column, x: Column) -> Column:
        return F.when((F.size(parts) > 0) & (token_count(x) < least), _with_last(parts, x)).otherwise(F.concat(parts, F.array(x)))

    begins = let(clauses, lambda c: _runs(c, F.transform(c, lambda x, i: (i == 0) | (x < FIRST_CJK) | ~x.rlike(f"^(?:{CONTINUES})")), "，"))
    start = F.struct(none.alias("parts"), none.alias("held"), F.lit(0).alias("used"))
    packed = F.aggregate(begins, start, pack, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["parts"], F.array(F.array_join(s["held"], "")))).otherwise(s["parts"]))
    return F.aggregate(packed, none, join_short)


def split_long(chunks: DataFrame, text: str, split=similarity_parts, above: int | None = MOST_TOKENS) -> DataFrame:
    """chunks with part (from 0); those of more than `above` tokens (all if None) become the parts that split gives as an
    array, their other columns kept."""
    c = F.col(text)
    parts = split(c) if above is None else F.when(F.coalesce(token_count(c) > above, F.lit(False)), split(c)).otherwise(F.array(c))
    split_up = chunks.select("*", F.posexplode(parts).alias("part", "_text"))
    return split_up.select(*(F.col("_text").alias(text) if x == text else F.col(x) for x in chunks.columns), "part")
