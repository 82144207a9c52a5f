"""Readers of record files and directories, and writers."""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import block_list, let, title

logger = logging.getLogger(__name__)

WRAPPERS = ("foods", "products", "items", "data")  # fixed values: keys that may hold the list of records


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, an object with a list under one of WRAPPERS (the first that has one), or one object."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    for key in WRAPPERS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType) and isinstance(df.schema[key].dataType.elementType, T.StructType):
            return df.select(F.explode(key).alias("r")).select("r.*")
    return df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; blank lines and lines that hold no object are skipped, malformed ones raise when read."""
    schema = T.StructType([f for f in spark.read.json(path).schema if f.name != "_corrupt_record"])
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*[{]"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*") if len(schema) else lines.limit(0)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte order mark before the header is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    kind = os.path.splitext(path)[1].lower()
    readers = {".json": read_json, ".jsonl": read_jsonl, ".csv": read_csv}
    if kind not in readers:
        raise ValueError(f"unsupported format: {kind}")
    return readers[kind](spark, path)


def read_directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """path, suffix, route, size, text and error of every file below path whose suffix is asked for, in order of path;
    invalid UTF-8 is replaced. A file that can't be read has an error instead of ending the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    route = F.when(suffix == ".pdf", "pdf").when(suffix.isin(".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff"), "image").otherwise("text")
    text = F.when(route == "text", F.make_valid_utf8(F.col("content").cast("string")))
    kept = files.withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes))
    return kept.select("path", "suffix", route.alias("route"), F.col("length").alias("size"), text.alias("text"), F.when(F.col("content").isNull(), "unreadable").alias("error")).orderBy("path")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """path, size, text and title of one text or Markdown file; invalid UTF-8 is replaced."""
    d = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return d.withColumn("title", title(block_list(F.col("text"))))


#: Lists of strings, and the other names that a field may have.
EXAMPLE_LISTS = {"contexts": "retrieved_contexts", "expected_routes": None, "expected_route_order": None, "actual_routes": "planned_routes", "expected_context_ids": None, "retrieved_context_ids": None, "forbidden_ingredients": None, "memory_policies": None, "expected_safety_warnings": None, "actual_safety_warnings": None, "expected_dynamic_entities": None, "actual_dynamic_entities": None, "expected_dynamic_routes": None, "actual_dynamic_routes": None, "executed_routes": None, "fallback_routes": None}
EXAMPLE_TEXTS = ("intent", "expected_intent", "multi_turn_group", "user_profile", "route_status", "trace", "metadata")


def _strings(value: Column) -> Column:
    """A JSON list, or one value, as an array without empty strings."""
    one = F.when(F.coalesce(value, F.lit("")) != "", F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.when(F.startswith(value, F.lit("[")), F.filter(F.from_json(value, "array<string>"), lambda x: x != "")).otherwise(one)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation examples of a JSONL file: question, answer, ground_truth, citations, turn_index, EXAMPLE_LISTS and
    EXAMPLE_TEXTS, with the other names that these may have. Blank lines are skipped; a line that is no object or lacks a
    question or an answer raises, with its number from 1, when the rows are read. The file is split as a whole, to number
    its lines."""
    names = ["question", "query", "answer", "ground_truth", "reference", "expected_answer", "citations", "turn_index", *EXAMPLE_TEXTS, *EXAMPLE_LISTS, *(v for v in EXAMPLE_LISTS.values() if v)]
    schema = ", ".join(f"{n} string" for n in names) + ", _bad string"
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = text.select(F.posexplode(F.split("value", "\r?\n", -1)).alias("at", "line")).where(F.trim("line") != "")
    r = lines.select((F.col("at") + 1).alias("line"), F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("line", "r.*")
    question, answer = F.trim(F.coalesce("question", "query", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    wrong = F.when(F.col("_bad").isNotNull(), "no object").when(question == "", "missing required field: question").when(answer == "", "missing required field: answer")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("invalid evaluation JSONL at line "), F.col("line").cast("string"), F.lit(": "), wrong)).cast("string")).otherwise(question)
    numbers = F.when(F.startswith("citations", F.lit("[")), F.from_json("citations", "array<int>")).otherwise(F.transform(F.filter(F.transform(F.split(F.coalesce("citations", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("int")))
    lists = {k: _strings(F.coalesce(k, v) if v else F.col(k)) for k, v in EXAMPLE_LISTS.items()}
    texts = [F.trim(F.coalesce(k, F.lit("{}" if k in ("user_profile", "route_status", "trace", "metadata") else ""))).alias(k) for k in EXAMPLE_TEXTS]
    return r.select(checked.alias("question"), answer.alias("answer"), F.trim(F.coalesce("ground_truth", "reference", "expected_answer", F.lit(""))).alias("ground_truth"), numbers.alias("citations"), F.coalesce(F.col("turn_index").cast("int"), F.lit(0)).alias("turn_index"), *texts, *(v.alias(k) for k, v in lists.items()))


def save_result(result: DataFrame, path: str) -> None:
    """Writes the small table of a result as one JSON file in the folder at path."""
    result.coalesce(1).write.mode("overwrite").json(path)


def rows_where(rows: DataFrame, column: str, value, *order: str) -> DataFrame:
    """The rows with a value, in order; all of them, without a cap."""
    return rows.where(F.col(column) == F.lit(value)).orderBy(*order)


# fixed values: words in names and scanned text of images, and limits
DOCUMENT_NAMES = {"nutrition_table": ("nutrition", "营养", "成分", "label", "标签", "table", "report", "报告", "scan", "扫描", "pdf", "page", "receipt", "票据"), "recipe": ("recipe", "菜谱", "食谱", "步骤", "做法"), "medical_report": ("medical", "体检", "化验", "检查", "诊断", "医院")}
NATURAL_NAMES = {"food_photo": ("food", "meal", "dish", "餐", "饭", "菜", "食物", "照片"), "fridge": ("fridge", "冰箱", "冷藏"), "takeout": ("takeout", "外卖", "餐盒")}
OCR_TERMS = {
    "nutrition_table": ("营养成分", "营养成份", "蛋白质", "脂肪", "碳水", "碳水化合物", "能量", "热量", "钠", "每100", "nrv", "配料", "nutrition", "protein", "fat", "carbohydrate", "sodium", "ingredients"),
    "recipe": ("食谱", "菜谱", "配料", "步骤", "做法", "烹饪", "recipe", "ingredients"),
    "medical_report": ("报告", "诊断", "检验", "检查", "医院", "医生", "medical", "diagnosis"),
    "pdf_page": ("目录", "摘要", "参考文献", "扫描", "page", "abstract"),
}
OCR_CHARS, PAGE_CHARS, SMALL_FILE = 18, 40, 80 * 1024


def _most_hits(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """struct(hits, before, name) of the kind with most words in text, the first among equals."""
    kinds = [F.struct(sum((F.contains(text, F.lit(w.lower())).cast("int") for w in terms[1:]), F.contains(text, F.lit(terms[0].lower())).cast("int")).alias("hits"), F.lit(-i).alias("before"), F.lit(k).alias("name")) for i, (k, terms) in enumerate(words.items())]
    return F.array_max(F.array(*kinds))


def image_route(name: Column, size: Column, ocr_text: Column) -> Column:
    """struct(kind, subtype, confidence, decision, reason) of an image by its name, the text read from it and its size
    (null: unknown), in this order."""

    def route(kind, subtype, confidence, decision, reason) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (subtype if isinstance(subtype, Column) else F.lit(subtype)).alias("subtype"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    def by_name(low: Column) -> Column:
        return (
            F.when(low["nat"]["hits"] > 0, route("natural", low["nat"]["name"], 0.78, "vision_required", "filename_natural_hint"))
            .when(size.isNull(), route("unknown", "unknown", 0.0, "vision_required", "stat_failed"))
            .when(size < SMALL_FILE, route("document", "pdf_page", 0.55, "vision_required", "weak_small_file_document_hint"))
            .otherwise(route("unknown", "unknown", 0.35, "vision_required", "no_strong_lightweight_signal"))
        )

    def by_text(r: Column, low: Column) -> Column:
        chars, hits = r["chars"], r["read"]["hits"]
        kind = F.when(hits > 0, r["read"]["name"]).otherwise("pdf_page")
        sure = F.lit(0.58) + F.when(chars >= OCR_CHARS, 0.12).otherwise(0.0) + F.least(hits, F.lit(5)) * 0.06 + F.when(kind.isin("nutrition_table", "medical_report") & (hits >= 2), 0.08).otherwise(0.0)
        strong = (chars >= OCR_CHARS) & F.when(kind == "medical_report", hits >= 2).when(kind == "pdf_page", (hits >= 3) & (chars >= PAGE_CHARS)).otherwise(hits >= 3)
        probed = (hits > 0) | (chars >= OCR_CHARS)
        return (
            F.when(probed & strong, route("document", kind, F.least(sure, F.lit(0.93)), "direct_document", "ocr_strong_document_match"))
            .when(probed, route("document", kind, F.least(sure, F.lit(0.93)), "vision_required", "ocr_weak_document_hint"))
            .otherwise(by_name(low))
        )

    # a text is squeezed once, and only where the name doesn't decide; what is white space in it then are single spaces
    squeezed = F.lower(F.trim(F.regexp_replace(F.coalesce(ocr_text, F.lit("")), r"[\t\n\x0B\f\r]\s*| \s+", " ")))
    read = let(squeezed, lambda ocr: F.struct(F.length(F.replace(ocr, F.lit(" "), F.lit(""))).alias("chars"), _most_hits(ocr, OCR_TERMS).alias("read")))
    names = let(F.lower(name), lambda low: F.struct(_most_hits(low, DOCUMENT_NAMES).alias("doc"), _most_hits(low, NATURAL_NAMES).alias("nat")))
    return let(
        names,
        lambda low: F.when(low["doc"]["hits"] > 0, route("document", low["doc"]["name"], 0.9, "direct_document", "filename_strong_document_match")).otherwise(let(read, lambda r: by_text(r, low))),
    )


def image_parser(route: Column, vision_kind: Column) -> Column:
    """layout or vision: which parser takes an image, given what one call of a vision model said of it (null: no model).
    Without a model every image goes to the layout parser."""
    return F.when((route["decision"] == "direct_document") | (vision_kind == "document"), "layout").when(vision_kind.isNotNull(), "vision").otherwise("layout")


def append(rows: DataFrame, path: str) -> bool:
    """Adds rows to the Parquet table at path. False, with a line in the log, if that failed: logs are best effort."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:
        logger.exception("rows weren't added to %s", path)
        return False
    return True


def with_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with their vectors; raises, when the rows are read, where a chunk has none."""
    j = chunks.join(vectors.withColumn("_has", F.lit(True)), key, "left")
    checked = F.when(F.col("_has"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no vector for chunk "), F.col(key).cast("string"))))
    return j.withColumn(key, checked.cast(chunks.schema[key].dataType)).drop("_has")
