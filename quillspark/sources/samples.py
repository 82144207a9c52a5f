"""Requests, notes and stores that the queries derive from the test tables: every row of a table takes one of a few
written samples by its id, so each query runs over the whole table. Every view has its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

QUESTIONS = (
    "番茄有什么营养",
    "蛋白质大于10g的食物有哪些",
    "痛风可以吃虾吗",
    "我花生过敏，帮我记住",
    "番茄炒蛋怎么做",
    "孕妇可以吃鱼吗",
    "鸡蛋和牛奶哪个蛋白质高",
    "保存这份菜谱：食材：豆腐 步骤1 切块",
    "根据我的饮食计划推荐早餐",
    "推荐一些低脂食物",
    "这个热量多少",
    "我的体检报告里尿酸 480",
    "脂肪低于5克 热量最少的食材",
    "save my workout plan: training 5组 深蹲",
    "what is the protein of oats",
    "糖尿病人每天吃多少碳水",
    "我不喜欢香菜，以后不要推荐",
    "今天吃了燕麦和香蕉，记一下",
    "适合我的菜谱",
    "它能不能吃",
    "高血压 sodium < 2000 mg 怎么吃",
    "肠胃炎期间吃粥安全吗",
    "",
    "我记录的饮食记录里昨天吃了什么",
)
NOTES = (
    "# 番茄炒蛋\n菜名：番茄炒蛋\n简介：家常菜\n\n食材：番茄、鸡蛋\n- 番茄 2个\n* 鸡蛋 3个\n\n1. 将番茄切块\n2. 把鸡蛋打散\n翻炒两分钟\n步骤3：煮熟\n番茄和黄瓜不宜同食，以免营养流失，请注意搭配。",
    "## 营养成分\n| 食材 | 热量 | 蛋白质 |\n|---|---|---|\n| 番茄 | 15 | 0.9 |\n|  |  |  |\n| 牛奶 |  54 | 3.0 |\n\n番茄营养丰富，每100克含蛋白质 0.9g，脂肪0.2克，碳水化合物 3.3 g，热量 15千卡，适合减脂人群。高蛋白低脂。",
    "用户ID：u_42\n姓名：张三，年龄：30，体重：70\n\n对花生过敏\n\n喜欢清淡口味\n| 单行表 |\n血压 120",
    "2024-01-02 早餐 燕麦 牛奶\n\n午餐 米饭 100克\n昨天 晚餐 面条\n\n2024/1/3 加餐 香蕉",
    "高血压患者禁忌高盐饮食\n\n建议每日摄入盐不超过5克\n\n剂量：每次 20 毫克\n\n其他说明，孕妇 请 咨询 医生。\n豆腐可以替代牛肉，适合素食者。菠菜与豆腐相克的说法没有依据。",
    "plain note\n\n  - item one\n\t+ item two\ntext after\n###no heading\n| a | b |\n| 1 | 2 |\n# Title\nbody",
)


def pick(samples: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, samples)), (F.pmod(n, F.lit(len(samples))) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, user_id, query, n: one question of every event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("user_id"), pick(QUESTIONS, F.col("event_id")).alias("query"), F.col("event_id").alias("n"), "value")


REQUESTS_SQL = f"requests AS (SELECT event_id AS request_id, user_id::varchar AS user_id, {sql_list(QUESTIONS)}[event_id % {len(QUESTIONS)} + 1] AS query, event_id AS n, value FROM events)"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a note and the whole text of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n\n", pick(NOTES, F.col("doc_id")), "text").alias("text"))


NOTES_SQL = f"notes AS (SELECT doc_id, concat_ws(chr(10) || chr(10), {sql_list(NOTES)}[doc_id % {len(NOTES)} + 1], text) AS text FROM documents)"
