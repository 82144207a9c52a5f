"""Ad-hoc SELECT queries under guard."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what a statement may not hold
MARKS = (";", "--", "/*", "*/")
VERBS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE")
#: Functions that reach beyond the tables: they call Java or read files, variables and the session.
FORBIDDEN = ("reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "version", "raise_error", "assert_true", "getvariable")
ROWS, ATTEMPTS, RAW_ROWS = 50, 3, 20


class RefusedSql(ValueError):
    pass


def sanitise(sql: str) -> str:
    """The statement without fence and last semicolon; RefusedSql unless it is one SELECT."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", sql.strip()).strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    if not re.match(r"select\b", text, re.I):
        raise RefusedSql("only SELECT is allowed")
    if any(m in text for m in MARKS) or re.search(rf"\s({'|'.join(VERBS)})\s", f" {text} ", re.I):
        raise RefusedSql("the statement holds a forbidden part")
    return text


def check(spark: SparkSession, sql: str, tables: Iterable[str]) -> None:
    """RefusedSql unless the parsed statement reads the named tables (and its own WITH names) alone and calls no function
    of FORBIDDEN. The session's parser says what it reads, so paths, table functions and quoted names are seen."""
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    own = {m.lower() for m in re.findall(r"(?:CTE \[|, )(\w+)(?=[,\]])", tree)}
    allowed = {t.lower() for t in tables} | own
    for name in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", tree):
        if name.strip().lower() not in allowed:
            raise RefusedSql(f"the statement reads {name}")
    if re.search(r"UnresolvedTableValuedFunction|UnresolvedTVFAliases|ScriptTransformation|UnresolvedInlineTable", tree):
        raise RefusedSql("the statement reads something that is no table")
    called = {m.lower() for m in re.findall(r"'([\w.]+)\(", tree)}
    if called & set(FORBIDDEN):
        raise RefusedSql(f"the statement calls {', '.join(sorted(called & set(FORBIDDEN)))}")


def run(spark: SparkSession, sql: str, limit: int = ROWS, tables: Iterable[str] | None = None) -> DataFrame:
    """The first rows of a SELECT; tables: what it may read (None: the session's temporary views)."""
    text = sanitise(sql)
    views = tables if tables is not None else [t.name for t in spark.catalog.listTables() if t.isTemporary]
    check(spark, text, views)
    return spark.sql(text).limit(limit)


def decoded(rows: DataFrame) -> DataFrame:
    """rows whose strings that are JSON have become variants, so that their parts can be asked for."""
    return rows.select(*(F.coalesce(F.try_parse_json(c), F.try_parse_json(F.to_json(F.struct(F.col(c).alias("v")))).cast("variant")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def fuzzy(sql: str) -> str:
    """col = 'v' and col IN ('v') as ILIKE '%v%', with % and _ escaped; ->> becomes get_json_object."""
    sql = re.sub(r"([\w.]+)\s*->>\s*'(\w+)'", r"get_json_object(\1, '$.\2')", sql)

    def like(m: re.Match) -> str:
        v = re.sub(r"([%_])", r"\\\\\1", m[2])
        return f"{m[1]} ILIKE '%{v}%'"

    left = r"([\w.]+|get_json_object\([^)]*\))"
    return re.sub(left + r"\s+IN\s*\(\s*'([^']*)'\s*\)", like, re.sub(left + r"\s*=\s*'([^']*)'", like, sql), flags=re.I)


def error_kind(error: Exception) -> str:
    name = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    if name.startswith(("UNRESOLVED_COLUMN", "TABLE_OR_VIEW_NOT_FOUND", "FIELD_NOT_FOUND")):
        return "schema_mismatch"
    return "invalid_sql" if name.startswith("PARSE") or isinstance(error, RefusedSql) else "sql_execution_failed"


def answer(spark: SparkSession, question: str, generate: Callable[[str], str], repair: Callable[[str, str, str], str] | None = None, tables: Iterable[str] | None = None, attempts: int = ATTEMPTS) -> dict:
    """Runs the statement that generate makes of a question. A failed one goes to repair(question, sql, error) and is run
    again, `attempts` times in all; an empty result is looked for once more with fuzzy comparisons. Returns status
    (success, empty or error), reason, sql, and the rows (at most 50)."""
    sql, reason, said = generate(question), "", ""
    for k in range(attempts):
        try:
            found = run(spark, sql, tables=tables).collect()
        except Exception as e:  # whatever a model's statement raises is its result
            reason, said = error_kind(e), str(e)
            if repair is None or k + 1 == attempts:
                break
            sql = repair(question, sql, said)
            continue
        if found:
            return {"status": "success", "reason": "", "sql": sql, "rows": found}
        wider = fuzzy(sanitise(sql))
        try:
            found = run(spark, wider, tables=tables).collect() if wider != sanitise(sql) else []
        except Exception as e:  # the wider statement is a guess: the exact one's empty result stands
            reason, found = error_kind(e), []
        return {"status": "success" if found else "empty", "reason": reason, "sql": wider if found else sql, "rows": found}
    return {"status": "error", "reason": reason, "sql": sql, "error": said, "rows": []}


def structured(rows: DataFrame) -> DataFrame:
    """entity, attribute, value of the first 20 rows of a result, by the names that its columns may have."""

    def first(*names: str):
        return F.coalesce(*(F.col(n).cast("string") for n in names if n in rows.columns), F.lit(""))

    return rows.limit(RAW_ROWS).select(first("entity_id", "entity", "subject").alias("entity"), first("attribute", "predicate").alias("attribute"), first("value", "object").alias("value"), F.lit("sql_raw").alias("evidence_type"))
