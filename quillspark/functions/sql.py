"""SQL functions of the text operators, for queries that are written as SQL. They are SQL expressions that Spark puts in
place of the call, so they stay within generated code; no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, type, expression)
FUNCTIONS = {
    "qs_token_count": ("t STRING", "INT", "CAST(floor(length(coalesce(t, '')) * 0.7D) AS INT)"),
    "qs_squeeze": ("t STRING", "STRING", r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\n{3,}', '\n\n'), '[ \t]{2,}', ' '), '^[ \t\n\r]+', ''), '[ \t\n\r]+$', ''), '')"),
    "qs_canonical_id": ("t STRING", "STRING", r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(t, '')), r'[^\p{L}\p{N}_]+', '_'), '_+', '_'), '^_|_$', ''), ''), 'unknown')"),
    "qs_token_id": ("t STRING", "BIGINT", "CAST(conv(substring(md5(CAST(t AS BINARY)), 1, 8), 16, 10) AS BIGINT) % 100000"),
    "qs_occurrences": ("t STRING, term STRING", "BIGINT", "CAST((length(t) - length(replace(t, term, ''))) / length(term) AS BIGINT)"),
    "qs_citations": ("t STRING", "ARRAY<INT>", r"array_distinct(transform(regexp_extract_all(t, r'\[(来源|证据)(\d+)\]', 2), x -> CAST(x AS INT)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; gives their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
