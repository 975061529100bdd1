"""Views that bind operators to the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

#: ``{name}`` stands for a table or another view.
VIEWS = {
    "v_issues": """SELECT CAST(user_id % 10 AS BIGINT) AS project_id, event_type AS rule_id, 'RULE' AS category,
        CASE WHEN value >= 60 THEN 'HIGH' WHEN value >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
        concat('d', CAST(user_id % 5 AS STRING), '/u', CAST(user_id AS STRING), '.x') AS file_path,
        CAST(event_id % 50 AS BIGINT) AS line, event_type AS description, event_id AS pos, ts FROM {events}""",
    "v_files": """SELECT CAST(substring(source, 4) AS BIGINT) AS project_id,
        concat(lang, '/', CAST(doc_id % 7 AS STRING), '/', CAST(doc_id AS STRING), '.',
            CASE doc_id % 10 WHEN 0 THEN 'java' WHEN 1 THEN 'py' WHEN 2 THEN 'md' WHEN 3 THEN 'xml' WHEN 4 THEN 'ts'
            WHEN 5 THEN 'yml' WHEN 6 THEN 'txt' WHEN 7 THEN 'png' WHEN 8 THEN 'go' ELSE 'log' END) AS path,
        n_chars AS size, text AS content FROM {documents}""",
    "v_names": "SELECT CAST(p_size % 7 AS BIGINT) AS project_id, p_partkey AS pos, replace(lower(p_name), ' ', '.') AS name, p_brand AS version FROM {part}",
    "v_coords": """SELECT l_orderkey % 10 AS project_id, CAST(l_orderkey AS STRING) AS file_path, CAST(l_linenumber AS BIGINT) AS line, CAST(l_linenumber AS BIGINT) AS ordinal,
        concat(CASE WHEN l_partkey % 23 = 0 THEN '?:' ELSE 'g:' END, CAST(l_partkey AS STRING)) AS dep_id,
        CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 7 = 1 THEN ' ' WHEN l_returnflag = 'N' THEN concat(CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '' END, '$', '{{v}}') ELSE l_returnflag END AS version FROM {lineitem}""",
    "v_trade": """SELECT c_nationkey AS a, s_nationkey AS b, o_orderkey, CAST(l_linenumber AS BIGINT) AS pos FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
        JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey""",
    # each supplier uses up to seven others of its third, one for each place of an order line
    "v_uses": """SELECT l_suppkey % 3 AS project_id, l_suppkey AS src, CAST(l_linenumber AS BIGINT) AS k, (min(l_partkey) % (SELECT count(*) FROM {supplier})) - (min(l_partkey) % (SELECT count(*) FROM {supplier})) % 3 + l_suppkey % 3 AS dst,
        count(*) AS weight FROM {lineitem} GROUP BY l_suppkey, l_linenumber""",
    "v_edges": "SELECT project_id, src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM {v_uses} AS u GROUP BY project_id, src, dst",
    "v_calls": """SELECT CAST(0 AS BIGINT) AS project_id, concat('n', CAST(a AS STRING), '#m', CAST(o_orderkey % 3 AS STRING)) AS caller,
        concat('n', CAST(b AS STRING), '#m', CAST(pos % 3 AS STRING)) AS callee, concat('k', CAST(pos AS STRING)) AS kind, concat('p', CAST(o_orderkey % 5 AS STRING)) AS path,
        o_orderkey * 10 + pos AS pos FROM {v_trade} AS t""",
    "v_modules": "SELECT s_suppkey % 3 AS project_id, s_suppkey AS type, CAST(s_nationkey AS BIGINT) AS module FROM {supplier}",
    "v_reviews": """SELECT user_id AS session_key, ts, event_id AS id,
        CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'click' THEN 'REJECTED' WHEN 'error' THEN 'REJECTED' WHEN 'signup' THEN 'MODIFIED' ELSE 'PENDING' END AS decision
        FROM {events}""",
    "v_types": """SELECT page_id % 5 AS project_id, url AS path,
        concat(CASE page_id % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'web' WHEN 2 THEN 'x' ELSE 'domain' END, '.p', CAST(page_id % 11 AS STRING)) AS package,
        concat('T', CAST(page_id AS STRING), CASE page_id % 5 WHEN 0 THEN 'Controller' WHEN 1 THEN 'ServiceImpl' WHEN 2 THEN 'Test' WHEN 3 THEN 'DTO' ELSE '' END) AS name,
        CASE WHEN page_id % 6 = 0 THEN array('Other', 'Service') ELSE array('Other') END AS annotations FROM {pages}""",
    "v_expected": """SELECT doc_id AS sample_id, CASE WHEN quality = 1 THEN 'clean' ELSE 'dirty' END AS category,
        CASE WHEN toxic = 1 THEN array('toxic') ELSE array('plain') END AS required, CASE WHEN quality = 1 THEN array('junk') ELSE array('fine') END AS forbidden,
        array('a', 'b') AS layers, quality = 1 AS documentation FROM {labels}""",
    "v_observed": """SELECT doc_id AS sample_id, CASE WHEN n_chars % 3 = 0 THEN array('toxic', 'junk') WHEN n_chars % 3 = 1 THEN array('plain') ELSE array('plain', 'fine') END AS detected,
        CASE WHEN n_chars % 2 = 0 THEN array('a') ELSE array('a', 'b') END AS layers_seen, n_chars > 400 AS documented FROM {documents}""",
}
NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view, or a table of the folder."""
    sql = VIEWS.get(name)
    if sql is None:
        return table(spark, folder, name)
    return spark.sql(sql, **{n: view(spark, folder, n) for n in NAME.findall(sql)})


def duck(sql: str) -> str:
    """SQL for DuckDB, with views written out as common table expressions."""
    found: dict[str, str] = {}

    def visit(text: str) -> str:
        for n in NAME.findall(text):
            if n in VIEWS and n not in found:
                body = visit(VIEWS[n])
                found[n] = re.sub(r"\barray\(", "list_value(", body)
        return NAME.sub(r"\1", text).replace("{{", "{").replace("}}", "}")

    main = visit(sql)
    with_ = ", ".join(f"{n} AS ({b})" for n, b in found.items())
    if not found:
        return main
    if main.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_}, {main[15:]}"
    return f"WITH {with_}, {main[5:]}" if main.startswith("WITH ") else f"WITH {with_} {main}"
