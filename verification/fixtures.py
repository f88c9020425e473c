"""Views over the given tables, as SQL text that runs in Spark and in DuckDB.

``@name`` is a given table or another view, ``@TOK(x)`` the token of ``x``. Every view keeps all
rows of the tables it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "fx_customers": """
        SELECT id,
          CASE WHEN id % 11 = 3 THEN NULL WHEN id % 13 = 5 THEN ''
               WHEN id % 7 = 2 THEN @TOK(e) ELSE e END AS email,
          CASE WHEN id % 5 = 1 THEN NULL WHEN id % 7 = 2 THEN @TOK(p)
               WHEN id % 17 = 4 THEN 'tok_hello_poc' ELSE p END AS phone,
          city
        FROM (SELECT c_custkey AS id,
                'user' || CAST(c_custkey AS string) || '@example.com' AS e,
                '+1-555-' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS string), 4, '0') ELSE CAST(c_custkey AS string) END AS p,
                c_mktsegment AS city
              FROM @customer) b""",
    # every kind of value the token test has to tell apart, over whole texts
    "fx_edge": """
        SELECT doc_id AS id,
          CASE doc_id % 14
            WHEN 0 THEN NULL
            WHEN 1 THEN ''
            WHEN 2 THEN @TOK(text)
            WHEN 3 THEN @TOK(text) || chr(10)
            WHEN 4 THEN @TOK(text) || chr(13)
            WHEN 5 THEN @TOK(text) || '\u2028'
            WHEN 6 THEN 'tok__poc'
            WHEN 7 THEN 'tok_hello_poc'
            WHEN 8 THEN upper(@TOK(lang))
            WHEN 9 THEN ' ' || @TOK(text)
            WHEN 10 THEN @TOK(text) || chr(10) || chr(10)
            WHEN 11 THEN 'x' || @TOK(text)
            WHEN 12 THEN 'ünï€😀 ' || text
            ELSE text END AS v
        FROM @documents""",
    # shipments in parts of which few hold plaintext; one part has no name
    "fx_shipments": """
        SELECT l_orderkey * 10 + l_linenumber AS id,
          CASE WHEN l_partkey % 20 IN (3, 19) OR l_partkey % 20 = 7 AND l_linenumber = 2
               THEN 'order' || CAST(l_orderkey AS string) || '@example.com'
               ELSE @TOK(l_linestatus) END AS email,
          CASE WHEN l_linenumber > 3 THEN l_returnflag END AS note,
          CASE WHEN l_partkey % 20 < 19 THEN lpad(CAST(l_partkey % 20 AS string), 2, '0') END AS hour
        FROM @lineitem""",
    "fx_catalog": """
        SELECT k, platform,
          CASE WHEN k % 50 = 49 THEN 'urn:li:chart:' || CAST(k AS string)
               ELSE 'urn:li:dataset:(urn:li:dataPlatform:' || platform || ',' || name || ',' || env || ')'
               END AS urn,
          name, env,
          CASE WHEN k % 6 = 0 THEN 'urn:li:tag:tokenize/run' END AS global_tag
        FROM (SELECT p_partkey AS k,
                CASE p_partkey % 4 WHEN 0 THEN 'postgres' WHEN 1 THEN 'databricks'
                                   WHEN 2 THEN 'postgres' ELSE 'mysql' END AS platform,
                CASE p_partkey % 10
                  WHEN 0 THEN 'sch.t' || CAST(p_partkey AS string)
                  WHEN 1 THEN 'solo' || CAST(p_partkey AS string)
                  WHEN 2 THEN 'db.sch.t' || CAST(p_partkey AS string) || '.v1'
                  ELSE 'db' || CAST(p_partkey % 5 AS string) || '.public.t' || CAST(p_partkey AS string)
                END AS name,
                CASE WHEN p_partkey % 3 = 0 THEN 'DEV' ELSE 'PROD' END AS env
              FROM @part) b""",
    "fx_fields": """
        SELECT c.k, c.urn, f.pos, 't' || CAST(c.k AS string) || '.' || f.col AS field_path, f.tag
        FROM (SELECT DISTINCT l_partkey AS k, l_linenumber AS pos,
                CASE (l_partkey + l_linenumber * 3) % 10
                  WHEN 0 THEN 'customer_email' WHEN 1 THEN 'primary_phone' WHEN 2 THEN 'city'
                  WHEN 3 THEN 'notes' WHEN 4 THEN 'SSN_last4' WHEN 5 THEN 'contact_email'
                  WHEN 6 THEN 'E_Mail' WHEN 7 THEN 'mobile_no' WHEN 8 THEN 'addr.email'
                  ELSE 'amount' END AS col,
                CASE (l_partkey * 7 + l_linenumber * 11) % 60
                  WHEN 0 THEN 'urn:li:tag:pii.email' WHEN 1 THEN 'urn:li:tag:sensitive'
                  WHEN 2 THEN 'urn:li:tag:pii.ssn' WHEN 3 THEN 'urn:li:tag:nonpii'
                  WHEN 4 THEN 'urn:li:tag:tokenize/run' WHEN 5 THEN 'urn:li:tag:other'
                  WHEN 6 THEN 'urn:li:tag:PII' END AS tag
              FROM @lineitem) f
        JOIN @fx_catalog c ON c.k = f.k""",
    # an edit of every field, most without a tag, and of one field that does not exist per dataset
    "fx_editable": """
        SELECT k, urn, field_path, CASE WHEN (k + pos) % 37 = 0 THEN 'urn:li:tag:pii.phone' END AS tag
        FROM @fx_fields
        UNION ALL
        SELECT k, urn, 'ghost.x' AS field_path, CASE WHEN k % 17 = 0 THEN 'urn:li:tag:pii' END AS tag
        FROM @fx_catalog""",
    # three names per dataset, NULL where there is none
    "fx_scope": """
        SELECT k, urn, CASE WHEN k % 8 = 1 THEN 't' || CAST(k AS string) || '.primary_phone' END AS name
        FROM @fx_catalog
        UNION ALL SELECT k, urn, CASE WHEN k % 8 = 1 THEN 'customer_email' END AS name FROM @fx_catalog
        UNION ALL SELECT k, urn, CASE WHEN k % 8 IN (1, 2) THEN 'no_such_field' END AS name FROM @fx_catalog""",
    "fx_samples": """
        SELECT id, 'customer_email' AS col,
          CASE WHEN id % 3 = 0 THEN 'n/a' ELSE 'u' || CAST(id AS string) || '@example.com' END AS val
        FROM @fx_customers
        UNION ALL SELECT id, 'primary_phone' AS col, 'not-a-phone' AS val FROM @fx_customers
        UNION ALL SELECT id, 'contact_email' AS col, 'bad address' AS val FROM @fx_customers
        UNION ALL SELECT id, 'email' AS col, CAST(NULL AS string) AS val FROM @fx_customers
        UNION ALL SELECT id, 'mobile_no' AS col, phone AS val FROM @fx_customers""",
    "fx_numbers": """
        SELECT 'custkey' AS col, c_custkey AS val FROM @customer
        UNION ALL SELECT 'size' AS col, CAST(p_size AS bigint) AS val FROM @part""",
    "fx_tagevents": """
        SELECT event_id AS seq, 'ds' || CAST(user_id AS string) AS urn,
          CASE WHEN event_id % 4 = 0 THEN 't.email' ELSE '' END AS field_path,
          CASE event_type WHEN 'error' THEN 'urn:li:tag:tokenize/status:FAILED'
                          WHEN 'view' THEN 'urn:li:tag:tokenize/done'
                          ELSE 'urn:li:tag:tokenize/run' END AS tag,
          CASE WHEN event_type = 'purchase' OR event_id % 9 = 0 THEN 'remove' ELSE 'add' END AS op
        FROM @events""",
    "fx_runs": """
        SELECT 'r' || CAST(event_id AS string) AS run_id, event_id AS seq,
          'ds' || CAST(user_id AS string) AS urn, ts AS started_at,
          CASE WHEN event_id % 2 = 0 THEN 'postgres' ELSE 'databricks' END AS platform,
          CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
          CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'email'
               ELSE 'email,phone' END AS columns,
          CASE WHEN event_type = 'error' OR event_id % 10 = 0 THEN 0 ELSE event_id % 100 END AS rows_updated,
          0 AS rows_skipped
        FROM @events""",
    # one catalog document per part, in all the shapes a catalog returns
    "fx_payload": """
        SELECT k, urn,
          CASE WHEN k % 29 = 0 THEN 'null'
               ELSE '{"name":"' || name || '","globalTags":' || global_tags || ',"schemaMetadata":' || fields
                    || ',"editableSchemaMetadata":' || edits || ',"editableProperties":' || props || '}'
          END AS payload
        FROM (SELECT k, urn, name,
            CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{"tags":null}' ELSE '{"tags":[' || entries || ']}' END
              AS global_tags,
            CASE k % 7 WHEN 0 THEN 'null' WHEN 1 THEN '{"fields":null}' ELSE
              '{"fields":[{"fieldPath":"' || t || '.email","nativeDataType":"TEXT","globalTags":{"tags":['
              || entries || ']}},{"fieldPath":"' || t || '.phone","nativeDataType":null,"globalTags":null},'
              || '{"nativeDataType":"int","globalTags":{"tags":[{"tag":{"urn":"urn:li:tag:pii"}}]}},'
              || '{"fieldPath":"","globalTags":null},{"fieldPath":"' || t || '.notes","globalTags":{"tags":null}}]}'
              END AS fields,
            CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN '{"editableSchemaFieldInfo":null}' ELSE
              '{"editableSchemaFieldInfo":[{"fieldPath":"' || t
              || '.email","globalTags":{"tags":[{"tag":{"urn":"urn:li:tag:edited"}}]}},'
              || '{"fieldPath":"ghost.x","globalTags":{"tags":[{"urn":"urn:li:tag:ghost"}]}},'
              || '{"fieldPath":"' || t || '.phone","globalTags":{"tags":[{"urn":"urn:li:tag:first"}]}},'
              || '{"fieldPath":"' || t || '.phone","globalTags":{"tags":[{"urn":"urn:li:tag:last"}]}}]}'
              END AS edits,
            CASE k % 3 WHEN 0 THEN 'null' WHEN 1 THEN '{"customProperties":null}'
              ELSE '{"customProperties":{"owner":"' || t || '"}}' END AS props
          FROM (SELECT k, urn, name, 't' || CAST(k AS string) AS t,
              CASE k % 9
                WHEN 0 THEN '{"tag":{"urn":"urn:li:tag:pii.email"}}'
                WHEN 1 THEN '{"urn":"urn:li:tag:plain"}'
                WHEN 2 THEN '{"tag":{},"urn":"urn:li:tag:own"}'
                WHEN 3 THEN '"urn:li:tag:bare"'
                WHEN 4 THEN '{"tag":null,"urn":"urn:li:tag:nulltag"}'
                WHEN 5 THEN '{"tag":{"urn":""}},{"urn":"urn:li:tag:second"}'
                WHEN 6 THEN '"bare",{"tag":{"urn":"urn:li:tag:mixed"}},{"tag":{"urn":"urn:li:tag:mixed"}}'
                WHEN 7 THEN ''
                ELSE '{"tag":"text","urn":"urn:li:tag:strtag"}' END AS entries
            FROM @fx_catalog) a) b""",
}

_REFERENCE = re.compile(r"@(" + "|".join([*VIEWS, *TABLES]) + r")\b")
_TOKEN = re.compile(r"@TOK\((\w+)\)")

SPARK_TOKEN = (
    r"('tok_' || replace(base64(CAST(\1 AS binary)), chr(13) || chr(10), '') || '_poc')"
)
DUCKDB_TOKEN = r"('tok_' || base64(encode(\1)) || '_poc')"


def with_views(sql: str, token: str, tables: dict[str, str]) -> str:
    """The query with the views it uses, directly or not, as common table expressions."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _REFERENCE.findall(_TOKEN.sub("", text)):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    parts = [f"{name} AS ({VIEWS[name]}\n)" for name in ordered]
    text = sql.lstrip()
    if parts and text.upper().startswith("WITH "):
        text = ", " + text[5:]
    full = ("WITH " + ",\n".join(parts) if parts else "") + "\n" + text
    full = _TOKEN.sub(token, full)
    return _REFERENCE.sub(lambda m: tables.get(m.group(1), m.group(1)), full)


def view(spark: SparkSession, sf_dir: str, name: str, **tables: str) -> DataFrame:
    """A view in Spark. ``tables`` maps given tables to other relations, such as a stream's view."""
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(with_views(f"SELECT * FROM @{name}", SPARK_TOKEN, {**files, **tables}))
