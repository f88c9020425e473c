"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from .fixtures import DUCKDB_TOKEN, with_views

TOKEN_RE = r"'\Atok_[A-Za-z0-9+/=]+_poc\n?\z'"
_WS = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
EMAIL_RE = rf"'\A[^@{_WS}]+@[^@{_WS}]+\.[^@{_WS}]+\n?\z'"
PHONE_RE = rf"'\A[+0-9()\-{_WS}]{{7,}}\n?\z'"
URN_RE = r"'\Aurn:li:dataset:\((urn:li:dataPlatform:[^,]+),([^,]+),([^)]+)\)\n?\z'"

PII_SUFFIXES = ("pii", "pii.email", "pii.phone", "pii.contact", "sensitive")
NAMES = ("email", "e_mail", "phone", "mobile", "contact", "ssn", "aadhaar")
RUN = "'urn:li:tag:tokenize/run'"


def tok(value: str) -> str:
    return f"('tok_' || base64(encode({value})) || '_poc')"


def plain(value: str) -> str:
    return f"({value} IS NOT NULL AND NOT regexp_matches({value}, {TOKEN_RE}))"


def needed(value: str) -> str:
    return f"CASE WHEN {plain(value)} THEN {tok(value)} ELSE {value} END"


def leaf(path: str) -> str:
    return f"split_part({path}, '.', -1)"


def pii(tag: str) -> str:
    return "(" + " OR ".join(f"ends_with({tag}, '{s}')" for s in PII_SUFFIXES) + ")"


def contains_any(column: str, names: tuple[str, ...] = NAMES) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{n}')" for n in names) + ")"


ROW = f"({plain('email')} OR {plain('phone')})"

# effective tags, one row per tag
EFFECTIVE = """
  eff AS (
    SELECT k, field_path, tag FROM @fx_fields
    UNION
    SELECT f.k, f.field_path, e.tag FROM @fx_fields f
    JOIN @fx_editable e ON e.k = f.k AND e.field_path = f.field_path)"""

PROFILE = f"""
  prof AS (
    SELECT col, count(*) AS n,
      coalesce(bool_or(regexp_matches(val, {EMAIL_RE})), false) AS hit_email,
      coalesce(bool_or(regexp_matches(val, {PHONE_RE})), false) AS hit_phone
    FROM @fx_samples GROUP BY col)"""

HEURISTIC_SAMPLED = f"""
  names AS (SELECT DISTINCT k, {leaf('field_path')} AS column_name FROM @fx_fields),
  heur AS (
    SELECT k, column_name FROM names LEFT JOIN prof ON col = column_name
    WHERE (contains(lower(column_name), 'email') AND (n IS NULL OR n = 0 OR hit_email))
       OR (contains(lower(column_name), 'phone') AND (n IS NULL OR n = 0 OR hit_phone))
       OR {contains_any('column_name', ('e_mail', 'mobile', 'contact', 'ssn', 'aadhaar'))})"""

EXPLICIT = f"""
  expl AS (
    SELECT DISTINCT f.k, {leaf('f.field_path')} AS column_name
    FROM @fx_fields f JOIN @fx_scope s
      ON s.k = f.k AND (s.name = f.field_path OR s.name = {leaf('f.field_path')}))"""

TAGGED = f"""
  tagged AS (SELECT DISTINCT k, {leaf('field_path')} AS column_name FROM eff WHERE coalesce({pii('tag')}, false))"""

# targets of the requested datasets: scope from the run tags, no samples
REQUESTED = f"""
  whole AS (SELECT k FROM @fx_catalog WHERE global_tag = {RUN}),
  parts AS (SELECT DISTINCT k, field_path FROM @fx_fields
            WHERE tag = {RUN} AND k NOT IN (SELECT k FROM whole)),
  asked AS (SELECT k FROM whole UNION SELECT k FROM parts),
  targets AS (
    SELECT DISTINCT f.k, {leaf('f.field_path')} AS column_name FROM @fx_fields f
    WHERE CASE
      WHEN f.k IN (SELECT k FROM parts) THEN (f.k, f.field_path) IN (SELECT (k, field_path) FROM parts)
      WHEN f.k NOT IN (SELECT k FROM whole) THEN false
      WHEN f.k IN (SELECT k FROM tagged)
        THEN (f.k, {leaf('f.field_path')}) IN (SELECT (k, column_name) FROM tagged)
      ELSE {contains_any(leaf('f.field_path'))} END)"""

CSV = "array_to_string(list_sort(list_distinct(list(tag) FILTER (tag IS NOT NULL))), ',')"

RUNS = """
  run_rows AS (
    SELECT *, array_to_string(list_sort(list_filter(string_split(columns, ','), lambda c: c <> '')), ',') AS cols,
      strftime(started_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(started_at) % 1000000 = 0 THEN ''
        ELSE strftime(started_at, '.%f') END AS iso
    FROM @fx_runs),
  latest AS (SELECT * FROM run_rows QUALIFY row_number() OVER (PARTITION BY urn ORDER BY seq DESC) = 1)"""

STATE = """
  SELECT urn, field_path, tag FROM @fx_tagevents GROUP BY urn, field_path, tag
  HAVING arg_max(op, seq) = 'add'"""

TAG_SET = """
  array_to_string(list_sort(list_distinct(list_filter(list_transform(
    coalesce(json_extract({0}, '$.globalTags.tags[*]'), []),
    lambda e: CASE WHEN json_type(e) <> 'OBJECT' THEN NULL
              WHEN json_type(e, '$.tag') = 'OBJECT' THEN json_extract_string(e, '$.tag.urn')
              ELSE json_extract_string(e, '$.urn') END),
    lambda u: u IS NOT NULL AND u <> ''))), ',')"""

JSON_DOCS = """
  docs AS (SELECT k, urn, CAST(payload AS JSON) AS doc FROM @fx_payload WHERE payload <> 'null')"""

STRING_COLUMNS = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
}


def _profile_of(table: str, column: str) -> str:
    return f"""
  SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS n,
    unnest(['email', 'phone']) AS validator,
    unnest([coalesce(bool_or(regexp_matches({column}, {EMAIL_RE})), false),
            coalesce(bool_or(regexp_matches({column}, {PHONE_RE})), false)]) AS any_match
  FROM @{table}"""


def _sample_of(table: str, column: str) -> str:
    return f"""
  SELECT '{table}' AS table_name, '{column}' AS column_name, hash, n,
    regexp_matches(v, {EMAIL_RE}) AS hit_email, regexp_matches(v, {PHONE_RE}) AS hit_phone
  FROM (SELECT md5({column}) AS hash, {column} AS v, count(*) AS n FROM @{table}
        WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY hash LIMIT 100)
  UNION ALL SELECT '{table}', '{column}', NULL, count(*), false, false FROM @{table}"""


_SQL = {
    "tokenize_customers": f"""
SELECT id, {needed('email')} AS email, {needed('phone')} AS phone, city FROM @fx_customers""",
    "tokenize_documents": f"SELECT doc_id, {needed('text')} AS text, lang FROM @documents",
    "tokenize_limited": f"""
WITH picked AS (SELECT id FROM @fx_customers WHERE {ROW} ORDER BY id LIMIT 100)
SELECT id,
  CASE WHEN id IN (SELECT id FROM picked) THEN {needed('email')} ELSE email END AS email,
  CASE WHEN id IN (SELECT id FROM picked) THEN {needed('phone')} ELSE phone END AS phone,
  city
FROM @fx_customers""",
    "token_candidates": f"SELECT id, email, phone FROM @fx_customers WHERE {ROW}",
    "token_flags": f"""
SELECT id, coalesce(regexp_matches(v, {TOKEN_RE}), false) AS is_token, {tok('v')} AS token,
  {needed('v')} AS if_needed
FROM @fx_edge""",
    "tokenize_arrays": f"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {tok('x')}), ',') AS tokens
FROM @documents""",
    "run_metrics": f"""
SELECT count(*) AS rows_scanned, count(*) FILTER ({ROW}) AS rows_updated,
  CAST(0 AS BIGINT) AS rows_skipped, count(*) FILTER (NOT {ROW}) AS rows_clean,
  count(*) FILTER ({plain('email')}) + count(*) FILTER ({plain('phone')}) AS cells_updated,
  CAST(0 AS BIGINT) AS rows_remaining
FROM @fx_customers""",
    "run_metrics_limited": f"""
WITH picked AS (SELECT * FROM @fx_customers WHERE {ROW} ORDER BY id LIMIT 100)
SELECT (SELECT count(*) FROM @fx_customers) AS rows_scanned, count(*) AS rows_updated,
  CAST(0 AS BIGINT) AS rows_skipped,
  (SELECT count(*) FROM @fx_customers WHERE NOT {ROW}) AS rows_clean,
  count(*) FILTER ({plain('email')}) + count(*) FILTER ({plain('phone')}) AS cells_updated,
  (SELECT count(*) FROM @fx_customers WHERE {ROW}) - count(*) AS rows_remaining
FROM picked""",
    "remaining_plaintext": f"""
SELECT 'email' AS column_name, count(*) FILTER ({plain('email')}) AS remaining FROM @fx_customers
UNION ALL
SELECT 'phone' AS column_name, count(*) FILTER ({plain('phone')}) AS remaining FROM @fx_customers""",
    "idempotency_report": f"""
WITH p1 AS (SELECT email, phone FROM @fx_customers),
  p2 AS (SELECT {needed('email')} AS email, {needed('phone')} AS phone FROM p1),
  p3 AS (SELECT {needed('email')} AS email, {needed('phone')} AS phone FROM p2),
  p4 AS (SELECT {needed('email')} AS email, {needed('phone')} AS phone FROM p3)
SELECT 1 AS pass_no, count(*) FILTER ({ROW}) AS rows_updated FROM p1
UNION ALL SELECT 2 AS pass_no, count(*) FILTER ({ROW}) AS rows_updated FROM p2
UNION ALL SELECT 3 AS pass_no, count(*) FILTER ({ROW}) AS rows_updated FROM p3
UNION ALL SELECT 4 AS pass_no, count(*) FILTER ({ROW}) AS rows_updated FROM p4""",
    "sql_tokenize": f"""
SELECT id, {needed('email')} AS email, coalesce(regexp_matches(phone, {TOKEN_RE}), false) AS phone_is_token
FROM @fx_customers""",
    "tokenize_mode": f"""
SELECT id, CASE WHEN {plain('email')} THEN 'tok_' || sha256(email) || '_poc' ELSE email END AS email
FROM @fx_customers""",
    "seed_rows": """
SELECT c_custkey AS id, 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
  '+1-555-' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS phone
FROM @customer""",
    "parse_urns": f"""
WITH m AS (
    SELECT k, urn, split_part(regexp_extract(urn, {URN_RE}, 1), ':', -1) AS platform,
      string_split(regexp_extract(urn, {URN_RE}, 2), '.') AS p, regexp_extract(urn, {URN_RE}, 3) AS env
    FROM @fx_catalog WHERE regexp_matches(urn, {URN_RE})),
  r AS (
    SELECT k, urn, platform,
      CASE WHEN len(p) = 2 THEN 'default' ELSE p[1] END AS database,
      CASE WHEN len(p) = 2 THEN p[1] ELSE p[2] END AS schema_name,
      CASE WHEN len(p) = 2 THEN p[2] ELSE array_to_string(p[3:], '.') END AS table_name, env
    FROM m WHERE len(p) >= 2)
SELECT *, CASE WHEN platform = 'databricks'
    THEN '`' || database || '`.`' || schema_name || '`.`' || table_name || '`'
    ELSE schema_name || '.' || table_name END AS table_expression
FROM r""",
    "invalid_urns": f"""
SELECT k, urn, CASE WHEN NOT regexp_matches(urn, {URN_RE}) THEN 'pattern' ELSE 'parts' END AS reason
FROM @fx_catalog
WHERE NOT regexp_matches(urn, {URN_RE}) OR NOT contains(regexp_extract(urn, {URN_RE}, 2), '.')""",
    "leaf_columns": f"SELECT k, pos, {leaf('field_path')} AS column_name FROM @fx_fields",
    "field_map": f"""
SELECT k, {leaf('field_path')} AS column_name, arg_min(field_path, pos) AS field_path
FROM @fx_fields GROUP BY 1, 2""",
    "effective_tags": f"""
WITH {EFFECTIVE}
SELECT k, field_path, coalesce({CSV}, '') AS tags FROM eff GROUP BY k, field_path""",
    "catalog_from_json": f"""
WITH {JSON_DOCS},
  f AS (SELECT urn, unnest(json_extract(doc, '$.schemaMetadata.fields[*]')) AS f FROM docs),
  e AS (SELECT urn, unnest(json_extract(doc, '$.editableSchemaMetadata.editableSchemaFieldInfo[*]')) AS e,
          generate_subscripts(json_extract(doc, '$.editableSchemaMetadata.editableSchemaFieldInfo[*]'), 1) AS pos
        FROM docs),
  edits AS (SELECT urn, json_extract_string(e, '$.fieldPath') AS field_path, arg_max({TAG_SET.format('e')}, pos) AS more
            FROM e GROUP BY 1, 2),
  base AS (SELECT urn, json_extract_string(f, '$.fieldPath') AS field_path,
             json_extract_string(f, '$.nativeDataType') AS native_data_type, {TAG_SET.format('f')} AS tags FROM f)
SELECT urn, field_path, native_data_type,
  array_to_string(list_sort(list_distinct(list_filter(
    string_split(tags, ',') || string_split(coalesce(more, ''), ','), lambda t: t <> ''))), ',') AS tags
FROM base LEFT JOIN edits USING (urn, field_path)
WHERE field_path <> ''""",
    "datasets_from_json": f"""
WITH {JSON_DOCS}
SELECT urn, json_extract_string(doc, '$.name') AS name, {TAG_SET.format('doc')} AS global_tags,
  json_extract_string(doc, '$.editableProperties.customProperties.owner') AS owner
FROM docs""",
    "search_dataset": """
SELECT k, urn FROM @fx_catalog
WHERE platform = 'databricks' AND contains(lower(name), 'public.t13')
ORDER BY CASE WHEN lower(name) = 'public.t13' THEN 1 WHEN ends_with(lower(name), 'public.t13') THEN 2 ELSE 3 END,
  urn
LIMIT 1""",
    "allowlist_datasets": """
SELECT k, urn FROM (SELECT k, urn, string_split(name, '.') AS p FROM @fx_catalog)
WHERE len(p) >= 2 AND CASE WHEN len(p) = 2 THEN p[1] ELSE p[2] END = 'public'
  AND starts_with(CASE WHEN len(p) = 2 THEN p[2] ELSE array_to_string(p[3:], '.') END, 't1')""",
    "list_datasets": """
SELECT urn FROM @fx_catalog WHERE urn > 'urn:li:dataset:(urn:li:dataPlatform:mysql,' ORDER BY urn LIMIT 50""",
    "run_requests": f"""
SELECT k, CAST(NULL AS VARCHAR) AS field_path FROM @fx_catalog WHERE global_tag = {RUN}
UNION ALL
SELECT DISTINCT k, field_path FROM @fx_fields WHERE tag = {RUN}
  AND k NOT IN (SELECT k FROM @fx_catalog WHERE global_tag = {RUN})""",
    "tagged_field_counts": f"""
SELECT k, count(DISTINCT field_path) AS n FROM @fx_fields WHERE tag = {RUN} GROUP BY k""",
    "crawl_catalog": """
SELECT DISTINCT table_name, CAST(ordinal_position - 1 AS INTEGER) AS pos, column_name,
  CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz'
       WHEN data_type = 'FLOAT[]' THEN 'array<float>' WHEN data_type = 'DOUBLE[]' THEN 'array<double>'
       WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'VARCHAR' THEN 'string'
       ELSE lower(data_type) END AS data_type
FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
  'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')""",
    "crawl_evolved": """
WITH kinds AS (
  SELECT column_name, CASE WHEN data_type = 'INTEGER' THEN 'int' ELSE lower(data_type) END AS kind
  FROM information_schema.columns WHERE table_name = 'orders'),
own AS (SELECT max(kind) FILTER (column_name = 'o_orderkey') AS id, max(kind) FILTER (column_name = 'o_custkey') AS customer,
  max(kind) FILTER (column_name = 'o_totalprice') AS price FROM kinds)
SELECT 'orders' AS table_name, CAST(pos AS INTEGER) AS pos, column_name, data_type
FROM own, LATERAL (VALUES (0, 'o_orderkey', id),
  (1, 'customer', 'struct<o_custkey:' || customer || ',o_totalprice:' || price || '>'),
  (2, 'customer.o_custkey', customer), (3, 'customer.o_totalprice', price), (4, 'late', 'boolean'),
  (5, 'o_orderstatus', 'string')) t(pos, column_name, data_type)
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_orderstatus != 'F')""",
    "detect_explicit": f"WITH {EXPLICIT} SELECT k, column_name FROM expl",
    "detect_tagged": f"WITH {EFFECTIVE}, {TAGGED} SELECT k, column_name FROM tagged",
    "detect_tagged_boundary": f"""
WITH {EFFECTIVE}
SELECT DISTINCT k, {leaf('field_path')} AS column_name FROM eff
WHERE tag IN ('urn:li:tag:pii', 'urn:li:tag:pii.email', 'urn:li:tag:pii.phone', 'urn:li:tag:pii.contact',
  'urn:li:tag:sensitive')""",
    "detect_heuristic": f"""
SELECT DISTINCT k, {leaf('field_path')} AS column_name FROM @fx_fields
WHERE {contains_any(leaf('field_path'))}""",
    "detect_custom_rules": f"""
SELECT DISTINCT k, {leaf('field_path')} AS column_name FROM @fx_fields
WHERE {contains_any(leaf('field_path'), ('city', 'addr'))}""",
    "detector_rules": rf"""
WITH rules AS (
  SELECT * FROM (VALUES ('email', '^[^@\s]+@[^@\s]+\.[^@\s]+$'), ('e_mail', NULL),
    ('phone', '^[+0-9()\-\s]{{7,}}$'), ('mobile', NULL), ('contact', NULL), ('ssn', NULL),
    ('aadhaar', NULL)) r(pattern, validator))
SELECT pattern, validator, count(k) AS fields
FROM rules LEFT JOIN @fx_fields ON contains(lower({leaf('field_path')}), pattern)
GROUP BY pattern, validator""",
    "sample_profile": f"""
WITH {PROFILE}
SELECT col, n, 'email' AS validator, hit_email AS any_match FROM prof
UNION ALL SELECT col, n, 'phone' AS validator, hit_phone AS any_match FROM prof""",
    "detect_custom_validators": r"""
WITH prof AS (
  SELECT col, count(*) AS n,
    coalesce(bool_or(regexp_matches(val, '\Au\p{Nd}+@[\p{L}\p{N}]+\.com\z')), false) AS email,
    coalesce(bool_or(regexp_matches(val, '\A([^\s@]{3}-a-|\+1-(000|111|222|333|444|555|666|777|888|999)-\p{Nd}{4}\n?\z)')), false) AS phone,
    coalesce(bool_or(regexp_matches(val, '\A\+\p{Nd}{1,3}-')), false) AS mobile
  FROM @fx_samples GROUP BY col)
SELECT col, n, unnest(['email', 'phone', 'mobile']) AS validator, unnest([email, phone, mobile]) AS any_match FROM prof""",
    "tokenize_limited_large": f"""
WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS email FROM @orders),
  first AS (SELECT id FROM r WHERE {plain('email')} ORDER BY id LIMIT 12000)
SELECT id, CASE WHEN id IN (SELECT id FROM first) THEN {tok('email')} ELSE email END AS email FROM r""",
    "detect_many_patterns": """
WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS name FROM @documents),
  patterns AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS pattern FROM @benchmark)
SELECT name, count(*) AS n_patterns FROM names JOIN patterns ON contains(lower(name), pattern) GROUP BY name""",
    "sample_profile_numeric": f"""
SELECT col, count(*) AS n, unnest(['email', 'phone']) AS validator,
  unnest([bool_or(regexp_matches(CAST(val AS VARCHAR), {EMAIL_RE})),
          bool_or(regexp_matches(CAST(val AS VARCHAR), {PHONE_RE}))]) AS any_match
FROM @fx_numbers GROUP BY col""",
    "profile_tables": "\nUNION ALL".join(
        _profile_of(t, c) for t, columns in STRING_COLUMNS.items() for c in columns
    ),
    "profile_bottom_k": "\nUNION ALL".join(
        _sample_of(t, c) for t, columns in STRING_COLUMNS.items() for c in columns
    ),
    "detect_with_samples": f"""
WITH {PROFILE}, {HEURISTIC_SAMPLED}
SELECT k, column_name FROM heur""",
    "detect_all": f"""
WITH {PROFILE}, {HEURISTIC_SAMPLED}, {EXPLICIT}, {EFFECTIVE}, {TAGGED},
  tiers AS (
    SELECT k, CASE WHEN k IN (SELECT k FROM @fx_scope WHERE name IS NOT NULL) THEN 'explicit'
                   WHEN k IN (SELECT k FROM tagged) THEN 'tag' ELSE 'heuristic' END AS tier
    FROM @fx_catalog),
  found AS (
    SELECT 'explicit' AS tier, k, column_name FROM expl
    UNION ALL SELECT 'tag' AS tier, k, column_name FROM tagged
    UNION ALL SELECT 'heuristic' AS tier, k, column_name FROM heur)
SELECT k, tier, column_name FROM tiers LEFT JOIN found USING (k, tier)""",
    "apply_success_tags": f"""
WITH {EFFECTIVE}, {TAGGED}, {REQUESTED},
  base AS (
    SELECT k, '' AS field_path, global_tag AS tag FROM @fx_catalog
    UNION ALL SELECT k, field_path, tag FROM eff),
  kept AS (
    SELECT k, field_path, CASE
      WHEN k IN (SELECT k FROM asked) AND tag = {RUN} THEN NULL
      WHEN k IN (SELECT k FROM asked) AND field_path = '' AND tag = 'urn:li:tag:tokenize/status:FAILED' THEN NULL
      ELSE tag END AS tag FROM base),
  added AS (
    SELECT k, '' AS field_path, unnest(['urn:li:tag:tokenize/done', 'urn:li:tag:tokenize/status:SUCCESS']) AS tag
    FROM asked
    UNION ALL
    SELECT f.k, f.field_path, 'urn:li:tag:tokenized' FROM @fx_fields f
    WHERE (f.k, {leaf('f.field_path')}) IN (SELECT (k, column_name) FROM targets))
SELECT k, field_path, coalesce({CSV}, '') AS tags
FROM (SELECT * FROM kept UNION ALL SELECT * FROM added) GROUP BY k, field_path""",
    "catalog_changes": f"""
WITH {EFFECTIVE}, {TAGGED}, {REQUESTED},
  base AS (
    SELECT k, '' AS field_path, global_tag AS tag FROM @fx_catalog WHERE global_tag IS NOT NULL
    UNION SELECT k, field_path, tag FROM eff WHERE tag IS NOT NULL),
  added AS (
    SELECT k, '' AS field_path, unnest(['urn:li:tag:tokenize/done', 'urn:li:tag:tokenize/status:SUCCESS']) AS tag
    FROM asked
    UNION
    SELECT f.k, f.field_path, 'urn:li:tag:tokenized' FROM @fx_fields f
    WHERE (f.k, {leaf('f.field_path')}) IN (SELECT (k, column_name) FROM targets))
SELECT k, field_path, tag, 'add' AS op FROM (SELECT * FROM added EXCEPT SELECT * FROM base)
UNION ALL
SELECT k, field_path, tag, 'remove' AS op FROM base
WHERE k IN (SELECT k FROM asked)
  AND (tag = {RUN} OR field_path = '' AND tag = 'urn:li:tag:tokenize/status:FAILED')""",
    "apply_failure_tags": f"""
WITH {EFFECTIVE}, {TAGGED}, {REQUESTED},
  base AS (
    SELECT k, '' AS field_path, global_tag AS tag FROM @fx_catalog
    UNION ALL SELECT k, field_path, tag FROM eff
    UNION ALL SELECT k, '' AS field_path, 'urn:li:tag:tokenize/status:FAILED' AS tag FROM asked)
SELECT k, field_path, coalesce({CSV}, '') AS tags FROM base
WHERE tag IS NULL OR NOT (field_path = '' AND tag = 'urn:li:tag:tokenize/status:SUCCESS'
                          AND k IN (SELECT k FROM asked))
GROUP BY k, field_path""",
    "tag_state": STATE,
    "latest_runs": f"""
WITH {RUNS}
SELECT urn, run_id, iso AS started_at, status, CAST(rows_updated AS BIGINT) AS rows_updated FROM latest""",
    "run_outcomes": f"""
WITH {RUNS}
SELECT u.urn, CASE status WHEN 'SUCCESS' THEN 'done' WHEN 'FAILED' THEN 'failed' ELSE 'waiting' END AS outcome
FROM (SELECT DISTINCT urn FROM @fx_tagevents) u LEFT JOIN latest USING (urn)""",
    "status_properties": f"""
WITH {RUNS}
SELECT urn, run_id, iso AS started_at, CAST(NULL AS VARCHAR) AS ended_at, status, cols AS columns,
  CAST(rows_updated AS BIGINT) AS rows_updated, urn AS owner
FROM latest""",
    "run_messages": f"""
WITH {RUNS}
SELECT run_id, CASE WHEN cols = '' THEN 'No PII columns detected; nothing to tokenise.'
  ELSE 'Tokenised columns ' || replace(cols, ',', ', ') || '; updated ' || CAST(rows_updated AS VARCHAR)
       || ' rows, skipped ' || CAST(rows_skipped AS VARCHAR) || '.' END AS message
FROM run_rows WHERE status = 'SUCCESS'""",
    "process_runs": f"""
WITH counts AS (
  SELECT (SELECT count(*) FROM @fx_customers WHERE {ROW}) AS customers,
         (SELECT count(*) FROM @events WHERE {plain('event_type')}) AS events,
         (SELECT count(*) FROM @documents WHERE {plain('text')}) AS documents),
  runs AS (
  SELECT 'postgres' AS platform, 'customers' AS name, 'SUCCESS' AS status, customers AS rows_updated,
    'email,phone' AS columns FROM counts
  UNION ALL SELECT 'postgres', 'parts', 'SUCCESS', 0, '' FROM counts
  UNION ALL SELECT 'postgres', 'numbers', 'FAILED', 0, 'phone' FROM counts
  UNION ALL SELECT 'mysql', 'legacy_customers', 'FAILED', 0, 'email' FROM counts
  UNION ALL SELECT 'databricks', 'events', 'SUCCESS', events, 'event_type' FROM counts
  UNION ALL SELECT 'databricks', 'documents', 'SUCCESS', documents, 'body' FROM counts)
SELECT 'urn:li:dataset:(urn:li:dataPlatform:' || platform || ',main.public.' || name || ',PROD)' AS urn,
  status, CAST(rows_updated AS BIGINT) AS rows_updated, columns,
  CASE WHEN name = 'numbers' THEN 'Only string columns can be tokenized: phone is bigint'
       WHEN platform = 'mysql' THEN 'Unsupported platform: mysql'
       WHEN columns = '' THEN 'No PII columns detected; nothing to tokenise.'
       ELSE 'Tokenised columns ' || replace(columns, ',', ', ') || '; updated '
            || CAST(rows_updated AS VARCHAR) || ' rows, skipped 0.' END AS message
FROM runs""",
    "process_partitioned": f"SELECT id, {needed('email')} AS email, note, hour FROM @fx_shipments",
    "published_tables": f"""
SELECT 'customers' AS name, id, {needed('email')} AS email, {needed('phone')} AS phone FROM @fx_customers
UNION ALL SELECT 'shipments' AS name, id, {needed('email')} AS email, hour AS phone FROM @fx_shipments""",
    "cycle_properties": f"""
WITH counts AS (SELECT count(*) AS n FROM @fx_customers WHERE {ROW}),
  runs AS (
  SELECT 'customers' AS name, 'SUCCESS' AS status, n AS rows_updated, 'email,phone' AS columns,
    'Tokenised columns email, phone; updated ' || CAST(n AS VARCHAR) || ' rows, skipped 0.' AS message,
    'urn:li:tag:tokenize/done,urn:li:tag:tokenize/status:SUCCESS' AS tags FROM counts
  UNION ALL SELECT 'numbers', 'FAILED', 0, 'phone', 'Only string columns can be tokenized: phone is bigint',
    'urn:li:tag:tokenize/run,urn:li:tag:tokenize/status:FAILED' FROM counts
  UNION ALL SELECT 'parts', NULL, -1, NULL, NULL, '' FROM counts)
SELECT 'urn:li:dataset:(urn:li:dataPlatform:postgres,main.public.' || name || ',PROD)' AS urn, tags, status,
  CAST(rows_updated AS BIGINT) AS rows_updated, columns, message
FROM runs""",
    "stream_runs": """
SELECT 'urn:li:dataset:(urn:li:dataPlatform:postgres,main.public.' || name || ',PROD)' AS urn, field_path,
  'urn:li:tag:' || tag AS tag
FROM (VALUES ('customers', '', 'tokenize/done'), ('customers', '', 'tokenize/status:SUCCESS'),
  ('customers', 'email', 'tokenized'), ('customers', 'phone', 'tokenized'),
  ('numbers', '', 'tokenize/run'), ('numbers', '', 'tokenize/status:FAILED'),
  ('parts', '', 'tokenize/done'), ('parts', '', 'tokenize/status:SUCCESS')) t(name, field_path, tag)
WHERE EXISTS (SELECT 1 FROM @customer)""",
    "stream_tokenize": f"SELECT event_id, event_type, {needed('props')} AS props FROM @events",
    "stream_requests": STATE,
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, DUCKDB_TOKEN, {}) for name, sql in _SQL.items()}
