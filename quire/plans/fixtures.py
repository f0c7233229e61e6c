"""Inputs of the transcript queries, derived from the driver's tables.

Each is one SQL text that Spark and DuckDB both accept, so a query and its check share their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.session import ship

TABLES = ("documents", "conversations", "events", "orders", "lineitem", "labels", "customer")

#: Pages of documents (a source's rows, so a document grows with the table), some layers damaged, copies of some damaged pages.
PAGES = """
WITH base AS (
    SELECT source AS doc, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS page_number, doc_id,
           CASE WHEN doc_id % 11 = 0 THEN translate(text, 'aeiouyAEIOUY', 'bcdfghBCDFGH') ELSE text END AS embedded_text,
           CASE WHEN doc_id % 4 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST((doc_id * 37) % 100 AS DOUBLE) / 100 + CAST(0.01 AS DOUBLE) END AS ink
    FROM documents
)
SELECT doc, page_number, doc_id, embedded_text, ink FROM base
UNION ALL
SELECT doc, page_number + 1000000 AS page_number, doc_id, embedded_text, ink FROM base WHERE doc_id % 22 = 11
"""

#: One engine's results: empty, looping, truncated and symbol-only pages among good ones.
RESULTS = """
SELECT source AS doc, CAST(doc_id AS BIGINT) AS page_number, 'vision_a' AS engine_id,
       CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 19 = 0 THEN repeat('the same line again' || chr(10), 8)
            WHEN doc_id % 23 = 0 THEN repeat('## ++ == ', 12) WHEN doc_id % 29 = 0 THEN 'Total' ELSE text END AS text,
       CASE WHEN doc_id % 31 = 0 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN doc_id % 17 = 0 THEN 'length' ELSE 'stop' END AS done_reason,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST((doc_id * 37) % 100 AS DOUBLE) / 100 END AS ink
FROM documents
"""

#: Three engines that share some pages of each document.
ENGINES = """
WITH base AS (
    SELECT source AS doc, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS page_number, doc_id, text FROM documents
), e AS (
    SELECT 'text_layer' AS engine_id, 0 AS engine_ord, 'success' AS engine_status
    UNION ALL SELECT 'vision_a', 1, 'success' UNION ALL SELECT 'vision_b', 2, 'partial'
    UNION ALL SELECT 'classic', 3, 'failed' UNION ALL SELECT 'routing', 4, 'success'
)
SELECT doc, page_number, doc_id, engine_id, engine_ord, engine_status,
       CASE WHEN engine_ord = 2 AND doc_id % 5 = 0 THEN '' WHEN engine_ord = 1 THEN text || chr(10) || 'page ' || CAST(page_number AS VARCHAR(20)) ELSE text END AS text,
       CASE WHEN engine_ord = 2 AND doc_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status
FROM base CROSS JOIN e
WHERE (engine_ord = 0 AND page_number % 3 <> 0) OR (engine_ord = 1 AND page_number % 2 = 0) OR (engine_ord = 2 AND page_number % 4 <> 1)
   OR (engine_ord = 3 AND page_number % 2 = 1) OR (engine_ord = 4 AND page_number % 9 = 0)
"""

#: Lines of invoices in two readings: B drops, edits or pads lines by their number.
INVOICE_LINES = """
WITH n AS (
    SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS line_no,
           l_partkey, l_suppkey, CAST(CAST(l_quantity AS DECIMAL(15, 2)) AS VARCHAR(20)) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS VARCHAR(20)) AS price
    FROM lineitem
)
SELECT doc, line_no, 'row ' || CAST(line_no AS VARCHAR(20)) || ' | part number ' || CAST(l_partkey AS VARCHAR(20)) || ' | supplier number ' || CAST(l_suppkey AS VARCHAR(20)) || ' | quantity ' || quantity || ' | amount due ' || price AS line_a,
       CASE WHEN line_no % 7 = 0 THEN NULL
            WHEN line_no % 5 = 0 THEN 'row ' || CAST(line_no AS VARCHAR(20)) || ' | part number ' || CAST(l_partkey AS VARCHAR(20)) || ' | supplier number ' || CAST(l_suppkey AS VARCHAR(20)) || ' | quantity ' || quantity || ' | amount due ' || price || '7'
            WHEN line_no % 3 = 0 THEN 'row  ' || CAST(line_no AS VARCHAR(20)) || '  |  part number ' || CAST(l_partkey AS VARCHAR(20)) || '  | supplier number ' || CAST(l_suppkey AS VARCHAR(20)) || ' |  quantity ' || quantity || ' | amount due ' || price
            ELSE 'row ' || CAST(line_no AS VARCHAR(20)) || ' | part number ' || CAST(l_partkey AS VARCHAR(20)) || ' | supplier number ' || CAST(l_suppkey AS VARCHAR(20)) || ' | quantity ' || quantity || ' | amount due ' || price END AS line_b
FROM n
"""

#: Ledgers of very many lines in two readings, some lines the same all over: reading B drops, edits and pads lines.
LEDGERS = """
SELECT doc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, line AS line_a,
       CASE WHEN e = 0 THEN NULL WHEN e IN (1, 2) THEN line || '7' WHEN e IN (3, 4) THEN replace(line, ' of ', '  of  ') ELSE line END AS line_b
FROM (
    SELECT *, CASE WHEN e IN (10, 11) THEN 'carried forward' ELSE 'order ' || CAST(l_orderkey AS VARCHAR(20)) || ' line ' || CAST(l_linenumber AS VARCHAR(20)) || ' of part ' || CAST(l_partkey AS VARCHAR(20)) || ' of supplier ' || CAST(l_suppkey AS VARCHAR(20)) || ' amount due ' || CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS VARCHAR(20)) END AS line
    FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_suppkey % 3 AS BIGINT) AS doc, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 97 AS e FROM lineitem)
)
"""

#: Invoices of which reading B has the first line at the end.
MOVED_LINES = """
SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS line_no,
       count(*) OVER (PARTITION BY l_orderkey) AS n_lines, 'part ' || CAST(l_partkey AS VARCHAR(20)) || ' of supplier ' || CAST(l_suppkey AS VARCHAR(20)) || ' on line ' || CAST(l_linenumber AS VARCHAR(20)) || ' for ' || CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS VARCHAR(20)) AS line
FROM lineitem
"""

#: Long statements of up to 150 lines, every one changed in reading B: blocks that are paired by place.
STATEMENTS = """
SELECT CAST(floor((n - 1) / 150) AS BIGINT) AS doc, CAST((n - 1) % 150 AS BIGINT) AS line_no, 'order ' || CAST(o_orderkey AS VARCHAR(20)) || ' of customer ' || CAST(o_custkey AS VARCHAR(20)) AS line_a,
       CASE WHEN n % 10 = 0 THEN '?' ELSE 'order ' || CAST(o_orderkey AS VARCHAR(20)) || ' of customer ' || CAST(o_custkey AS VARCHAR(20)) || ' #' END AS line_b
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'P'))
"""

#: Ground truth and a reading of it that loses words and figures.
TRUTH = """
SELECT doc_id, source, text AS reference,
       CASE WHEN doc_id % 6 = 0 THEN text
            ELSE replace(translate(text, '05', '17'), ' the ', ' teh ') || ' (total: 1,250.00)' END AS hypothesis
FROM documents
"""

#: Raw engine outputs in their usual wrappings.
RAW = """
SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN '```markdown' || chr(10) || text || chr(10) || '```'
    WHEN 1 THEN 'Here is the transcription of the page:' || chr(10) || chr(10) || text
    WHEN 2 THEN text || chr(10) || chr(10) || 'Let me know if you need anything else!'
    WHEN 3 THEN 'Sure, here you go:' || chr(10) || '```' || chr(10) || text || '   ' || chr(13) || chr(10) || '```'
    ELSE text || chr(10) || chr(10) || chr(10) || chr(10) || text END AS raw
FROM documents
"""

#: Page timings: unknown for every tenth.
TIMINGS = """
SELECT CAST(user_id AS BIGINT) AS doc, event_type AS engine_id, event_id AS page_number,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE abs(value) END AS seconds,
       CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id % 5000 AS BIGINT) END AS input_tokens,
       CASE WHEN event_type = 'view' OR event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 700 AS BIGINT) END AS output_tokens
FROM events
"""

#: Batch jobs from orders.
JOBS = """
SELECT 'scans/' || CAST(o_custkey % 40 AS VARCHAR(20)) || '/file' || CAST(o_orderkey % 500 AS VARCHAR(20)) || '.pdf' AS source, CAST(o_custkey % 8 AS BIGINT) AS folder, o_orderkey AS job,
       CASE WHEN o_orderkey % 9 = 0 THEN 'review_required' WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'processing' END AS state,
       CAST(o_orderkey % 12 AS BIGINT) AS pages, CAST(o_orderkey % 300 AS DOUBLE) AS seconds, CAST(o_orderkey % 4 AS INTEGER) AS attempts,
       CASE WHEN o_orderkey % 17 = 0 THEN 'corrupt' ELSE NULL END AS load_error, CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' ELSE NULL END AS run_error, CAST(o_orderkey % 3 AS BIGINT) AS flagged
FROM orders
"""

FIXTURES = {"pages": PAGES, "results": RESULTS, "engines": ENGINES, "invoice_lines": INVOICE_LINES, "ledgers": LEDGERS, "moved_lines": MOVED_LINES, "statements": STATEMENTS, "truth": TRUTH, "raw": RAW, "timings": TIMINGS, "jobs": JOBS}


#: Fixtures whose pages are numbered within a source, of which there are few, so that a task would hold all texts of one.
DEALT = ("pages", "engines")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or one of the driver's tables by its own name, over the tables of ``sf_dir``."""
    ship(spark)
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name]
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql}
    for t in args:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    df = spark.sql(sql, **args)
    # numbering pages leaves a source's rows in one task; what reads the texts of pages gets them dealt out
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "page_number") if name in DEALT else df


def with_fixtures(sql: str) -> str:
    """DuckDB SQL in which ``{pages}`` and the like stand for the fixtures as subqueries."""
    for name, body in FIXTURES.items():
        sql = sql.replace("{" + name + "}", f"({body})")
    return sql
