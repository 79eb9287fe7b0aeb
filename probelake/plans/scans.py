"""Queries over scans, sinks and source predicates, each with its own SQL.

Records are written from a driver table and read back by the operators; the SQL reads
the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.functions import python_source, python_values
from probelake.functions import text as T
from probelake.operators import keys, reports
from probelake.plans.stand_ins import query, rounded, table
from probelake.sources import records, scratch

_ORDER = "task_id string, price bigint, half string"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines, in order; every tenth line is malformed and every ninth blank."""
    o = table(spark, sf_dir, "orders").withColumn("repo", (F.col("o_custkey") % 3).cast("string")).withColumn(
        "half", F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed")
    )
    good = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("task_id"), F.round("o_totalprice").cast("long").alias("price"), "half"
        )
    )
    line = F.when(
        F.col("o_orderkey") % 10 == 0, F.concat(F.lit("{bad "), F.col("o_orderkey").cast("string"))
    ).when(F.col("o_orderkey") % 9 == 0, "").otherwise(good)
    return o.select("half", "repo", "o_orderkey", line.alias("value"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Files <half>/<repo>.jsonl of these lines."""
    root, lines = scratch.scratch_folder(spark, "lines"), _lines(spark, sf_dir)
    for half in ("open", "closed"):
        for repo in "012":
            own = lines.where((F.col("half") == half) & (F.col("repo") == repo)).coalesce(1).sortWithinPartitions("o_orderkey")
            own.select("value").write.text(f"{root}/parts")
            scratch.move_only_part(spark, f"{root}/parts", f"{root}/{half}/{repo}.jsonl")
    return root


_KEPT = "SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CAST(round(o_totalprice) AS BIGINT) AS price, CAST(o_custkey % 3 AS VARCHAR) AS reponame, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS half FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 9 <> 0"


@query(_KEPT)
def records_skipping_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.read_records(spark, [f"{_written(spark, sf_dir)}/*/*.jsonl", "/nowhere/*.jsonl"], _ORDER)
    return records.with_path_columns(found.drop("half"), "half").select("task_id", "price", "reponame", "half")


@query(_KEPT)
def records_of_a_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.read_records(spark, _written(spark, sf_dir), _ORDER, recursive=True)
    return records.with_path_columns(found).select("task_id", "price", "reponame", "half")


@query(
    """
    SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS half, CAST(o_custkey % 3 AS VARCHAR) AS reponame, count(*) FILTER (o_orderkey % 10 = 0) AS bad_lines FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 9 <> 0 GROUP BY ALL
    """
)
def bad_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.read_records(spark, f"{_written(spark, sf_dir)}/*/*.jsonl", _ORDER, "keep")
    return records.with_path_columns(records.bad_line_counts(found), "half").select("half", "reponame", "bad_lines")


@query(
    """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'O', o_custkey % 3 ORDER BY o_orderkey) - 1 AS line_no FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CAST(round(o_totalprice) AS BIGINT) AS price, CAST(o_custkey % 3 AS VARCHAR) AS reponame, CAST(line_no AS INTEGER) AS line_no FROM n WHERE o_orderkey % 10 <> 0 AND o_orderkey % 9 <> 0
    """
)
def records_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.read_ordered_records(spark, f"{_written(spark, sf_dir)}/*/*.jsonl", _ORDER)
    return records.with_path_columns(found).select("task_id", "price", "reponame", "line_no")


@query("SELECT event_id, event_type, CAST(user_id AS BIGINT) AS user_id FROM events")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each event type holds all its events as one array."""
    root = scratch.scratch_folder(spark, "arrays")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.to_json(
            F.collect_list(F.struct("event_id", "event_type", F.col("user_id").cast("long").alias("user_id")))
        ).alias("value")
    )
    e.repartition(8, "event_type").write.partitionBy("event_type").text(root)
    return records.read_json_arrays(
        spark, f"{root}/*", "event_id bigint, event_type string, user_id bigint"
    ).select("event_id", "event_type", "user_id")


@query(
    "SELECT c_mktsegment AS condition, CAST(c_nationkey AS VARCHAR) AS reponame, c_custkey, round(c_acctbal, 2) AS balance FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR), c_custkey, 0.0 FROM customer WHERE c_mktsegment = 'BUILDING'"
)
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a tree of conditions and repositories; one condition is then written again."""
    root = scratch.scratch_folder(spark, "tree")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("condition"), F.col("c_nationkey").cast("string").alias("reponame"), "c_custkey",
        F.round("c_acctbal", 2).alias("balance")
    )
    records.write_records(c, root, ("condition", "reponame"))
    again = c.where("condition = 'BUILDING'").withColumn("balance", F.lit(0.0)).drop("condition")
    records.write_records(again, f"{root}/condition=BUILDING", ("reponame",))
    schema = "c_custkey bigint, balance double, condition string, reponame string"
    return spark.read.schema(schema).json(root)


@query(
    "SELECT o_orderkey, o_orderkey % 5 AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'stop' END AS finish_reason, 1 AS round FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderkey % 5, 'stop', 2 FROM orders WHERE o_orderkey % 2 = 1 OR o_orderstatus = 'F'"
)
def resumable_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the work is there, some of it as errors; the second round adds what is missing or failed."""
    root = scratch.scratch_folder(spark, "appended")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("sample_id"), "o_orderstatus")
    reason = F.when(F.col("o_orderstatus") == "F", "error").otherwise("stop")
    records.append_missing(
        spark,
        o.where("o_orderkey % 2 = 0").select("o_orderkey", "sample_id", reason.alias("finish_reason"), F.lit(1).alias("round")),
        root, ("o_orderkey", "sample_id")
    )
    second = o.select("o_orderkey", "sample_id", F.lit("stop").alias("finish_reason"), F.lit(2).alias("round"))
    records.append_missing(spark, second, root, ("o_orderkey", "sample_id"), retry_errors=True)
    return spark.read.parquet(root)


@query(
    """
    WITH r AS (SELECT coalesce(event_type, '?') AS reason, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL)
    SELECT reason, n, (SELECT count(*) FROM events) AS total FROM r
    """
)
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report as a JSON object that is written and read again."""
    root = scratch.scratch_folder(spark, "report")
    analysis = F.struct(
        F.lit(1).alias("complexity_score"), (F.col("value") >= 20).alias("is_quality"), F.col("event_type").alias("reason")
    )
    e = table(spark, sf_dir, "events").select(F.lit("r").alias("reponame"), analysis.alias("quality_analysis"))
    records.write_report(spark, reports.quality_report(e), root)
    text = spark.read.text(root, wholetext=True).select(
        F.from_json("value", "total_assertions bigint, filter_reasons map<string, bigint>").alias("r")
    )
    return text.select(F.explode("r.filter_reasons").alias("reason", "n"), F.col("r.total_assertions").alias("total"))


_SHOWN = """
    SELECT row_number() OVER (ORDER BY o_orderpriority) AS line, '|' || rpad(o_orderpriority, 15, ' ') || '|' || lpad(format('{:,.4f}', avg(o_totalprice)), 12, ' ') || '|' AS text FROM orders GROUP BY o_orderpriority
"""


@query(_SHOWN)
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a result as they are shown on a console."""
    per = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean_price"))
    shown = [x for x in records.console_table(per.orderBy("o_orderpriority")).split("\n") if x.startswith("|")][1:]
    cells = [[c.strip() for c in x.strip("|").split("|")] for x in shown]
    return spark.createDataFrame([(i, f"|{a:<15}|{b:>12}|") for i, (a, b) in enumerate(cells, 1)], "line long, text string")


@query(
    """
    SELECT r_name AS category, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)) AS present FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
    """
)
def repo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as repositories, regions as categories; those with a rich supplier are present."""
    rows = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("r_name", "n_name").collect()
    repos: dict[str, dict[str, str]] = {}
    for r in rows:
        repos.setdefault(r["r_name"], {})[r["n_name"]] = f"https://example.org/{r['n_name']}"
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return records.repo_catalog(spark, repos, rich.select(F.col("n_name").alias("reponame")))[1]


@query(
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS reponame FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
)
def repos_with_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("reponame", F.col("o_custkey").cast("string"))
    return records.repos_with_reports(o.where("o_orderstatus = 'P'"), o.where("o_orderpriority = '1-URGENT'"))


_PATHS = """
    p AS (
      SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Tests' WHEN 1 THEN 'src' WHEN 2 THEN 'docs' WHEN 3 THEN '.hidden' ELSE 'build' END AS folder,
        CASE p_partkey % 7 WHEN 0 THEN '__init__.py' WHEN 1 THEN 'test_a.py' WHEN 2 THEN 'conftest.py' WHEN 3 THEN 'test_b_agent_rewrite.py' ELSE 'mod' || p_size || '.py' END AS name, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END AS content FROM part)
"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    folder = F.when(k % 5 == 0, "Tests").when(k % 5 == 1, "src").when(k % 5 == 2, "docs").when(k % 5 == 3, ".hidden").otherwise("build")
    name = F.when(k % 7 == 0, "__init__.py").when(k % 7 == 1, "test_a.py").when(k % 7 == 2, "conftest.py").when(k % 7 == 3, "test_b_agent_rewrite.py").otherwise(
        F.concat(F.lit("mod"), size, F.lit(".py"))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("/", F.lit("r"), folder, name).alias("path"),
        F.when(k % 11 == 0, "  ").otherwise(F.col("p_name")).alias("content")
    )


@query(
    f"""
    WITH {_PATHS} SELECT p_partkey, 'r/' || folder || '/' || name AS path, 'corpus' AS kind FROM p WHERE folder IN ('src', '.hidden') AND name NOT IN ('__init__.py', 'conftest.py') AND trim(content) <> ''
    UNION ALL SELECT p_partkey, 'r/' || folder || '/' || name, 'pool' FROM p WHERE folder IN ('Tests', 'src', 'build') AND name <> '__init__.py'
    UNION ALL SELECT p_partkey, 'r/' || folder || '/' || name, 'test' FROM p WHERE folder <> 'build' AND name LIKE 'test\\_%' ESCAPE '\\'
    UNION ALL SELECT p_partkey, 'r/' || folder || '/test_b.py', 'rewrite' FROM p WHERE name = 'test_b_agent_rewrite.py'
    """
)
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a retrieval corpus, a candidate pool, a search for tests and one for rewrites take."""
    files = _paths(spark, sf_dir)
    parts = {
        "corpus": records.corpus_sources(files), "pool": records.pool_sources(files), "test": records.test_sources(files),
        "rewrite": records.rewritten_sources(files).withColumn("path", F.col("original_path"))
    }
    out = None
    for kind, df in parts.items():
        part = df.select("p_partkey", "path", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "SELECT n_name || '/test_' || lower(n_name) || '.py' AS path, '# ' || n_name || chr(10) || 'x = ' || n_nationkey || chr(10) AS content FROM nation"
)
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole source files below a folder; other files there are passed over."""
    root = scratch.scratch_folder(spark, "sources")
    rows = table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    for r in rows:
        for name in (f"test_{r['n_name'].lower()}.py", "notes.txt"):
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{r['n_name']}/{name}"))
            out.write(f"# {r['n_name']}\nx = {r['n_nationkey']}\n".encode())
            out.close()
    return records.read_sources(spark, root)


@query(
    """
    SELECT CAST(p_partkey AS VARCHAR) AS task_id, p_partkey % 4 <> 2 AS found, p_partkey % 4 = 0 AS in_class, CASE WHEN p_partkey % 4 <> 2 THEN 'lambda: ' || (p_size + 1) || ')' END AS recorded, CASE WHEN p_partkey % 4 <> 2 THEN 'assert g(1) == 0' END AS other FROM part
    """
)
def instrumented_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assertion with the known truth gives way to a printer; other assertions stay."""
    fourth, truth = F.col("p_partkey") % 4, (F.col("p_size") + 1).cast("string")
    cls = F.when(fourth == 0, "TestP")
    body = lambda pad: F.concat(
        F.lit(f"{pad}def test_a(self):\n{pad}    assert g(1) == 0\n{pad}    with x:\n{pad}        assert f(2) == "), truth,
        F.lit("\n")
    )
    source = F.when(fourth == 0, F.concat(F.lit("class TestP:\n"), body("    "))).otherwise(body(""))
    wanted = F.when(fourth == 2, "'no such truth'").otherwise(truth)
    out = python_source.truth_printed(source, cls, F.lit("test_a"), wanted)
    marked = out.contains("---GT_START---") & out.contains("---GT_END---") & ~out.contains("assert f(2)")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("task_id"), F.coalesce(marked, F.lit(False)).alias("found"),
        (F.coalesce(out, F.lit("")).startswith("class")).alias("in_class"),
        F.regexp_extract(out, r"lambda: \d+\)", 0).alias("recorded"),
        F.regexp_extract(out, r"assert g\(1\) == 0", 0).alias("other")
    ).withColumns({c: F.when(F.col("found"), F.col(c)) for c in ("recorded", "other")})


@query(
    """
    WITH p AS (SELECT DISTINCT p_brand AS repo, string_split(replace(p_type, ' ', '/') || '/' || p_size || '.py', '/') AS parts FROM part),
    q AS (SELECT repo, parts FROM p UNION SELECT repo, ['out', 'x.py'] FROM p UNION SELECT repo, ['a.tmp'] FROM p UNION SELECT repo, ['Zeta.py'] FROM p UNION SELECT repo, ['alpha.py'] FROM p),
    ok AS (SELECT * FROM q WHERE len(list_filter(parts, lambda x: x IN ('out', 'a.tmp'))) = 0),
    n AS (SELECT DISTINCT repo, d, parts[:d - 1] AS folder, parts[d] AS name, d = len(parts) AS is_file FROM ok, range(1, 5) r(d) WHERE d <= len(parts)),
    s AS (SELECT *, row_number() OVER (PARTITION BY repo, folder ORDER BY is_file, lower(name), name) AS k, count(*) OVER (PARTITION BY repo, folder) AS c, count(*) FILTER (is_file) OVER (PARTITION BY repo, folder) AS f FROM n),
    walk AS (
      SELECT repo, d, list_append(folder, name) AS node, is_file, k = c AS last, c, f, [k] AS place, '' AS before, name FROM s WHERE d = 1
      UNION ALL SELECT s.repo, s.d, list_append(folder, s.name), s.is_file, s.k = s.c, s.c, s.f, list_append(place, s.k), before || CASE WHEN last THEN '    ' ELSE '│   ' END, s.name FROM walk JOIN s ON s.repo = walk.repo AND s.folder = walk.node AND s.d = walk.d + 1),
    lines AS (
      SELECT repo, place, before || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || CASE WHEN is_file THEN '' ELSE '/' END AS line FROM walk
      UNION ALL SELECT repo, list_append(place[:len(place) - 1], c + 1), before || '    └── ... (' || (f - 5) || ' more files)' FROM walk WHERE last AND f > 5)
    SELECT repo AS reponame, repo || '/' || string_agg(chr(10) || line, '' ORDER BY place) AS tree FROM lines GROUP BY repo
    """.replace("walk AS (", "walk AS (", 1).replace("WITH p AS", "WITH RECURSIVE p AS")
)
def project_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probelake.operators import context

    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("reponame"),
        F.concat(
            F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_size").cast("string"), F.lit(".py")
        ).alias("path")
    )
    more = part.select(
        "reponame", F.explode(F.array(*[F.lit(x) for x in ("out/x.py", "a.tmp", "Zeta.py", "alpha.py")])).alias("path")
    )
    return context.project_trees(part.unionByName(more).distinct(), limit=1_000_000)


@query(
    "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS reponame FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
)
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("reponame"))
    return keys.missing_names(
        requested,
        table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("reponame"))
    )


# texts that operators take apart: the SQL takes the same texts apart by its own expressions

_ANSWERS = """
    r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '```json' || chr(10) || '["' || p_brand || '", "' || p_type || '"]' || chr(10) || '```' WHEN 1 THEN 'files: ["' || p_brand || '", " b "] end' WHEN 2 THEN '```python' || chr(10) || '["' || p_type || '"]' || chr(10) || '```'
        WHEN 3 THEN 'I do not know' WHEN 4 THEN '[' || p_size || ', "' || p_brand || '"]' ELSE 'x [1] and ["' || p_name || '"' END AS text FROM part),
    l AS (SELECT p_partkey, coalesce(nullif(regexp_extract(text, '```(?:output|json|python)?\\s*(\\[[\\s\\S]*\\])\\s*```', 1), ''), nullif(regexp_extract(text, '\\[[\\s\\S]*\\]'), '')) AS lit FROM r)
""".replace("\\\\", "\\")


@query(
    f"""
    WITH {_ANSWERS} SELECT p_partkey, coalesce(array_to_string(list_transform(CASE WHEN json_valid(lit) THEN from_json(lit, '["VARCHAR"]') ELSE [] END, lambda x: trim(x)), ','), '') AS files FROM l
    """
)
def list_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in fences, in running text, of other things than strings, and none."""
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    k = F.col("p_partkey") % 6
    response = (
        F.when(k == 0, F.concat(F.lit("```json\n["), q("p_brand"), F.lit(", "), q("p_type"), F.lit("]\n```")))
        .when(k == 1, F.concat(F.lit("files: ["), q("p_brand"), F.lit(', " b "] end')))
        .when(k == 2, F.concat(F.lit("```python\n["), q("p_type"), F.lit("]\n```")))
        .when(k == 3, F.lit("I do not know"))
        .when(k == 4, F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", "), q("p_brand"), F.lit("]")))
        .otherwise(F.concat(F.lit("x [1] and ["), q("p_name")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(python_values.file_list(response), ",").alias("files"))


@query(
    r"""
    WITH t AS (SELECT p_partkey, 'do' || chr(10) || '```file: a' || p_size || '.py ' || chr(10) || p_type || chr(10) || '```' || chr(10) || '```bash' || chr(10) || '# note' || chr(10) || '  ' || p_brand || chr(10) || chr(10) || 'ls -l' || chr(10) || '```' || chr(10)
      || CASE WHEN p_partkey % 3 = 0 THEN '```file:b.py' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '```bash' || chr(10) || 'pwd' || chr(10) || '```' ELSE p_name END AS text FROM part),
    f AS (SELECT p_partkey, text, regexp_extract_all(text, '(?s)```file:([^\n]+)\n(.*?)```', 1) AS names, regexp_extract_all(text, '(?s)```file:([^\n]+)\n(.*?)```', 2) AS bodies,
      list_filter(list_transform(string_split(array_to_string(regexp_extract_all(text, '(?s)```bash\s*\n(.*?)\n```', 1), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x[1] <> '#') AS commands FROM t)
    SELECT p_partkey, trim(names[1]) AS first_name, rtrim(bodies[1], chr(10)) AS first_content, len(names) AS n_files, array_to_string(commands, ',') AS commands FROM f
    """
)
def message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    more = F.when(F.col("p_partkey") % 3 == 0, "```file:b.py\nx\n```\n```bash\npwd\n```").otherwise(F.col("p_name"))
    text = F.concat(
        F.lit("do\n```file: a"), size, F.lit(".py \n"), "p_type", F.lit("\n```\n```bash\n# note\n  "), "p_brand",
        F.lit("\n\nls -l\n```\n"), more
    )
    first = T.first_file_block(text)
    return table(spark, sf_dir, "part").select(
        "p_partkey", first["filename"].alias("first_name"), first["content"].alias("first_content"),
        F.size(T.file_blocks(text)).cast("long").alias("n_files"), F.array_join(T.shell_commands(text), ",").alias("commands")
    )


_LOGS = """
    l AS (
      SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a' || chr(10) || '```status' || chr(10) || ' FAILED ' || chr(10) || '```' || chr(10) || '```status' || chr(10) || 'success' || chr(10) || '```' WHEN 1 THEN '```status' || chr(10) || 'Success' || chr(10) || '```' ELSE event_type END AS text,
        CASE event_id % 7 WHEN 0 THEN 'collected 3 items' || chr(10) || 'FAILED t.py ERROR' WHEN 1 THEN 'ERROR collecting t.py' WHEN 2 THEN '== 3 passed in 1s' WHEN 3 THEN '= no tests ran' ELSE props END AS out,
        CASE event_id % 4 WHEN 0 THEN 'Timeout >60s' WHEN 1 THEN 'ImportError: x' ELSE '' END AS err, event_id % 3 AS code, CASE WHEN user_id % 5 = 0 THEN 'ls' ELSE 'pytest -q' END AS command FROM events)
"""


@query(
    rf"""
    WITH {_LOGS} SELECT event_id, CASE WHEN regexp_matches(text, '(?i)```status\s*\n\s*failed\s*\n```') THEN 'failed' WHEN regexp_matches(text, '(?i)```status\s*\n\s*success\s*\n```') THEN 'success' END AS status,
      CASE WHEN code = 0 THEN 'passed' WHEN contains(out, 'FAILED') THEN 'failed' WHEN contains(out, 'ERROR') THEN 'error' WHEN contains(out || err, 'Timeout >') THEN 'timeout' ELSE 'unknown' END AS outcome,
      contains(command, 'pytest') AND regexp_matches(out || err, 'collected \d+ items|=\s*(?:\d+ (?:passed|failed|skipped)|no tests ran)') AND NOT contains(err, 'ImportError') AND NOT contains(out, 'ERROR collecting') AS setup_done FROM l
    """
)
def status_and_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(
        k % 5 == 0, "a\n```status\n FAILED \n```\n```status\nsuccess\n```"
    ).when(k % 5 == 1, "```status\nSuccess\n```").otherwise(F.col("event_type"))
    out = F.when(
        k % 7 == 0, "collected 3 items\nFAILED t.py ERROR"
    ).when(k % 7 == 1, "ERROR collecting t.py").when(k % 7 == 2, "== 3 passed in 1s").when(k % 7 == 3, "= no tests ran").otherwise(F.col("props"))
    err = F.when(k % 4 == 0, "Timeout >60s").when(k % 4 == 1, "ImportError: x").otherwise("")
    command = F.when(F.col("user_id") % 5 == 0, "ls").otherwise("pytest -q")
    return table(spark, sf_dir, "events").select(
        "event_id", T.status_marker(text).alias("status"), T.failure_class((k % 3).cast("int"), out, err).alias("outcome"),
        T.setup_complete(command, out, err).alias("setup_done")
    )


@query(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_partkey % 60 AS p, l_linenumber % 6 AS form FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE form WHEN 0 THEN q = p WHEN 1 THEN q = p WHEN 2 THEN true WHEN 3 THEN q = p AND q <> 0 WHEN 4 THEN false ELSE q % 2 = p % 2 END AS correct FROM l
    """
)
def literal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, floats of them, sets in any order, texts in either quotes, lists against tuples, and booleans against numbers."""
    q, p, form = F.col("l_quantity").cast("long").cast("string"), (F.col("l_partkey") % 60).cast("string"), F.col("l_linenumber") % 6
    of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    said = F.when(form == 0, of(q, ".0")).when(form == 1, of(" ", q)).when(form == 2, of("{'a', ", q, "}")).when(form == 3, of('"', q, '"')).when(form == 4, of("[", q, "]")).otherwise(
        F.when(F.col("l_quantity").cast("long") % 2 == 1, "True").otherwise("0")
    )
    true = F.when(form < 2, p).when(form == 2, of("{", q, ', "a"}')).when(form == 3, of("'", p, "'")).when(form == 4, of("(", q, ",)")).otherwise(
        (F.col("l_partkey") % 60 % 2).cast("string")
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", python_values.matches_any(said, F.array(F.lit("'other'"), true)).alias("correct")
    )


@query(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_partkey % 6 AS form, l_returnflag FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '' WHEN form = 0 THEN q || '' WHEN form = 1 THEN q || '|' || q || '.0' WHEN form = 2 THEN '''' || q || '''' WHEN form = 3 THEN '' WHEN form = 4 THEN '(' || q || ', ' || (q + 1) || ')' ELSE '[' || q || ', ''a'']' END AS truths FROM l
    """
)
def runtime_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, approximations, texts, nothing, tuples and lists, of successful and failed runs."""
    q, form = F.col("l_quantity").cast("long"), F.col("l_partkey") % 6
    text, more = q.cast("string"), (q + 1).cast("string")
    kind = F.when(form == 0, "<class 'numpy.int64'>").when(
        form == 1, "<class '_pytest.python_api.ApproxScalar'>"
    ).when(form == 2, "<class 'str'>").when(form == 3, "<class 'NoneType'>").when(form == 4, "<class 'tuple'>").otherwise("<class 'list'>")
    value = F.when(form == 2, F.concat(F.lit('"'), text, F.lit('"'))).when(form == 3, "null").when(
        form == 4, F.concat(F.lit("["), text, F.lit(", "), more, F.lit("]"))
    ).when(form == 5, F.concat(F.lit("["), text, F.lit(', "a"]'))).otherwise(text)
    status = F.when(F.col("l_returnflag") == "R", "failure").otherwise("success")
    original = F.concat(F.lit("pytest.approx("), text, F.lit(", rel=1)"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array_join(python_values.truths_of_runtime(status, value, kind, original), "|").alias("truths")
    )


#: Six assertions a source; which of them are tasks, and their scores, follow from the table of weights.
_ASSERTS = """
    t AS (SELECT p_partkey, p_size AS s, p_size + 10 AS v FROM part),
    a AS (
      SELECT p_partkey, 0 AS i, 'size(' || s || ')' AS l, v || '' AS r, 3 + 1 + 1 AS score, v NOT IN (0, 1, 2) AS good FROM t
      UNION ALL SELECT p_partkey, 1, 'x', '''' || v || '''', 2, false FROM t
      UNION ALL SELECT p_partkey, 2, 'a.b[' || s || ']', CASE WHEN s % 2 = 0 THEN '1' ELSE '[' || s || ', 2]' END, 3 + 2 + 1 + CASE WHEN s % 2 = 0 THEN 1 ELSE 2 + 1 + 1 END, s % 2 = 1 FROM t
      UNION ALL SELECT p_partkey, 3, 'n + ' || s, '-1', 2 + 1 + 1 + 2 + 1, true FROM t
      UNION ALL SELECT p_partkey, 4, 'd(k=' || s || ')', CASE WHEN s % 3 = 0 THEN '''yes''' ELSE '{''a'': ' || s || '}' END, 3 + CASE WHEN s % 3 = 0 THEN 1 ELSE 3 + 1 + 1 END, s % 3 <> 0 FROM t)
"""


@query(
    f"""
    WITH {_ASSERTS}, n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS ordinal FROM a WHERE good)
    SELECT CAST(n.p_partkey AS VARCHAR) AS testpath, CAST(ordinal AS INTEGER) AS ordinal, 'TestPart' AS classname, 'test_' || n.p_partkey AS funcname, n.r AS ground_truth, CAST(score AS INTEGER) AS complexity_score,
      'def test_' || n.p_partkey || '(self):' || chr(10) || (SELECT string_agg('    assert ' || o.l || ' == ' || CASE WHEN o.i = n.i THEN '''???''' ELSE o.r END, chr(10) ORDER BY o.i) FROM a o WHERE o.p_partkey = n.p_partkey) || chr(10) || '    assert y.z > 3' AS masked_code
    FROM n
    """
)
def extract_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of six assertions of different kinds."""
    s, v, of = F.col("p_size").cast("string"), (F.col("p_size") + 10).cast("string"), lambda *parts: F.concat(
        *[F.lit(x) if isinstance(x, str) else x for x in parts]
    )
    third = F.when(F.col("p_size") % 2 == 0, "1").otherwise(of("[", s, ", 2]"))
    fifth = F.when(F.col("p_size") % 3 == 0, "'yes'").otherwise(of("{'a': ", s, "}"))
    pad = "\n    assert "
    source = of(
        "import os\nclass TestPart:\n  def test_", F.col("p_partkey").cast("string"), "(self):", pad, "size(", s, ") == ", v,
        pad, "x == '", v, "'", pad, "a.b[", s, "] == ", third, pad, "n + ", s, " == -1", pad, "d(k=", s, ") == ", fifth, pad,
        "y.z > 3\n"
    )
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("testpath"), source.alias("content"))
    tasks = python_source.extract_tasks(files, partitions=spark.sparkContext.defaultParallelism)
    return tasks.select(
        "testpath", "ordinal", "classname", "funcname", "ground_truth", "masked_code",
        F.col("quality_analysis.complexity_score").alias("complexity_score")
    )


@query(
    """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x = ' || p_size || chr(10) || chr(10) || 'def test_a():' || chr(10) || '    return ' || (p_size + 1) WHEN 1 THEN 'class A:' || chr(10) || chr(10) || '    def test_a():' || chr(10) || '        return ' || (p_size + 1) || chr(10) || '    y = ' || p_size END AS replaced,
      CASE WHEN p_partkey % 2 = 0 THEN 'def pytest_sessionfinish(s):' || chr(10) || '    # Call chain tracking disabled during rewrite phase' || chr(10) || '    return' ELSE 'def other(s):' || chr(10) || '    a()' || chr(10) || chr(10) || '    b()' END || chr(10) || 'y = ' || p_size AS neutral
    FROM part
    """
)
def source_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function at module level, one in a class, and one that is not there; a hook and another function."""
    size, third = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    plain, inside = F.concat(F.lit("x = "), size, F.lit("\ndef test_a():\n    pass\n")), F.concat(
        F.lit("class A:\n    def test_a(self):\n        pass\n    y = "), size
    )
    source = F.when(third == 1, inside).otherwise(plain)
    cls, name = F.when(third == 1, "A"), F.when(third == 2, "test_b").otherwise("test_a")
    new = F.concat(F.lit("def test_a():\n    return "), (F.col("p_size") + 1).cast("string"))
    hook = F.when(F.col("p_partkey") % 2 == 0, "pytest_sessionfinish").otherwise("other")
    hooks = F.concat(F.lit("def "), hook, F.lit("(s):\n    a()\n\n    b()\ny = "), size)
    return table(spark, sf_dir, "part").select(
        "p_partkey", python_source.function_replaced(source, cls, name, new).alias("replaced"),
        python_source.hooks_neutralized(hooks).alias("neutral")
    )


__all__ = ["rounded"]
