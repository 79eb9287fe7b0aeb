"""Queries over evaluation, packing, traces and prompts, each with its own SQL.

As in ``stand_ins``, driver tables take the shape of the operators' inputs. The SQL
computes the results from the same tables by other means: sets instead of parsed
answers, recursion instead of folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.functions import text as T
from probelake.operators import context, evaluation, keys, prompts, reports, retrieval, trace
from probelake.plans.stand_ins import query, rounded, table
from probelake.sources import scratch
from probelake.streaming import trace_stream

# call chains: a customer is a test file, its nation the repository, suppliers are files

_CHAINS = """
    li AS (SELECT c_custkey, c_nationkey, c_mktsegment, o_orderstatus, o_orderkey % 2 AS sample_id, 's' || (l_suppkey % 7) AS f
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    truth AS (SELECT c_custkey, coalesce(list(DISTINCT f) FILTER (o_orderstatus = 'O'), []) AS t FROM li WHERE c_custkey % 5 <> 0 GROUP BY ALL),
    said AS (SELECT c_custkey, c_nationkey, c_mktsegment, sample_id, CASE WHEN c_custkey % 11 = 3 THEN [] ELSE coalesce(list(DISTINCT f) FILTER (o_orderstatus = 'F'), []) END AS p FROM li GROUP BY c_custkey, c_nationkey, c_mktsegment, sample_id),
    sized AS (SELECT *, len(t) AS nt, len(p) AS np, len(list_intersect(p, t)) AS nb FROM said JOIN truth USING (c_custkey)),
    e AS (
      SELECT *, CASE WHEN nt + np = 0 THEN 1.0 WHEN nt = 0 OR np = 0 THEN 0.0 ELSE nb / np END AS precision, CASE WHEN nt + np = 0 THEN 1.0 WHEN nt = 0 OR np = 0 THEN 0.0 ELSE nb / nt END AS recall,
        CASE WHEN nt + np = 0 THEN 1.0 WHEN nb = 0 THEN 0.0 ELSE 2.0 * nb / (nt + np) END AS f1, CASE WHEN nb = np AND nb = nt THEN 1 ELSE 0 END AS exact_match
      FROM sized)
"""


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").join(
        t("orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = li.select(
        "c_custkey", "c_nationkey", "c_mktsegment", "o_orderstatus", (F.col("o_orderkey") % 2).cast("int").alias("sample_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("f")
    )
    name = F.col("c_custkey").cast("string").alias("test_file")
    files = F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("f")))
    # a report names the test itself too; every fifth test has no report
    own = F.struct(F.col("c_custkey").cast("string").alias("file"), F.lit(1).alias("hops"))
    found = li.where("c_custkey % 5 <> 0").groupBy("c_custkey", "c_nationkey").agg(files.alias("t"))
    found = found.select(
        F.col("c_nationkey").cast("string").alias("reponame"), name,
        F.concat(
            F.array(own), F.transform("t", lambda f: F.struct(f.alias("file"), F.lit(2).alias("hops")))
        ).alias("dependencies")
    )
    said = li.groupBy("c_custkey", "c_nationkey", "c_mktsegment", "sample_id").agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("f"))).alias("p")
    )
    listed = lambda quote, sep: F.concat(
        F.lit("["), F.array_join(F.transform("p", lambda f: F.concat(F.lit(quote), f, F.lit(quote))), sep), F.lit("]")
    )
    # answers as JSON in a fence, as a bare Python list, or none
    response = F.when(F.col("c_custkey") % 11 == 3, "no idea").when(
        F.col("sample_id") == 0, F.concat(F.lit("So:\n```json\n"), listed('"', ", "), F.lit("\n```"))
    ).otherwise(F.concat(F.lit("files = "), listed("'", " , ")))
    predictions = said.select(
        F.col("c_nationkey").cast("string").alias("reponame"), F.col("c_mktsegment").alias("ratio"),
        F.lit("t").alias("task_id"), name, "sample_id", response.alias("response")
    )
    return evaluation.evaluate_chains(predictions, found)


@query(
    f"""
    WITH {_CHAINS} SELECT CAST(c_nationkey AS VARCHAR) AS reponame, c_mktsegment AS ratio, CAST(c_custkey AS VARCHAR) AS test_file, CAST(sample_id AS INTEGER) AS sample_id, CAST(nt AS INTEGER) AS num_truth_files,
      CAST(np AS INTEGER) AS num_pred_files, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, exact_match, array_to_string(list_sort(t), ',') AS truth_files, array_to_string(list_sort(p), ',') AS predicted_files
    FROM e
    """
)
def evaluated_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {c: F.array_join(c, ",") for c in ("truth_files", "predicted_files")}
    return rounded(_chains(spark, sf_dir).drop("task_id").withColumns(lists))


@query(
    f"""
    WITH {_CHAINS}, per AS (SELECT c_mktsegment AS ratio, CAST(c_nationkey AS VARCHAR) AS reponame, c_custkey, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(exact_match) AS exact_match FROM e GROUP BY ALL)
    SELECT ratio, reponame, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(exact_match), 6) AS exact_match, count(*) AS num_tasks
    FROM per GROUP BY GROUPING SETS ((ratio), (ratio, reponame))
    """
)
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.chain_summary(_chains(spark, sf_dir)))


# outputs: a user is a task, an event a sample whose answer is its value modulo 3

_OUTPUTS = """
    s AS (SELECT event_type AS mode, CASE WHEN user_id % 2 = 0 THEN 'original' ELSE 'rewrite' END AS condition, user_id, event_id, CAST(floor(value) AS BIGINT) % 3 AS a, event_id % 7 <> 0 AS fenced FROM events),
    o AS (
      SELECT mode, condition, user_id, count(*) AS n, count(*) FILTER (fenced AND a = user_id % 3) AS c, string_agg(CASE WHEN fenced THEN CASE event_id % 3 WHEN 0 THEN a || '' WHEN 1 THEN a || '.0' ELSE ' ' || a END ELSE '' END, '|' ORDER BY event_id) AS predictions,
        CASE user_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE 'unknown' END AS difficulty
      FROM s GROUP BY ALL),
    k AS (SELECT unnest(range(1, 6)) AS k),
    p AS (SELECT *, CASE WHEN n - c < k THEN 1.0 WHEN n < k THEN 0.0 ELSE 1.0 - (SELECT product((n - c - i) / (n - i)) FROM range(0, k) r(i)) END AS p FROM o, k)
"""


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, a = F.col("user_id"), (F.floor("value") % 3).cast("string")
    condition = F.when(user % 2 == 0, "original").otherwise("rewrite").alias("condition")
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_type").alias("mode"), condition, a.alias("a"), user.cast("string").alias("task_id")
    )
    # the same number is written in three ways, and every seventh answer has no fence
    third = F.col("event_id") % 3
    said = F.when(third == 0, F.col("a")).when(third == 1, F.concat("a", F.lit(".0"))).otherwise(F.concat(F.lit("\t"), "a", F.lit(" ")))
    # a fence's value is trimmed by the operator, so the second spelling is all that differs
    response = F.when(F.col("event_id") % 7 == 0, F.col("a")).otherwise(
        F.concat(F.lit("It gives\n```output\n"), said, F.lit("\n```\n"))
    )
    predictions = e.select(
        "condition", "mode", F.lit("r").alias("reponame"), "task_id", F.col("event_id").alias("sample_id"),
        response.alias("response")
    )
    truth = F.array(F.lit("'x'"), (user % 3).cast("string"))
    truths = e.select(
        "condition", "task_id", F.concat(F.lit("test_"), "task_id", F.lit("[p]")).alias("funcname"),
        truth.alias("ground_truth"), "user_id"
    ).distinct()
    level = F.when(F.col("user_id") % 4 == 0, 2).otherwise(3)
    deps = F.array(
        F.struct(F.lit("a").alias("file"), F.lit(1).alias("hops")), F.struct(F.lit("b").alias("file"), level.alias("hops"))
    )
    chains = truths.where("user_id % 4 < 2").select(
        F.lit("r").alias("reponame"), F.concat(F.lit("TestA::"), "funcname").alias("test_function"), deps.alias("dependencies"),
        F.lit(1).alias("line_no")
    )
    named = truths.withColumn("funcname", T.bare_name(F.col("funcname"))).drop("user_id")
    evaluation.require_truths(predictions, named)
    return evaluation.evaluate_outputs(predictions, named, keys.function_difficulty(chains), "actual")


@query(
    f"""
    WITH {_OUTPUTS} SELECT mode, condition, CAST(user_id AS VARCHAR) AS task_id, difficulty, CAST(n AS INTEGER) AS num_samples, CAST(c AS INTEGER) AS num_correct, replace(predictions, ' ', '') AS predictions,
      round(max(p) FILTER (k = 1), 6) AS p1, round(max(p) FILTER (k = 2), 6) AS p2, round(max(p) FILTER (k = 5), 6) AS p5
    FROM p GROUP BY ALL
    """
)
def evaluated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [
        "mode", "condition", "task_id", "difficulty", "num_samples", "num_correct",
        F.array_join("predictions", "|").alias("predictions")
    ]
    return rounded(_outputs(spark, sf_dir).select(*shown, *[F.col("pass_at_k")[str(k)].alias(f"p{k}") for k in (1, 2, 5)]))


@query(
    f"""
    WITH {_OUTPUTS}, d AS (SELECT mode, condition, unnest([difficulty, 'overall']) AS difficulty, k, p FROM p), g AS (SELECT mode, condition, difficulty, CAST(k AS VARCHAR) AS k, round(avg(p), 6) AS pass_at_k, count(*) AS problems FROM d GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY mode, condition, list_position(['easy', 'hard', 'unknown', 'overall'], difficulty), k) AS line FROM g
    """
)
def output_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from probelake.functions import scores

    # a handful of rows: modes by conditions by levels by k
    out = evaluation.output_summary(_outputs(spark, sf_dir))
    line = F.row_number().over(Window.orderBy("mode", "condition", scores.difficulty_order(F.col("difficulty")), "k"))
    return rounded(out.withColumn("line", line.cast("long")))


_EXECUTED = """
    r AS (SELECT event_type AS mode, CASE WHEN user_id % 2 = 0 THEN 'original' ELSE 'rewrite' END AS condition, user_id, event_id, value > 50 AS ok FROM events),
    t AS (SELECT mode, condition, user_id, count(*) AS n, count(*) FILTER (ok) AS c, string_agg(CASE WHEN ok THEN '1' ELSE '0' END, '' ORDER BY event_id) AS results FROM r GROUP BY ALL),
    p AS (SELECT *, CASE WHEN n - c < k THEN 1.0 WHEN n < k THEN 0.0 ELSE 1.0 - (SELECT product((n - c - i) / (n - i)) FROM range(0, k) x(i)) END AS p FROM t, (SELECT unnest(range(1, 6)) AS k))
"""


def _executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = F.when(F.col("user_id") % 2 == 0, "original").otherwise("rewrite")
    results = table(spark, sf_dir, "events").select(
        condition.alias("condition"), F.col("event_type").alias("mode"), F.lit("r").alias("reponame"),
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("sample_id"),
        (F.col("value") > 50).alias("passed")
    )
    return evaluation.evaluate_executions(results)


@query(
    f"WITH {_EXECUTED} SELECT DISTINCT mode, condition, CAST(user_id AS VARCHAR) AS task_id, CAST(n AS INTEGER) AS num_samples, CAST(c AS INTEGER) AS num_correct, results, round(p, 6) AS p3 FROM p WHERE k = 3"
)
def evaluated_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = F.array_join(F.transform("execution_results", lambda x: x.cast("int").cast("string")), "")
    return rounded(
        _executed(spark, sf_dir).select(
            "mode", "condition", "task_id", "num_samples", "num_correct", results.alias("results"),
            F.col("pass_at_k")["3"].alias("p3")
        )
    )


@query(
    f"WITH {_EXECUTED} SELECT condition, mode, CAST(k AS VARCHAR) AS k, round(avg(p), 6) AS pass_at_k, count(*) AS problems FROM p GROUP BY ALL"
)
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.execution_summary(_executed(spark, sf_dir)))


@query(
    """
    SELECT l_returnflag AS condition, CAST(p_partkey AS VARCHAR) AS task_id, l_orderkey, l_linenumber, 'assert f(' || p_size || ', ' || CAST(l_quantity AS BIGINT) || ') == ' || CAST(l_quantity AS BIGINT) AS injected_code,
      CASE p_partkey % 3 WHEN 0 THEN 'TestPart::' ELSE '' END || 'test_' || p_size AS selector
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'
    """
)
def execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    response = F.concat(F.lit("```output\n"), F.col("l_quantity").cast("long").cast("string"), F.lit(" \n```"))
    predictions = li.select(
        F.col("l_returnflag").alias("condition"), F.col("l_partkey").cast("string").alias("task_id"), "l_orderkey",
        "l_linenumber", response.alias("response")
    )
    size, third = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    cls = F.when(third == 0, "TestPart").when(third == 1, "")
    tasks = part.select(
        F.explode(F.array(F.lit("A"), F.lit("R"))).alias("condition"), F.col("p_partkey").cast("string").alias("task_id"),
        F.lit("t.py").alias("testpath"), cls.alias("classname"), F.concat(F.lit("test_"), size).alias("funcname"),
        F.concat(F.lit("assert f("), size, F.lit(", '???') == '???'")).alias("masked_code")
    )
    return evaluation.execution_plan(predictions, tasks).select(
        "condition", "task_id", "l_orderkey", "l_linenumber", "injected_code", "selector"
    )


@query(
    """
    WITH last AS (SELECT l_partkey, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS flag, arg_max(CAST(l_quantity AS BIGINT), (l_orderkey, l_linenumber)) AS q FROM lineitem GROUP BY ALL)
    SELECT CAST(p_partkey AS VARCHAR) AS task_id, array_to_string(list_sort(list_distinct(CASE flag WHEN 'A' THEN [p_size || '', q || ''] WHEN 'N' THEN [p_size || '', '''v' || q || ''''] ELSE [p_size || ''] END)), ',') AS truths
    FROM part LEFT JOIN last ON l_partkey = p_partkey
    """
)
def augmented_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, q = F.col("l_returnflag"), F.col("l_quantity").cast("long").cast("string")
    status = F.when(flag == "R", "failure").otherwise("success")
    value = F.when(flag == "N", F.concat(F.lit('"v'), q, F.lit('"'))).otherwise(q)
    kind = F.when(flag == "N", "<class 'str'>").otherwise("<class 'int'>")
    runtime = table(spark, sf_dir, "lineitem").select(
        F.lit("c").alias("condition"), F.col("l_partkey").cast("string").alias("task_id"), "l_orderkey", "l_linenumber",
        F.struct(status.alias("status"), value.alias("value"), kind.alias("type")).alias("runtime_ground_truth")
    )
    tasks = table(spark, sf_dir, "part").select(
        F.lit("c").alias("condition"), F.col("p_partkey").cast("string").alias("task_id"),
        F.col("p_size").cast("string").alias("ground_truth")
    )
    return reports.augment_truths(tasks, runtime, ["l_orderkey", "l_linenumber"]).select(
        "task_id", F.array_join("ground_truth", ",").alias("truths")
    )


# packing: eight documents make a task; words are letters and digits, so tokens can be counted in SQL

_FILES = """
    w AS (SELECT doc_id // 8 AS task_id, doc_id % 8 AS position, 'f' || doc_id || '.py' AS path, doc_id % 13 = 0 AS missing, list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda x: x <> '') AS words FROM documents),
    b AS (SELECT *, CASE WHEN task_id % 17 = 0 THEN 0 WHEN task_id % 19 = 1 THEN 10 ELSE 200 + (task_id % 10) * 300 END AS budget, row_number() OVER (PARTITION BY task_id ORDER BY position) AS i FROM w),
    f AS (SELECT task_id, i, path, missing, budget, CASE WHEN missing THEN string_split('# file ' || path || ' was not found', ' ') ELSE words END AS words FROM b)
"""
#: One step for each file: 8 tokens of a head, 3 of a foot, words and the gaps between them;
#: a cut after a gap lets the gap and the foot's line feed run together.
_WALK = """
    walk AS (
      SELECT task_id, 0 AS i, 0 AS used, '' AS context, CAST([] AS VARCHAR[]) AS files, false AS over, max(budget) AS budget FROM f GROUP BY task_id
      UNION ALL
      SELECT task_id, i, CASE WHEN taken THEN used + cost ELSE used END, CASE WHEN taken THEN context || '### file: ' || path || chr(10) || '```python' || chr(10) || body || chr(10) || '```' || chr(10) ELSE context END,
        CASE WHEN taken THEN list_append(files, path) ELSE files END, over OR used >= budget OR ({stops} AND NOT taken), budget
      FROM (
        SELECT *, NOT over AND used < budget AND room > 0 AND NOT ({skip} AND missing) AND used + cost <= budget AND NOT ({stops} AND budget <= 0) AS taken
        FROM (
          SELECT *, 11 + n - CASE WHEN n < tokens AND n % 2 = 0 AND n > 0 THEN 1 ELSE 0 END - CASE WHEN tokens = 0 THEN 1 ELSE 0 END AS cost,
            array_to_string(words[1:(n + 1) // 2], ' ') || CASE WHEN n < tokens AND n % 2 = 0 THEN ' ' ELSE '' END AS body
          FROM (
            SELECT walk.task_id, f.i, used, context, files, over, walk.budget, f.path, f.missing, f.words, greatest(2 * len(f.words) - 1, 0) AS tokens, walk.budget - used - 11 AS room, least(greatest(2 * len(f.words) - 1, 0), greatest(walk.budget - used - 11, 0)) AS n
            FROM walk JOIN f ON f.task_id = walk.task_id AND f.i = walk.i + 1))))
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    task = F.floor(F.col("doc_id") / 8)
    budget = F.when(task % 17 == 0, 0).when(task % 19 == 1, 10).otherwise(200 + (task % 10) * 300)
    content = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+"), lambda x: x != ""), " ")
    content = F.when(F.col("doc_id") % 13 != 0, content)
    return d.select(
        task.alias("task_id"), (F.col("doc_id") % 8).alias("position"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), content.alias("content"),
        budget.cast("int").alias("budget")
    )


def _packed(df: DataFrame) -> DataFrame:
    return df.select(
        "task_id", F.md5("context").alias("context"), F.array_join("files", ",").alias("files"),
        F.col("tokens").cast("long").alias("tokens")
    )


_PACKED = "SELECT task_id, md5({text}) AS context, array_to_string(files, ',') AS files, CAST(used AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY i DESC) AS r FROM walk) WHERE r = 1"


@query(
    f"WITH RECURSIVE {_FILES}, {_WALK.format(skip='false', stops='true')} "
    + _PACKED.format(text=f"CASE WHEN budget <= 0 THEN '{context.NO_BUDGET.strip()}' || chr(10) WHEN len(files) = 0 THEN '{context.NOTHING_FITS.strip()}' || chr(10) ELSE context END")
)
def packed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(context.packed_contexts(_files(spark, sf_dir), ["task_id"]))


@query(f"WITH RECURSIVE {_FILES}, {_WALK.format(skip='true', stops='false')} " + _PACKED.format(text="context"))
def packed_contexts_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(context.packed_contexts(_files(spark, sf_dir), ["task_id"], skip=True))


@query(
    f"""
    WITH RECURSIVE {_FILES.replace("CASE WHEN missing THEN string_split('# file ' || path || ' was not found', ' ') ELSE words END AS words FROM b", "words, task_id % 2 AS side FROM b")},
    {_WALK.format(skip='true', stops='false')},
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY i DESC) AS r FROM walk),
    t AS (SELECT task_id // 2 AS task, max(context) FILTER (task_id % 2 = 0) AS p, max(context) FILTER (task_id % 2 = 1) AS n, max(array_to_string(files, ',')) FILTER (task_id % 2 = 0) AS pf, max(array_to_string(files, ',')) FILTER (task_id % 2 = 1) AS nf FROM r WHERE r = 1 GROUP BY ALL)
    SELECT task, md5(CASE WHEN md5('42|' || task) < '8' THEN coalesce(p, '') || coalesce(n, '') ELSE coalesce(n, '') || coalesce(p, '') END) AS context, concat_ws(',', nullif(pf, ''), nullif(nf, '')) AS files FROM t
    """
)
def two_sided_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("task", F.floor(F.col("task_id") / 2))
    side = lambda k: files.where(F.col("task_id") % 2 == k).drop("task_id")
    both = context.two_sided_context(side(0), side(1), ["task"])
    return both.select("task", F.md5("context").alias("context"), F.array_join("files_in_prompt", ",").alias("files"))


# traces: a user is a test, its events in order are calls and returns

_TRACE = """
    ev AS (
      SELECT CAST(user_id % 20 AS VARCHAR) || '::' || user_id AS test, CASE WHEN event_type IN ('click', 'view') THEN 'call' ELSE 'return' END AS kind, CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS f,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type <> 'error'),
    walk AS (
      SELECT DISTINCT test, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stack, CAST(NULL AS VARCHAR) AS pushed FROM ev
      UNION ALL
      SELECT walk.test, ev.i, CASE WHEN kind = 'call' AND (len(stack) = 0 OR stack[-1] <> f) THEN list_append(stack, f) WHEN kind = 'return' AND len(stack) > 0 AND stack[-1] = f THEN stack[:len(stack) - 1] ELSE stack END,
        CASE WHEN kind = 'call' AND (len(stack) = 0 OR stack[-1] <> f) THEN f END
      FROM walk JOIN ev ON ev.test = walk.test AND ev.i = walk.i + 1),
    hops AS (SELECT test, pushed AS file, min(len(stack)) AS hops FROM walk WHERE pushed IS NOT NULL GROUP BY ALL)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(
        F.col("event_type").isin("click", "view"), "call"
    ).when(F.col("event_type") == "error", "other").otherwise("return")
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("::", (user % 20).cast("string"), user.cast("string")).alias("test_nodeid"), F.col("event_id").alias("seq"),
        kind.alias("kind"), (F.floor("value") % 7).cast("string").alias("filename")
    )


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.fold_traces(_events(spark, sf_dir))


@query(f"WITH RECURSIVE {_TRACE} SELECT test AS test_nodeid, file, CAST(hops AS INTEGER) AS hops FROM hops")
def trace_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir)


@query(
    f"""
    WITH RECURSIVE {_TRACE}, least AS (SELECT string_split(test, '::')[1] AS test_file, file, min(hops) AS hops FROM hops GROUP BY ALL)
    SELECT string_split(test, '::')[1] AS test_file, string_split(test, '::')[2] AS test_function, string_agg(hops || ':' || file, ',' ORDER BY hops, file) AS dependencies FROM hops GROUP BY test
    UNION ALL SELECT test_file, '', string_agg(hops || ':' || file, ',' ORDER BY hops, file) FROM least GROUP BY test_file
    """
)
def trace_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = _folded(spark, sf_dir)
    shown = F.array_join(
        F.transform("dependencies", lambda d: F.concat_ws(":", d["hops"].cast("string"), d["file"])), ","
    ).alias("dependencies")
    per_file = trace.file_report(folded).select("test_file", F.lit("").alias("test_function"), shown)
    return trace.function_report(folded).select("test_file", "test_function", shown).unionByName(per_file)


@query(f"WITH RECURSIVE {_TRACE} SELECT test AS test_nodeid, file, CAST(hops AS INTEGER) AS hops FROM hops")
def streamed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold over a stream of two files, through a resumable sink."""
    root = scratch.scratch_folder(spark, "stream")
    events = _events(spark, sf_dir)
    half = events.agg(F.percentile_approx("seq", 0.5).alias("half")).first()["half"]
    for i, part in enumerate((events.where(F.col("seq") <= half), events.where(F.col("seq") > half))):
        part.coalesce(1).write.parquet(f"{root}/in/{i}")
    reader = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1")
    improved = trace_stream.fold_stream(reader.parquet(f"{root}/in"))
    sink = trace_stream.append_new(spark, f"{root}/out", ("test_nodeid", "file", "hops"))
    run = improved.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    return trace_stream.least_hops(spark.read.schema("test_nodeid string, file string, hops int").parquet(f"{root}/out"))


# prompts and texts


@query(
    """
    WITH p AS (SELECT event_type AS mode, user_id % 20 AS repo, user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'original' ELSE 'rewrite' END AS condition FROM events WHERE event_id % 3 < 2)
    SELECT mode, CAST(repo AS VARCHAR) AS reponame, CAST(user_id AS VARCHAR) AS task_id, condition, event_id FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.mode = a.mode AND b.user_id = a.user_id AND b.condition <> a.condition)
    """
)
def common_task_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = F.when(F.col("event_id") % 3 == 0, "original").otherwise("rewrite")
    e = table(spark, sf_dir, "events").where("event_id % 3 < 2")
    said = e.select(
        F.col("event_type").alias("mode"), (F.col("user_id") % 20).cast("string").alias("reponame"),
        F.col("user_id").cast("string").alias("task_id"), condition.alias("condition"), "event_id"
    )
    return evaluation.common_tasks(said)


@query(
    """
    WITH q AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, CAST(l_partkey AS VARCHAR)) AS rank FROM q)
    SELECT 'r' AS reponame, CAST(l_suppkey AS VARCHAR) AS query, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rank) AS paths FROM r GROUP BY l_suppkey
    """
)
def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    total = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("q"), F.col("l_partkey").cast("string"))
    ranks = total.select(
        F.lit("r").alias("reponame"), F.col("l_suppkey").cast("string").alias("query"),
        F.col("l_partkey").cast("string").alias("path"), F.row_number().over(w).alias("rank")
    )
    return retrieval.rank_lists(ranks).select("reponame", "query", F.array_join("related_files_rank", ",").alias("paths"))


@query(
    """
    SELECT conv_id, turn, 'As ' || role || ':' || chr(10) || text || chr(10) || 'Again: ' || role AS prompt, CASE WHEN turn % 4 = 3 THEN 'ERROR: ValueError - turn' ELSE reverse(role) END AS response, CASE WHEN turn % 4 = 3 THEN 'error' ELSE 'stop' END AS finish_reason
    FROM conversations
    """
)
def prompt_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def call(prompt: str) -> str:
        turn, _, role = prompt.rpartition("\n")[2].partition("|")
        if int(turn) % 4 == 3:
            raise ValueError("turn")
        return role[::-1]

    c = table(spark, sf_dir, "conversations")
    prompt = T.template("As {role}:\n{text}\nAgain: {role}", role=F.col("role"), text=F.col("text"))
    asked = c.select(
        "conv_id", "turn", prompt.alias("prompt"),
        F.concat(prompt, F.lit("\n"), F.col("turn").cast("string"), F.lit("|"), F.col("role")).alias("full")
    )
    return prompts.completions(asked, call, "full").select("conv_id", "turn", "prompt", "response", "finish_reason")


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'conftest.py' ELSE 'setup.py' END AS filename,
      CASE p_partkey % 4 WHEN 0 THEN 'import hunter' || chr(10) || 'x = ' || p_size || chr(10) || 'end' WHEN 1 THEN 'import hunter # ' || p_brand ELSE 'x = ' || p_size END AS content
    FROM part
    """
)
def expanded_shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    fourth, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(fourth < 2, "conftest.py").otherwise("setup.py")
    content = F.when(fourth == 1, F.concat(F.lit("import hunter # "), "p_brand")).otherwise(F.concat(F.lit("x = "), size))
    full = F.lit("import hunter\n{line}\nend")
    return table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("filename"), T.expand_shorthand(name, content, full, "{line}").alias("content")
    )


@query(
    """
    SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'None' ELSE 'Test' || (c_custkey % 5) END, c_name) AS line FROM customer
    """
)
def aligned_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    cls = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Test"), (F.col("c_custkey") % 5).cast("string")))
    named = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("testname"), cls.alias("classname"),
        F.col("c_name").alias("funcname")
    )
    return named.select(
        "c_custkey",
        F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*keys.align_order())).cast("long").alias("line")
    )


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS task_id, 'original' AS condition, CAST(round(o_totalprice) AS BIGINT) AS price, -1 AS lines FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'rewrite', CAST(round(l_extendedprice) AS BIGINT), CAST(l_linenumber AS INTEGER) FROM lineitem WHERE l_returnflag = 'R'
    """
)
def tagged_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").cast("string").alias("task_id"), F.round("o_totalprice").cast("long").alias("price")
    )
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    li = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("task_id"),
        F.round("l_extendedprice").cast("long").alias("price"), F.col("l_linenumber").cast("int").alias("lines")
    )
    # a column that one side lacks is null there
    return keys.tagged_union({"original": o, "rewrite": li}).withColumn("lines", F.coalesce("lines", F.lit(-1)))


def _scores_of(text: Column) -> Column:
    return F.least(F.length(text) % 9, F.lit(6)).cast("int")


@query(
    "SELECT least(length(p_name) % 9, 6)::INTEGER AS complexity_score, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL"
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = F.when(
        F.col("p_partkey") % 3 != 0,
        F.struct(_scores_of(F.col("p_name")).alias("complexity_score"), F.lit(True).alias("is_quality"))
    )
    return reports.score_histogram(table(spark, sf_dir, "part").select(analysis.alias("quality_analysis")))


@query("SELECT page_id, replace(list_extract(string_split(rtrim(url, '/'), '/'), -1), 'a', 'evaluated_') AS folder FROM pages")
def renamed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.renamed_folder(F.col("url"), "a", "evaluated_").alias("folder"))
