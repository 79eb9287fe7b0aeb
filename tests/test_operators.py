"""Operators on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from probelake.operators import context, evaluation, keys, reports, retrieval, trace
from probelake.functions.python_values import SpaceTokenizer
from probelake.sources import records, schemas
from probelake.streaming import trace_stream


def test_aligned(spark):
    schema = "task_id string, reponame string, testpath string, testname string, classname string, funcname string, line_no int"
    o = spark.createDataFrame(
        [
            ("o1", "r", "p", "t", None, "f", 1), ("o2", "r", "p", "t", None, "f", 2), ("o3", "r", "p", "t", None, "f", 3),
            ("o4", "r", "p", "t", "C", "f", 4), ("o5", "r", "p", "t", "C", "", 5)
        ],
        schema
    )
    r = spark.createDataFrame(
        [("r1", "r", "q", "t", None, "f", 1), ("r2", "r", "q", "t", None, "f", 2), ("r5", "r", "q", "t", "C", "", 5)], schema
    )
    left, right = keys.aligned(o, r, ["line_no"])
    assert sorted(x.task_id for x in left.collect()) == ["o1", "o2"]
    assert sorted((x.task_id, x.testpath, x.line_no) for x in right.collect()) == [("o1", "p", 1), ("o2", "p", 2)]
    totals = {x.reponame: (x.original, x.rewrite, x.aligned) for x in keys.align_totals(o, r, left).collect()}
    assert totals == {"r": (5, 3, 2), None: (5, 3, 2)}


def test_keyed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, line_no int, v string")
    assert {(r.k, r.v) for r in keys.last_per_key(df, ["k"], ["line_no"]).collect()} == {("a", None), ("b", "z")}
    assert {(r.k, r.v) for r in keys.first_per_key(df, ["k"], ["line_no"]).collect()} == {("a", "x"), ("b", "z")}
    assert keys.with_samples(df, 5).count() == 15
    assert keys.missing_names(
        df.selectExpr("k as reponame"), spark.createDataFrame([("a",)], "reponame string")
    ).collect()[0][0] == "b"
    stats = keys.kept_and_discarded(df, spark.createDataFrame([("a",)], "k string"), ["k"], ["k"]).orderBy("k").collect()
    assert [(s.kept, s.discarded, s.kept_percent) for s in stats] == [(2, 0, 100.0), (0, 1, 0.0)]


def test_files_by_hops(spark):
    df = spark.createDataFrame([([("c", None), ("b", 2), ("a", 2), ("d", 1)],)], "d array<struct<file:string, hops:int>>")
    assert df.select(keys.files_by_hops(F.col("d")).alias("f")).first().f == ["d", "b", "a", "c"]


def bm25(corpus, query):
    import math

    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = {}
    for tokens in corpus.values():
        for t in set(tokens):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    score = lambda ts: sum(
        idf.get(q, 0) * ts.count(q) * 2.5 / (ts.count(q) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for q in query
    )
    return sorted(corpus, key=lambda p: (-round(score(corpus[p]), 9), p))


def test_bm25(spark):
    corpus = {"a.py": "x y y z".split(), "b.py": "x q".split(), "c.py": "w w w".split(), "d.py": "w w w".split()}
    c = spark.createDataFrame([("r", p, t) for p, t in corpus.items()], "reponame string, path string, tokens array<string>")
    q = spark.createDataFrame([("r", "t", ["y", "x", "x", "none"])], "reponame string, query string, tokens array<string>")
    assert retrieval.rank_lists(retrieval.bm25_ranks(c, q)).first().related_files_rank == bm25(corpus, ["y", "x", "x", "none"])


def test_bm25_limit_looks_up_unscored_documents(spark):
    """A limit gives the first ranks of the full list, unscored and negative ones included."""
    import random

    rng = random.Random(4)
    corpus = {f"f{i:02d}.py": rng.choices("abcdefgh", k=rng.randint(1, 6)) for i in range(40)}
    # a term in most documents weighs less than nothing where the mean does
    common = {f"g{i}.py": ["the", "the"] if i else ["the", "rare"] for i in range(6)}
    docs = [("r", p, t) for p, t in corpus.items()] + [("s", p, t) for p, t in common.items()]
    c = spark.createDataFrame(docs, "reponame string, path string, tokens array<string>")
    asked = [("r", "one", ["a", "b", "b"]), ("r", "none", ["zz"]), ("s", "the", ["the"]), ("s", "rare", ["rare", "the"])]
    q = spark.createDataFrame(asked, "reponame string, query string, tokens array<string>")
    key = lambda r: (r.reponame, r.query, r.path, r["rank"], round(r.score, 9))
    full = {key(r) for r in retrieval.bm25_ranks(c, q).collect()}
    for limit in (1, 3, 5, 30, 100):
        assert {key(r) for r in retrieval.bm25_ranks(c, q, limit=limit).collect()} == {k for k in full if k[3] <= limit}


def test_selection(spark):
    tasks = spark.createDataFrame([("t", "r", "A::f[p]")], "task_id string, reponame string, funcname string")
    ranks = spark.createDataFrame([("t", f"f{i:02d}", i) for i in range(1, 50)], "task_id string, path string, rank int")
    rep = spark.createDataFrame(
        [("r", "f", [("b", 2), ("a", 1)])],
        "reponame string, funcname string, dependencies array<struct<file:string, hops:int>>"
    )
    got = retrieval.selection(tasks, ranks, rep).collect()
    by = lambda m: [x.path for x in sorted(got, key=lambda x: x.position) if x["mode"] == m]
    assert sorted(by("retrieval")) == [f"f{i:02d}" for i in range(1, 21)] and by("retrieval") != sorted(by("retrieval"))
    assert len(by("confusion")) == 20 and min(by("confusion")) > "f20"
    assert by("oracle") == ["a", "b"]


def test_packing():
    t = SpaceTokenizer()
    files = [("a", "one two"), ("b", " ".join(["w"] * 50)), ("c", "x")]
    assert context.pack_files(files, 0, t)[0] == context.NO_BUDGET
    assert context.pack_files(files, 3, t)[0] == context.NOTHING_FITS
    for skip in (False, True):
        for budget in range(0, 120, 7):
            text, paths, used = context.pack_files(files, budget, t, skip)
            assert used <= max(budget, 0) and used == (len(t.encode(text)) if paths else 0)
    text, paths, _ = context.pack_files([("n", None), ("c", "x")], 40, t, True)
    assert paths == ["c"]
    assert context.pack_files([("n", None)], 60, t)[1] == ["n"]


def test_two_sided_context(spark):
    schema = "task_id string, position int, path string, content string, budget int"
    pos = spark.createDataFrame([("t", 1, "p.py", "one", 50)], schema)
    neg = spark.createDataFrame([("t", 1, "n.py", "two", 50), ("u", 1, "m.py", "three", 50)], schema)
    got = {r.task_id: r for r in context.two_sided_context(pos, neg, ["task_id"]).collect()}
    assert got["t"].files_in_prompt == ["p.py", "n.py"] and "one" in got["t"].context and "two" in got["t"].context
    assert got["u"].files_in_prompt == ["m.py"]


def test_recorded_chain_evaluations(spark):
    """The recorded predictions of one task, two models and two ratios, give the recorded metrics."""
    one, two, other = ["pulp/pulp.py"], ["pulp/pulp.py", "pulp/utilities.py"], ["pulp/pulp.py", "pulp/constants.py"]
    recorded = {
        ("a", "25_percent_positive"): [two, one, one, one, one],
        ("a", "50_percent_positive"): [two, one, one, one, two],
        ("b", "25_percent_positive"): [one, one, one, other, one],
        ("b", "50_percent_positive"): [one, one, one, two, two],
    }
    deps = [("pulp/tests/test_lpdot.py", 1), ("pulp/pulp.py", 2)]
    known = spark.createDataFrame(
        [("pulp", "pulp/tests/test_lpdot.py", deps)],
        "reponame string, test_file string, dependencies array<struct<file:string, hops:int>>"
    )
    golden = {"25_percent_positive": (0.9, 1.0, 0.9333, 0.8), "50_percent_positive": (0.8, 1.0, 0.8667, 0.6)}
    for model in "ab":
        rows = [
            ("pulp", ratio, "pulp_0", "pulp/tests/test_lpdot.py", i, f"```json\n{json.dumps(files)}\n```") for (m, ratio),
            samples in recorded.items() if m == model for i, files in enumerate(samples)
        ]
        said = spark.createDataFrame(
            [*rows, ("pulp", "25_percent_positive", "x", "no/report.py", 0, "[]")],
            "reponame string, ratio string, task_id string, test_file string, sample_id int, response string"
        )
        evaluated = evaluation.evaluate_chains(said, known)
        for r in evaluated.collect():
            wrong = len(recorded[model, r.ratio][r.sample_id]) == 2
            assert (r.precision, r.recall, r.exact_match) == (
                (0.5, 1.0, 0) if wrong else (1.0, 1.0, 1)
            ) and r.f1 == pytest.approx(2 / 3 if wrong else 1)
            assert r.truth_files == one and r.predicted_files == sorted(recorded[model, r.ratio][r.sample_id])
        summary = {r.ratio: r for r in evaluation.chain_summary(evaluated).where("reponame IS NULL").collect()}
        for ratio, means in golden.items():
            r = summary[ratio]
            assert (round(r.precision, 4), r.recall, round(r.f1, 4), round(r.exact_match, 4), r.num_tasks) == (*means, 1)


def test_chat_window(spark):
    rows = [("long", i, f"m{i}") for i in range(9)] + [("two", 0, "x"), ("two", 1, "y"), ("one", 5, "z")]
    got = context.chat_window(spark.createDataFrame(rows, "c string, turn int, text string"), ["c"], "turn").collect()
    assert sorted((r.c, r.turn) for r in got) == [("long", 0), ("long", 7), ("long", 8), ("one", 5), ("two", 0), ("two", 1)]


def test_project_tree(spark):
    paths = [
        "src/a/b/c/d.py", "src/Z.py", "src/a.py", "README", "build/x.py", "pkg.egg-info/y", "a.tmp",
        *[f"many/f{i}.py" for i in range(8)]
    ]
    df = spark.createDataFrame([("r", p) for p in paths], "reponame string, path string")
    lines = context.project_trees(df).first().tree.split("\n")
    assert lines[:9] == [
        "r/", "├── many/", "│   ├── f0.py", "│   ├── f1.py", "│   ├── f2.py", "│   ├── f3.py", "│   ├── f4.py", "│   ├── f5.py",
        "│   ├── f6.py"
    ]
    assert lines[9:] == [
        "│   └── f7.py", "│       └── ... (3 more files)", "├── src/", "│   ├── a/", "│   │   └── b/", "│   │       └── c/",
        "│   ├── a.py", "│   └── Z.py", "└── README"
    ]
    short = context.project_trees(df, limit=8).first().tree
    assert short.endswith("lines omitted)") and len(SpaceTokenizer().encode(short.rsplit("\n", 1)[0])) <= 8


EVENTS = [
    ("call", "A"), ("call", "A"), ("return", "A"), ("call", "B"), ("return", "B"), ("return", "A"), ("line", "C"),
    ("call", None)
]


def test_trace(spark):
    rows = [("t.py::f", i, k, n) for i, (k, n) in enumerate(EVENTS)] + [("t.py::g", 0, "call", "B"), ("u.py", 0, "call", "Z")]
    events = spark.createDataFrame(rows, schemas.TRACE_EVENT)
    folded = trace.fold_traces(events)
    assert {(r.test_nodeid, r.file, r.hops) for r in folded.collect()} == {
        ("t.py::f", "A", 1), ("t.py::f", "B", 1), ("t.py::g", "B", 1), ("u.py", "Z", 1)
    }
    assert {
        (r.file, r.hops) for r in trace.fold_traces(events.where("test_nodeid = 't.py::f'"), balanced=True).collect()
    } == {("A", 1), ("B", 2)}
    report = {
        (r.test_file, r.test_function): [tuple(d) for d in r.dependencies] for r in trace.function_report(folded).collect()
    }
    assert report == {("t.py", "f"): [("A", 1), ("B", 1)], ("t.py", "g"): [("B", 1)], ("u.py", "[module-level]"): [("Z", 1)]}
    assert {r.test_file: len(r.dependencies) for r in trace.file_report(folded).collect()} == {"t.py": 2, "u.py": 1}


def test_trace_stream(spark, tmp_path):
    rows = [("t", i, k, n) for i, (k, n) in enumerate(EVENTS)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schemas.TRACE_EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schemas.TRACE_EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    got = []
    q = trace_stream.fold_stream(stream).writeStream.outputMode("update").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    q.awaitTermination(120)
    out = spark.createDataFrame(got, "test_nodeid string, file string, hops int")
    assert {(r.file, r.hops) for r in trace_stream.least_hops(out).collect()} == {("A", 1), ("B", 1)}


def test_chain_evaluation(spark):
    reports_ = spark.createDataFrame(
        [("r", "t.py", [("t.py", 1), ("p.py", 2)]), ("r", "own.py", [("own.py", 1)])],
        "reponame string, test_file string, dependencies array<struct<file:string, hops:int>>"
    )
    rows = [
        ("r", "25", "r_0", "t.py", 0, '```json\n["p.py", "q.py"]\n```'), ("r", "25", "r_0", "t.py", 1, '["p.py"]'),
        ("r", "25", "r_1", "own.py", 0, "[]"), ("r", "25", "r_2", "missing.py", 0, "[]"), ("r", "25", "r_3", None, 0, "[]")
    ]
    preds = spark.createDataFrame(
        rows, "reponame string, ratio string, task_id string, test_file string, sample_id int, response string"
    )
    got = {
        (r.task_id, r.sample_id): (
            r.precision, r.recall, r.f1, r.exact_match
        ) for r in evaluation.evaluate_chains(preds, reports_).collect()
    }
    assert got == {("r_0", 0): (0.5, 1.0, pytest.approx(2 / 3), 0), ("r_0", 1): (1, 1, 1, 1), ("r_1", 0): (1, 1, 1, 1)}
    summary = {
        r.reponame: (r.precision, r.num_tasks) for r in evaluation.chain_summary(
            evaluation.evaluate_chains(preds, reports_)
        ).collect()
    }
    assert summary == {None: (0.875, 2), "r": (0.875, 2)}


def test_output_evaluation(spark):
    preds = spark.createDataFrame(
        [
            ("oracle", c, "r", "r_0", i, f"```output\n{a}\n```") for c in ("original", "rewrite") for i,
            a in enumerate(["1", "1.0", "2"])
        ] + [("oracle", "original", "r", "r_9", 0, None)],
        "mode string, condition string, reponame string, task_id string, sample_id int, response string"
    )
    truths = spark.createDataFrame(
        [(c, "r_0", "f", ["1"]) for c in ("original", "rewrite")] + [("original", "r_9", "g", ["1"])],
        "condition string, task_id string, funcname string, ground_truth array<string>"
    )
    diff = spark.createDataFrame([("r", "f", "hard")], "reponame string, funcname string, difficulty string")
    assert {r.task_id for r in evaluation.common_tasks(preds).collect()} == {"r_0"}
    ev = evaluation.evaluate_outputs(preds, truths, diff, n="actual")
    got = {
        (r.condition, r.task_id): (r.num_correct, r.num_samples, r.difficulty, round(r.pass_at_k["1"], 4)) for r in ev.collect()
    }
    assert got[("original", "r_0")] == (2, 3, "hard", 0.6667) and got[("original", "r_9")] == (0, 1, "unknown", 0.0)
    rows = evaluation.output_summary(ev).where("k = '1' AND condition = 'original'").collect()
    assert [r.difficulty for r in rows] == ["hard", "unknown", "overall"]
    with pytest.raises(ValueError):
        evaluation.require_truths(preds, truths.where("task_id = 'r_0'"))


def test_execution(spark):
    tasks = spark.createDataFrame(
        [("original", "t", "p.py", None, "f", "x == '???'")],
        "condition string, task_id string, testpath string, classname string, funcname string, masked_code string"
    )
    preds = spark.createDataFrame(
        [("original", "t", 0, "```output\n5\n```"), ("rewrite", "t", 0, "")],
        "condition string, task_id string, sample_id int, response string"
    )
    plan = evaluation.execution_plan(preds, tasks).collect()
    assert [(p.injected_code, p.selector) for p in plan] == [("x == 5", "f")]
    res = spark.createDataFrame(
        [("original", "m", "r", "t", i, i == 1) for i in range(4)],
        "condition string, mode string, reponame string, task_id string, sample_id int, passed boolean"
    )
    ev = evaluation.evaluate_executions(res)
    assert ev.first().execution_results == [False, True, False, False]
    assert {r.k: r.pass_at_k for r in evaluation.execution_summary(ev).collect()}["1"] == 0.25


def test_quality_report(spark):
    q = "struct<complexity_score:int, is_quality:boolean, reason:string>"
    tasks = spark.createDataFrame(
        [("a", (3, True, "ok")), ("a", (4, False, "x")), ("b", None)], f"reponame string, quality_analysis {q}"
    )
    r = reports.quality_report(tasks)
    assert (
        r["total_assertions"], r["quality_assertions"], r["filtered_assertions"], r["filter_reasons"]
    ) == (3, 2, 1, {"x": 1})
    assert r["repo_stats"]["b"]["quality_percent"] == 100.0


def test_augment(spark):
    tasks = spark.createDataFrame(
        [("original", "t", "pytest.approx(1)"), ("original", "u", "z")], "condition string, task_id string, ground_truth string"
    )
    rt = spark.createDataFrame(
        [
            ("original", "t", 1, ("failure", None, None)),
            ("original", "t", 2, ("success", "1", "<class '_pytest.python_api.ApproxScalar'>"))
        ],
        "condition string, task_id string, line_no int, runtime_ground_truth struct<status:string, value:string, type:string>"
    )
    got = {r.task_id: r.ground_truth for r in reports.augment_truths(tasks, rt, ["line_no"]).collect()}
    assert got == {"t": ["1", "1.0", "pytest.approx(1)"], "u": ["z"]}
    types = reports.type_histogram(rt).collect()
    assert [(x.n, x.percent) for x in types] == [(1, 100.0)]


def test_scans(spark, tmp_path):
    folder = tmp_path / "preds" / "25_percent"
    folder.mkdir(parents=True)
    (folder / "pulp.jsonl").write_text(
        '{"test_file": "a", "dependencies": [{"file": "x", "hops": 1}]}\n\nnot json\n{"test_file": "b", "dependencies": null}\n'
    )
    path = f"{tmp_path}/preds/*/*.jsonl"
    assert records.read_records(spark, path, schemas.FILE_REPORT).count() == 2
    kept = records.read_records(spark, path, schemas.FILE_REPORT, "keep").cache()
    assert records.bad_line_counts(kept).first().bad_lines == 1
    with pytest.raises(Exception):  # noqa: B017
        records.read_records(spark, path, schemas.FILE_REPORT, "fail").collect()
    assert records.read_records(spark, f"{tmp_path}/none/*.jsonl", schemas.FILE_REPORT).count() == 0
    ordered = records.read_ordered_records(spark, path, schemas.FILE_REPORT).orderBy("line_no").collect()
    assert [(r.test_file, r.line_no) for r in ordered] == [("a", 0), ("b", 3)]
    named = records.with_path_columns(records.read_records(spark, path, schemas.FILE_REPORT), "ratio").first()
    assert (named.reponame, named.ratio) == ("pulp", "25_percent")
    (tmp_path / "log.json").write_text(json.dumps([{"command": "ls", "success": True, "execution_time": 1.5}]))
    assert records.read_json_arrays(spark, str(tmp_path / "log.json"), schemas.COMMAND_LOG).first().command == "ls"


def test_source_scans(spark, tmp_path):
    tree = {
        "src/a.py": "x = 1", "src/__init__.py": "y", "Tests/test_b.py": "z", "src/test_c.py": "def test(): pass",
        "build/test_d.py": "q", "src/blank.py": " ", ".hid/e.py": "e", "src/t_agent_rewrite.py": "r"
    }
    for p, text in tree.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(records.read_sources(spark, str(tmp_path))) == sorted(set(tree) - {"src/__init__.py", ".hid/e.py"})
    files = spark.createDataFrame(list(tree.items()), "path string, content string")
    assert paths(records.test_sources(files)) == ["Tests/test_b.py", "src/test_c.py"]
    assert paths(records.corpus_sources(files)) == [".hid/e.py", "src/a.py", "src/t_agent_rewrite.py", "src/test_c.py"]
    assert "Tests/test_b.py" in paths(records.pool_sources(files)) and ".hid/e.py" not in paths(records.pool_sources(files))
    assert records.rewritten_sources(files).first().original_path == "src/t.py"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "stop"), ("a", 2, "error")], "task_id string, sample_id int, finish_reason string")
    out = str(tmp_path / "out")
    records.append_missing(spark, df, out, ("task_id", "sample_id"))
    records.append_missing(spark, df, out, ("task_id", "sample_id"))
    assert spark.read.parquet(out).count() == 2
    records.append_missing(spark, df, out, ("task_id", "sample_id"), retry_errors=True)
    assert spark.read.parquet(out).count() == 3
    records.write_report(spark, {"a": 1}, str(tmp_path / "rep"))
    assert "0.5000" in records.console_table(spark.createDataFrame([(0.5,)], "x double"))
    records.write_records(df.withColumnRenamed("task_id", "reponame"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    catalog, counts = records.repo_catalog(
        spark, {"c": {"a": "u", "b": "v"}}, spark.createDataFrame([("a",)], "reponame string")
    )
    assert catalog.count() == 2 and tuple(counts.first()) == ("c", 2, 1)


def test_trees(spark):
    df = spark.createDataFrame([("r", p) for p in ["a/b.py", "a/c/d.py", "z.py", ".git/x"]], "reponame string, path string")
    assert context.project_trees(df).first().tree.split("\n") == [
        "r/", "├── a/", "│   ├── c/", "│   │   └── d.py", "│   └── b.py", "└── z.py"
    ]


def test_tags_and_display_order(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert {
        tuple(r) for r in keys.tagged_union({"original": a, "rewrite": b}).collect()
    } == {(1, "x", "original"), (2, None, "rewrite")}
    df = spark.createDataFrame(
        [("t", "Z", "f"), ("t", None, "g"), ("t", "A", "h")], "testname string, classname string, funcname string"
    )
    assert [r.funcname for r in df.orderBy(*keys.align_order()).collect()] == ["h", "g", "f"]


def test_reports_with_sources(spark):
    df = lambda *names: spark.createDataFrame([(n,) for n in names], "reponame string")
    assert [r.reponame for r in records.repos_with_reports(df("a", "a", "b"), df("a", "c")).collect()] == ["a"]


def test_phases(spark):
    rows = [
        (1, "pytest", "ERROR collecting", ""), (2, "pytest", "collected 2 items", ""), (3, "ls", "", ""),
        (4, "pytest", "=== 1 passed", "ImportError")
    ]
    df = spark.createDataFrame(rows, "n int, command string, stdout string, stderr string").withColumn("r", F.lit("r"))
    assert [r.phase for r in trace.phases(df, ["r"], "n").orderBy("n").collect()] == ["SETUP", "SETUP", "TRACING", "TRACING"]
