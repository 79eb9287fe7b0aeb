"""Command lines and prompts on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from probelake import cli
from probelake.operators import prompts


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_evaluate_chains(spark, tmp_path, capsys):
    lines(
        tmp_path / "p/25_percent/pulp.jsonl",
        [
            {
                "task_id": "pulp_0", "test_file": "t.py", "sample_id": 0, "ratio": 0.25,
                "response": '```json\n["p.py", "q.py"]\n```'
            }
        ]
    )
    lines(
        tmp_path / "r/pulp/report_files.jsonl",
        [{"test_file": "t.py", "dependencies": [{"file": "t.py", "hops": 1}, {"file": "p.py", "hops": 2}]}]
    )
    cli.main(["evaluate-chains", str(tmp_path / "p"), str(tmp_path / "r"), str(tmp_path / "out")], spark)
    row = spark.read.json(str(tmp_path / "out")).first()
    assert (row.ratio, row.reponame, row.precision, row.recall, row.exact_match) == ("25_percent", "pulp", 0.5, 1.0, 0)
    assert "0.6667" in capsys.readouterr().out


def test_collect_rank_and_align(spark, tmp_path):
    repo = tmp_path / "repos/r"
    for p, text in {
        "lib/a.py": "def size(x): return 5", "lib/b.py": "other words",
        "tests/test_a.py": "from a import size\ndef test_a():\n    assert size(3) == 50\n    assert size(4) == 60\n"
    }.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(text)
    cli.main(["collect-tasks", str(tmp_path / "repos"), str(tmp_path / "tasks")], spark)
    got = spark.read.json(str(tmp_path / "tasks")).orderBy("task_id").collect()
    assert [(r.task_id, r.testpath, r.ground_truth) for r in got] == [
        ("r_0", "tests/test_a.py", "50"), ("r_1", "tests/test_a.py", "60")
    ]
    flat = [
        json.loads(x) for x in spark.read.json(str(tmp_path / "tasks")).withColumn("reponame", F.lit("r")).toJSON().collect()
    ]
    lines(tmp_path / "flat/r.jsonl", flat)
    lines(tmp_path / "re/r.jsonl", [dict(flat[0], task_id="x")])
    cli.main(["rank", str(tmp_path / "flat"), str(tmp_path / "repos"), str(tmp_path / "ranks")], spark)
    assert spark.read.json(str(tmp_path / "ranks")).first().related_files_rank[0] == "lib/a.py"
    cli.main(["align", str(tmp_path / "flat"), str(tmp_path / "re"), str(tmp_path / "al")], spark)
    assert spark.read.json(str(tmp_path / "al/rewrite")).first().task_id == flat[0]["task_id"]
    cli.main(["quality-report", str(tmp_path / "flat"), "--output", str(tmp_path / "q")], spark)
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "q")).collect()))["total_assertions"] == 2


def test_outputs_augment_and_executions(spark, tmp_path, capsys):
    task = {
        "task_id": "r_0", "reponame": "r", "testpath": "t.py", "testname": "t.py", "funcname": "test_a",
        "ground_truth": "pytest.approx(1)"
    }
    for c in ("original", "rewrite"):
        lines(tmp_path / f"d/{c}/r.jsonl", [task])
        lines(
            tmp_path / f"p/{c}/predictions/oracle/r.jsonl",
            [
                {"task_id": "r_0", "experiment_type": "oracle", "sample_id": i, "response": f"```output\n{v}\n```"} for i,
                v in enumerate(["1", "2"])
            ]
        )
    lines(
        tmp_path / "rt/all.jsonl",
        [
            {
                "task_id": "r_0", "condition": c,
                "runtime_ground_truth": {"status": "success", "value": 1, "type": "<class '_pytest.python_api.ApproxScalar'>"}
            } for c in ("original", "rewrite")
        ]
    )
    cli.main(["augment", str(tmp_path / "d"), str(tmp_path / "rt"), str(tmp_path / "aug")], spark)
    aug = spark.read.json(str(tmp_path / "aug"))
    assert aug.count() == 2 and aug.first().ground_truth == ["1", "1.0", "pytest.approx(1)"]
    for c in ("original", "rewrite"):
        lines(tmp_path / f"t/{c}/r.jsonl", [dict(task, ground_truth=["1", "1.0"])])
    lines(
        tmp_path / "rep/r/report_functions.jsonl",
        [{"test_file": "t.py", "test_function": "A::test_a[x]", "dependencies": [{"file": "a", "hops": 3}]}]
    )
    cli.main(
        [
            "evaluate-outputs", str(tmp_path / "p"), str(tmp_path / "t"), str(tmp_path / "rep"), str(tmp_path / "ev"),
            "--actual_samples"
        ],
        spark
    )
    row = spark.read.json(str(tmp_path / "ev")).first()
    assert (row.num_correct, row.difficulty, row.pass_at_k["1"]) == (1, "hard", 0.5)
    lines(
        tmp_path / "ex.jsonl",
        [
            {
                "condition": "original", "mode": "oracle", "reponame": "r", "task_id": "r_0", "sample_id": i, "passed": i == 0
            } for i in range(2)
        ]
    )
    cli.main(["evaluate-executions", str(tmp_path / "ex.jsonl"), str(tmp_path / "exo")], spark)
    assert spark.read.json(str(tmp_path / "exo")).first().num_correct == 1


def test_output_prompts(spark):
    tasks = spark.createDataFrame([("t", "r", "assert f() == '???'")], "task_id string, reponame string, masked_code string")
    chosen = spark.createDataFrame(
        [("t", "oracle", 1, "a.py"), ("t", "oracle", 2, "none.py")], "task_id string, mode string, position int, path string"
    )
    files = spark.createDataFrame([("r", "a.py", "def f(): return 1")], "reponame string, path string, content string")
    done = spark.createDataFrame([("t", "oracle", 0)], "task_id string, mode string, sample_id int")
    got = prompts.output_prompts(
        tasks, chosen, files, "system", "Files:\n{related_files}\nTest:\n{masked_code}", 400, 50, 3, done
    ).collect()
    assert sorted(r.sample_id for r in got) == [1, 2] and got[0].files == ["a.py", "none.py"]
    assert "def f(): return 1" in got[0].prompt and "assert f() == '???'" in got[0].prompt


def test_chain_prompts_and_completions(spark):
    tests = spark.createDataFrame([("r", "t.py")], "reponame string, test_file string")
    reports = spark.createDataFrame(
        [("r", "t.py", [("t.py", 1), ("p.py", 2)])],
        "reponame string, test_file string, dependencies array<struct<file:string, hops:int>>"
    )
    pool = spark.createDataFrame([("r", "p.py"), ("r", "n.py"), ("r", "m.py")], "reponame string, path string")
    sources = spark.createDataFrame(
        [("r", p, f"code of {p}") for p in ("t.py", "p.py", "n.py", "m.py")], "reponame string, path string, content string"
    )
    positive, negative = prompts.candidate_files(tests, reports, pool)
    assert [r.path for r in positive.collect()] == ["p.py"] and {r.path for r in negative.collect()} == {"n.py", "m.py"}
    made = prompts.chain_prompts(tests, reports, pool, sources, "{test_file}\n{test_code}\n{files}", 200, (0.25, 0.5), 2)
    rows = made.collect()
    assert len(rows) == 4 and all(set(r.files_in_prompt) == {"p.py", "n.py", "m.py"} for r in rows)

    def model(prompt):
        if "0.5" in prompt:
            raise RuntimeError("no")
        return "[]"

    out = prompts.completions(
        made.withColumn("prompt", F.concat_ws("|", "prompt", F.col("ratio").cast("string"))), model
    ).collect()
    assert {(r.ratio, r.finish_reason) for r in out} == {(0.25, "stop"), (0.5, "error")}
    assert any(r.response == "ERROR: RuntimeError - no" for r in out)


def test_unknown_command():
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_prompt_commands(spark, tmp_path):
    repo = tmp_path / "repos/r"
    for p, text in {
        "lib/a.py": "def size(x): return 5", "lib/b.py": "other words here",
        "tests/test_a.py": "from a import size\ndef test_a(): ..."
    }.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(text)
    task = {
        "task_id": "r_0", "reponame": "r", "testpath": "tests/test_a.py", "testname": "test_a.py", "funcname": "test_a",
        "masked_code": "assert size(3) == '???'"
    }
    lines(tmp_path / "tasks/r.jsonl", [task, dict(task, task_id="r_1")])
    lines(tmp_path / "ranks/r.jsonl", [{"task_id": "r_0", "reponame": "r", "related_files_rank": ["lib/b.py", "lib/a.py"]}])
    deps = [{"file": "tests/test_a.py", "hops": 1}, {"file": "lib/a.py", "hops": 2}]
    lines(
        tmp_path / "reports/r/report_functions.jsonl",
        [{"test_file": "tests/test_a.py", "test_function": "test_a", "dependencies": deps}]
    )
    lines(tmp_path / "reports/r/report_files.jsonl", [{"test_file": "tests/test_a.py", "dependencies": deps}])
    (tmp_path / "t.txt").write_text("Files:\n{related_files}Code:\n{masked_code}")
    at = lambda name: str(tmp_path / name)
    cli.main(
        [
            "output-prompts", at("tasks"), at("ranks"), at("reports"), at("repos"), at("out"), "--modes", "oracle,retrieval",
            "--template", at("t.txt"), "--samples", "2"
        ],
        spark
    )
    got = {(r.mode, r.task_id, r.sample_id): r for r in spark.read.json(at("out")).collect()}
    assert set(got) == {("oracle", t, i) for t in ("r_0", "r_1") for i in (0, 1)} | {("retrieval", "r_0", i) for i in (0, 1)}
    assert got["oracle", "r_1", 0].files == ["tests/test_a.py", "lib/a.py"] and sorted(got["retrieval", "r_0", 1].files) == ["lib/a.py", "lib/b.py"]
    assert got["oracle", "r_0", 0].prompt.startswith("Files:\n### file: tests/test_a.py") and got["oracle", "r_0", 0].prompt.endswith("assert size(3) == '???'")
    cli.main(
        [
            "output-prompts", at("tasks"), at("ranks"), at("reports"), at("repos"), at("more"), "--modes", "oracle",
            "--samples", "3", "--done_dir", at("out")
        ],
        spark
    )
    assert {r.sample_id for r in spark.read.json(at("more")).collect()} == {2}
    cli.main(["chain-prompts", at("tasks"), at("reports"), at("repos"), at("chains"), "--samples", "1"], spark)
    rows = spark.read.json(at("chains")).collect()
    assert len(rows) == 2 and all(
        sorted(r.files_in_prompt) == ["lib/a.py", "lib/b.py"] and "def test_a" in r.prompt for r in rows
    )
