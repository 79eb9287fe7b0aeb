"""Edge tables of the expressions and literal functions."""

import ast

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probelake.functions import python_source as S
from probelake.functions import python_values as V
from probelake.functions import scores
from probelake.functions import text as T


def one(spark, schema, row, **columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("pred", "truth", "expected"),
    [
        ([], [], (1, 1, 1, 1)), ([], ["a"], (0, 0, 0, 0)), (["a"], [], (0, 0, 0, 0)), (["a"], ["b"], (0, 0, 0, 0)),
        (["a", "b", "a"], ["a"], (0.5, 1, 2 / 3, 0)), (None, None, (1, 1, 1, 1)), (["b", "a"], ["a", "b"], (1, 1, 1, 1))
    ],
)
def test_set_metrics(spark, pred, truth, expected):
    r = one(spark, "p array<string>, t array<string>", (pred, truth), m=scores.set_metrics(F.col("p"), F.col("t"))).m
    assert tuple(r) == pytest.approx(expected)


def test_pass_at_k(spark):
    rows = spark.createDataFrame([(5, 0), (5, 1), (5, 5), (3, 1), (40, 7)], "n int, c int")
    got = rows.select(*[scores.pass_at_k(F.col("n"), F.col("c"), k).alias(f"k{k}") for k in (1, 5)]).collect()
    assert [r.k1 for r in got] == pytest.approx([0, 0.2, 1, 1 / 3, 7 / 40])
    assert [r.k5 for r in got][:4] == pytest.approx([0, 1, 1, 1])


def test_pass_at_k_is_monotone(spark):
    rows = spark.range(0, 21).selectExpr("20 as n", "int(id) as c").select(
        "c", *[scores.pass_at_k(F.col("n"), F.col("c"), k).alias(f"k{k}") for k in range(1, 6)]
    ).orderBy("c").collect()
    for r in rows:
        assert list(r)[1:] == sorted(list(r)[1:])
    for k in range(1, 6):
        assert [r[k] for r in rows] == sorted(r[k] for r in rows)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("1", "True", True), ("(1,2)", "[1,2]", False), ("'a'", '"a"', True), ("{1,2}", "{2,1}", True), ("x+1", "x + 1", False),
        (" 1.0", "1", True), ("(" * 5000 + ")" * 5000, "1", False), ("{[]}", "{[]}", True)
    ]
)
def test_literal_equal(a, b, same):
    assert V.literal_equal(a, b) is same


@given(
    st.recursive(
        st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.tuples(x, x),
        max_leaves=6
    )
)
def test_literal_equal_to_itself(value):
    assert V.literal_equal(repr(value), f" {value!r}\n") is True


def test_matches_any(spark):
    rows = [("1", ["2", "1.0"], True), ("x", ["x "], True), (None, ["None"], False), ("1", None, False), ("1", [], False)]
    got = spark.createDataFrame(rows, "p string, t array<string>, e boolean").select(
        V.matches_any(F.col("p"), F.col("t")).alias("m"), "e"
    ).collect()
    assert [r.m for r in got] == [r.e for r in got]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("none", None), ("```output\n```", ""), ("a\n```output\n 1 \n```\n```output\n2\n```", "1"),
        ("```output  \nx\ny\n```", "x\ny"), (None, None)
    ],
)
def test_answer(spark, text, expected):
    assert one(spark, "t string", (text,), a=T.answer(F.col("t"))).a == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('```json\n["a.py", " b.py "]\n```', ["a.py", "b.py"]), ('x ["a"] y', ["a"]), ("['a', \"b\"]", ["a", "b"]),
        ("prose", []), ('[["a"], 1]', ["['a']", "1"]), (None, []), ("[a, b]", []), ("[]", []), ('["a\\u0041"]', ["aA"]),
        ("[(1, 2), None]", ["(1, 2)", "None"]),
    ],
)
def test_file_list(spark, text, expected):
    assert one(spark, "t string", (text,), a=V.file_list(F.col("t"))).a == expected


@pytest.mark.parametrize(
    ("name", "bare", "before"),
    [
        ("A::test_x[p]", "test_x", "test_x"), ("test_x[a::b]", "test_x", "test_x"), ("test_x[p]y", "test_x[p]y", "test_x"),
        ("A[T]::test_x", "test_x", "A")
    ]
)
def test_names(spark, name, bare, before):
    # the greedy form only drops a bracket that ends the name
    r = one(spark, "n string", (name,), a=T.bare_name(F.col("n")), b=T.bare_name_before_bracket(F.col("n")))
    assert (r.a, r.b) == (bare, before)


def test_node_id_and_selector(spark):
    r = one(
        spark, "a string, b string", ("t.py::A::f", "t.py"), x=T.node_id_parts(F.col("a")), y=T.node_id_parts(F.col("b")),
        s=T.test_selector(F.lit(""), F.lit("f")), c=T.test_selector(F.lit("C"), F.lit("f"))
    )
    assert (tuple(r.x), tuple(r.y), r.s, r.c) == (("t.py", "A::f"), ("t.py", "[module-level]"), "f", "C::f")


@pytest.mark.parametrize(
    ("deps", "known", "level"),
    [
        ([], True, "easy"), ([("a", 2)], True, "easy"), ([("a", 2), ("b", 3)], True, "hard"), ([("a", None)], True, "easy"),
        (None, False, "unknown"), (None, True, "easy")
    ]
)
def test_difficulty(spark, deps, known, level):
    assert one(
        spark, "d array<struct<file:string, hops:int>>, k boolean", (deps, known), x=scores.difficulty(F.col("d"), F.col("k"))
    ).x == level


def test_space_tokens(spark):
    text = "a b　c \n d "
    assert one(spark, "t string", (text,), x=T.space_tokens(F.col("t"))).x == text.split()


def test_message_parsing(spark):
    text = "```file: a.py \nx = 1\n```\n```bash\n# note\n ls -l\n\npwd\n```\n```file:b.sh\necho\n```\n```bash\ntrue\n```\n```status\n Success \n```"
    r = one(
        spark, "t string", (text,), f=T.file_blocks(F.col("t")), c=T.shell_commands(F.col("t")), s=T.status_marker(F.col("t")),
        g=T.first_file_block(F.lit("no"))
    )
    assert [tuple(x) for x in r.f] == [("a.py", "x = 1"), ("b.sh", "echo")]
    assert (r.c, r.s, r.g) == (["ls -l", "pwd", "true"], "success", None)


def test_markers_paths_and_percent(spark):
    r = one(
        spark, "t string", ("a---GT_START---\n{\"k\": 1}\n---GT_END---b",), m=T.between_markers(F.col("t")),
        n=T.between_markers(F.lit("---GT_START--- x")), p=T.percent(F.lit(1), F.lit(0)),
        r=T.rewritten_name(F.lit("a/test_b.c.py")),
        o=T.original_path(F.lit("a/test_b_agent_rewrite.py")), s=T.slug(F.lit("gpt 4.1/x")), w=T.posix(F.lit("a\\b")),
        f=T.fill_placeholder(F.lit("f('???', '???')"), F.lit("1")),
        e=T.expand_shorthand(F.lit("x/conftest.py"), F.lit("S = 1"), F.lit("a\nP\nb"), "P"),
        q=T.template("{a}-{b}-{a}", a=F.lit(1), b=F.lit("z")),
    )
    assert (r.m, r.n, r.p, r.r, r.o, r.s, r.w, r.f, r.e, r.q) == (
        '{"k": 1}', None, None, "test_b.c_agent_rewrite.py", "a/test_b.py", "gpt_4_1_x", "a/b", "f(1, 1)", "a\nS = 1\nb",
        "1-z-1"
    )


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        (("success", "1", "<class '_pytest.python_api.ApproxScalar'>", "pytest.approx(1)"), ["1", "1.0"]),
        (("success", '"-45.6 \\u00b1 4.6e-05"', "<class '_pytest.python_api.ApproxScalar'>", "pytest.approx(x[1])"), ["-45.6"]),
        (("success", "[1, 2]", "<class 'tuple'>", "t"), ["(1, 2)"]), (("success", '"a"', "<class 'str'>", "s"), ["'a'"]),
        (("success", "null", "<class 'NoneType'>", "n"), []), (("failure", "1", "<class 'int'>", "n"), []),
        (("success", "[1, true]", "<class 'list'>", "n"), ["[1, True]"]),
        (("success", "7", "<class 'numpy.int64'>", "n"), ["7"]), ((None, None, None, None), []),
    ],
)
def test_truth_texts(args, expected):
    assert V.truth_texts(*args) == expected


@pytest.mark.parametrize(
    ("right", "ok"),
    [
        ("1", False), ("-1", True), ("1.0", False), ("True", False), ("None", True), ("''", False), ("'ab'", True),
        ("'None'", False), ("3", True), ("no", False), ("x", True)
    ]
)
def test_right_side(right, ok):
    assert S.is_guessable(ast.parse(right, mode="eval").body) is not ok


def test_weights_and_reasons():
    a = lambda src: S.analyse(ast.parse(src).body[0])
    assert a("assert f(x, 1).y == [1, {2: g(3)}]")["complexity_score"] == 2 + (2 + 1 + 3 + 1 + 3 + 1)
    assert a("assert x")["reason"] == "Not a comparison"
    assert a("assert x < 3")["reason"] == "Not an equality comparison"
    assert a("assert x == 3")["reason"] == "Left side lacks meaningful operations"
    assert a("assert f() == 1")["reason"] == "Right side too simple"
    assert a("assert f() == 5")["is_quality"]
    assert S.analyse(ast.parse("assert str(5) == '5!'").body[0], "plain")["reason"] == "Matches simple pattern"


SOURCE = '''
import os
from a import b
class A:
    def test_one(self):
        if True:
            assert f(1) == 10 == z
        assert g() == 'long'
        def test_inner():
            assert h() == 7
async def test_async():
    assert f() == 9
'''


def test_tasks_of_source():
    tasks = S.tasks_of_source(SOURCE)
    assert [(t["classname"], t["funcname"], t["ground_truth"]) for t in tasks] == [
        ("A", "test_one", "'long'"), ("A", "test_one", "10"), ("A", "test_one", "7"), ("A", "test_inner", "7")
    ]
    assert tasks[0]["imports"] == ["import os", "from a import b"]
    assert "assert f(1) == '???' == z" in tasks[1]["masked_code"]
    assert S.tasks_of_source("def (") == [] and S.tasks_of_source(None) == []
    assert len(S.tasks_of_source("def test_a():\n    assert x == 1", quality=False)) == 1


def test_rewriting():
    new = S.replace_function(SOURCE, "A", "test_one", "def test_one(self):\n    pass")
    assert "assert" not in new.split("async")[0]
    assert S.replace_function(SOURCE, None, "test_one", "def test_one(): pass") is None
    assert S.replace_function(SOURCE, "A", "test_one", "x = 1") is None
    printed = S.print_truth(SOURCE, "A", "test_one", "'long'")
    assert "GT_START" in printed and "assert g()" not in printed
    assert S.print_truth(SOURCE, "A", "test_one", "99") is None
    hooks = "x = 1\ndef pytest_sessionfinish(session):\n    a()\n\n    b()\ny = 2"
    assert S.neutralize_hooks(hooks).split("\n") == [
        "x = 1", "def pytest_sessionfinish(session):", "    # Call chain tracking disabled during rewrite phase", "    return",
        "y = 2"
    ]


def test_truncate():
    t = V.SpaceTokenizer()
    assert V.truncate_text("a b\nc d", 9, t) == "a b\nc d"
    assert V.truncate_text("a b\nc d", 3, t) == "a b\n... (1 lines omitted)"
    assert V.truncate_text("a b c", 3, t) == "a b\n... (truncated)"


def test_white_space_is_that_of_python(spark):
    odd = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    texts = [f"{c}a{c}b{c}" for c in odd] + [odd + "x" + odd, "\u200bz\u200b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.strip(F.col("t")).alias("s"), T.space_tokens(F.col("t")).alias("w")).collect():
        assert r.s == r.t.strip() and r.w == r.t.split(), repr(r.t)


def test_printer_keeps_its_contract():
    """The code that stands for an assertion, run on plain values here, prints one line of JSON between the markers."""
    import contextlib
    import io
    import json

    for truth, status, value in (
        ("[1, 2]", "success", [1, 2]), ("{3}", "success", "{3}"), ("1 / 0", "failure", None), ("'a\\nb'", "success", "a\nb")
    ):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            exec(S._PRINTER.format(truth=truth), {})  # our own template
        lines = out.getvalue().split("\n")
        assert lines[0] == "" and lines[1] == "---GT_START---" and lines[3] == "---GT_END---"
        record = json.loads(lines[2])
        assert record["status"] == status and record.get("value") == value
        assert ("type" in record) == (status == "success") and ("traceback" in record) == (status == "failure")
