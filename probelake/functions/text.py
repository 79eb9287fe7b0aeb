r"""Text expressions: answers in fences, names, logs and paths, as plain Columns.

Everything here stays in the JVM; no Python runs per row. Regular expressions and
higher-order functions are evaluated row by row inside the generated code or beside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fences and blocks that hold values, lists, files and commands.
ANSWER_FENCE = r"(?s)```output\s*\n(.*?)\s*```"
_LIST_IN_FENCE = r"(?s)```(?:output|json|python)?\s*(\[.*\])\s*```"
_LIST_ANYWHERE = r"(?s)\[.*\]"
_FILE_BLOCK = r"(?s)```file:([^\n]+)\n(.*?)```"
_SHELL_BLOCK = r"(?s)```bash\s*\n(.*?)\n```"
#: White space as Python's ``str.strip`` and ``str.split`` know it.
_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Python's ``str.strip``: Unicode white space at both ends goes."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def answer(response: Column) -> Column:
    """The first answer fence's text; null where there is none (an empty fence gives '')."""
    response = F.coalesce(response, F.lit(""))
    return F.when(F.regexp_like(response, F.lit(ANSWER_FENCE)), strip(F.regexp_extract(response, ANSWER_FENCE, 1)))


def list_text(response: Column) -> Column:
    """The list literal of a response: in a fence, else from the first [ to the last ]."""
    response = F.coalesce(response, F.lit(""))
    fenced, bare = F.regexp_extract(response, _LIST_IN_FENCE, 1), F.regexp_extract(response, _LIST_ANYWHERE, 0)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def json_strings(list_literal: Column) -> Column:
    """A JSON array's items as trimmed strings; null where the text is no JSON array."""
    return F.transform(F.from_json(list_literal, "array<string>", {"allowSingleQuotes": "false"}), strip)


def bare_name(name: Column) -> Column:
    """Function name: a trailing [...] goes, then the last part of a::b::c stays."""
    return F.element_at(F.split(F.regexp_replace(name, r"(?s)\[.*\]$", ""), "::"), -1)


def bare_name_before_bracket(name: Column) -> Column:
    """Function name: what precedes the first [, then its last :: part."""
    return F.element_at(F.split(F.split(name, r"\[")[0], "::"), -1)


def node_id_parts(node_id: Column) -> Column:
    """(test_file, test_function) of a test id; without a function ``[module-level]``."""
    parts = F.split(node_id, "::", 2)
    return F.struct(
        parts[0].alias("test_file"), F.coalesce(F.get(parts, F.lit(1)), F.lit("[module-level]")).alias("test_function")
    )


def space_tokens(text: Column) -> Column:
    """Tokens between Unicode white space, case kept."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"(?U){_SPACE}+"), "")


def fill_placeholder(masked: Column, value: Column) -> Column:
    """Every placeholder of a masked test replaced by ``value``."""
    return F.replace(masked, F.lit("'???'"), value)


def file_blocks(text: Column) -> Column:
    """All file blocks of a message: array of (filename, content), trimmed."""
    names, bodies = F.regexp_extract_all(text, F.lit(_FILE_BLOCK), F.lit(1)), F.regexp_extract_all(text, F.lit(_FILE_BLOCK), F.lit(2))
    return F.zip_with(names, bodies, lambda n, b: F.struct(strip(n).alias("filename"), strip(b).alias("content")))


def first_file_block(text: Column) -> Column:
    """The first file block, or null."""
    return F.get(file_blocks(text), F.lit(0))


def shell_commands(text: Column) -> Column:
    """Lines of all shell blocks, without blanks and comments."""
    lines = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(_SHELL_BLOCK), F.lit(1)), lambda b: F.transform(F.split(b, "\n"), strip))
    )
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


def status_marker(text: Column) -> Column:
    """``failed``, else ``success``, else null."""
    has = lambda word: F.regexp_like(text, F.lit(rf"(?i)```status\s*\n\s*{word}\s*\n```"))
    return F.when(has("failed"), "failed").when(has("success"), "success")


# What a finished, and what a crashed, collection of tests prints.
_COLLECTED = r"collected \d+ items|=\s*(?:\d+ (?:passed|failed|skipped)|no tests ran)"
_CRASHED = "INTERNALERROR|ImportError|ModuleNotFoundError"


def setup_complete(command: Column, stdout: Column, stderr: Column) -> Column:
    """Whether a logged command shows that tests were collected without a crash."""
    out, err = F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))
    both = F.concat(out, err)
    good = F.regexp_like(both, F.lit(_COLLECTED))
    bad = F.regexp_like(err, F.lit(_CRASHED)) | both.contains("ERROR collecting")
    return command.contains("pytest") & good & ~bad


def failure_class(exit_code: Column, stdout: Column, stderr: Column) -> Column:
    """``passed`` for exit code 0, else the first of failed, error, timeout; else unknown."""
    out, err = F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))
    late = out.contains("Timeout >") | err.contains("Timeout >")
    return F.when(exit_code == 0, "passed").when(out.contains("FAILED"), "failed").when(out.contains("ERROR"), "error").when(late, "timeout").otherwise("unknown")


def between_markers(text: Column, start: str = "---GT_START---", end: str = "---GT_END---") -> Column:
    """The trimmed text between two markers; null unless both occur."""
    inner = F.get(F.split(text, F.lit(_quote(start)), -1), F.lit(1))
    return F.when(text.contains(start) & text.contains(end), strip(F.substring_index(inner, end, 1)))


def _quote(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def rewritten_name(path: Column) -> Column:
    """File name of the rewritten variant of a test file."""
    return F.concat(stem(path), F.lit("_agent_rewrite.py"))


def original_path(path: Column) -> Column:
    """Path of the original of a rewritten test file."""
    return F.regexp_replace(path, r"_agent_rewrite\.py$", ".py")


def renamed_folder(path: Column, prefix: str = "callchain_prediction_", to: str = "evaluation_results_") -> Column:
    """The last folder's name with a part replaced; unchanged where it is not there."""
    return F.replace(F.regexp_extract(path, r"([^/]*)/*$", 1), F.lit(prefix), F.lit(to))


def slug(model: Column) -> Column:
    return F.regexp_replace(model, r"[^A-Za-z0-9_\-]", "_")


def test_selector(classname: Column, funcname: Column) -> Column:
    """``Class::function``, or the function alone where there is no class."""
    return F.concat_ws("::", F.when(classname != "", classname), funcname)


def percent(part: Column, total: Column) -> Column:
    """Percent of the total; null for an empty one."""
    return F.try_divide(part * F.lit(100.0), total)


def template(text: str, /, **values: Column) -> Column:
    """Named substitution of ``{name}`` in a prompt text."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def expand_shorthand(
    filename: Column, content: Column, full: Column, placeholder: str, marker: str = "import hunter"
) -> Column:
    """A created ``conftest.py`` without the tracer gets its line put into the full text."""
    short = filename.contains("conftest.py") & ~content.contains(marker)
    return F.when(short, F.replace(full, F.lit(placeholder), content)).otherwise(content)


def excluded_path(path: Column, names: list[str], lower: bool = True) -> Column:
    """Whether a directory or file name of a relative path is one of ``names``."""
    return F.arrays_overlap(F.split(F.lower(path) if lower else path, "/"), F.array(*[F.lit(n) for n in names]))
