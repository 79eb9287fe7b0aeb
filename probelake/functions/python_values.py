"""Values written as Python literals: equality, lists, runtime values, tokens.

These need Python's own semantics, so they run as Arrow-batched pandas UDFs. Texts are
only ever parsed as literals, never executed.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from probelake.functions import text as T

_BAD_LITERAL = (ValueError, SyntaxError, MemoryError, TypeError, RecursionError)


def literal_equal(left: str | None, right: str | None) -> bool:
    """Equal as Python literals; where either is none, equal as trimmed texts."""
    left, right = (left or "").strip(), (right or "").strip()
    try:
        return bool(ast.literal_eval(left) == ast.literal_eval(right))
    except _BAD_LITERAL:
        return left == right


@F.pandas_udf(BooleanType())
def _any_literal(prediction: pd.Series, truths: pd.Series) -> pd.Series:
    return pd.Series([t is not None and any(literal_equal(p, x) for x in t) for p, t in zip(prediction, truths, strict=True)])


def matches_any(prediction: Column, truths: Column) -> Column:
    """Whether a predicted text equals any true text; null predictions never do."""
    return F.coalesce(
        prediction.isNotNull() & (contains_text(truths, prediction) | _any_literal(prediction, truths)), F.lit(False)
    )


def contains_text(truths: Column, prediction: Column) -> Column:
    """Equal trimmed texts are equal either way, as literals or as texts."""
    return F.coalesce(F.exists(truths, lambda t: T.strip(t) == T.strip(prediction)), F.lit(False))


def parse_list(list_literal: str | None) -> list[str]:
    """Items of a JSON or Python list as trimmed strings; [] for anything else."""
    if not list_literal:
        return []
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(list_literal)
        except _BAD_LITERAL:
            continue
        return [str(x).strip() for x in found] if isinstance(found, list) else []
    return []


@F.pandas_udf(ArrayType(StringType()))
def _listed(literals: pd.Series) -> pd.Series:
    return literals.map(parse_list)


def file_list(response: Column) -> Column:
    """File names of a response: JSON lists of plain strings stay in the JVM, the rest is parsed."""
    literal = T.list_text(response)
    plain = F.regexp_like(F.coalesce(literal, F.lit("")), F.lit(r'^\[\s*(?:"[^"\\]*"\s*(?:,\s*"[^"\\]*"\s*)*)?\]$'))
    return F.when(
        literal.isNull(), F.array().cast("array<string>")
    ).when(plain, T.json_strings(literal)).otherwise(_listed(literal))


def _number_texts(number: float) -> set[str]:
    """A whole number is written both ways."""
    return {str(int(number)), str(float(number))} if number.is_integer() else {str(number)}


def truth_texts(status: str | None, value_json: str | None, type_name: str | None, original: str | None) -> list[str]:
    """Texts that a recorded runtime value may be written as, sorted."""
    if status != "success" or type_name == "<class 'NoneType'>":
        return []
    value = json.loads(value_json) if value_json is not None else None
    kind = (type_name or "").removeprefix("<class '").removesuffix("'>")
    if kind.endswith("ApproxScalar"):
        m = re.search(r"pytest\.approx\(([^,)]+)", original or "")
        candidates = [(m.group(1), True)] if m else []
        if isinstance(value, str) and "±" in value:
            candidates.append((value.split("±")[0], False))
        for text, both_ways in candidates:
            try:
                number = float(text.strip())
                return sorted(_number_texts(number) if both_ways else {str(number)})
            except (ValueError, OverflowError):
                continue
        return []
    if kind == "tuple":
        return [str(tuple(value))] if isinstance(value, list) else []
    return [repr(value) if kind == "str" else str(value)]


@F.pandas_udf(ArrayType(StringType()))
def _truths(status: pd.Series, value: pd.Series, kind: pd.Series, original: pd.Series) -> pd.Series:
    return pd.Series([truth_texts(*x) for x in zip(status, value, kind, original, strict=True)])


def truths_of_runtime(status: Column, value_json: Column, type_name: Column, original: Column) -> Column:
    """Extra truths from a runtime value; its value comes as JSON text."""
    return _truths(status, value_json, type_name, original)


# tokens: any pair of encode and decode functions


class SpaceTokenizer:
    """Offline default: white space runs and the rest are tokens; decoding restores the text."""

    pattern = re.compile(r"\s+|\S+")

    def encode(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


def token_count(text: Column, tokenizer_of: Callable[[], object] = SpaceTokenizer) -> Column:
    """Tokens of each text; ``tokenizer_of`` is called once in a batch."""

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        tokenizer = tokenizer_of()
        return texts.map(lambda t: len(tokenizer.encode(t or "")))

    return count(text)


def truncate_text(text: str, limit: int, tokenizer, lines: int | None = None) -> str:
    """The first ``limit`` tokens and a note of what is missing; ``lines`` where the text is itself the head of one of so many."""
    tokens, lines = tokenizer.encode(text), lines or len(text.splitlines())
    if len(tokens) <= limit:
        return text
    short = tokenizer.decode(tokens[:limit])
    missing = lines - len(short.splitlines())
    if missing > 0:
        return f"{short}\n... ({missing} lines omitted)"
    return f"{short}\n... (truncated)" if len(short) < len(text) else short


def token_truncate(text: Column, limit: int, tokenizer_of: Callable[[], object] = SpaceTokenizer) -> Column:
    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        tokenizer = tokenizer_of()
        return texts.map(lambda t: None if t is None else truncate_text(t, limit, tokenizer))

    return cut(text)
