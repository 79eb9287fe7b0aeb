r"""Quality rules: a threshold table compiled into one native projection.

Every rule compares a ratio of two measured quantities with a bound as
``100 * numerator <op> bound * denominator``, so no division by zero occurs and
whole numbers stay exact. The compiled verdict is one Catalyst expression; no
Python runs on executors.

Defined results: a null or empty text has no words, all counts 0, ``base_failed`` true;
very long texts are measured whole; a ratio that equals its bound passes; repeated rows
give repeated results; a null id stays null; further columns of the input, whatever their
names, are ignored (or kept as they are by :func:`quality_filter`). An empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import let, words

SYMBOLS = "#*$%&|<>"

# Common function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it on was with as be at by are this from or an which not but "
    "der die das und ist in den von zu mit sich auf für als auch ein eine nicht des dem "
    "le la les de des et un une du en que qui est dans pour par sur au avec pas "
    "el los las y en que un una es por con para al lo como su se del no más así"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject when ``100 * numerator <op> bound * denominator``."""

    reason: str
    numerator: str
    op: str
    bound: float
    denominator: str


#: The base contract: few words, or most words inside repeated windows.
BASE = (
    Rule("few_words", "n_words", "<", 5000, "one"),
    Rule("repeated_words", "n_repeat_words", ">", 50, "n_words"),
)
#: The threshold table. Bounds are percent of the denominator.
RULES = (
    Rule("short_words", "word_chars", "<", 200, "n_words"),
    Rule("long_words", "word_chars", ">", 2000, "n_words"),
    Rule("symbols", "n_symbols", ">", 5, "word_chars"),
    Rule("stop_words", "n_stop_words", "<", 1, "n_words"),
    Rule("repeated_lines", "n_dup_lines", ">", 40, "n_lines"),
)


def _n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in ``w``."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(
            placed,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"])),
                            lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2),
                        )
                    )
                )
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    some = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(some).cast("long")


def _measures(text: Column, stop_words: list[str]) -> Column:
    """A struct of every quantity that the rules name."""
    text = F.coalesce(text, F.lit(""))
    forms = sorted({x for s in stop_words for x in (s, s.capitalize())})

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            _n_repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(forms))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    return F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))


def _fails(rule: Rule) -> Column:
    left, right = F.lit(100) * F.col(rule.numerator), F.lit(rule.bound) * F.col(rule.denominator)
    return left < right if rule.op == "<" else left > right


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    base: tuple[Rule, ...] = BASE,
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and ``reasons`` (names of failed rules) of each row."""
    m = docs.select(F.col(id_col), _measures(F.col(text_col), stop_words).alias("m"))
    flat = m.select(id_col, "m.w.*", "m.l.*", "m.n_symbols", F.lit(1).cast("long").alias("one"))
    reasons = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.reason)) for r in (*base, *rules)]))
    base_failed = _any_of(base)
    out = flat.withColumns({"base_failed": base_failed, "kept": ~(base_failed | _any_of(rules)), "reasons": reasons})
    return out.drop("one")


def _any_of(rules: tuple[Rule, ...]) -> Column:
    verdict = F.lit(False)
    for r in rules:
        verdict = verdict | _fails(r)
    return verdict


def quality_filter(
    docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE
) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    inner = F.struct(*[F.col(c) for c in docs.columns])
    m = docs.select(inner.alias("row"), _measures(F.col(text_col), STOP_WORDS).alias("m"))
    flat = m.select("row", "m.w.*", "m.l.*", "m.n_symbols", F.lit(1).cast("long").alias("one"))
    return flat.where(~(_any_of(base) | _any_of(rules))).select("row.*")
