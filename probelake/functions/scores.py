"""Scores as Columns: set metrics, pass@k and difficulty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: pass@k values reported by default.
K_VALUES = (1, 2, 3, 4, 5)


def set_metrics(predicted: Column, truth: Column) -> Column:
    """precision, recall, f1 and exact_match of two string sets; null counts as empty.

    Both empty is a full match; one empty scores 0 throughout.
    """
    p, t = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (predicted, truth))
    both, n_p, n_t = F.size(F.array_intersect(p, t)), F.size(p), F.size(t)
    empty, one = (n_p == 0) & (n_t == 0), (n_p == 0) | (n_t == 0)
    precision = F.when(empty, 1.0).when(one, 0.0).otherwise(both / n_p)
    recall = F.when(empty, 1.0).when(one, 0.0).otherwise(both / n_t)
    # 2pr / (p + r) with p = both / n_p and r = both / n_t
    f1 = F.when(empty, 1.0).when(one | (both == 0), 0.0).otherwise(2 * (precision * recall) / (precision + recall))
    exact = F.when(empty | ((both == n_p) & (both == n_t)), 1).otherwise(0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), exact.alias("exact_match"))


def pass_at_k(n: Column, c: Column, k: int | Column) -> Column:
    """1 - C(n-c, k) / C(n, k): chance that one of k drawn samples is right.

    1 where fewer than k samples are wrong; 0 where k exceeds n. The ratio is a
    product of k factors, so it holds for any n.
    """
    k = F.lit(k) if isinstance(k, int) else k
    steps = F.sequence(F.lit(0), k - 1)
    wrong = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(n - c < k, 1.0).when(n < k, 0.0).otherwise(1.0 - wrong)


def difficulty(dependencies: Column, known: Column | None = None) -> Column:
    """easy up to 2 hops (no or missing hops count 0), else hard; unknown without a report."""
    hops = F.transform(dependencies, lambda d: F.coalesce(d["hops"], F.lit(0)))
    level = F.when(F.coalesce(F.array_max(hops), F.lit(0)) <= 2, "easy").otherwise("hard")
    return level if known is None else F.when(known, level).otherwise("unknown")


def difficulty_order(level: Column) -> Column:
    """Sort key of the report's rows: easy, hard, unknown, overall."""
    return F.array_position(F.array(*[F.lit(x) for x in ("easy", "hard", "unknown", "overall")]), level)


def context_budget(
    window: Column, completion: Column, system: Column, static: Column, test: Column, safety: int = 100, margin: int = 50
) -> Column:
    """Tokens left for related files in a prompt."""
    return window - completion - safety - system - static - margin - test


def split_budget(total: Column, ratio: Column) -> Column:
    """(positive, negative) parts of a budget; the positive one is truncated."""
    positive = (total * ratio).cast("int")
    return F.struct(positive.alias("positive"), (total - positive).cast("int").alias("negative"))
