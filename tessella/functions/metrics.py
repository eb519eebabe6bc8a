"""Column functions that score rankings and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import filled, tokens


def recall_at_k(found: Column, relevant: Column, k: int) -> Column:
    """Share of the distinct relevant ids among the first k; 0 without relevant ids."""
    rel = F.array_distinct(relevant)
    hits = F.size(F.array_intersect(F.slice(found, 1, k), rel))
    return F.round(F.when(F.size(rel) == 0, 0.0).otherwise(hits / F.size(rel)), 4)


def precision_at_k(found: Column, relevant: Column, k: int) -> Column:
    """Hits, repeats included, over the number of ids in the first k."""
    top = F.slice(found, 1, k)
    return F.round(F.when(F.size(top) == 0, 0.0).otherwise(F.size(F.filter(top, lambda x: F.array_contains(relevant, x))) / F.size(top)), 4)


def reciprocal_rank(found: Column, relevant: Column) -> Column:
    ranks = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return F.round(F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0)), 4)


def ndcg_at_k(found: Column, relevant: Column, k: int) -> Column:
    gains = F.transform(F.slice(found, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    total = F.aggregate(gains, F.lit(0.0), lambda s, g: s + g)
    n = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    ideal = F.aggregate(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda r: 1.0 / F.log2(r + 1.0)), F.lit(0.0), lambda s, g: s + g)
    return F.round(F.when(ideal == 0, 0.0).otherwise(total / ideal), 4)


def _chars(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.replace(filled(c), F.lit(" "), F.lit("")), ""), lambda x: x != ""))


def lexical_f1(answer: Column, reference: Column) -> Column:
    """F1 of the sets of characters, spaces aside."""
    a, b = _chars(answer), _chars(reference)
    both = F.size(F.array_intersect(a, b))
    return F.round(F.when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b))), 4)


def groundedness(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct tokens that the context has."""
    a = F.array_distinct(tokens(answer))
    return F.round(F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, F.array_distinct(tokens(context)))) / F.size(a)), 4)


def groundedness_in(answer: Column, contexts: Column) -> Column:
    """Share of the answer's distinct tokens that any text of an array has, null texts aside; a null array is an empty one."""
    a = F.array_distinct(tokens(answer))
    union = F.coalesce(F.array_distinct(F.flatten(F.transform(contexts, tokens))), F.array().cast("array<string>"))
    return F.round(F.when((F.size(a) == 0) | (F.size(union) == 0), 0.0).otherwise(F.size(F.array_intersect(a, union)) / F.size(a)), 4)


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def dpo_margin(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """Preference margin of four raw scores, each through log-sigmoid."""
    return beta * ((log_sigmoid(policy_chosen) - log_sigmoid(policy_rejected)) - (log_sigmoid(ref_chosen) - log_sigmoid(ref_rejected)))
