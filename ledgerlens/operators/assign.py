"""One-to-one assignment of facts to expression leaves: the unique best of all, for any number a side."""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hungarian(cost: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Column of each row with the least total, and the prices of rows and columns; integers, so exact."""
    n = len(cost)
    row_price, col_price, owner = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)  # column n starts each search
    for i in range(n):
        owner[n], at = i, n
        least, back, seen = [None] * n, [n] * n, [False] * (n + 1)
        while owner[at] >= 0:
            seen[at] = True
            row, step, following = owner[at], None, -1
            for j in range(n):
                if not seen[j]:
                    new = cost[row][j] - row_price[row] - col_price[j]
                    if least[j] is None or new < least[j]:
                        least[j], back[j] = new, at
                    if step is None or least[j] < step:
                        step, following = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    row_price[owner[j]] += step
                    col_price[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            at = following
        while at != n:
            owner[at] = owner[back[at]]
            at = back[at]
    way = [0] * n
    for j in range(n):
        way[owner[j]] = j
    return way, row_price[:n], col_price[:n]


def best_assignment(scores: dict[tuple[int, int], float], n: int) -> tuple[int, ...] | None:
    """Leaf of each fact 0..n-1 with the largest total; None if none is possible or two totals agree to 8 decimals."""
    ratios = {p: float(s).as_integer_ratio() for p, s in scores.items() if s is not None and math.isfinite(s)}
    if len({i for i, _ in ratios}) < n or len({j for _, j in ratios}) < n:
        return None
    unit = max(d for _, d in ratios.values())  # powers of two
    exact = {p: a * (unit // d) for p, (a, d) in ratios.items()}
    never = (max(exact.values()) - min(exact.values()) + 1) * (n + 1) - min(exact.values())
    way, rows, cols = _hungarian([[-exact[i, j] if (i, j) in exact else never for j in range(n)] for i in range(n)])
    if any((i, j) not in exact for i, j in enumerate(way)):
        return None
    # the second best moves some facts in a ring, each to the leaf of the next; a move costs its reduced cost
    ring = [[-exact[i, way[k]] - rows[i] - cols[way[k]] if i != k and (i, way[k]) in exact else None for k in range(n)] for i in range(n)]
    for k in range(n):
        for i in range(n):
            if (first := ring[i][k]) is not None:
                for j in range(n):
                    if ring[k][j] is not None and (ring[i][j] is None or first + ring[k][j] < ring[i][j]):
                        ring[i][j] = first + ring[k][j]
    total = sum(exact[i, j] for i, j in enumerate(way))
    gaps = [ring[i][i] for i in range(n) if ring[i][i] is not None]
    # totals that differ by more than 1e-8 do not agree: the fractions are for the others
    if gaps and min(gaps) * 10**8 <= unit and round(Fraction(total, unit), 8) == round(Fraction(total - min(gaps), unit), 8):
        return None
    return tuple(way)


def _largest(facts: list, leaves: list, scores: list) -> dict[tuple[int, int], float]:
    """Score of each pair; of repeated ones the largest, NaN before all and none after all."""
    out: dict = {}
    for f, x, v in zip(facts, leaves, scores):
        old = out.setdefault((f, x), v)
        if v is not None and (old is None or v > old or v != v):
            out[f, x] = v
    return out


def _solve(batches):
    """Rows qid, pairs -> qid, fact, leaf."""
    for b in batches:
        pairs = b.column(1).flatten()
        f, x, s = (pairs.field(i).to_pylist() for i in range(3))
        qid, fact, leaf, at = [], [], [], 0
        for q, n in zip(b.column(0).to_pylist(), b.column(1).value_lengths().to_pylist()):
            mine = slice(at, at + n)
            at += n
            if n and (best := best_assignment(_largest(f[mine], x[mine], s[mine]), max(max(f[mine]), max(x[mine])) + 1)):
                qid += [q] * len(best)
                fact += range(len(best))
                leaf += best
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (qid, fact, leaf)], names=["qid", "fact", "leaf"])


def assign_lists(questions: DataFrame) -> DataFrame:
    """(qid, pairs) -> (qid, fact, leaf); pairs: array of (fact, leaf, score), a question a row. Questions without a unique best assignment drop out.

    No row for a pair is made, so nothing but the questions themselves is ever sorted, spilled or exchanged.
    """
    pairs = F.col("pairs").cast("array<struct<fact:long,leaf:long,score:double>>")
    return questions.select(F.col("qid").cast("long").alias("qid"), pairs.alias("pairs")).mapInArrow(_solve, "qid long, fact long, leaf long")


def assign(pairs: DataFrame) -> DataFrame:
    """(qid, fact, leaf, score) -> (qid, fact, leaf); questions without a unique best assignment drop out.

    Of repeated pairs the largest score counts. The pairs of one question are gathered, and Python sees
    batches of questions, not one at a time; a question of n facts takes some n^3 steps.
    """
    return assign_lists(pairs.groupBy("qid").agg(F.collect_list(F.struct("fact", "leaf", "score")).alias("pairs")))
