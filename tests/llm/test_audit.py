"""The filter audit against a simulation of every order on every document."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import audit

LONG = " ".join(f"word{i}" for i in range(230))
REPEATING = "same " * 240
CAPITALS = " ".join(f"Word{i}X" for i in range(210))
TEXTS = [None, "", "short", LONG, REPEATING, CAPITALS, LONG + " #", CAPITALS + " $", REPEATING + " & | X", LONG, LONG, "", "É" * 50_000, "a " * 40_000, LONG + "\x0bmore\x0c\x1cone", "short"]


def words(text):
    out, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def failures(row, rows):
    i, text, _ = row
    text = text or ""
    w = words(text)
    return {
        "A": len(w) < 200,
        "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
    }


def by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = [(i, part or "", failures((i, t, part), rows)) for i, t, part in rows]
    out = {}
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                shapley[letter] += len(gone)
                failing = sum(f[letter] for _, f in mine)
                only = sum(f[letter] and sum(f.values()) == 1 for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def tables(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("mask", "n", "docs", "digest", "first", "good", "quality"):
        docs = docs.withColumn(name, F.lit("extra"))
    return docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("x"))


def audited(docs, labels):
    return sorted(tuple(r) for r in audit.filter_interactions(audit.mask_counts(docs, labels)).collect())


def test_audit(spark):
    rows = [(i, t, ("s0", "s1", None, "")[i % 4]) for i, t in enumerate(TEXTS)]
    rows += [(3, LONG, "s0"), (3, LONG, "s1"), (2, "other", "s0"), (None, LONG, "s1"), (None, "short", None), (None, "nobody else", "s1")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(3, 0, 1), (3, None, None), (None, 1, 1), (99, 1, 1)]
    assert audited(*tables(spark, rows, labels)) == by_hand(rows, labels)
    assert audited(*tables(spark, rows, [])) == by_hand(rows, [])
    assert audited(*tables(spark, [], labels)) == []


def test_ranks_are_lexicographic():
    orders = list(permutations(range(5)))
    assert [audit.lehmer_rank(o, 5) for o in orders] == list(range(120))
    for prefix in ((2,), (4, 1), (0, 3, 2)):
        inside = [r for r, o in enumerate(orders) if o[: len(prefix)] == prefix]
        first = audit.lehmer_rank(prefix, 5)
        assert inside == list(range(first, first + math.factorial(5 - len(prefix))))


def test_every_order_removes_a_failing_mask_once():
    steps = audit.interval_ends(4).cumsum(-1)[..., :-1]
    assert (steps[1:].sum(1) == 1).all() and not steps[0].any()
    assert np.isin(steps, (0, 1)).all()


def test_too_many_filters_are_refused(spark):
    counts = spark.createDataFrame([], "part string, mask int, docs long, good long, toxic long")
    with pytest.raises(ValueError):
        audit.filter_interactions(counts, "ABCDEFGH")
