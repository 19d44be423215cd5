"""The filter audit against one pass per order."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit as audit

LABELS = [(5, 1, 0), (6, 0, 1), (2, 1, 1), (9, None, 1), (None, 1, 1), (2, 0, None), (77, 1, 1)]


def brute(rows, labels):
    """``{(part, order, step): figures}``, every order run document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least, docs = {}, []
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        docs.append((source or "", {c for c in failed if failed[c]}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                failing = [d for d in docs if d[0] == part and c in d[1]]
                removed_by[c] += len(gone)
                alone = sum(d[1] == {c} for d in failing)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def figures(rows):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


@pytest.mark.parametrize("name", ["odd", "small"])
def test_every_order(spark, name, request):
    docs = request.getfixturevalue(name)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    rows = audit.audit_filters(docs, labels).collect()
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], LABELS)
    assert len(rows) == len(want) and figures(rows) == want


def test_copies(spark):
    """Copies over sources and labels, repeated ids, and null ids."""
    text = "One of many " + "x y " * 120
    rows = [(i, text if i % 3 else text + str(i % 7), "abc"[i % 3] if i % 5 else None) for i in range(100)]
    rows += [(1, text, "a"), (1, text, "b"), (0, text, "c"), (None, text, "a"), (None, None, "z"), (200, "", ""), (201, None, "z")]
    labels = [(i, i % 2, i % 4 == 0 and 1 or 0) for i in range(0, 100, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert figures(got) == brute(rows, labels)


def test_empty_tables(spark, none, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(none, labels).count() == 0
    rows = audit.audit_filters(odd, labels).collect()
    assert figures(rows) == brute([(r.doc_id, r.text, r.source) for r in odd.collect()], [])


def test_intervals_cover_every_order_once():
    orders = sorted("".join(p) for p in permutations(audit.LETTERS))
    assert [audit.lehmer_rank(o) for o in orders] == list(range(120))
    for mask in range(1, 32):
        covered = sorted(r for m, _, lo, hi in audit.removal_intervals() for r in range(lo, hi) if m == mask)
        assert covered == list(range(120))
