"""The filter audit against plain Python, and its defined cases."""

from itertools import permutations

import pytest
from conftest import SF_MID
from pyspark.sql import functions as F
from test_queries import odd, small  # noqa: F401

from quietab.llm import audit, catalog
from quietab.llm.common import narrow


def plain(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ")
        words = [w for w in words.split(" ") if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}
        rows.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [r for r in own if f in r[1] and not r[1] & before]
                out[part, "".join(order), step] = [
                    sum(not r[1] & {*before, f} for r in own), len(here), sum(f in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
                removed_by[f] += len(here)
        for key in out:
            if key[0] == part:
                out[key].append(removed_by[key[1][key[2] - 1]])
    return out


def result(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in (*audit.MEASURES, "shapley")] for r in rows}
    assert len(got) == len(rows)
    return got


def test_odd_rows_equal_plain_python(spark, odd, small):  # noqa: F811
    more = spark.createDataFrame(
        [(20, "same text here", "web"), (None, "same text here", "web"), (21, "UP " * 250, "web"), (21, "UP " * 250, "web"),
         (22, " ".join(f"word{i}" for i in range(300)), None), (23, "a # b", ""), (5, "other text of an id", "web"),
         (24, "UP " * 250, "paper")], "doc_id long, text string, source string")
    docs = narrow(odd, "doc_id", "text", "source").unionAll(more)
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, 1), (21, 1, 1), (None, 1, 1), (5, None, 1), (24, 1, None)],
                                   "doc_id long, quality int, toxic int")
    want = plain([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    clash = docs.withColumn("Part", F.lit("x")).withColumn("own", F.lit(1)).withColumn("digest", F.lit("y"))
    got = result(audit.fold_orders(audit.mask_cells(clash.repartition(3), labels.withColumn("n", F.lit(3)))))
    assert got == want and {k[0] for k in got} == {"", "web", "paper"} and len(got) == 3 * 600
    assert audit.fold_orders(audit.mask_cells(docs.limit(0), labels)).count() == 0
    unlabelled = result(audit.fold_orders(audit.mask_cells(docs, labels.limit(0))))
    assert all(v[4] == v[5] == 0 for v in unlabelled.values())


def test_fewer_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 0), ("p", 3, 2, 1, 1)],
                                  "part string, mask int, n long, good long, toxic long")
    got = result(audit.fold_orders(cells, "XY"))
    assert got == {("p", "XY", 1): [5, 5, 0, 3, 1, 1, 8], ("p", "XY", 2): [5, 0, 2, 0, 0, 0, 2],
                   ("p", "YX", 1): [8, 2, 0, 0, 1, 1, 2], ("p", "YX", 2): [5, 3, 2, 3, 0, 0, 8]}


def test_counts_add_up(spark):
    got = result(catalog.QUERIES["op11_filter_interaction_audit"](spark, SF_MID))
    total = spark.read.parquet(f"{SF_MID}/documents.parquet").groupBy("source").count().collect()
    for r in total:
        for order in map("".join, permutations("ABCDE")):
            steps = [got[r["source"] or "", order, s] for s in range(1, 6)]
            assert sum(s[1] for s in steps) + steps[-1][0] == r["count"]
            assert all(a[0] == b[0] + b[1] for a, b in zip(steps, steps[1:]))


def test_plan_has_no_python(spark, small, capsys):  # noqa: F811
    audit.fold_orders(audit.mask_cells(small["documents"], small["labels"])).explain("formatted")
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("text,mask", [("", 1), ("A", 1 + 4), ("a " * 200, 2), ("a | b", 1 + 8), ("ÉÉ", 1)])
def test_own_failures(spark, text, mask):
    row = spark.createDataFrame([(text,)], "text string").select(audit.own_failures(F.col("text")).alias("m")).first()
    assert row["m"] == mask
