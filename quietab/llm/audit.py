"""Filter interaction audit: what each filter removes under every order of application.

Method.  A document's failed filters are the bits of a mask, so a part of the
corpus is a handful of mask cells with counts (at most ``2^filters``).  Every cell
is folded across the literal array of all orders, which ships with the plan, by
``transform`` and ``aggregate``: one fold carries whether the cell's
documents are still there and appends one weighted struct a step (600 structs for
five filters).  A second fold merges a part's cells by elementwise sums
(``zip_with``).  DataFrame and SQL functions only.

Plan: one scan of the texts makes narrow rows (digest, id, part, four bits); equal
rows are counted map-side; two small joins and grouped sums follow.  Equality of texts
goes by SHA-256, so no text is shuffled.  A text's copies are counted per part before they meet
its least id, so a group of copies costs a row per part, label pair and task, however large it is.

Defined cases: a null text counts as empty; a null source is the part ''; a null doc_id
is no smaller than any other, so its row never fails E nor makes another fail; repeated rows count each
on their own, and those of a text's smallest doc_id all pass E; a document is
good (toxic) if any label row of its id says 1, null or missing labels say nothing.
No document gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietab.llm.common import narrow, table, written

#: least words, least percent of distinct words, most percent of capitals
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> Column:
    """Bits 0-3: the filters A to D, which look at one text alone."""
    words = F.array_remove(F.split(text, GAPS), "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"),
                                                            F.size(F.array_distinct(w)).alias("distinct")))[0]
    failed = (counts["n"] < MIN_WORDS, 100 * counts["distinct"] < MIN_DISTINCT * counts["n"],
              100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.char_length(text), text.rlike(SYMBOLS))
    mask = F.lit(0)
    for bit, fails in enumerate(failed):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents that fail just the filters of the mask (bit 4: E)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = (narrow(docs, "doc_id", "text", "source")
             .select("doc_id", F.coalesce("source", F.lit("")).alias("part"), own_failures(text).alias("own"),
                     F.unhex(F.sha2(text, 256)).alias("digest"))
             .groupBy("digest", "doc_id", "part", "own").agg(F.count("*").alias("n"))
             # rows without an id match no label; the second key spreads them
             .withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(0)))
    said = (narrow(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy("doc_id")
            .agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
            .withColumn("spread", F.lit(0).cast("long")))
    rows = written(marks.join(said, ["doc_id", "spread"], "left").drop("spread")
                   .fillna(False, ["good", "toxic"]), "marks")
    kind = ["part", "own", "good", "toxic"]
    first = (rows.filter("doc_id is not null").groupBy("digest", *kind)
             .agg(F.min("doc_id").alias("id"), F.min_by("n", "doc_id").alias("n")))
    least = first.groupBy("digest").agg(F.min("id").alias("id"))
    passed = (first.join(least, ["digest", "id"]).select(*kind, "n")
              .unionAll(rows.filter("doc_id is null").select(*kind, "n")))
    copy = F.col("own") + 16
    cells = (rows.select(*kind, "n").withColumn("own", copy)
             .unionAll(passed.withColumn("own", copy).withColumn("n", -F.col("n"))).unionAll(passed))
    return (cells.groupBy("part", F.col("own").alias("mask"))
            .agg(F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0L)")).alias("good"),
                 F.sum(F.expr("if(toxic, n, 0L)")).alias("toxic")).filter("n > 0"))


def fold_orders(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order of the letters and step, from (part, mask, n, good, toxic)."""
    k = len(letters)
    orders = list(permutations(range(k)))
    literal = F.array(*[F.array(*map(F.lit, o)) for o in orders])
    names = F.array(*[F.lit("".join(letters[f] for f in o)) for o in orders])
    zero = F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES])
    nothing = F.lit(0).cast("long")

    def one_cell(cell: Column) -> Column:
        """k * k! structs of the cell's documents, order by order."""
        def step(state: Column, f: Column) -> Column:
            fails = F.call_function("getbit", cell["mask"], f) == 1
            here, gone = state["alive"] & fails, ~state["alive"]
            amount = {"kept": (cell["n"], state["alive"] & ~fails), "removed": (cell["n"], here),
                      "redundant": (cell["n"], gone & fails),
                      "unique_fails": (cell["n"], cell["mask"] == F.call_function("shiftleft", F.lit(1), f)),
                      "good_lost": (cell["good"], here), "toxic_lost": (cell["toxic"], here)}
            now = F.struct(*[F.when(amount[m][1], amount[m][0]).otherwise(nothing).alias(m) for m in MEASURES])
            return F.struct((state["alive"] & ~fails).alias("alive"), F.concat(state["steps"], F.array(now)).alias("steps"))

        start = F.struct(F.lit(True).alias("alive"), F.slice(F.array(zero), 1, 0).alias("steps"))
        return F.flatten(F.transform(literal, lambda order: F.aggregate(order, start, step, lambda s: s["steps"])))

    def added(a: Column, b: Column) -> Column:
        return F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES])

    size = k * len(orders)
    merged = F.aggregate("cells", F.array_repeat(zero, size), lambda acc, cell: F.zip_with(acc, one_cell(cell), added))
    by_filter = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.aggregate(
        F.zip_with("merged", F.flatten(literal), lambda m, g: F.when(g == f, m["removed"]).otherwise(nothing)),
        nothing, lambda a, b: a + b))
    order, step = F.floor(F.col("pos") / k).cast("int"), F.col("pos") % k
    return (cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # <= 2^k
            .select("part", merged.alias("merged")).select("part", "merged", by_filter.alias("by_filter"))
            .select("part", "by_filter", F.posexplode("merged").alias("pos", "m"))
            .select("part", F.get(names, order).alias("filter_order"), (step + 1).cast("int").alias("step"),
                    *[F.col(f"m.{m}").alias(m) for m in MEASURES],
                    F.get("by_filter", F.get(F.get(literal, order), step)).alias("shapley")))


def op11_filter_interaction_audit(spark, sf_dir) -> DataFrame:
    return fold_orders(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t,
         regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic
  FROM documents d LEFT JOIN said s ON d.doc_id = s.doc_id
), failed AS (
  SELECT part, good, toxic,
         [len(w) < 200,
          100 * len(list_distinct(w)) < 50 * len(w),
          100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM docs
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, fails
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter,
         [ascii(filter_order[i]) - 64 FOR i IN range(1, step)] AS earlier, ascii(filter_order[step]) - 64 AS own
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[own] AS here,
         len([1 FOR f IN earlier IF fails[f]]) > 0 AS gone, len([1 FOR f IN fails IF f]) = 1 AS alone
  FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (here AND alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""
