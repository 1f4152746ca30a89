"""CSV records with line breaks inside quotes, read by ranges in parallel.

Spark's own reader takes such a file as one task.  Here the text source cuts a
file into ranges of whole lines.  Whether a range starts inside a quoted field
depends on all text before it, so the first pass reduces every range to a
function -- the state (outside, inside) after it for either state before it --
and the functions are composed over a file's ranges by window sums: a state is that
of the last range whose end does not depend on its start, turned once for every
inverting range since.  In the second pass each range knows its start, joins the
lines of its own records, and hands over at most two fragments: the end of a
record begun earlier and the beginning of its last one.  Fragments alone are
shuffled and joined in order.

A quote opens a field only where the field begins, as in RFC 4180; a doubled quote is a quote;
a quote inside an unquoted field is text.  A record that the file's end leaves open is
kept.  Lines end with LF or CRLF.  A file without quoted line breaks is
found by the first pass and left to Spark's reader, which splits it as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, ship_package

#: ranges whose starts tasks may know (8 bytes each): 128 TB of 128 MB ranges take a million
RANGES_MAX = 8_000_000


class LineStates:
    """Whether a field is open after a line, for lines of one separator."""

    def __init__(self, sep: str = ","):
        s = re.escape(sep.encode())
        body = rb'(?:[^"]++|"")*+'
        field = rb'(?:"' + body + rb'"[^' + s + rb']*+|[^"' + s + rb'][^' + s + rb']*+)?+'
        opens = rb'(?:' + field + s + rb')*+"' + body
        self.outside = re.compile(opens + rb"\Z", re.S)
        self.inside = re.compile(body + rb'(?:\Z|"[^' + s + rb']*+' + s + opens + rb"\Z)", re.S)

    def after(self, line: bytes, is_open: bool) -> bool:
        return (self.inside if is_open else self.outside).match(line) is not None


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the first byte of the range they were read from."""
    return (spark.read.text(path, lineSep="\n")
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def _segments(b: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, range start, first row, end row) of the runs of one range in a batch."""
    if not len(b):
        return
    file, start = b.column("file").dictionary_encode(), b.column("start").to_numpy()
    of = file.indices.to_numpy()
    cuts = np.flatnonzero((of[1:] != of[:-1]) | (start[1:] != start[:-1])) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
        yield file.dictionary[int(of[i])].as_py(), int(start[i]), i, j


def range_functions(lines: DataFrame, sep: str = ",") -> DataFrame:
    """file, start, after0 and after1 (open after the range, had it begun outside or inside),
    broken0 and broken1 (some line leaves a field open, likewise)."""
    ship_package(lines.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, now, held = LineStates(sep), None, []

        def told():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]]), pa.array([now[1]])] + [pa.array([bool(x)]) for x in held],
                ["file", "start", "after0", "after1", "broken0", "broken1"])

        for b in batches:
            for file, start, i, j in _segments(b):
                if now != (file, start):
                    if now:
                        yield told()
                    now, held = (file, start), [False, True, False, False]
                for line in b.column("value").slice(i, j - i).drop_null().cast(pa.binary()).to_pylist():
                    for k in (0, 1):
                        held[k] = states.after(line, held[k])
                        held[2 + k] |= held[k]
        if now:
            yield told()

    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))
    return lines.select(quoted.alias("value"), "file", "start").mapInArrow(
        run, "file string, start long, after0 boolean, after1 boolean, broken0 boolean, broken1 boolean")


def range_states(functions: DataFrame) -> DataFrame:
    """file, start, is_open (a field is open where the range begins), broken."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("after0") == F.col("after1"), F.when(F.col("after0") & ~F.col("after1"), 1).otherwise(0)
    turned = F.sum(turns).over(Window.partitionBy("file").orderBy("start"))
    # the last range before this one that ends alike from either state, and the turns up to it
    last = F.max(F.when(fixed, F.struct("start", F.col("after0").cast("int").alias("state"), F.col("turned")))).over(before)
    so_far = F.coalesce(F.sum(turns).over(before), F.lit(0))
    state = F.pmod(F.coalesce(last["state"], F.lit(0)) + so_far - F.coalesce(last["turned"], F.lit(0)), F.lit(2)) == 1
    return (functions.withColumn("turned", turned)
            .select("file", "start", state.alias("is_open"), "broken0", "broken1")
            .select("file", "start", "is_open", F.when(F.col("is_open"), F.col("broken1")).otherwise(F.col("broken0")).alias("broken")))


class Joiner:
    """Joins the lines of one range after the other into records."""

    def __init__(self, sep: str, header: bool):
        self.states, self.header = LineStates(sep), header

    def begin(self, is_open: bool, first: bool) -> None:
        self.is_open, self.head, self.skip, self.pending = is_open, is_open, first and self.header, []

    def add(self, lines: pa.Array) -> tuple[pa.Array, list[tuple[int, str]]]:
        """(records of one line, [(kind, text)] of the records of several lines and of the range's head)."""
        text = lines.cast(pa.binary())
        quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        after = np.empty(len(lines), bool)
        at, state = 0, self.is_open
        for i, line in zip(quoted.tolist(), text.take(pa.array(quoted)).to_pylist()):
            after[at:i] = state
            state = self.states.after(line, state)
            after[i] = state
            at = i + 1
        after[at:] = state
        before = np.concatenate(([self.is_open], after[:-1]))
        self.is_open = bool(state)
        alone = ~before & ~after
        several = []
        some = np.flatnonzero(~alone)
        for i, line in zip(some.tolist(), lines.take(pa.array(some)).to_pylist()):
            self.pending.append(line)
            if not after[i]:
                several.append((1 if self.head else 0, "\n".join(self.pending), i))
                self.pending, self.head = [], False
        blank = pc.is_in(lines, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        alone &= ~blank
        if self.skip:  # the file's first record is its header
            own = [(int(i), None) for i in np.flatnonzero(alone)[:1]] + [(i, k) for k, (_, _, i) in enumerate(several)][:1]
            if own:
                i, k = min(own)
                if k is None:
                    alone[i] = False
                else:
                    several.pop(k)
                self.skip = False
        return lines.filter(pa.array(alone)), [(kind, t) for kind, t, _ in several]

    def end(self) -> list[tuple[int, str]]:
        """The unfinished record: (1: begun in an earlier range, 2: in this one; 3: the file's header)."""
        if not self.pending:
            return []
        return [(3 if self.skip else 1 if self.head else 2, "\n".join(self.pending))]


def broken_records(lines: DataFrame, states: DataFrame, sep: str = ",", header: bool = True) -> DataFrame:
    """One column ``record``: every record of files whose fields hold line breaks."""
    spark = lines.sparkSession
    n = states.count()
    if n > RANGES_MAX:
        raise ValueError(f"{n} ranges: read the files in parts or with larger spark.sql.files.maxPartitionBytes")
    starts: dict = {}
    for r in states.select("file", "start", "is_open").toLocalIterator():
        starts.setdefault(r["file"], {})[r["start"]] = r["is_open"]
    ranges = {}
    for file, of in starts.items():
        at = np.array(sorted(of), np.int64)
        is_open = np.array([of[x] for x in at.tolist()], bool)
        ranges[file] = at, is_open, is_open | np.append(is_open[1:], True)  # the last: a record crosses one of its ends
    shared = spark.sparkContext.broadcast(ranges)  # 10 bytes a range, at most RANGES_MAX

    def joined(parts: bool):
        """The records inside their ranges, or else the parts of those that cross ranges."""
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, now, joiner, wanted = shared.value, None, Joiner(sep, header), False

            def rows(found):
                found = [(now[0], now[1], kind, text) for kind, text in found if (kind > 0) == parts]
                if found:
                    types = (pa.string(), pa.int64(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)],
                                                     ["file", "start", "kind", "record"])

            for b in batches:
                for file, start, i, j in _segments(b):
                    if now != (file, start):
                        if wanted:
                            yield from rows(joiner.end())
                        now = (file, start)
                        at, is_open, crossed = known[file]
                        k = int(np.searchsorted(at, start))
                        if k == len(at) or at[k] != start:
                            raise RuntimeError("the files are split unlike before: set spark.sql.files.minPartitionNum")
                        joiner.begin(bool(is_open[k]), start == 0)
                        wanted = bool(crossed[k]) or not parts
                    if not wanted:
                        continue
                    alone, several = joiner.add(b.column("value").slice(i, j - i))
                    if len(alone) and not parts:
                        yield pa.RecordBatch.from_arrays(
                            [pa.nulls(len(alone), pa.string()), pa.nulls(len(alone), pa.int64()),
                             pa.nulls(len(alone), pa.int32()), alone], ["file", "start", "kind", "record"])
                    yield from rows(several)
            if wanted:
                yield from rows(joiner.end())
        return lines.mapInArrow(run, "file string, start long, kind int, record string")

    # at most two parts a range, joined per file in the order of the ranges
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    chain = F.sum(F.when(F.col("kind") >= 2, 1).otherwise(0)).over(order)
    whole = (joined(parts=True).withColumn("chain", chain).groupBy("file", "chain")
             .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("p"))
             .filter(F.col("p")[0]["kind"] != 3)
             .select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    found = joined(parts=False).select("record").unionAll(whole)
    cr = F.endswith("record", F.lit("\r"))  # a CRLF ends the record
    return found.select(F.when(cr, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record")).alias("record"))


def csv_strings(spark: SparkSession, path: str, dialect: dict, sep: str = ",") -> DataFrame:
    """All columns as strings, in as many tasks as ``spark.sql.files.maxPartitionBytes`` asks for."""
    reader = spark.read.options(header=True, inferSchema=False, sep=sep, **dialect)
    lines = lines_of(spark, path)
    states = materialise(range_states(range_functions(lines, sep)), "csv-ranges")
    if not states.filter("broken").limit(1).count():
        return reader.csv(path)
    names = reader.options(multiLine=True).csv(path).columns  # reads the first record
    plain = [f"c{i}" for i in range(len(names))]
    options = {**{k: str(v) for k, v in dialect.items()}, "sep": sep}
    parsed = F.from_csv("record", ", ".join(f"{c} string" for c in plain), options)
    return broken_records(lines, states, sep).select(parsed.alias("r")).select("r.*").toDF(*names)
