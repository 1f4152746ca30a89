"""CSV with line breaks inside quotes, cut into ranges anywhere, equals Python's csv module."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quietab.sources.csv_ranges import LineStates, broken_records, csv_strings, lines_of, range_functions, range_states
from quietab.sources.tables import CSV_DIALECT, read_table


@pytest.fixture
def small_ranges(spark):
    """Ranges of about 700 bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def field(rnd):
    return rnd.choice([
        lambda: f"plain {rnd.randint(0, 99)}", lambda: f'say ""no""'.replace('""', '"'), lambda: "two\nlines", lambda: "a,b",
        lambda: "\n".join("x" * rnd.randint(0, 40) for _ in range(rnd.randint(2, 60))), lambda: 'ends with "', lambda: '"',
        lambda: "crlf\r\ninside", lambda: '\n"\n",\n"', lambda: " outer blanks ", lambda: "été 日本"])()


def rows_of(raw, columns):
    return sorted(tuple(r[c] for c in columns) for r in raw.collect())


@pytest.mark.parametrize("seed", range(4))
def test_ranges_equal_the_csv_module(spark, small_ranges, tmp_path, seed):
    rnd = random.Random(seed)
    want, names = [], ["id", "a", "b b"]
    for part in range(2):
        rows = [[f"{part}-{i}", field(rnd), field(rnd)] for i in range(150)]
        if seed == 1 and part:  # one field over many ranges
            rows[70][1] = "line\n" * 900
        want += rows
        text = io.StringIO(newline="")
        writer = csv.writer(text, lineterminator="\r\n" if seed == 2 else "\n", quoting=csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL)
        writer.writerows([names, *rows])
        (tmp_path / f"part{part}.csv").write_bytes(text.getvalue().encode())
    df = csv_strings(spark, str(tmp_path), CSV_DIALECT)
    assert df.columns == names
    assert rows_of(df, names) == sorted(map(tuple, want))
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    assert lines_of(spark, str(tmp_path)).rdd.getNumPartitions() >= size // 1400 > 10


def test_a_quote_inside_an_unquoted_field_is_text(spark, small_ranges, tmp_path):
    rows = ['id,t'] + [f'{i},5" pipe' if i % 3 else f'{i},"multi\nline {i}"' for i in range(400)]
    (tmp_path / "x.csv").write_text("\n".join(rows) + "\n")
    got = dict(rows_of(csv_strings(spark, str(tmp_path), CSV_DIALECT), ["id", "t"]))
    assert got == {str(i): '5" pipe' if i % 3 else f"multi\nline {i}" for i in range(400)}


def test_header_over_lines_blank_lines_and_open_end(spark, small_ranges, tmp_path):
    body = "".join(f'{i},"{"z" * 30}\n{i}"\n\n' for i in range(80))
    (tmp_path / "x.csv").write_text('id,"long\nname"\n' + body + '99,"never closed\nuntil the end\n')
    got = dict(rows_of(csv_strings(spark, str(tmp_path), CSV_DIALECT), ["id", "long\nname"]))
    assert len(got) == 81 and got["7"] == "z" * 30 + "\n7" and got["99"].startswith("never closed\nuntil the end")


def test_without_line_breaks_spark_reads(spark, small_ranges, tmp_path):
    (tmp_path / "x.csv").write_text("id,t\n" + "".join(f'{i},"a, ""b"" {i}"\n' for i in range(300)))
    df = csv_strings(spark, str(tmp_path), CSV_DIALECT)
    assert df.rdd.getNumPartitions() > 5 and df.count() == 300
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    typed = read_table(spark, str(tmp_path))
    assert dict(typed.dtypes) == {"id": "bigint", "t": "string"} and typed.filter("t = 'a, \"b\" 7'").count() == 1


def test_states_follow_the_ranges_before(spark):
    rows = [("f", i * 10, a, b, a, b) for i, (a, b) in enumerate(
        [(False, True), (True, False), (False, True), (True, False), (True, True), (False, True), (True, False), (False, False)])]
    functions = spark.createDataFrame(rows, "file string, start long, after0 boolean, after1 boolean, broken0 boolean, broken1 boolean")
    got = {r["start"]: r["is_open"] for r in range_states(functions).collect()}
    state, want = False, {}
    for _, start, a, b, *_ in rows:
        want[start] = state
        state = b if state else a
    assert got == want


def test_line_states():
    s = LineStates()
    assert s.after(b'a,"b', False) and not s.after(b'a,"b"', False) and not s.after(b'a,b"c', False)
    assert s.after(b'""', True) and not s.after(b'"', True) and s.after(b'x","y', True) and not s.after(b'x",5" y', True)
    assert s.after(b'","', True) and s.after(b'"', False) and not s.after(b'""', False) and s.after(b'"""', False)


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,"t\nu"\n')
    df = csv_strings(spark, str(tmp_path), CSV_DIALECT)
    assert df.columns == ["id", "t\nu"] and df.count() == 0
