"""Helpers shared by the training-data operators.

The operators take a DataFrame with (at least) the columns they name and return
one row per input row.  Columns are picked by exact, first name, so extra
columns -- also ones that differ only in case or repeat a name -- never clash;
a result column replaces an input column of the same name.  Text reaches the
Python tasks as UTF-8 bytes in Arrow batches, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quietab.session import scratch_folder, ship_package

#: bytes of text handled at once inside a task (a longer text is a block of its own)
BLOCK_BYTES = 2 << 20

#: most rows of a broadcast join side; larger sides are joined by a shuffle
BROADCAST_ROWS = 1_000_000

#: A-Z to a-z, everything outside [0-9a-z] and non-ASCII to a space
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
#: A-Z to a-z only
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame) -> DataFrame:
    """Unique positional names c0, c1, ...: safe whatever the input's names are."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """The first column of exactly each name."""
    at = df.columns
    return renamed(df).select(*[F.col(f"c{at.index(n)}").alias(n) for n in names])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: cuts the
    lineage, so that a lost executor's successor reads files."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 16 MB and 4096 rows, unless the session asks for
    less; the package on the workers' path."""
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20),
                      ("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)):
        now = spark.conf.get(key, None)
        number = int("".join(ch for ch in now or "" if ch.isdigit() or ch == "-") or -1)
        if not 0 < number <= most:
            spark.conf.set(key, str(most))


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list]]:
    """(start, end, list of bytes or None) with at most ``block_bytes`` of text or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    texts = texts.cast(kind)
    lens = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    i, n = 0, len(texts)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + block_bytes, "right")))
        yield i, j, texts.slice(i, j - i).to_pylist()
        i = j


def map_text(df: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], dict]],
             text: str = "text", keep: Sequence[str] | None = None,
             only: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append ``fields`` computed from the text column.

    ``make()`` runs once per task and returns ``f(list of bytes or None) -> {field: values}``.
    ``keep`` names the input columns to return (None: all); with ``only`` the rows
    whose boolean field ``only`` is true come back in the input's own columns.
    """
    small_batches(df.sparkSession)
    names = df.columns
    at = list(range(len(names))) if keep is None else [names.index(n) for n in keep]
    new = {f.name for f in fields}
    back = [i for i in at if only is not None or names[i] not in new]
    plain = renamed(df)
    passed = [f"c{i}" for i in back]
    source = plain.select(*passed, F.col(f"c{names.index(text)}").alias("t"))
    kinds = {f.name: f.dataType for f in plain.schema.fields}
    out = T.StructType([T.StructField(c, kinds[c]) for c in passed] + ([] if only else list(fields)))
    added = to_arrow_schema(T.StructType(list(fields)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for lo, hi, block in blocks(b.column("t"), block_bytes):
                got = f(block)
                cols = [b.column(k).slice(lo, hi - lo) for k in range(len(passed))]
                if only:
                    mask = pa.array(got[only], pa.bool_())
                    yield pa.RecordBatch.from_arrays([c.filter(mask) for c in cols], passed)
                else:
                    made = [pa.array(got[x.name], x.type) for x in added]
                    yield pa.RecordBatch.from_arrays(cols + made, passed + added.names)

    res = source.mapInArrow(run, out)
    return res.toDF(*[names[i] for i in back], *([] if only else [f.name for f in fields]))


def joined(texts: list, pad: bytes = b"\x00") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array with ``pad`` after each; starts and lengths (None: empty)."""
    texts = [t or b"" for t in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lens + len(pad))[:-1])) if len(texts) else np.zeros(0, np.int64)
    return np.frombuffer(pad.join([*texts, b""]), np.uint8), starts, lens


def segment_sums(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of values[start : start + len] for each segment (empty: 0)."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return c[starts + lens] - c[starts]


def word_ids(texts: list, fold: np.ndarray, gaps: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all texts, each word's place among them, and the number of words before each
    text (with the total at the end).  ``gaps`` tells the bytes between words, once ``fold`` has
    replaced every byte of the texts."""
    data, starts, _ = joined(texts, b" ")
    data = fold[data]
    solid = ~gaps[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    begins = np.flatnonzero(edge == 1)
    offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(edge == -1) - begins)))
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [
        None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    before = np.append(np.searchsorted(begins, starts), len(begins))
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), before
