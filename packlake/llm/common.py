"""What the operators of this subpackage share: reading tables, checkpoints, passing rows through Python."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of input, about, that a Python worker turns into Python objects at a time.
SLICE = 4 << 20


def _ranges(wanted) -> str:
    """The characters for which wanted(c), as the inside of a character class."""
    found: list[list[int]] = []
    for c in filter(wanted, map(chr, range(0x300, 0x20000))):
        if found and found[-1][1] == ord(c) - 1:
            found[-1][1] += 1
        else:
            found.append([ord(c), ord(c)])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


#: Marks that belong to the letter before, and scripts written without spaces.
MARKS = _ranges(lambda c: unicodedata.category(c)[0] == "M")
SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the cluster's shared folder; where none is set, in a folder of our own if all runs on
    this one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="packlake-checkpoint-"))
    return df.checkpoint(eager=True)


def trim() -> None:
    """Give back to the machine what this process has freed; else its allocators keep it, beside what comes later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more; else they stay until the
    driver happens to collect its garbage. The driver's Python gives memory back, too."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def portions(texts: list, most: int) -> Iterator[list]:
    """`texts` in runs of about `most` characters or bytes; a longer text makes a run of its own."""
    part: list = []
    size = 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, which are turned into Python objects one after the other."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frugal(run: Callable) -> Callable:
    """A function over batches that gives memory back to the machine when it ends: workers live on from task to task,
    and what their allocators keep for later counts beside the next one's needs."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def unique_name(taken: list[str], name: str) -> str:
    """`name`, with underscores in front until no column of that name (in any case) exists."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def quoted(name: str):
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(
    df: DataFrame, inputs: list, outputs: list[tuple[str, T.DataType]], make: Callable[[], Callable[..., list]], keep: list[str]
) -> DataFrame:
    """Rows of `df` with the columns `keep` and new columns `outputs`, computed from whole Arrow columns.

    inputs: Spark columns sent to Python. make() is called once in each task and returns f(*arrays), which returns
    one array for each output, as long as its inputs.
    """
    kept = df.select(*[quoted(c) for c in keep], *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*df.select(*[quoted(c) for c in keep]).schema.fields, *[T.StructField(n, t) for n, t in outputs]])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for part in slices(batches):
            f = f or make()
            out = f(*part.columns[n_keep:])
            yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *out], names=[s.name for s in schema.fields])

    return kept.mapInArrow(frugal(run), schema)
