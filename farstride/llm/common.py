"""What the operators of this subpackage share: tables, shared scratch tables, and numpy text kernels."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U = np.uint64
#: Rows that Spark hands to Python at once.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the folder that all executors share (spark.checkpoint.dir).

    A saved table cuts the lineage like a checkpoint, is stored once in compressed columns,
    and survives the loss of any executor. clear() deletes the tables and destroys the broadcasts made here.

    As all operators begin with one, it also bounds what Spark hands to Python at once: whole texts can be long, and Spark, Arrow and
    Python each hold a copy of a batch. A smaller number that the session has set stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.shared = spark, []
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="scratch-")  # one machine only
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root}/{uuid.uuid4().hex}"
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        atexit.register(self.clear)

    def broadcast(self, value):
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        atexit.unregister(self.clear)
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            for x in self.shared:
                x.destroy()
            self.shared = []
            self.drop("")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift multiply)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def batches(texts: list, limit: int = 1 << 18):
    """Ranges of consecutive texts of about `limit` bytes (kernels hold some hundred times that); a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def join_bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with one line feed after each, and where each text starts (one entry more at the end)."""
    lens = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=starts[1:])
    return np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8), starts


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run without white space."""
    space = np.ones(len(buf) + 2, dtype=bool)
    space[1:-1] = SPACES[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
BASE = U(0xD1342543DE82EF95)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    powers = np.ones(int(lens.max()), dtype=np.uint64)
    powers[1:] = BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    first = np.zeros(len(lens), dtype=np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    at = within + np.repeat(starts, lens)
    return mix(np.add.reduceat(BYTE[buf[at]] * powers[within], first) + lens.astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, one for each start that has n words."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = out * U(0x9FB21C651E98DF25) + h[i : i + len(out)]
    return mix(out)
