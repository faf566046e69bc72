"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the same six characters in Python, Arrow, Java and DuckDB.
SPACE = " \t\n\r\f\x0b"
SPACE_RE = r"[ \t\n\r\f\x0b]"
WORD_RE = r"[^ \t\n\r\f\x0b]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where that is unset and all runs on one machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return at
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="penprint-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written to the shared folder to cut lineage. They outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop shuffle files nobody can read any more
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def cached(key, make):
    """make() once per Python worker, however many tasks it runs."""
    home = sys.modules.setdefault("_penprint_cache", types.ModuleType("_penprint_cache"))
    store = home.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def latest(kind: str, key, make):
    """Like cached, but a worker holds one thing in all: another kind or key frees the last before it makes its own."""
    slot = cached("latest", dict)
    if slot.get("key") != (kind, key):
        forget()
        slot.update(key=(kind, key), value=make())
        release()
    return slot["value"]


def forget() -> None:
    """Frees what latest holds, for tasks that need the memory for something else."""
    cached("latest", dict).clear()
    release()


def release() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)


#: Bytes of text that are hashed at one time.
CHUNK = 1 << 20


def chunks(texts):
    """Slices of an Arrow string array of about CHUNK bytes each, with the row that each begins at. Nulls become empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
        yield at, texts.slice(at, to - at)
        at = to


class Words:
    """The words of a slice of texts: hash (int64), first and last byte of each, and offsets by text.

    A word's hash is a polynomial over random values of its bytes, modulo 2^64 and mixed.
    """

    def __init__(self, texts):
        import numpy as np

        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, bounds = bounds[0], bounds - bounds[0]
        data = texts.buffers()[2]
        self.bytes = b = np.frombuffer(data, np.uint8)[base : base + bounds[-1]] if data else np.zeros(0, np.uint8)
        space, values = cached("byte tables", _byte_tables)
        inside = ~space[b]
        before = np.empty(len(b) + 1, bool)  # whether a word goes on across this border
        before[0] = before[-1] = False
        before[1:-1] = inside[1:] & inside[:-1]
        before[bounds] = False
        self.first = np.flatnonzero(inside & ~before[:-1])
        self.last = np.flatnonzero(inside & ~before[1:]) + 1
        self.offsets = np.searchsorted(self.first, bounds)
        self.bounds = bounds
        n = 1 << max(12, int(len(b)).bit_length())
        power, inverse = cached(("powers", n), lambda: _powers(n))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[b] * power[: len(b)])])
        self.hash = mix((sums[self.last] - sums[self.first]) * inverse[self.first]).view(np.int64)

    def __len__(self):
        return len(self.bounds) - 1

    def text(self, i: int) -> slice:
        """Where text i's words lie."""
        return slice(self.offsets[i], self.offsets[i + 1])


def word_counts(texts):
    """How many words each text of a slice has."""
    import numpy as np

    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, bounds = bounds[0], bounds - bounds[0]
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[base : base + bounds[-1]] if data else np.zeros(0, np.uint8)
    space, _ = cached("byte tables", _byte_tables)
    inside = ~space[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[bounds[:-1][bounds[:-1] < len(b)]] = inside[bounds[:-1][bounds[:-1] < len(b)]]
    return np.diff(np.searchsorted(np.flatnonzero(first), bounds))


def _byte_tables():
    import numpy as np

    space = np.zeros(256, bool)
    space[[ord(c) for c in SPACE]] = True
    return space, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int):
    import numpy as np

    odd = 0x2545F4914F6CDD1B  # 3 modulo 8
    out = []
    for x in (odd, pow(odd, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out


def mix(x):
    """A bijective mix of int64 arrays (splitmix64's finalizer), as uint64."""
    import numpy as np

    x = x.astype(np.uint64) if x.dtype != np.uint64 else x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h, n: int):
    """Hashes of every n consecutive entries of an int64 array, by position of the first; empty where there are fewer."""
    import numpy as np

    h = h.view(np.uint64)
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(n):
        out *= np.uint64(0x100000001B3)
        out ^= h[i : i + m]
    return mix(out)


def polynomial(h, start, end):
    """Hashes of the stretches start..end of an array of mixed uint64, alike wherever an equal stretch lies."""
    import numpy as np

    n = 1 << max(12, len(h).bit_length())
    power, inverse = cached(("powers", n), lambda: _powers(n))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
    return mix((sums[end] - sums[start]) * inverse[start])
