"""What the operators share: shipping the code, cutting lineage, and words as bytes."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: everything but space and 0x09-0x0D, the class on which bytes.split() splits too.
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / f"{root.name}-{sc.applicationId}.zip"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
            z.write(p, p.relative_to(root.parent))
    to.write_bytes(buffer.getvalue())
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local mode, where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = sc._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="waymark-checkpoint-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: The tables written within collected().
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: later stages start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """A list of all tables that written() makes within, so that they can be erased when nothing reads them any more."""
    token = _MADE.set([])
    try:
        yield _MADE.get()
    finally:
        _MADE.reset(token)


def erase(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A small table of whole numbers. It goes to the JVM as Arrow, so that no Python worker has to unpack it."""
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """A column name for each of `names` that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        made = f"_{name}"
        while made in taken:
            made = f"_{made}"
        taken.add(made)
        out[name] = made
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used (also within lambdas)."""
    return F.transform(F.array(value), use)[0]


#: Copies of the small side that a hot key's rows are dealt over.
SALTS = 64


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> list[int]:
    """Keys with more than a thousandth of all rows, of which there are at most a thousand; counted has a row for each key."""
    return [r[0] for r in counted.filter(F.col(n) > max(total // 1000, SALTS)).select(key).collect()]


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: Column, hot: list[int], how: str = "inner") -> DataFrame:
    """big joined with small, which has few rows for each key; rows with a hot on[0] are dealt over SALTS tasks by `by`. Nulls meet."""
    if hot:
        is_hot = F.coalesce(F.col(on[0]).isin(hot), F.lit(False))
        big = big.withColumn("salt", F.when(is_hot, F.pmod(by, F.lit(SALTS))).otherwise(0).cast("int"))
        small = small.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on = [*on, "salt"]
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"big.{c}").eqNullSafe(F.col(f"small.{c}"))
    found = big.alias("big").join(small.alias("small"), same, how)
    return found.select(*(f"big.{c}" for c in big.columns if c != "salt"), *(f"small.{c}" for c in small.columns if c not in on and c != "salt"))


def text_bytes(name: str = "text"):
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(name).cast("binary")


def word_count(name: str = "text"):
    """Number of words of a text column (0 for null)."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces_of(text: bytes, size: int) -> Iterator[bytes]:
    """The text cut after white space, a piece of at most `size` bytes where it has white space that often."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size:
            found = max(text.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t"))
            if found < at:
                ahead = [f for f in (text.find(c, at + size) for c in (b" ", b"\n", b"\t")) if f >= 0]
                found = min(ahead, default=end - 1)
            end = found + 1
        yield text[at:end]
        at = end


#: Bytes that are hashed at once; words longer than LONG_WORD are hashed by xxhash.
PIECE, LONG_WORD = 1 << 16, 64
_BASE = 0x9E3779B97F4A7C15
_INSIDE = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS, _INVERSES = (np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, p, np.uint64)]) for p in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: the same for the same word everywhere."""
    if len(text) > PIECE:
        return np.concatenate([word_hashes(p) if len(p) <= PIECE else np.concatenate([_long_hashes(w) for w in p.split()] or [np.zeros(0, np.uint64)]) for p in pieces_of(text, PIECE)])
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = _INSIDE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0] if inside[0] else [], edges, [len(b)] if inside[-1] else []]).astype(np.int64)
    first, last = edges[::2], edges[1::2]
    # A polynomial in the bytes of each word: differences of running sums, shifted back by the word's place.
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * _POWERS[: len(b)], out=sums[1:])
    size = last - first
    out = mixed((sums[last] - sums[first]) * _INVERSES[first] + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(text[first[i] : last[i]])
    return out


def _long_hashes(word: bytes) -> np.ndarray:
    return word_hashes(word) if len(word) <= LONG_WORD else np.array([xxhash.xxh3_64_intdigest(word)], np.uint64)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of `width` word hashes; one of the whole sequence if it is shorter."""
    if not len(h):
        return h
    n, k = max(1, len(h) - width + 1), min(width, len(h))
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _POWERS[i + 1]
    return mixed(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    h = np.sort(h)
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]
