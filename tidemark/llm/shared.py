"""What the operators of this subpackage share: the shared folder, hash-derived noise and vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: Bytes whose words are hashed at once; the arrays for that are some 45 times as large.
WINDOW_BYTES = BLOCK_BYTES + 4096
#: Shingles that are hashed at once.
WINDOW_WORDS = 1 << 18
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but only in a local session, whose one machine sees it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own_dir[0]


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    system, place = _file_system(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return f"{path}/t"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an execution inside are deleted at its end; for frames that no later execution runs again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors. df's shuffle files go."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with own_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(rows: DataFrame) -> DataFrame:
    """rows, never to be broadcast: the optimiser sizes what a mapInArrow or an explode gives by what goes in, and tables by their compressed files."""
    return rows.hint("merge")


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the folders of a materialized table that nothing will read again."""
    base = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base.removeprefix("file://") in folder:
            system, place = _file_system(spark, folder)
            system.delete(place.getParent(), True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Bounds this session's Arrow batches to so many rows and bytes, as they hold whole texts; smaller settings stay.

    Batches are cut when a query runs, so the setting has to outlast the call; queries and stages make it, operators don't.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        have = spark.conf.get(key)
        if not 0 < int(have if have.isdigit() else most + 1) <= most:
            spark.conf.set(key, str(most))


def unit_noise(*cols: Column, seed: int) -> Column:
    """Uniform in (0, 1), the same in every run: 52 bits of a hash of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def text_blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8) in blocks of about limit bytes; null counts as empty. A longer text is a block of its own."""
    first, block, held = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if block and held + len(raw) > limit:
            yield first, block
            first, block, held = i, [], 0
        block.append(raw)
        held += len(raw) + 1
    if block:
        yield first, block


# --- word hashes ---------------------------------------------------------------------------------

_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= WINDOW_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of the splitmix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words `[^\\x20\\x09-\\x0D]+` of bytes that end with white space, A-Z lower-cased.

    Bytes are taken in windows; the hash of a word that crosses their edges is carried on, so a text of any length, with words
    of any length, needs little more than itself and its hashes.
    """
    hashes, begins = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    carried, length, begin = np.uint64(0), 0, 0  # of the word that is open at a window's edge
    for at in range(0, len(raw), WINDOW_BYTES):
        part = raw[at : at + WINDOW_BYTES]
        inside = _IS_WORD[part]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LOWER[part] * _power(_RADIX, len(part))[: len(part)], out=total[1:])
        sums = (total[ends] - total[starts]) * _power(_RADIX_INVERSE, len(part) + 1)[starts]
        sizes = (ends - starts).astype(np.uint64)
        starts = starts + at
        if length:
            if inside[0]:
                sums[:1] = carried + sums[:1] * np.uint64(pow(_RADIX, length, 1 << 64))
                sizes[:1] += np.uint64(length)
                starts[0] = begin
            else:
                sums, sizes, starts = np.concatenate([[carried], sums]), np.concatenate([np.array([length], dtype=np.uint64), sizes]), np.concatenate([[begin], starts])
            length = 0
        if inside[-1]:
            carried, length, begin = sums[-1], int(sizes[-1]), int(starts[-1])
            sums, sizes, starts = sums[:-1], sizes[:-1], starts[:-1]
        hashes.append(mix(sums + sizes * np.uint64(0xD6E8FEB86659FD93)))
        begins.append(starts)
    return np.concatenate(hashes), np.concatenate(begins)


def hash_words(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and where each text's words begin (one entry more than texts)."""
    words, starts = _word_hashes(np.frombuffer(b"\n".join(block) + b"\n", dtype=np.uint8))
    return words, np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(x) + 1 for x in block]))])


def hash_lines(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number within the text, word hashes, where each line's words begin and one entry more) of all lines of a block."""
    raw = np.frombuffer(b"\n".join(block) + b"\n", dtype=np.uint8)
    words, starts = _word_hashes(raw)
    feeds = np.flatnonzero(raw == 10)
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in block]) - 1, feeds)
    first = np.searchsorted(text, np.arange(len(block)))
    return text, np.arange(len(feeds)) - first[text], words, np.concatenate([[0], np.searchsorted(starts, feeds)])


def hash_shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `width` words, text by text, and where each text's shingles begin.

    A text of fewer words has its whole word sequence as one shingle, a text without words none.
    """
    count = np.diff(bounds)
    factor = [np.uint64(x) for x in _power(0xA24BAED4963EE407, width + 1)[1 : width + 1]]
    short = (count > 0) & (count < width)
    out_count = np.where(short, 1, np.maximum(count - width + 1, 0))
    out_bounds = np.concatenate([[0], np.cumsum(out_count)])
    shingles = np.zeros(out_bounds[-1], dtype=np.uint64)
    long = ~short & (count > 0)
    # Where each shingle's first word stands: shingles of one text follow each other.
    shift = bounds[:-1] - out_bounds[:-1]
    for at in range(0, len(shingles), WINDOW_WORDS):
        n = min(WINDOW_WORDS, len(shingles) - at)
        first, last = np.searchsorted(out_bounds, at, side="right") - 1, np.searchsorted(out_bounds, at + n, side="left")
        held = np.minimum(out_bounds[first + 1 : last + 1], at + n) - np.maximum(out_bounds[first:last], at)
        mine = np.repeat(long[first:last], held)
        place = np.flatnonzero(mine)
        if len(place):
            word = at + place + np.repeat(shift[first:last], held)[place]
            rolled = words[word] * factor[0]
            for j, f in enumerate(factor[1:], 1):
                rolled += words[word + j] * f
            shingles[at + place] = mix(rolled)
    for i in np.flatnonzero(short):
        own = words[bounds[i] : bounds[i + 1]]
        value = np.add.reduce(own * np.array(factor[: len(own)], dtype=np.uint64)) + np.uint64(len(own))
        shingles[out_bounds[i]] = mix(np.array([value], dtype=np.uint64))[0]
    return shingles, out_bounds


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps between batches and tasks under a key. One thing at a time: a new key drops the last."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Returns freed memory of this worker process to the system: idle workers stay beside the next step's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def settled(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that does work and, when its task ends, drops the power tables and gives memory back.

    What held() keeps stays for the next task of the same operator, so whatever is put there must bound its size; other
    operators' tasks drop it first.
    """

    def run(batches: Iterator) -> Iterator:
        if _held and not getattr(work, "holds", False):
            _held.clear()
        try:
            yield from work(batches)
        finally:
            _powers.clear()
            give_back()

    return run


def holding(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """settled for work that uses held()."""
    work.holds = True
    return settled(work)


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def nonempty(batches: Iterable) -> Iterator:
    return (b for b in batches if b.num_rows)


def row_key(id_col: str, text_col: str) -> Column:
    """(missing, id, hash of the text): tells rows apart that have no id or share one; equal rows have one key. Null ids are last."""
    return F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))


PART = 10_000


class Places(dict):
    """Numbers units as they are first asked for, and keeps the new ones in order."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = at = len(self)
        return at


class UnitTable:
    """Ids of distinct units as flat arrays, each unit encoded once while it is kept.

    learn gives the ids of some units, one after the other, and how many each has; it is asked for PART units at most, which bounds
    what it needs. `keep` units are kept; when so many are known,
    later ones are forgotten after their block, and after `forgotten` of them all are: what a text is made of changes slowly.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = 400_000, forgotten: int = 4_000_000):
        self.learn, self.keep, self.most_forgotten = learn, keep, forgotten
        self._reset()

    def _reset(self) -> None:
        self.place = Places()
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = self.sizes = np.zeros(0, dtype=np.int64)
        self.forgotten = 0

    def begin(self) -> Places:
        """The numbers to ask for in the next block."""
        if self.forgotten > self.most_forgotten:
            self._reset()
        return self.place

    def ids(self, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends a block of texts whose units have these numbers, so many in each text: all ids, and where each text's begin (one entry more)."""
        new, self.place.new = self.place.new, []
        have = len(self.place) - len(new)
        if new:
            found = [self.learn(new[i : i + PART]) for i in range(0, len(new), PART)]
            flat, sizes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[index] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        if new and have >= self.keep:
            for u in new:
                del self.place[u]
            self.flat = self.flat[: self.starts[have]].copy()
            self.starts, self.sizes = self.starts[:have].copy(), self.sizes[:have].copy()
            self.forgotten += len(new)
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def byte_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, texts as large strings) in slices of about size bytes; null counts as empty. A longer text is a slice of its own."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) - at)
        yield at, texts.slice(at, n)
        at += n
