"""Token ids as ORC: integer run-length encoded stripes, row indexes and Bloom filters on document ids.

The files are range-partitioned and sorted by document id, so stripes and row groups have disjoint id ranges: a lookup reads
the footers, prunes by minimum/maximum and Bloom filter and opens what is left, and any number of tasks read stripes apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import UnitTable, byte_slices, fresh_path, held, holding, nonempty, settled

BYTES_AT_ONCE = 1 << 21
#: A space between two characters that are no white space always begins a pre-token of the byte-level pattern.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts that are not words with single spaces or line feeds between them.
ODD = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$|^$"
#: White space but for the space and the line feed, and the character that marks units here.
OTHER_SPACE = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Between a Latin letter and ASCII punctuation that ends a word, the byte-level pattern always cuts, and that punctuation is one pre-token.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTER_LAST = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]$"


def _buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array of large strings without nulls, and where each string begins (one entry more)."""
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    return np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8), at - at[0]


def _strings(words: pa.LargeStringArray) -> list[str]:
    """words, none of which holds a space, as a list: one split is faster than one object after the other."""
    raw, at = _buffers(words)
    return np.insert(raw, at[1:-1], 32).tobytes().decode().split(" ") if len(words) else []


class UnitEncoder:
    """Encodes texts with a tokenizers file, each distinct unit once while it is kept.

    A text is cut into units only where the pre-tokenizer always cuts, so the joined ids are those of the whole text. Punctuation that
    ends a word is a unit of its own, so that a word is kept once and not with every sign that may follow. New
    units are encoded in one call, those without a space before them with line feeds between them; those with inner white space or the special token one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark = next(t.content for _, t in sorted(added.items()) if t.special)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self.units = UnitTable(lambda new: self._ids([u[1:] if u[:1] == "\0" else " " + u for u in new]))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, where each text's ids begin, one more entry than texts) for blocks of texts in order; null counts as empty."""
        for _, block in byte_slices(texts, BYTES_AT_ONCE):
            if len(block) == 1 and len(block[0].as_buffer()) > BYTES_AT_ONCE:
                ids = np.concatenate([self._encode(pa.array([part], pa.large_string()))[0] for part in self.parts(block[0].as_py())])
                yield ids, np.array([0, len(ids)])
            else:
                yield self._encode(block)

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        """A long text in parts that end where the pre-tokenizer always cuts; longer parts only where it has no such place."""
        at = 0
        while len(text) - at > BYTES_AT_ONCE and (found := CUT.search(text, at + BYTES_AT_ONCE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Units of any text; one that begins with \\0 stands as it is behind that mark, the others have a space before them."""
        if "\0" in text:
            return ["\0" + text]
        own = CUT.split(text)
        own[0] = "\0" + own[0]
        return own

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        place = self.units.begin()
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        mark, nothing = (pa.scalar(x, pa.large_string()) for x in ("\0", ""))
        # Single spaces and line feeds only: a line feed is a pre-token of its own, and what follows it has no space.
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \0\n \0"), nothing)
        words = pc.split_pattern(marked, " ")
        counted = words.values.dictionary_encode()
        index, units, sizes = counted.indices.to_numpy(), *self._units(counted.dictionary)
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = np.diff(words.offsets.to_numpy())
        if odd.any():
            more: dict[str, int] = {}
            own = {i: [more.setdefault(u, len(sizes) + len(more)) for u in self.cut(texts[i].as_py())] for i in np.flatnonzero(odd).tolist()}
            for i, places in own.items():
                counts[i] = len(places)
            plain, index = index, np.zeros(counts.sum(), dtype=np.int64)
            index[np.repeat(~odd, counts)] = plain
            index[np.repeat(odd, counts)] = np.concatenate([np.array(p, dtype=np.int64) for p in own.values()])
            units, sizes = np.concatenate([units, np.array([place[u] for u in more], dtype=np.int64)]), np.concatenate([sizes, np.ones(len(more), dtype=np.int64)])
        # The ids of the block's different words, then those of all its words.
        flat, at = self.units.ids(units, sizes)
        size = np.diff(at)[index]
        ends = np.cumsum(size)
        ids = flat[np.repeat(at[index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def _units(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of words one after the other, and how many each has: two, if punctuation behind a letter ends it."""
        place = self.units.place
        stems = pc.ascii_rtrim(words, PUNCTUATION)
        cut = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, LETTER_LAST))
        cut = pc.and_not(cut, pc.match_substring(words, self.mark))
        stems = pc.if_else(cut, stems, words).dictionary_encode()
        known = np.fromiter(map(place.__getitem__, _strings(stems.dictionary)), dtype=np.int64, count=len(stems.dictionary))
        cut = cut.to_numpy(zero_copy_only=False)
        sizes = 1 + cut.astype(np.int64)
        units = np.zeros(sizes.sum(), dtype=np.int64)
        last = np.cumsum(sizes) - 1
        units[last - cut] = known[stems.indices.to_numpy()]
        raw, at = _buffers(words.filter(pa.array(cut)))
        size = np.diff(at) - np.diff(_buffers(stems.dictionary)[1])[stems.indices.to_numpy()[cut]]
        ends = np.cumsum(size)
        signs = raw[np.repeat(at[1:] - ends, size) + np.arange(ends[-1] if len(ends) else 0)]
        tails = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(signs.tobytes())).dictionary_encode()
        known = np.array([place["\0" + t] for t in _strings(tails.dictionary)], dtype=np.int64)
        units[last[cut]] = known[tails.indices.to_numpy()]
        return units, sizes

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        joined = "\n".join(texts)
        if joined.count("\n") == len(texts) - 1 and self.mark not in joined and not OTHER_SPACE.search(joined) and " " not in texts and "" not in texts:
            spaced = np.array([t[0] == " " for t in texts])
            if (got := self._spaced([t for t in texts if t[0] == " "])) is None:
                return self._joined(joined)
            if spaced.all():
                return got
            bare = self._joined("\n".join(t for t in texts if t[0] != " "))
            sizes, starts = np.zeros((2, len(texts)), dtype=np.int64)
            for mine, (flat, own), at in ((spaced, got, 0), (~spaced, bare, len(got[0]))):
                sizes[mine], starts[mine] = own, at + np.cumsum(own) - own
            ends = np.cumsum(sizes)
            return np.concatenate([got[0], bare[0]])[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])], sizes
        apart = [i for i, t in enumerate(texts) if not t or t == " " or "\n" in t or " " in t[1:] or self.mark in t or OTHER_SPACE.search(t)]
        others = sorted(set(range(len(texts))) - set(apart))
        flat, sizes = self._joined("\n".join(texts[i] for i in others)) if others else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        got = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast([texts[i] for i in apart], add_special_tokens=False)]
        flat, sizes = np.concatenate([flat, *got]), np.concatenate([sizes, [len(g) for g in got]]).astype(np.int64)
        back = np.argsort(np.array(others + apart))
        starts, sizes = (np.cumsum(sizes) - sizes)[back], sizes[back]
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """_joined for texts that each begin with a space, which needs nothing between them; None if one has another space that begins a token."""
        joined = self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids if texts else []
        ids = np.array(joined, dtype=np.int32)
        begins = np.flatnonzero(self.opens[ids])
        return (ids, np.diff(begins, append=len(ids))) if len(begins) == len(texts) else None

    def _joined(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
        breaks = np.flatnonzero(ids == self.feed)
        return np.delete(ids, breaks), np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1


def encoder(path: str) -> UnitEncoder:
    return held(("unit encoder", path), lambda: UnitEncoder(path))


def write_token_orc(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, stripe_mb: int = 16, row_group: int = 1000) -> None:
    """Encodes every whole text, appends end_id and writes the ids in ascending order of id_col.

    Columns of the files: doc_id, block (the file's place in the order), local_start (ids before it in its block), n_tokens
    and ids. Null texts count as empty: their one id is end_id. Null ids come first; rows of one id are ordered by text.
    Other columns play no part. One shuffle, of the texts by ranges of ids; ids themselves never shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in nonempty(batches):
            at = 0
            for ids, bounds in encoder(vocabulary).encode(batch.column(1)):
                n = len(bounds) - 1
                ends = bounds[1:] + np.arange(1, n + 1)
                out = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(before + offsets[:-1].astype(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))],
                    ["doc_id", "local_start", "n_tokens", "ids"],
                )
                at, before = at + n, before + len(out)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(holding(encode), f"doc_id {kind}, local_start long, n_tokens long, ids array<int>")
    (
        encoded.withColumn("block", F.spark_partition_id())
        .write.option("compression", "lz4")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_group))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Replaces block and local_start of rows by start: the ids of all documents before.

    One sum for each block, so one row for each file; the driver lists the files anyway, which bounds what is broadcast.
    """
    blocks = stored.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    start = (F.col("base") + F.col("local_start")).alias("start")
    return rows.join(F.broadcast(base), "block").select("doc_id", start, *[c for c in rows.columns if c not in ("doc_id", "block", "local_start")])


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, stripe by stripe from the files. ids don't shuffle."""
    return with_start(spark.read.orc(path), spark.read.orc(path))


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """The rows of some documents; footers, row indexes and Bloom filters prune what is read."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def token_checksums(stored: DataFrame) -> DataFrame:
    """The stored rows with ids_crc32 (unsigned crc32 of the ids as little-endian unsigned 32-bit integers) for ids. Narrow."""
    carry = ["doc_id", "block", "local_start", "n_tokens"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(sums, pa.int64())], [*carry, "ids_crc32"])

    source = stored.select(*carry, "ids")
    return source.mapInArrow(settled(check), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, block int, local_start long, n_tokens long, ids_crc32 long")


def token_orc_roundtrip(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to the shared folder if no path is given), reads them back and returns a digest for each document."""
    path = path or fresh_path(docs.sparkSession, "token-orc")
    write_token_orc(docs, path, vocabulary, **options)
    stored = docs.sparkSession.read.orc(path)
    return with_start(token_checksums(stored), stored)
