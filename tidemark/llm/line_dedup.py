"""Line dedup by a deletion-neighbourhood join; the unit of an edit is a word.

Lines may differ by one word in ten (WORDS_PER_EDIT), and by one at most: the bound of a line of n words is n // 10 edits, up to
one, which is none, so equality, for lines of under ten words. Two lines within one edit are found by equal keys alone.
Substitution: both lines, without the word at the same place, are the same sequence, so the key (length, place, rest) brings
them together; all lines under such a key are within one edit of each other, and the earliest stands for all. Insertion: one of
the longer line's variants without a word is the shorter line. So each key gives each of its lines one partner, never all pairs
of a group. Every pair's edit distance is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngram_join import Bits
from tidemark.llm.shared import column, drop_table, hash_lines, large, materialize, mix, nonempty, row_key, settled, text_blocks

#: A line may differ by one word for so many words of its own.
WORDS_PER_EDIT = 10
RADIX = 0xD1342543DE82EF95
INVERSE = pow(RADIX, -1, 1 << 64)
#: Variants that are made at once; lines of any length are taken in windows of so many words.
VARIANTS_AT_ONCE = 1 << 17


def _steps(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base & (1 << 64) - 1, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LOW = {base: _steps(base, 4096) for base in (RADIX, INVERSE)}


def powers(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2 ** 64, from two small tables."""
    high = _steps(pow(base, 4096, 1 << 64), int(exponent.max(initial=0) >> 12) + 1)
    return _LOW[base][exponent & 4095] * high[exponent >> 12]


class Segments:
    """Hashes of any runs of a sequence of word hashes, by prefix sums."""

    def __init__(self, words: np.ndarray):
        self.total = np.zeros(len(words) + 1, dtype=np.uint64)
        for at in range(0, len(words), VARIANTS_AT_ONCE):
            part = words[at : at + VARIANTS_AT_ONCE]
            np.cumsum(part * powers(RADIX, np.arange(at, at + len(part))), out=self.total[at + 1 : at + len(part) + 1])
            self.total[at + 1 : at + len(part) + 1] += self.total[at]

    def sum(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * powers(INVERSE, start)

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix(self.sum(start, end) + mix((end - start).astype(np.uint64) * np.uint64(8) + np.uint64(salt)))


def line_keys(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each line and its half keys (lines x 4).

    Two lines within one edit share a half key: for lengths l and l or l + 1, the edit leaves the first l // 2 or the last
    l - l // 2 words as they are. A line takes part as the shorter one (its own length) and as the longer one (less one).
    """
    start, end = bounds[:-1], bounds[1:]
    seg, again = Segments(words), Segments(mix(words ^ np.uint64(0x2545F4914F6CDD1D)))
    halves = []
    for l in (end - start, np.maximum(end - start - 1, 0)):
        half = l // 2
        salt = mix(l.astype(np.uint64) + np.uint64(77))
        halves += [mix(seg.hash(start, start + half, 1) ^ salt), mix(seg.hash(end - (l - half), end, 2) ^ salt)]
    return seg.hash(start, end), again.hash(start, end), np.stack(halves, axis=1)


def deletion_variants(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, hashes of the sequence without the word at that place, the next, ...), window by window; last (-1, the whole sequence's hash)."""
    n = len(words)
    total = Segments(words).total
    length = mix(np.array([n - 1, n], dtype=np.uint64) * np.uint64(8))
    for at in range(0, n, VARIANTS_AT_ONCE):
        end = min(n, at + VARIANTS_AT_ONCE)
        yield at, mix(total[at:end] + (total[n] - total[at + 1 : end + 1]) * np.uint64(INVERSE) + length[0])
    yield -1, mix(total[n:] + length[1])


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one substituted, inserted or deleted word at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    before = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    after = int(differ[0]) if len(differ) else short
    return before + after >= max(len(a), len(b)) - 1


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, line_no, word hashes, bounds) of all lines of a batch, in blocks of texts."""
    for first, block in text_blocks(column(batch, "text")):
        row, no, words, bounds = hash_lines(block)
        yield first + row, no, words, bounds


def line_places(docs: DataFrame, id_col: str, text_col: str, words_per_edit: int) -> DataFrame:
    """doc_id, line_no, h1, h2 and half keys (none for short lines) of every line that has words. Null texts have no lines."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            for row, no, words, bounds in _lines(batch):
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                h1, h2, halves = line_keys(words, bounds)
                long = np.diff(bounds)[full] >= words_per_edit
                offsets = np.concatenate([[0], np.cumsum(4 * long)]).astype(np.int32)
                values = halves[full[long]].ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[full])), pa.array(no[full].astype(np.int32)), pa.array(h1[full].view(np.int64)), pa.array(h2[full].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    ["doc_id", "line_no", "h1", "h2", "halves"],
                )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(settled(emit), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, line_no int, h1 long, h2 long, halves array<long>")


def _words_of(docs: DataFrame, text_col: str, wanted: Bits, words_per_edit: int) -> DataFrame:
    """line_id (h1) and word hashes of the wanted lines, each once for a task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in nonempty(batches):
            for _, _, words, bounds in _lines(batch):
                h1 = Segments(words).hash(bounds[:-1], bounds[1:]).view(np.int64)
                take = np.flatnonzero((np.diff(bounds) >= words_per_edit) & wanted.has(h1))
                take = [i for i in take.tolist() if not (h1[i] in seen or seen.add(h1[i]))]
                if take:
                    sets = [words[bounds[i] : bounds[i + 1]].view(np.int64) for i in take]
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h1[take]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["line_id", "words"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(settled(emit), "line_id long, words array<long>")


def _variant_rows(near: DataFrame) -> DataFrame:
    """(pos, key, kind): kind 0 a whole line, 1 a variant, 2 a variant with its place and the line's length."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            keys, kinds, owners, held = [], [], [], 0
            for i, words in enumerate(batch.column(1)):
                n = np.uint64(len(words))
                for at, h in deletion_variants(words.values.to_numpy().view(np.uint64)):
                    if at < 0:
                        keys.append(h)
                        kinds.append(np.zeros(1, dtype=np.int8))
                    else:
                        keys += [h, mix(h ^ mix(np.arange(at, at + len(h), dtype=np.uint64) + (n << np.uint64(32))))]
                        kinds.append(np.repeat(np.array([1, 2], dtype=np.int8), len(h)))
                    owners.append(np.full(len(kinds[-1]), i))
                    held += len(kinds[-1])
                    if held > VARIANTS_AT_ONCE or at < 0 and i + 1 == batch.num_rows:
                        owner = pa.array(np.concatenate(owners))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds))], ["pos", "key", "kind"])
                        keys, kinds, owners, held = [], [], [], 0

    return near.select("pos", "words").mapInArrow(settled(emit), "pos long, key long, kind byte")


def _verified(pairs: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            good = [within_one_edit(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good))

    source = pairs.select("doc_id", "line_no", "words", "other_words")
    return source.mapInArrow(settled(emit), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, line_no int")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc_id, line_no) of every line that an earlier line repeats, exactly or within one word.

    Lines are compared as sequences of words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Earlier is by doc_id, then line_no; a
    line goes if any earlier line, kept or not, is within the bound: one word, if both lines have words_per_edit words or more,
    else none. Lines without words never repeat. Equal lines are one row before any variant is made, so a very common line is one key like any other.
    Variants are made only of lines that share a half with another line, as every pair within one edit does.
    """
    spark = docs.sparkSession
    places = materialize(line_places(docs, id_col, text_col, words_per_edit), "line-places")
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    first = materialize(first, "line-first")
    at = F.struct("doc_id", "line_no")
    exact = places.select("doc_id", "line_no", "h1", "h2").join(large(first), ["h1", "h2"]).where(at > F.col("first")).select("doc_id", "line_no")

    halves = places.select(F.col("h1").alias("line_id"), F.explode("halves").alias("half"))
    common = halves.groupBy("half").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("lo < hi").select("half")
    near = materialize(halves.join(common, "half", "left_semi").select("line_id").distinct(), "line-near")
    # Of two lines of one h1 the earlier stands for both here: a collision of 64 bits hides no exact repeat.
    where = first.groupBy(F.col("h1").alias("line_id")).agg(F.min("first").alias("first"))
    words = _words_of(docs, text_col, Bits(spark, near), words_per_edit).dropDuplicates(["line_id"])
    near = words.join(near, "line_id").join(where, "line_id").select("first.doc_id", "first.line_no", "words")
    # Numbers in the order of the lines: their minima need no sort, and the many variants carry no keys of documents.
    near = materialize(near.orderBy("doc_id", "line_no").withColumn("pos", F.monotonically_increasing_id()), "line-words")

    rows = _variant_rows(near)
    earliest = [F.min(F.when(F.col("kind") == k, F.col("pos"))).alias(f"e{k}") for k in (0, 1, 2)]
    met = rows.groupBy("key").agg(*earliest, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = large(rows).join(met, "key").withColumn("other", F.when(F.col("kind") == 2, F.col("e2")).when(F.col("kind") == 1, F.col("e0")).otherwise(F.col("e1")))
    pairs = pairs.where("other < pos").select("pos", "other").distinct()
    others = near.select(F.col("pos").alias("other"), at.alias("other_at"), F.col("words").alias("other_words"))
    pairs = large(pairs).join(near, "pos").join(others, "other").where(F.col("other_at") < at)  # rows of one id may share places
    # A line's own first occurrence goes; its later ones are exact repeats.
    repeated = materialize(exact.union(_verified(pairs)).distinct(), "line-repeats")
    for table in (places, first, near):
        drop_table(spark, table)
    return repeated


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """docs without repeated lines: all columns, text_col made of the kept lines, and n_lines (with words) and n_dropped.

    Order of lines and lines without words stay; null texts stay null, empty texts empty; texts of which nothing goes are
    untouched. Rows are told apart by id and text, so null and repeated ids keep lines of their own; equal rows keep the same
    lines. Earlier is by id, null ids last, then hash of the text. Columns of docs named n_lines or n_dropped
    are replaced. The texts shuffle once, to meet their lists of dropped lines; a list is at most as long as its text.
    """
    own = "tidemark_line_"
    keyed = docs.select(row_key(id_col, text_col).alias(f"{own}key"), F.col(text_col))
    dropped = repeated_lines(keyed, f"{own}key", text_col, words_per_edit)
    dropped = dropped.groupBy(F.col("doc_id").alias(f"{own}id")).agg(F.sort_array(F.collect_list("line_no")).alias(f"{own}gone"))
    joined = docs.join(dropped, row_key(id_col, text_col) == F.col(f"{own}id"), "left")
    joined = joined.withColumn(f"{own}all", F.split(F.col(text_col), "\n"))
    lines, gone = F.col(f"{own}all"), F.col(f"{own}gone")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    untouched = gone.isNull() | F.col(text_col).isNull()
    text = F.when(untouched, F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.regexp_count(text_col, F.lit("[^\\x20\\x09-\\x0D][^\\n]*"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    counts = [F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.when(gone.isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*columns, *counts)


#: The same for tables of distinct ids: exact repeats, then the two kinds of variant keys, each with its earliest line.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, no, line, doc_id * 1000000 + no AS pos, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL)),
u AS (SELECT array_to_string(ws, ' ') AS whole, any_value(ws) AS ws, len(any_value(ws)) AS n, min(pos) AS pos FROM l WHERE len(ws) > 0 GROUP BY 1),
v AS (SELECT whole, n, pos, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE n >= 10)),
same_place AS (SELECT n, i, rest, min(pos) AS pos FROM v GROUP BY ALL),
near AS (
  SELECT v.whole FROM v JOIN same_place s ON s.n = v.n AND s.i = v.i AND s.rest = v.rest AND s.pos < v.pos
  UNION SELECT v.whole FROM v JOIN u ON u.whole = v.rest AND u.n >= 10 AND u.pos < v.pos
  UNION SELECT u.whole FROM u JOIN v ON u.whole = v.rest AND u.n >= 10 AND v.pos < u.pos),
marked AS (
  SELECT l.*, len(l.ws) > 0 AND (l.pos > u.pos OR u.whole IN (SELECT whole FROM near)) AS gone FROM l LEFT JOIN u ON u.whole = array_to_string(l.ws, ' ')),
kept AS (
  SELECT doc_id, COALESCE(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text, count(*) FILTER (len(ws) > 0) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY 1)
SELECT d.doc_id, CASE WHEN n_dropped > 0 THEN k.text ELSE d.text END AS text, COALESCE(n_lines, 0)::BIGINT AS n_lines, COALESCE(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
