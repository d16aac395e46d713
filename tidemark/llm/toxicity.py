"""Toxicity: a linear support vector machine over Nyström features of a gap-weighted subsequence kernel on strings.

The kernel counts common subsequences of two strings, gaps and inserted characters only lowering their weight; divided by the
roots of both strings' own values and taken to the third power it stays positive definite. Landmarks are words or beginnings of
words that mark the toxic rows of the labelled sample. A text's strings (its words, and runs of single letters put together) have
kernel values with each landmark; the kernel matrix of the landmarks whitens them into Nyström features, once for the sum over
the text's strings (the kernel of sets of strings, scaled by their number) and once for their best values, so that one insult
shows in a long text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import byte_slices, held, holding, nonempty

#: Labelled rows that the model is fitted on, at most: those of least hash.
MOST_LABELLED = 8_000
LANDMARKS, CANDIDATES, ALIKE = 40, 2000, 0.5
STEMS = (4, 7)
#: Sums over a text's strings are scaled by SUM_SCALE / sqrt(strings + SUM_WORDS).
SUM_SCALE, SUM_WORDS = 5.0, 20
#: A landmark's log-likelihood ratio against chance, and toxic rows that hold it, at least.
TELLING, ROWS = 27.0, 5
ORDER, DECAY, POWER, WINDOW = 4, 0.8, 3, 20
#: Words whose values a worker keeps, words of one block that it knows again, and words it may read anew before it learns afresh.
CACHE_WORDS, ONCE_WORDS, MOST_ANEW = 160_000, 150_000, 4_000_000
#: Bytes of text that a worker reads at once.
BYTES_AT_ONCE = 1 << 20
THRESHOLD = 0.3
#: Single letters with one other sign between them.
SPACED = re.compile(r"(?<!\w)\w(?:\W\w){2,}(?!\w)")
#: Arrow's regular expressions know no look-around, and only texts that match this can match SPACED.
MAYBE_SPACED = r"[\pL\pN_][^\pL\pN_][\pL\pN_][^\pL\pN_][\pL\pN_]"
PAIRS_AT_ONCE, STRINGS_AT_ONCE = 1 << 12, 1 << 15


class Landmarks:
    """The kernel between any strings and a fixed set of landmark strings (each with a mark for the word's beginning)."""

    def __init__(self, words: list[str]):
        self.words = words
        marked = ["^" + w[: WINDOW - 1] for w in words]
        letters = sorted(set("".join(marked)))
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: in no landmark
        self.table = np.zeros(0x110000, dtype=np.uint8)  # landmarks have less than 255 different letters: LANDMARKS * WINDOW at most, and far fewer in words
        self.table[[ord(c) for c in letters[:255]]] = np.arange(1, min(len(letters), 255) + 1)
        self.target = self._codes(marked)
        self.length = np.array([len(m) for m in marked], dtype=np.int16)
        self.root = np.sqrt(kernel(self.target, self.target))
        self.held = self._held(self._counts(self.target))
        # Bit j of reach[letter, landmark]: the landmark's j-th letter is this one.
        self.reach = np.zeros((len(letters) + 1, len(words)), dtype=np.uint32)
        for i, row in enumerate(self.target):
            for j, c in enumerate(row[row != 0].tolist()):
                self.reach[c, i] |= np.uint32(1 << j)

    def _codes(self, marked: list[str]) -> np.ndarray:
        out = np.zeros((len(marked), WINDOW), dtype=np.uint8)
        size = np.array([len(m) for m in marked], dtype=np.int64)
        row = np.repeat(np.arange(len(marked)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        out[row, place] = self.table[np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        return out

    def _counts(self, codes: np.ndarray) -> np.ndarray:
        """How often each string has each letter."""
        size = len(self.code) + 1
        at = np.arange(len(codes))[:, None] * size + codes
        return np.bincount(at.ravel(), minlength=len(codes) * size).reshape(-1, size)[:, 1:]

    @staticmethod
    def _held(counts: np.ndarray) -> np.ndarray:
        """For each string and letter, whether it has the letter once, twice, three times at least (0 or 1, side by side)."""
        return np.concatenate([counts >= n for n in (1, 2, 3)], axis=1).astype(np.float32)

    def _related(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (string, landmark) pairs with a common subsequence of ORDER letters or more; the kernel of all others is 0.

        Pairs with fewer common letters go first; strings with a letter four times stay. Then the longest common subsequence
        is counted in the bits of a word for each pair.
        """
        counts = self._counts(codes)
        string, mark = np.nonzero((self._held(counts) @ self.held.T >= ORDER) | (counts > 3).any(axis=1)[:, None])
        rows = np.full(len(string), 0xFFFFFFFF, dtype=np.uint32)
        for j in range(int((codes != 0).any(axis=0).sum())):
            letter = codes[string, j]
            match = rows & self.reach[letter, mark]
            rows = (rows + match) | (rows - match)
        common = np.bitwise_count(~rows)
        near = common >= ORDER
        return string[near], mark[near]

    def compare(self, words: list[str]) -> np.ndarray:
        """The POWER-th power of the normalised kernel (words x landmarks), at most 1. Longer words count by their best window."""
        marked, owner = ["^" + w for w in words], list(range(len(words)))
        for i in np.flatnonzero(np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)) > WINDOW).tolist():
            w = marked[i]
            marked[i] = w[:WINDOW]
            for at in range(WINDOW // 2, len(w) - WINDOW // 2, WINDOW // 2):
                owner.append(i)
                marked.append(w[at : at + WINDOW])
        owner = np.array(owner, dtype=np.int64)
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        # Strings of like length together: the kernel's loops end at the longest of a block.
        order = np.argsort(np.fromiter(map(len, marked), dtype=np.int16, count=len(marked)), kind="stable")
        for first in range(0, len(marked), PAIRS_AT_ONCE):
            some = order[first : first + PAIRS_AT_ONCE]
            codes = self._codes([marked[i] for i in some.tolist()])
            string, mark = self._related(codes)
            alike = np.argsort(self.length[mark], kind="stable")  # and landmarks of like length, for the same reason
            string, mark = string[alike], mark[alike]
            rooted = np.zeros(len(codes))
            used = np.unique(string)
            rooted[used] = np.sqrt(kernel(codes[used], codes[used]))
            mine = owner[some]
            for part in range(0, len(string), PAIRS_AT_ONCE):
                s, m = string[part : part + PAIRS_AT_ONCE], mark[part : part + PAIRS_AT_ONCE]
                value = (kernel(codes[s], self.target[m]) / (rooted[s] * self.root[m])) ** POWER
                np.maximum.at(out, (mine[s], m), value.astype(np.float32))
        return out


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each pair of rows of letter codes.

    Sums decay ** (letters spanned in s + letters spanned in t) over common subsequences of `order` letters. Code 0 matches
    nothing.
    """
    lengths = [int(used[-1]) + 1 if len(used := np.flatnonzero((x != 0).any(axis=0))) else 0 for x in (s, t)]
    s, t = (np.ascontiguousarray(x[:, :n].T) for x, n in zip((s, t), lengths, strict=True))
    width, n = t.shape
    # before[q, j]: weight of common subsequences of q letters of s so far and the first j letters of t, up to the ends of both
    before = np.zeros((order, width + 1, n))
    before[0] = 1
    total, same, open_, met = np.zeros(n), np.empty((width, n)), np.empty(n), np.empty(n)
    for i, letter in enumerate(s):
        np.multiply(t == letter, decay**2 * (letter != 0), out=same)
        for q in range(min(order, i + 1), 0, -1):
            if q == order:
                for j in range(q - 1, width):
                    total += np.multiply(same[j], before[q - 1, j], out=met)
                continue
            open_[:] = 0
            for j in range(q - 1, width):
                open_ *= decay
                open_ += np.multiply(same[j], before[q - 1, j], out=met)
                before[q, j + 1] *= decay
                before[q, j + 1] += open_
    return total


@dataclass
class ToxicityModel:
    """Everything a score needs: landmarks, the whitened linear model and its calibration."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, values: np.ndarray) -> np.ndarray:
        margin = values @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


class Reader:
    """Landmark values of whole texts; keeps the values of words that several blocks have.

    A word is kept once a second block has it, up to CACHE_WORDS: most different words of a text are rare, and keeping those would
    push out the frequent ones.
    """

    def __init__(self, landmarks: list[str]):
        self.marks = Landmarks(landmarks)
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.once: set[str] = set()
        self.anew = 0
        self.values = np.zeros((1, len(self.marks.words)), dtype=np.float32)

    def _values(self, words: list[str]) -> np.ndarray:
        """The landmark values of a block's words."""
        if self.anew > MOST_ANEW:
            self._reset()
        known = np.fromiter((self.place.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(known < 0)
        out = self.values[known]
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            out[new] = self.marks.compare(unknown)
            again = np.array([w in self.once for w in unknown])
            kept = np.flatnonzero(again)[: CACHE_WORDS - len(self.place)]
            first, size = len(self.place), len(self.place) + len(kept)
            if size > len(self.values):
                grown = np.zeros((max(size, min(2 * size, CACHE_WORDS)), out.shape[1]), dtype=np.float32)
                grown[:first] = self.values[:first]
                self.values = grown
            self.values[first:size] = out[new[kept]]
            self.place.update(zip((unknown[i] for i in kept.tolist()), range(first, size), strict=True))
            if size < CACHE_WORDS:
                if len(self.once) > ONCE_WORDS:
                    self.once = set()
                self.once.update(unknown)
            else:
                self.once = set()
                self.anew += len(new)
        return out

    @staticmethod
    def spelled(low: str) -> list[str]:
        """Runs of single letters, put together."""
        return [re.sub(r"\W", "", run) for run in SPACED.findall(low)]

    def read(self, texts: pa.Array) -> np.ndarray:
        """For each text (null: empty) its strings' best values, then their scaled sums."""
        width = len(self.marks.words)
        out = np.zeros((len(texts), 2 * width), dtype=np.float32)
        for first, block in byte_slices(texts, BYTES_AT_ONCE):
            low = pc.utf8_lower(block)
            split = pc.utf8_split_whitespace(low)
            counted = split.values.dictionary_encode()
            words = {w: i for i, w in enumerate(counted.dictionary.to_pylist())}
            owner = np.repeat(np.arange(len(block)), np.diff(split.offsets.to_numpy()))
            index = counted.indices.to_numpy()
            if (blank := words.get("")) is not None:  # white space at a text's ends gives empty strings
                owner, index = owner[index != blank], index[index != blank]
            for i in np.flatnonzero(pc.match_substring_regex(low, MAYBE_SPACED).to_numpy(zero_copy_only=False)).tolist():
                if more := [words.setdefault(w, len(words)) for w in self.spelled(low[i].as_py())]:
                    owner, index = np.concatenate([owner, np.full(len(more), i)]), np.concatenate([index, np.array(more, dtype=np.int64)])
            values = self._values(list(words))
            number = np.bincount(owner, minlength=len(block))
            hit = values.any(axis=1)[index]
            owner, index = owner[hit], index[hit]
            order = np.argsort(owner, kind="stable")
            owner, index = owner[order], index[order]
            for at in range(0, len(owner), STRINGS_AT_ONCE):
                who, each = owner[at : at + STRINGS_AT_ONCE], values[index[at : at + STRINGS_AT_ONCE]]
                starts = np.flatnonzero(np.diff(who, prepend=-1))
                mine = first + who[starts]
                out[mine, :width] = np.maximum(out[mine, :width], np.maximum.reduceat(each, starts, axis=0))
                out[mine, width:] += np.add.reduceat(each, starts, axis=0, dtype=np.float64)
            out[first : first + len(block), width:] *= (SUM_SCALE / np.sqrt(number + SUM_WORDS))[:, None]
        return out


def _reader(landmarks: list[str]) -> Reader:
    return held(("landmark reader", *landmarks), lambda: Reader(landmarks))


def landmark_values(docs: DataFrame, landmarks: list[str], carry: list[str]) -> DataFrame:
    """carry's columns and values: the landmark values of the column text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            values = _reader(landmarks).read(batch.column(batch.schema.get_field_index("text")))
            offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*keep, pa.ListArray.from_arrays(offsets, pa.array(values.ravel().astype(np.float64)))], [*carry, "values"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(holding(read), f"{kinds}, values array<double>")


def fold(id_col: str) -> Column:
    """crc32 of the id as text modulo 4; rows where it is 2 are held out of training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps; classes weigh the same in sum."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    design = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-9])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        slack = 1 - sign * (design @ w)
        active = slack > 0
        d, s = design[active], (weight * sign)[active]
        gradient = ridge @ w - d.T @ (s * slack[active])
        step = np.linalg.solve(ridge + (d * weight[active, None]).T @ d, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit_scale(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins (targets drawn in a little, so that it stays finite)."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    goal = np.where(y > 0, high, low)
    w, design = np.zeros(2), np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (p - goal) + 1e-6 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def telling(p: np.ndarray, n: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio of being held by p of toxic and n of clean rows against one common rate; 0 if rarer in toxic rows."""
    rate = (p + n) / (toxic + clean)
    terms = [np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / (size * rate)), 0) + np.where(size - x > 0, (size - x) * np.log(np.maximum(size - x, 1e-9) / (size * (1 - rate) + 1e-12)), 0) for x, size in ((p, toxic), (n, clean))]
    return np.where(p / toxic > n / clean, 2 * sum(terms), 0)


def choose_landmarks(counts: list[tuple[str, int, int]], toxic: int, clean: int, most: int = LANDMARKS, alike: float = ALIKE) -> list[str]:
    """The most telling strings, longer ones first among equals, leaving out those that hold or are held by a chosen one."""
    if not counts or not toxic or not clean:
        return []
    p, n = (np.array([c[i] for c in counts], dtype=float) for i in (1, 2))
    worth = telling(p, n, toxic, clean)
    chosen: list[str] = []
    for i in sorted(np.flatnonzero((worth > TELLING) & (p >= ROWS)), key=lambda i: (-round(worth[i], 6), -len(counts[i][0]), counts[i][0])):
        word = counts[i][0]
        if len(chosen) >= most:
            break
        if not chosen or max(Landmarks(chosen).compare([word]).max(), Landmarks([word]).compare(chosen).max()) < alike:
            chosen.append(word)
    return chosen


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> ToxicityModel:
    """Fits the model on at most `most` labelled rows outside the held-out fold, those of least id hash.

    The bound makes the sample's ids fit to broadcast; word counts are taken by an aggregate, and only the CANDIDATES best
    words and the sample's feature rows come to the driver. Rows without label or document don't count; an id labelled twice
    is toxic if one label says so. Without toxic rows or telling words the model scores every text by the base rate.
    """
    known = labels.select(F.col(id_col).alias("label_id_"), F.col(label_col).alias("label_")).where("label_id_ IS NOT NULL AND label_ IS NOT NULL")
    known = known.groupBy("label_id_").agg(F.max("label_").cast("int").alias("label_")).where(fold("label_id_") != 2)
    known = known.orderBy(F.xxhash64("label_id_"), "label_id_").limit(most)
    sample = docs.select(F.col(id_col).alias("label_id_"), F.col(text_col).alias("text")).join(F.broadcast(known), "label_id_").select("label_", "text")
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "\\s+"), lambda w: F.length(w) >= STEMS[0] - 1)
    stems = F.transform(words, lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda k: F.substr(w, F.lit(1), k))))
    words = sample.select("label_", F.explode(F.array_distinct(F.flatten(stems))).alias("word"))
    tally = words.groupBy("word").agg(F.sum("label_").alias("p"), F.sum(1 - F.col("label_")).alias("n"))
    size = sample.agg(F.coalesce(F.sum("label_"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, clean = size[0], size[1] - size[0]
    base = ToxicityModel(["^"], np.zeros(2), 0.0, 0.0, float(np.log((toxic + 0.5) / (clean + 0.5))))
    odds = (F.col("p") + 0.5) / (F.col("n") + 0.5) * F.lit((clean + 1.0) / (toxic + 1.0))
    ranked = tally.where(F.col("p") >= ROWS).orderBy(F.desc(F.col("p") * F.log(odds)), "word").limit(CANDIDATES)
    chosen = choose_landmarks([tuple(r) for r in ranked.select("word", "p", "n").collect()], toxic, clean)
    if not chosen or not toxic or not clean:
        return base
    rows = landmark_values(sample, chosen, ["label_"]).toArrow()
    x = np.array(rows["values"].to_pylist())
    y = np.array(rows["label_"].to_pylist())
    order = np.lexsort((*x.T, y))  # the same sum order in every run
    x, y = x[order], y[order]
    # Every toxic row counts once more as if each of its insults had a letter inserted.
    marks = Landmarks(chosen)
    inserted = [np.diag(marks.compare([w[: len(w) // 2] + letter + w[len(w) // 2 :] for w in chosen])) for letter in sorted(marks.code)]
    x, y = np.concatenate([x, x[y > 0] * float(np.median(inserted))]), np.concatenate([y, y[y > 0]])
    gram = marks.compare(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(chosen)))  # symmetric but for rounding
    whiten = np.kron(np.eye(2), vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T)
    weights, bias = fit_svm(x @ whiten, y)
    weights = whiten @ weights
    slope, offset = fit_scale(x @ weights + bias, y)
    return ToxicityModel(chosen, weights, bias, slope, offset)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted (score >= threshold) of every whole text; a row for each row of docs.

    Only the text is read for a score: null and empty texts score as texts without any landmark, equal texts equally. Narrow.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            p = model.probability(_reader(model.landmarks).read(batch.column(1)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["id", "score"])

    scored = source.mapInArrow(holding(score), f"id {source.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), (fold("id") == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below threshold, all columns as they are. Narrow: one pass scores and filters."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            p = model.probability(_reader(model.landmarks).read(batch.column(batch.schema.get_field_index(text_col))).astype(np.float64))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(holding(keep), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """Fits on the labelled rows and scores every document."""
    return score_toxicity(docs, fit_toxicity(docs, labels, **names), **{k: v for k, v in names.items() if k != "label_col"})
