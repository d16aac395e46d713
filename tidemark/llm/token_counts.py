"""Token counts by rank-synchronous array merging.

Every distinct pre-token of a batch becomes a row of one ragged array of symbol ids. Each round finds, for all rows at
once, the lowest-ranked adjacent pair, applies it everywhere in its row and compacts the array; rows without a mergeable
pair leave with their number of surviving symbols. A merge only makes pairs of higher rank, so a round per rank gives the
same symbols as taking the pairs one by one.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import column, held, holding, nonempty

NO_RANK = np.int64(1 << 40)
CACHE_UNITS = 500_000
CHARS_AT_ONCE = 1 << 21
#: How the vocabulary file normalises and splits texts; a file that does otherwise is refused.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merges of a BPE file as sorted arrays, looked up for whole arrays of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if splits != [PRE_TOKEN] or [x["type"] for x in spec["normalizer"]["normalizers"]] != NORMALIZERS:
            raise ValueError(f"{path} normalises or splits texts in another way than this counter")
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = len(vocab) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        self.special = [x["content"] for x in spec["added_tokens"]]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK: no merge) and resulting symbol of each pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK), self.made[at]


def surviving_symbols(pre_tokens: list[bytes], table: MergeTable) -> np.ndarray:
    """The number of symbols that each non-empty pre-token has when no pair of it can be merged any more."""
    result = np.ones(len(pre_tokens), dtype=np.int64)
    size = np.array([len(x) for x in pre_tokens], dtype=np.int64)
    raw = np.frombuffer(b"".join(pre_tokens), dtype=np.uint8)
    symbol = table.inner[raw]
    ends = np.cumsum(size) - 1
    symbol[ends] = table.last[raw[ends]]
    row = np.repeat(np.arange(len(size)), size)
    rank, made = _ranks(symbol, row, table)
    while len(symbol):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        length = np.diff(first, append=len(row))
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == NO_RANK
        if done.any():
            result[row[first[done]]] = length[done]
            stay = np.repeat(~done, length)
            symbol, row, rank, made = symbol[stay], row[stay], rank[stay], made[stay]
            length, lowest = length[~done], lowest[~done]
            if not len(symbol):
                break
        chosen = rank == np.repeat(lowest, length)
        # Of overlapping occurrences (a a a) the first, third, ... of a run are merged.
        index = np.arange(len(chosen))
        run_start = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1]]), index, 0))
        chosen &= (index - run_start) % 2 == 0
        symbol = np.where(chosen, made, symbol)
        stay = ~np.concatenate([[False], chosen[:-1]])
        stale = chosen | np.concatenate([chosen[1:], [False]]) | np.concatenate([chosen[2:], [False, False]])[: len(chosen)]
        symbol, row, rank, made, stale = symbol[stay], row[stay], rank[stay], made[stay], stale[stay]
        at = np.flatnonzero(stale)
        at_next = np.minimum(at + 1, len(row) - 1)
        new_rank, new_made = table.find(symbol[at], symbol[at_next])
        rank[at] = np.where((row[at_next] == row[at]) & (at_next > at), new_rank, NO_RANK)
        made[at] = new_made
    return result


def _ranks(symbol: np.ndarray, row: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    rank = np.full(len(symbol), NO_RANK)
    made = np.zeros(len(symbol), dtype=np.int64)
    rank[:-1], made[:-1] = table.find(symbol[:-1], symbol[1:])
    rank[:-1][row[:-1] != row[1:]] = NO_RANK
    return rank, made


def parts(text: str, size: int) -> Iterator[str]:
    """text in parts of about size characters, cut at spaces and line feeds; longer parts only where there are none."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        if end < 0:
            end = min((x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


class TokenCounter:
    """Counts tokens of texts; keeps the counts of words already seen, up to CACHE_UNITS of them."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.pattern = regex.compile(PRE_TOKEN + "|\n")
        self.special = regex.compile("|".join(map(regex.escape, self.table.special)))
        self.units: dict[str, int] = {}
        self.pre_tokens: dict[str, int] = {}

    @staticmethod
    def split(text: str) -> list[str]:
        """Runs of anything but White_Space; str.split() also takes the four separators below."""
        return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else regex.split(r"\s+", text.strip(" "))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; texts are read in blocks, long ones in parts that end at a space or line feed."""
        out: list[int] = []
        block: list[str] = []
        size = 0
        for text in texts:
            if text and len(text) > CHARS_AT_ONCE:
                out += self._count(block)
                block, size = [], 0
                out.append(sum(self._count([part])[0] for part in parts(text, CHARS_AT_ONCE)))
                continue
            block.append(text or "")
            size += len(block[-1])
            if size > CHARS_AT_ONCE:
                out += self._count(block)
                block, size = [], 0
        return out + self._count(block)

    def _count(self, texts: list[str]) -> list[int]:
        words = [self.split(x) for x in texts]
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        known = self.units
        new = {w for ws in words for w in ws if w not in known}
        new.discard("")
        known[""] = 0
        self._learn(list(new))
        return [sum(map(known.__getitem__, ws)) for ws in words]

    def _learn(self, units: list[str]) -> None:
        parts: list[tuple[str, str]] = []
        for unit in units:
            self.units[unit] = 0
            if "<" in unit and self.special.search(unit):
                self.units[unit] = len(self.special.findall(unit))
                parts += [(unit, x) for x in self.special.split(unit) if x]
            else:
                parts.append((unit, unit))
        joined = "\n".join(x for _, x in parts)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
        found = self.pattern.findall(joined.lower())
        if len(self.pre_tokens) > CACHE_UNITS:
            self.pre_tokens.clear()
        known = self.pre_tokens
        known["\n"] = 0
        new = list({x for x in found if x not in known})
        if new:
            known.update(zip(new, surviving_symbols([x.encode("utf-8", "surrogatepass") for x in new], self.table).tolist(), strict=True))
        at, total = 0, 0
        for token in found:
            if token == "\n":
                self.units[parts[at][0]] += total
                at, total = at + 1, 0
            else:
                total += known[token]
        if parts:
            self.units[parts[at][0]] += total


def counter(path: str) -> TokenCounter:
    """One for each worker process and vocabulary."""
    return held(("token counter", path), lambda: TokenCounter(path))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text.

    Returns id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each row of docs. Null and empty
    texts have 0 bytes and 0 tokens; equal rows give equal rows; other columns of docs play no part, whatever their names.
    Narrow: no shuffle. vocabulary: path of a tokenizers file with the pattern PRE_TOKEN, on every executor; another pattern
    is refused. Memory grows with the longest run without a space or line feed, not with the longest text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            n = counter(vocabulary).count(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(holding(count), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
