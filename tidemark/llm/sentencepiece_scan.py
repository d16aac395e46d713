"""SentencePiece encoding and decoding by a max-plus scan over chunk boundaries.

A merge-based piece sequence is the one path through the lattice of pieces whose neighbours are all compatible: two pieces are
compatible if encoding their joint text alone gives just these two. With weight 0 for compatible and -inf for other neighbours
this is a max-plus path problem, and any stretch of text between two piece boundaries is encoded as if it stood alone.

Every text is cut into chunks of equal length, wherever that falls; a short one is one chunk. For a chunk, the boundary state is
how far the piece that crosses its edge reaches over it. Its transfer matrix holds, for each state at its beginning and each at
its end, the weight of the path between and the path's first and last piece; matrices of neighbours combine in max-plus, adding
the compatibility of the pieces that meet, pair by pair up a tree. Down the tree the states of all chunks are read off the
products, and then every chunk is traced back by itself along its path, stretch by stretch: a space mark that follows another
character always begins a piece, so distinct words are traced once while they are kept. The one chunk of a short text goes from
state 0 to state 0 and needs no matrix.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import UnitTable, byte_slices, column, held, holding, materialize, nonempty, settled

SPACE = "\u2581"
CHUNK = 1 << 16
BYTES_AT_ONCE = 1 << 21
#: Chunks of a giant text that go on as one batch.
CHUNKS_AT_ONCE = 32
NEVER = -np.inf
#: Words of more characters are traced one by one.
LONG = 64


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", raw, at)[0]
            at += 4
        else:
            yield tag >> 3, raw[at : at + 8]
            at += 8


class Pieces:
    """The pieces of a model file: normal ones by text, byte ones by value."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.text: list[str] = []
        self.bytes: list[bytes] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.unknown = 0
        for number, value in _fields(raw):
            if number != 1:
                continue
            piece = {1: b"", 2: 0.0, 3: 1, **dict(_fields(value))}
            i, text, kind = len(self.text), piece[1].decode("utf-8"), piece[3]
            self.text.append(text)
            if kind == 6:
                self.byte_id[int(text[3:5], 16)] = i
                self.bytes.append(bytes([int(text[3:5], 16)]))
            elif kind == 3:
                self.bytes.append(b"")
            elif kind == 2:
                self.unknown = i
                self.bytes.append(" \u2047 ".encode())
            else:
                self.id[text], self.score[text] = i, piece[2]
                self.bytes.append(text.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.id))
        #: Every beginning of a piece, and whether it is one.
        self.begins = {t[:n]: False for t in self.id for n in range(1, len(t))} | dict.fromkeys(self.id, True)
        self.merged = lru_cache(1 << 16)(self._merged)
        self.compatible = lru_cache(1 << 18)(self._compatible)

    def _merged(self, text: str) -> tuple[str, ...]:
        """The pieces of two joined pieces' text: of the neighbours whose joint text is a piece, the best scored (leftmost of equals) merge first."""
        parts, find = list(text), self.score.get
        scores = [find(a + b, NEVER) for a, b in pairwise(parts)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = find(parts[i - 1] + parts[i], NEVER)
            if i < len(scores):
                scores[i] = find(parts[i] + parts[i + 1], NEVER)
        return tuple(parts)

    def _compatible(self, left: str, right: str) -> bool:
        """Whether right may follow left; left is empty at the beginning of a stretch."""
        return self.merged(left + right) == ((left, right) if left else (right,))

    def paths(self, text: str, begin: int = 0) -> list[str | None]:
        """For each end, the last piece of the one path from begin to there; the weight of any other path is -inf."""
        begins, ok, n = self.begins, self.compatible, len(text)
        last: list[str | None] = [None] * (n + 1)
        last[begin] = ""
        for start in range(begin, n):
            before = last[start]
            if before is None:
                continue
            for end in range(start + 1, n + 1):
                piece = text[start:end]
                whole = begins.get(piece)
                if whole is None and end - start > 1:
                    break  # no piece begins like this
                if last[end] is None and (whole or end - start == 1) and ok(before, piece):
                    last[end] = piece
                if whole is None:
                    break
        return last

    def trace(self, text: str) -> list[str]:
        """The pieces of a stretch that stands alone, back along its path."""
        last, out, at = self.paths(text), [], len(text)
        while at:
            out.append(last[at])
            at -= len(out[-1])
        return out[::-1]

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids; characters that are no piece as their bytes."""
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte_id[b] for b in p.encode("utf-8", "replace")]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, bytes joined to characters, without the space that encoding puts in front."""
        text = b"".join(self.bytes[i] for i in ids.tolist()).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def prepared(text: str | None) -> str:
    """What the model encodes: a space in front of a text that is not empty, and spaces as its own mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Lattice:
    """The paths of many words at once, as arrays: what Pieces.paths and Pieces.trace do one by one.

    Boundaries of all words stand in one array, a word's behind each other. First all pieces that match at any place are found, by
    one step of a trie for all places at a time. Then paths grow from each word's beginning, all words by one character a round:
    a boundary that has a path passes it on over every compatible piece that begins there. Last, all paths are walked back.
    """

    #: Pieces are their ids; characters that are no piece follow them. A boundary without path, and what is before a word.
    NONE, BEGIN = -2, -1
    PAIR_BITS = 20

    def __init__(self, model: Pieces):
        self.model = model
        letters = sorted({c for t in model.id for c in t})
        self.code = np.zeros(0x110000, dtype=np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes = {"": 0} | {t: i + 1 for i, t in enumerate(model.begins)}
        key = np.array([nodes[t[:-1]] * self.width + int(self.code[ord(t[-1])]) for t in model.begins], dtype=np.int64)
        order = np.argsort(key)
        self.edge, self.child = key[order], np.array([nodes[t] for t in model.begins], dtype=np.int64)[order]
        self.piece_of = np.array([-1, *(model.id.get(t, -1) for t in model.begins)], dtype=np.int64)
        self.first_raw = len(model.text)
        self.length = np.array([len(t) for t in model.text], dtype=np.int64)
        self.raw: dict[str, int] = {}
        self.raw_ids: list[list[int]] = []
        self.pair = np.full(1 << self.PAIR_BITS, -1, dtype=np.int64)
        self.fits = np.zeros(1 << self.PAIR_BITS, dtype=bool)

    def _text(self, piece: int) -> str:
        if piece == self.BEGIN:
            return ""
        return self.model.text[piece] if piece < self.first_raw else self.raw_text[piece - self.first_raw]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether right may follow left, for arrays; answers are kept in a table in which a new pair takes an old one's place."""
        key = (left + 1) << np.int64(32) | right
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.PAIR_BITS)).astype(np.int64)
        out = self.fits[at]
        miss = np.flatnonzero(self.pair[at] != key)
        if len(miss):
            _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            one = miss[one]
            found = np.array([self.model.compatible(self._text(a), self._text(b)) for a, b in zip(left[one].tolist(), right[one].tolist(), strict=True)])
            out[miss] = found[back]
            self.pair[at[one]], self.fits[at[one]] = key[one], found
        return out

    def _matches(self, codes: np.ndarray, left: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces in the words, by place; left: characters up to the end of the word from each place on."""
        place = np.arange(len(codes))
        node = np.zeros(len(codes), dtype=np.int64)
        found = []
        for n in range(1, self.model.longest + 1):
            key = node * self.width + codes[place + n - 1]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[at] == key
            if n == 1:
                lone = np.flatnonzero(~on | (self.piece_of[self.child[at]] < 0))
                for c in {text[i] for i in lone.tolist()} - self.raw.keys():
                    self.raw[c] = len(self.raw)
                    self.raw_ids.append(self.model.ids([c]))
                self.raw_text = list(self.raw)
                found.append((lone, np.ones(len(lone), dtype=np.int64), np.array([self.first_raw + self.raw[text[i]] for i in lone.tolist()], dtype=np.int64)))
            place, node = place[on], self.child[at[on]]
            piece = self.piece_of[node]
            whole = piece >= 0
            found.append((place[whole], np.full(int(whole.sum()), n), piece[whole]))
            more = left[place] > n
            place, node = place[more], node[more]
        place, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], length[order], piece[order]

    def trace(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are not empty, one after the other, and how many each has."""
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        text = "".join(words)
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        word = np.repeat(np.arange(len(words)), size)
        place, length, piece = self._matches(codes, ends[word] - np.arange(len(codes)), text)
        first = np.searchsorted(place, np.arange(len(codes) + 1))
        # A word's boundaries: its places and its end; so boundary = place + number of words before.
        last = np.full(len(codes) + len(words), self.NONE, dtype=np.int64)
        number = np.arange(len(words))
        last[begins + number] = self.BEGIN
        for round_ in range(int(size.max(initial=0))):
            mine = number[size > round_]
            at = begins[mine] + round_
            reached = last[at + mine] != self.NONE
            at, mine = at[reached], mine[reached]
            counts = first[at + 1] - first[at]
            which = np.repeat(first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            to = np.repeat(at + mine, counts) + length[which]
            free = last[to] == self.NONE
            which, to, before = which[free], to[free], np.repeat(last[at + mine], counts)[free]
            good = self._compatible(before, piece[which])
            last[to[good]] = piece[which[good]]
        steps, owners = [], []
        at, mine = ends + number, number
        while len(mine):
            came = last[at]
            if (came < 0).any():
                raise ValueError("a word without a path")
            steps.append(came)
            owners.append(mine)
            at = at - np.where(came < self.first_raw, self.length[np.minimum(came, self.first_raw - 1)], 1)
            going = at > (begins + number)[mine]
            at, mine = at[going], mine[going]
        steps, owners = np.concatenate(steps[::-1]), np.concatenate(owners[::-1])
        steps, owners = (x[np.argsort(owners, kind="stable")] for x in (steps, owners))
        # Characters that are no piece stand as their bytes.
        raw_size = np.array([len(i) for i in self.raw_ids], dtype=np.int64)
        raw_flat = np.array([i for ids in self.raw_ids for i in ids], dtype=np.int64)
        raw = steps >= self.first_raw
        counts = np.ones(len(steps), dtype=np.int64)
        counts[raw] = raw_size[steps[raw] - self.first_raw]
        ids = np.repeat(steps, counts)
        if raw.any():
            within = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            spot = np.flatnonzero(ids >= self.first_raw)
            ids[spot] = raw_flat[(np.cumsum(raw_size) - raw_size)[ids[spot] - self.first_raw] + within[spot]]
        return ids.astype(np.int32), np.bincount(owners, weights=counts, minlength=len(words)).astype(np.int64)


class PieceEncoder:
    """Ids of stretches that begin and end at piece boundaries, each distinct word traced once while it is kept."""

    def __init__(self, model: Pieces):
        self.model = model
        self.lattice = Lattice(model)
        self.units = UnitTable(self._learn)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of up to LONG characters grow together; longer ones would keep the others waiting and are traced one by one."""
        if max(map(len, words)) <= LONG:
            return self.lattice.trace(words)
        short = self.lattice.trace([w for w in words if len(w) <= LONG])
        long = [np.array(self.model.ids(self.model.trace(w)), dtype=np.int32) for w in words if len(w) > LONG]
        is_long = np.array([len(w) > LONG for w in words])
        sizes = np.zeros(len(words), dtype=np.int64)
        sizes[~is_long], sizes[is_long] = short[1], [len(x) for x in long]
        ids = np.zeros(sizes.sum(), dtype=np.int32)
        in_long = np.repeat(is_long, sizes)
        ids[~in_long], ids[in_long] = short[0], np.concatenate(long)
        return ids, sizes

    @staticmethod
    def cut(text: str) -> list[str]:
        """The words of any stretch: no piece crosses a mark that follows another character; a run of marks stays with its word."""
        first, *units = text.split(SPACE)
        words, run = [first] if first else [], ""
        for u in units:
            run += SPACE
            if u:
                words.append(run + u)
                run = ""
        return [*words, run] if run else words

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin, one entry more) of prepared texts."""
        place = self.units.begin()
        odd = pc.match_substring_regex(texts, f"^[^{SPACE}]|{SPACE}{SPACE}|{SPACE}$").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), SPACE)
        counted = split.values.dictionary_encode()
        # What stands before the first mark of a text is empty, and so no word.
        known = np.array([place[SPACE + u] if u else -1 for u in counted.dictionary.to_pylist()], dtype=np.int64)
        index = known[counted.indices.to_numpy()]
        index = index[index >= 0]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = np.maximum(np.diff(split.offsets.to_numpy()) - 1, 0)
        if odd.any():
            own = {i: [place[w] for w in self.cut(texts[i].as_py())] for i in np.flatnonzero(odd).tolist()}
            for i, places in own.items():
                counts[i] = len(places)
            plain, index = index, np.zeros(counts.sum(), dtype=np.int64)
            index[np.repeat(~odd, counts)] = plain
            index[np.repeat(odd, counts)] = np.concatenate([np.array(p, dtype=np.int64) for p in own.values()])
        return self.units.ids(index, counts)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of whole texts as they come: a space in front of those that are not empty, and spaces as marks."""
        marked = pc.replace_substring(texts, " ", SPACE)
        mark, nothing = (pa.scalar(x, pa.large_string()) for x in (SPACE, ""))
        return self.encode(pc.if_else(pc.equal(marked, nothing), nothing, pc.binary_join_element_wise(mark, marked, nothing)))

    def encode_one(self, text: str) -> np.ndarray:
        """Ids of one prepared stretch."""
        return self.encode(pa.array([text], pa.large_string()))[0]


def _cache(path: str) -> PieceEncoder:
    """One for each worker process and model; it holds the model too."""
    return held(("piece encoder", path), lambda: PieceEncoder(Pieces(path)))


def pieces(path: str) -> Pieces:
    return _cache(path).model


# --- chunks of giant texts -----------------------------------------------------------------------


def transfer(model: Pieces, text: str, size: int, final: bool) -> list[tuple[int, int, str, str]]:
    """The finite entries of a chunk's transfer matrix: (state at its beginning, state at its end, first piece, last piece).

    text: the chunk's size characters and as many more as a piece can reach over its end. A state is the number of characters
    that the crossing piece reaches over the edge; at the end of the whole text (final) it is 0.
    """
    entries = []
    # Where a mark follows another character every path has a boundary; paths that begin before it agree after it.
    meeting = next((i for i in range(1, size) if text[i] == SPACE and text[i - 1] != SPACE), None)
    after = None
    if meeting is not None and meeting >= model.longest:
        after = _exits(model, text, meeting, size, final)
    for begin in range(min(model.longest, size + 1)):
        if begin == size:
            entries.append((begin, 0, "", ""))
        elif after is not None:
            first = model.trace(text[begin:meeting])[0]
            entries += [(begin, end, first, last) for end, _, last in after]
        else:
            entries += [(begin, end, first, last) for end, first, last in _exits(model, text, begin, size, final)]
    return entries


def _exits(model: Pieces, text: str, begin: int, size: int, final: bool) -> list[tuple[int, str, str]]:
    """(state at the end, first piece, last piece) of the paths from begin whose last piece begins inside the chunk."""
    resume = begin
    if len(text) - begin > 4 * model.longest:  # only the part behind the last meeting place matters for the last pieces
        resume = next((i for i in range(size - 1, begin, -1) if text[i] == SPACE and text[i - 1] != SPACE), begin)
    last = model.paths(text, resume)
    found = []
    for end in range(size, size + 1 if final else min(len(text), size + model.longest - 1) + 1):
        piece = last[end]
        if piece and end - len(piece) < size:
            if resume == begin:
                at, first = end, piece
                while at > begin:
                    first = last[at]
                    at -= len(first)
            else:
                stop = next((i for i in range(begin + 1, resume + 1) if text[i] == SPACE and text[i - 1] != SPACE), resume)
                first = model.trace(text[begin:stop])[0]
            found.append((end - size, first, piece))
    return found


def product(model: Pieces, left: list[tuple], right: list[tuple]) -> dict[tuple[int, int], tuple[tuple, int]]:
    """The max-plus product of two neighbours' transfer matrices, by (state at the beginning, at the end): the entry and the state in which its path crosses from one to the other.

    Paths meet in a state, and the meeting pieces must be compatible; of the paths between two states only one has a finite weight.
    """
    by_state: dict[int, list[tuple]] = {}
    for entry in right:
        by_state.setdefault(entry[0], []).append(entry)
    found = {}
    for begin, middle, first, last in left:
        for _, end, next_first, next_last in by_state.get(middle, ()):
            if not last or not next_first or model.compatible(last, next_first):
                found[begin, end] = (begin, end, first or next_first, next_last or last), middle
    return found


def combine(model: Pieces, left: list[tuple], right: list[tuple]) -> list[tuple]:
    """The product's entries alone: an associative operation."""
    return [entry for entry, _ in product(model, left, right).values()]


def scan_states(model: Pieces, matrices: list[list[tuple]]) -> list[int]:
    """The state at the beginning of each chunk and at the end of the last, on the path from state 0 to state 0.

    Neighbours' matrices are multiplied pair by pair, level by level; then each product's states give the one between its halves.
    """
    levels: list[list] = [[{(e[0], e[1]): (e, None) for e in m} for m in matrices]]
    while len(levels[-1]) > 1:
        below = [[e for e, _ in m.values()] for m in levels[-1]]
        above = [product(model, below[i], below[i + 1]) for i in range(0, len(below) - 1, 2)]
        levels.append(above + levels[-1][len(below) - len(below) % 2 :])
    spans = [(0, 0)]
    if (0, 0) not in levels[-1][0]:
        raise ValueError("no path through the chunks")
    for below, above in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        wider, spans = spans, []
        for i, span in enumerate(wider):
            if 2 * i + 1 < len(below):
                middle = above[i][span][1]
                spans += [(span[0], middle), (middle, span[1])]
            else:
                spans.append(span)
    return [0, *[end for _, end in spans]]


def _giant_ids(giants: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """(key, ids) of distinct giant texts (key, text), chunks in parallel."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces(model_path).longest
        for batch in nonempty(batches):
            for key, text in zip(column(batch, "key"), column(batch, "text"), strict=True):
                whole = prepared(text)
                for first in range(0, len(whole), CHUNKS_AT_ONCE * chunk):
                    at = range(first, min(len(whole), first + CHUNKS_AT_ONCE * chunk), chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(at)), pa.array([i // chunk for i in at], pa.int32()), pa.array([min(chunk, len(whole) - i) for i in at], pa.int32()), pa.array([i + chunk >= len(whole) for i in at]), pa.array([whole[i : i + chunk + reach] for i in at])],
                        ["key", "no", "size", "final", "part"],
                    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            model = pieces(model_path)
            rows = [transfer(model, part, size, final) for part, size, final in zip(column(batch, "part"), column(batch, "size"), column(batch, "final"), strict=True)]
            cols = [[[e[i] for e in r] for r in rows] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.list_(pa.int32() if i < 2 else pa.string())) for i, c in enumerate(cols)]], ["key", "no", "begins", "ends", "firsts", "lasts"]
            )

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        m = [list(zip(*r, strict=True)) for r in zip(group["begins"], group["ends"], group["firsts"], group["lasts"], strict=True)]
        states = scan_states(pieces(model_path), m)
        return pd.DataFrame({"key": group["key"], "no": group["no"], "begin": states[:-1], "end": states[1:]})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            cache = _cache(model_path)
            ids = [cache.encode_one(part[b : size + e]) if size + e > b else np.zeros(0, np.int32) for part, size, b, e in zip(*[column(batch, c) for c in ("part", "size", "begin", "end")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))], ["key", "no", "ids"])

    parts = materialize(giants.mapInArrow(holding(cut), "key string, no int, size int, final boolean, part string").repartition("key", "no"), "chunks")
    states = parts.mapInArrow(holding(matrices), "key string, no int, begins array<int>, ends array<int>, firsts array<string>, lasts array<string>")
    states = states.groupBy("key").applyInPandas(scan, "key string, no int, begin int, end int")
    encoded = parts.join(states, ["key", "no"]).select("key", "no", "size", "begin", "end", "part").mapInArrow(holding(encode), "key string, no int, ids array<int>")
    whole = encoded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return whole.select("key", F.flatten(F.col("parts.ids")).alias("ids"))


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, restore: bool = False) -> DataFrame:
    """doc_id, text and ids of every whole text, as the model's own library encodes it; a row for each row of docs.

    restore adds restored: whether decoding the ids gives the text (null: the empty text).

    Null and empty texts have no ids. A text of one chunk is traced in a narrow pass. Of the others each distinct one is cut into
    chunk rows, whose matrices and paths are found in parallel; the matrices of one text, a few numbers and pieces for each
    chunk, meet in one group. Other columns of docs play no part. model_path: a model of merges with byte fallback.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            encoder, texts = _cache(model_path), batch.column(1)
            for first, block in byte_slices(texts, BYTES_AT_ONCE):
                ids, bounds = encoder.encode_texts(block)
                columns = [*[batch.column(c).slice(first, len(block)) for c in (0, 1)], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if restore:
                    columns.append(pa.array([encoder.model.decode(ids[a:b]) == t for a, b, t in zip(bounds[:-1], bounds[1:], block.to_pylist(), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text", "ids", *(["restored"] if restore else [])]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))  # a space goes in front
    small = source.where(~giant).mapInArrow(holding(encode), f"doc_id {kind}, text string, ids array<int>" + ", restored boolean" * restore)
    giants = source.where(giant).withColumn("key", F.sha2("text", 256))
    ids = _giant_ids(giants.select("key", "text").dropDuplicates(["key"]), model_path, chunk)
    large = giants.join(ids, "key").select("doc_id", "text", "ids")
    if restore:
        large = with_decoded(large, model_path).select("doc_id", "text", "ids", (F.col("decoded") == F.col("text")).alias("restored"))
    return small.union(large).withColumnRenamed("doc_id", id_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded: the text of each row's ids. Null ids give null, no ids the empty text. Narrow."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            model = pieces(model_path)
            texts = [model.decode(row.values.to_numpy()) if row.is_valid else None for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(holding(decode), f"id {source.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)


def with_decoded(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text and ids with decoded beside them; null ids give null. Narrow."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            model = pieces(model_path)
            texts = [model.decode(row.values.to_numpy()) if row.is_valid else None for row in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "text", "ids", "decoded"])

    source = encoded.select("doc_id", "text", "ids")
    return source.mapInArrow(holding(decode), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>, decoded string")


def pieces_digest(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and restored: whether decoding gives the text.

    A row for each row; a null text counts as empty, null ids give nulls. Narrow.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            model, rows = pieces(model_path), []
            for text, row in zip(column(batch, "text"), batch.column(2), strict=True):
                if row.is_valid:
                    ids = row.values.to_numpy()
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), model.decode(ids) == (text or "")))
                else:
                    rows.append((None, None, None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "restored"])

    source = encoded.select("doc_id", "text", "ids")
    return source.mapInArrow(holding(digest), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, restored boolean")
