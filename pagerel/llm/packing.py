"""Packing documents into sequences of bounded length by swap-based local search.

Documents become pieces of at most ``capacity`` tokens: only a longer document
is cut, and its first piece takes what does not fill a sequence. A full piece
is a sequence by itself. The others are dealt by a hash over groups of bounded
size, and each group is packed in one task: pieces start in bins by best fit
(longest first), then a local search moves a piece into another bin's room,
exchanges one piece for one, one for two, or two for one, whenever this raises
the sum of squared fills, until no two bins allow such a step or the tokens need
all bins that are left. Nearly full bins fill up, the emptiest lose their
pieces, and those that end up empty go.

Defined cases: null or empty text is the end mark alone; rows that are alike,
or have no id, are packed each by itself; an empty table has no pieces; only
the id and the text are read, other columns have no part in the result."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import ship, stored

CAPACITY = 1024
GROUP = 100_000  # pieces packed together, about
END = 2


def encoder(vocabulary: str, marks_as_text: bool = False):
    """text -> token ids as little-endian 32-bit numbers, those of the
    tokenizer's JSON file: the strings of its added tokens get their ids, or
    with ``marks_as_text`` (``encode_special_tokens`` there) those of ordinary
    text. The rank file of the same vocabulary gives the same ids at several
    times the speed."""
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    with open(public.path(f"{vocabulary}.json")) as file:
        added = {} if marks_as_text else {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    encode = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=added).encode
    return lambda text: np.array(encode(text, allowed_special="all", disallowed_special=()), "<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces."""
    ship(__name__)
    schema = docs.select(F.col(id_col)).withColumns({c: F.lit(0).cast(t) for c, t in (("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"))}).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = encoder(vocabulary), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, of = [], []
            for i, text_ in enumerate(batch.column(1).to_pylist()):
                ids = tokens(text_ or "") + last
                cuts = cut(len(ids) // 4, capacity)
                of += [i] * len(cuts)
                rows += [(k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts)]
            columns = zip(*rows) if rows else [()] * 4
            arrays = [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(id_col, text).mapInArrow(encode, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: longest piece first, each into the fullest bin it fits."""
    open_at: dict[int, list[int]] = defaultdict(list)  # bins by room
    rooms, bins = 0, []  # rooms: bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            open_at[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class Holders:
    """Bins by the numbers they hold (lengths, or sums of two) and by fill."""

    def __init__(self):
        self.bins: dict[tuple[int, int], dict[int, None]] = defaultdict(dict)  # (number, fill) -> bins
        self.fills: dict[int, int] = defaultdict(int)  # number -> bit f is set if a bin with fill f holds it
        self.numbers = 0  # bit n is set if a bin holds number n

    def enter(self, number: int, fill: int, b: int) -> None:
        self.bins[number, fill][b] = None
        self.fills[number] |= 1 << fill
        self.numbers |= 1 << number

    def leave(self, number: int, fill: int, b: int) -> None:
        held = self.bins[number, fill]
        del held[b]
        if not held:
            del self.bins[number, fill]
            self.fills[number] ^= 1 << fill
            if not self.fills[number]:
                self.numbers ^= 1 << number

    def find(self, number: int, below: int, but: int) -> int | None:
        """The emptiest bin other than ``but`` with less fill than ``below``
        that holds ``number``."""
        fits = self.fills.get(number, 0) & ((1 << below) - 1)
        while fits:
            fill = (fits & -fits).bit_length() - 1
            b = next((b for b in self.bins[number, fill] if b != but), None)
            if b is not None:
                return b
            fits &= fits - 1
        return None


class Search:
    """Bins under local search. Only bins with room take part; ``one`` finds
    those that hold a piece of a given length, ``two`` those that hold two
    pieces of a given sum."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.n, self.capacity = bins, lengths.tolist(), capacity
        self.fill = [sum(self.n[i] for i in b) for b in bins]
        self.one, self.two = Holders(), Holders()
        for b, fill in enumerate(self.fill):
            if fill < capacity:
                self._enter(b)

    def _pairs(self, b: int) -> dict[int, list[int]]:
        """Two pieces of the bin for each sum."""
        two = defaultdict(list)  # two pieces of a length are enough
        for i in self.bins[b]:
            if len(two[self.n[i]]) < 2:
                two[self.n[i]].append(i)
        some = [i for held in two.values() for i in held]
        return {self.n[x] + self.n[y]: [x, y] for k, x in enumerate(some) for y in some[k + 1 :]}

    def _enter(self, b: int) -> None:
        for holders, numbers in ((self.one, {self.n[i] for i in self.bins[b]}), (self.two, self._pairs(b))):
            for number in numbers:
                holders.enter(number, self.fill[b], b)

    def _leave(self, b: int) -> None:
        for holders, numbers in ((self.one, {self.n[i] for i in self.bins[b]}), (self.two, self._pairs(b))):
            for number in numbers:
                holders.leave(number, self.fill[b], b)

    def _swap(self, a: int, out: list[int], b: int, back: list[int]) -> None:
        """Pieces ``out`` of bin ``a`` go to ``b``, ``back`` of ``b`` go to ``a``."""
        self._leave(a), self._leave(b)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + out
        gain = sum(self.n[i] for i in back) - sum(self.n[i] for i in out)
        self.fill[a] += gain
        self.fill[b] -= gain
        for x in (a, b):
            if 0 < self.fill[x] < self.capacity:
                self._enter(x)

    def _piece(self, b: int, length: int) -> list[int]:
        return [next(i for i in self.bins[b] if self.n[i] == length)]

    def _step(self, a: int, give: dict[int, list[int]], take: Holders) -> tuple[list[int], int, int] | None:
        """What to give of ``a``, by its sum, the bin to take from, and the
        number to take from there, for the largest gain. Squared fill rises if
        the other bin's fill is less than what ``a`` comes to."""
        room, fill = self.capacity - self.fill[a], self.fill[a]
        gains = 0  # bit g - 1 is set if something given and something held are g apart
        for given in give:
            gains |= take.numbers >> (given + 1)
        gains &= (1 << room) - 1
        while gains:
            gain = gains.bit_length()
            for given, out in give.items():
                if (b := take.find(given + gain, fill + gain, a)) is not None:
                    return out, b, given + gain
            gains ^= 1 << (gain - 1)
        return None

    def improve(self, a: int) -> bool:
        """One step that fills bin ``a`` more, the largest gain found first:
        move or one for one, then one for two, then two for one."""
        own = {self.n[i]: [i] for i in self.bins[a]}
        if step := self._step(a, {0: [], **own}, self.one):
            out, b, length = step
            self._swap(a, out, b, self._piece(b, length))
        elif step := self._step(a, own, self.two):
            out, b, both = step
            self._swap(a, out, b, self._pairs(b)[both])
        elif step := self._step(a, self._pairs(a), self.one):
            out, b, length = step
            self._swap(a, out, b, self._piece(b, length))
        return step is not None

    def run(self) -> list[list[int]]:
        """Bins from the fullest to the emptiest improve until none can; each
        step raises the sum of squared fills, so this ends."""
        again = True
        while again:
            again = False
            under = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: -self.fill[b])
            if sum(self.fill[b] for b in under) > (len(under) - 1) * self.capacity:
                break  # as few bins as the tokens need
            for b in under:
                while 0 < self.fill[b] < self.capacity and self.improve(b):
                    again = True
        return [b for b in self.bins if b]


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece."""
    bins = Search(best_fit(lengths, capacity), lengths, capacity).run()
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, held in enumerate(bins):
        bin_of[held] = b
        offset[held] = np.concatenate([[0], np.cumsum(lengths[held])[:-1]])
    return bin_of, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY,
         end: int = END, group: int = GROUP) -> DataFrame:
    """The pieces of all ``docs`` with ``sequence_id`` and ``offset``.
    Full pieces have negative sequence ids; those of a group lie together."""
    ship(__name__)
    cuts = stored(pieces(docs, id_col, text, vocabulary, capacity, end), "pieces").withColumn("_row", F.monotonically_increasing_id())
    full = cuts.filter(F.col("length") == capacity).select(*cuts.columns[:-1], (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cuts.filter(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))
    schema = full.schema

    def fill(some: pa.Table) -> pa.Table:
        some = some.sort_by([("length", "ascending"), ("_row", "ascending")])  # the same order on a second try
        bin_of, offset = pack_group(some["length"].to_numpy(), capacity)
        some = some.append_column("sequence_id", pa.array(some["_group"].to_numpy().astype(np.int64) * (1 << 32) + bin_of))
        return some.append_column("offset", pa.array(offset)).select(schema.names)

    # by row, not by document: copies and repeated rows spread over all groups
    packed = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).groupBy("_group").applyInArrow(fill, schema)
    return full.unionByName(packed)
