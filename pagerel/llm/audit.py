"""How filters overlap, with exact duplicates found by radix text tries.

Each filter is a bit of a document's failure mask. Four look at the text alone;
the fifth fails a document whose text a smaller id has, anywhere in the table.
That one is found by compressed tries over whole texts (bytes), whose terminals
hold the smallest id:

1. Each task inserts its own texts. A document that meets a smaller id at its
   terminal is decided there and leaves without its text; one entry for each
   distinct text and task goes on, whatever the number of its copies.
2. Entries are dealt by ranges of text prefixes. Prefixes adapt: where the
   entries under one weigh more than ``cell_bytes``, the prefix grows to twice
   its length; an entry whose whole text is that heavy is dealt over several
   tries, whose survivors meet in one more.
3. Each cell of a range gets a trie, and traversing it decides the rest.

What is left are small rows (id, part, mask, n). Labels join them by id, and
masks reduce to 32 counts a part, from which all orders of the filters follow.

Memory is a trie of at most TRIE_BYTES, or a few cells, and one text more. The prefixes that
are broadcast are at most ``most_cells`` a round: ``cell_bytes`` grows with the
table where more would weigh too much.

Defined cases: null text is empty; null part is the empty string; a row without
id has no smaller one and makes none fail; rows with the same id are equally
old, so neither fails because of the other; labels may repeat, and any that is
1 counts; an empty table has no parts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import ship, stored

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
TRIE_BYTES = 16 << 20  # of a task's own texts
CELL_BYTES = 4 << 20
MOST_CELLS = 200_000
FIRST, GROWTH = 8, 4  # bytes of the first prefix, and how it grows
FLUSH = 8 << 20  # bytes of small cells that share a trie
ROWS = "id long, part string, mask int, n long, text binary"

_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))  # bytes of a code point after its first
_SYMBOLS = b"#$%&*|"


def failing(text: bytes) -> int:
    """The failure bits A to D of a text."""
    words = text.split()  # at ASCII white space
    n_upper = len(text) - len(text.translate(None, _UPPER))
    n_chars = len(text.translate(None, _FOLLOWING))
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
            | (100 * n_upper > 10 * n_chars) << 2 | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3)


class Node:
    """An edge's label, text[start:end], and what its end holds. The way from
    the root to its end is text[:end]."""

    __slots__ = ("text", "start", "end", "kids", "held")

    def __init__(self, text: bytes, start: int, end: int):
        self.text, self.start, self.end, self.kids, self.held = text, start, end, {}, None


class Trie:
    """Compressed trie of whole texts. A terminal holds (smallest id, mask,
    rows of that id by part)."""

    def __init__(self):
        self.root, self.size = Node(b"", 0, 0), 0

    def _common(self, node: Node, text: bytes, at: int) -> int:
        """How much of the node's label ``text`` has from ``at`` on."""
        label, most = node.text, min(node.end - node.start, len(text) - at)
        if label[node.start : node.start + most] == text[at : at + most]:
            return most
        low, high = 0, most  # the first ``low`` bytes agree, the first ``high`` do not
        while high - low > 1:
            mid = (low + high) // 2
            if label[node.start + low : node.start + mid] == text[at + low : at + mid]:
                low = mid
            else:
                high = mid
        return low

    def find(self, text: bytes) -> Node:
        """The node where ``text`` ends, put in if it is not there."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text, at, len(text))
                self.size += len(text)
                return kid
            n = self._common(kid, text, at)
            if n < kid.end - kid.start:  # the label is cut in two
                upper = Node(kid.text, kid.start, kid.start + n)
                kid.start += n
                upper.kids[kid.text[kid.start]] = kid
                node.kids[text[at]] = kid = upper
            node, at = kid, at + n
        return node

    def insert(self, key: int, part: str, n: int, text: bytes, mask: int | None, decided: list) -> None:
        """Put in ``n`` rows; rows that a smaller id is known for are decided."""
        node = self.find(text)
        if node.held is None:
            node.held = [key, failing(text) if mask is None else mask, Counter()]
        held = node.held
        if key < held[0]:
            decided += ((held[0], p, held[1] | DUPLICATE, k, None) for p, k in held[2].items())
            held[0], held[2] = key, Counter()
        if key == held[0]:
            held[2][part] += n
        else:
            decided.append((key, part, held[1] | DUPLICATE, n, None))

    def traverse(self, with_text: bool) -> Iterator[tuple]:
        """The rows of each terminal's smallest id."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.held:
                text = node.text[: node.end] if with_text else None
                yield from ((node.held[0], p, node.held[1], n, text) for p, n in node.held[2].items())
            todo += node.kids.values()


KIND = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())])


def written(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, KIND)], schema=KIND)


def batched(rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes."""
    some, weight = [], 0
    for row in rows:
        some.append(row)
        weight += 64 + len(row[4] or b"")
        if weight >= size:
            yield written(some)
            some, weight = [], 0
    yield written(some)


def gathered(docs: DataFrame, trie_bytes: int) -> DataFrame:
    """``docs`` (id, part, text) as rows that are decided, without text, and
    entries, the distinct texts of each task."""
    ship(__name__)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            decided: list = []
            for key, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None:
                    decided.append((None, part, failing(text), 1, None))
                else:
                    trie.insert(key, part, 1, text, None, decided)
                if trie.size > trie_bytes:
                    yield from batched(trie.traverse(True))
                    trie = Trie()
            yield written(decided)
        yield from batched(trie.traverse(True))

    return docs.mapInArrow(gather, ROWS)


def celled(entries: DataFrame, cell_bytes: int) -> tuple[DataFrame, bool]:
    """``entries`` with ``cell``, the shortest prefix that weighs ``cell_bytes``
    at most, and ``salts``, over how many tries a heavier whole text is dealt;
    whether there is such a text."""
    size, salted, length = F.octet_length("text"), False, FIRST
    head = lambda n: F.substring("text", 1, n)
    at = entries.withColumns({"cell": head(length), "salts": F.lit(1), "open": F.lit(True)})
    while True:
        at = at.withColumn("whole", size <= length)
        heavy = (at.filter("open").groupBy("cell", "whole").agg(F.sum(size + 64).alias("bytes")).filter(F.col("bytes") > cell_bytes)
                 .select("cell", "whole", F.ceil(F.col("bytes") / cell_bytes).cast("int").alias("times")))
        heavy = stored(heavy, "heavy-prefixes")  # all bytes / cell_bytes at most: MOST_CELLS
        kinds = {r.whole for r in heavy.select("whole").distinct().collect()}
        salted |= True in kinds
        if not kinds:
            return at.drop("open", "whole"), salted
        more = F.col("open") & F.col("times").isNotNull()
        grows = more & ~F.col("whole")
        at = at.join(F.broadcast(heavy), ["cell", "whole"], "left").select(
            *entries.columns, F.when(grows, head(GROWTH * length)).otherwise(F.col("cell")).alias("cell"),
            F.when(more & F.col("whole"), F.col("times")).otherwise(F.col("salts")).alias("salts"), grows.alias("open"))
        length *= GROWTH
        if False not in kinds:
            return at.drop("open"), salted


def settled(entries: DataFrame, ranges: int) -> DataFrame:
    """Rows of ``entries`` (with cell and salts) that are decided; of a text
    with several salts the entries that no trie has decided, with their text."""
    ship(__name__)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*row[:-1], (row[-2], row[-1])) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        trie, decided = Trie(), []
        for (_, salt), cell in groupby(rows, key=lambda row: row[-1]):
            if salt is not None or trie.size > FLUSH:
                yield from batched((*row[:4], None) for row in trie.traverse(False))
                trie = Trie()
            for key, part, mask, n, text, *_ in cell:
                trie.insert(key, part, n, text, mask, decided)
                if len(decided) > 20_000:
                    yield written(decided)
                    decided = []
            if salt is not None:
                yield from batched(trie.traverse(True))
                trie = Trie()
        yield written(decided)
        yield from batched((*row[:4], None) for row in trie.traverse(False))

    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "part"), F.col("salts")))
    dealt = entries.withColumn("salt", salt).select("id", "part", "mask", "n", "text", "cell", "salt")
    return dealt.repartitionByRange(ranges, "cell", "salt").sortWithinPartitions("cell", "salt").mapInArrow(settle, ROWS)


def flagged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang", cell_bytes: int = CELL_BYTES,
            trie_bytes: int = TRIE_BYTES, most_cells: int = MOST_CELLS) -> DataFrame:
    """(id, part, mask, n): the failure mask of every document; ``n`` rows
    alike in all three."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = stored(gathered(docs, trie_bytes), "audit-entries")
    entries, done = rows.filter(F.col("text").isNotNull()), rows.filter(F.col("text").isNull())
    total = entries.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    cell_bytes = max(cell_bytes, -(-total // most_cells))
    ranges = max(1, -(-total // max(FLUSH, cell_bytes)))
    placed, salted = celled(entries, cell_bytes)
    late = settled(placed, ranges)
    if salted:
        late = stored(late, "audit-survivors")
        # one entry for each trie of a salted text, 2 * total / cell_bytes at most
        left = late.filter(F.col("text").isNotNull()).withColumns({"cell": F.substring("text", 1, 64), "salts": F.lit(1)})
        late = late.filter(F.col("text").isNull()).unionByName(settled(left, ranges))
    return done.unionByName(late).drop("text").groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def with_labels(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``flags`` with ``good`` (quality 1) and ``toxic`` (toxic 1)."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"_{c}")
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality"), is_one("toxic"))
    none = F.lit(False)
    return flags.join(marks, "id", "left").withColumns({"good": F.coalesce("_quality", none), "toxic": F.coalesce("_toxic", none)}).drop("_quality", "_toxic")


def interactions(flags: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts
    by mask of ``flags`` (part, mask, n, good, toxic)."""
    per = flags.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                                            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    # one entry for each of the 32 masks at most
    parts = per.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("seen"))
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda m, c: m + _bit(c))
    rows = rows.withColumns({"own": _bit(F.substring("filter_order", F.col("step"), F.lit(1))),
                             "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})

    def total(of: str, where) -> Column:
        return F.aggregate("seen", F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(where(s["mask"]), s[of]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    hit = lambda m, bit: m.bitwiseAND(bit) != 0
    here = lambda m: hit(m, own) & ~hit(m, before)
    n_orders = 120
    share = F.aggregate("seen", F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(
        hit(s["mask"], own), (s["n"] * n_orders / F.bit_count(s["mask"])).cast("bigint")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~hit(m, own) & ~hit(m, before)).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: hit(m, own) & hit(m, before)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"))


def _bit(letter: Column) -> Column:
    return F.pow(F.lit(2), F.ascii(letter) - ord(FILTERS[0])).cast("int")
