"""Exact substring de-duplication by induced sorting over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. As in induced sorting, only sampled suffixes,
chosen by the content alone, are sorted; what is known of them is then induced
to all others, and recursion goes on with what is still undecided:

1. A window's sample is the place in it whose next GRAM bytes have the smallest
   hash, its name. Equal windows have the same sample, so a window whose
   sample's name occurs in one document only is unique.
2. Consecutive windows with one sample form a span. Where the whole span also
   occurs in a document with a smaller id, all its windows go.
3. The first document's copy of each span is left. If its sample has other
   spans too, its windows are compared one by one, by their hashes.

Each round sorts tuples (name, hash, document) externally, dealt by the name
over buckets of bounded size, and sends back a bit or two for each tuple. A
shard is a few megabytes of whole documents, dealt row by row into a bucketed
table, so texts are shuffled once and rows of one id, or of none, spread over
all shards (tuples carry the id); each shard sends a name once, whatever the
number of its copies, so a passage in every document loads no bucket more than
any other. Where this differs from the external suffix array of the method is
said in the README.

Spans are compared by 64 bits among equal samples, single windows by 128 bits
(two hashes over unlike tables). The number of buckets follows the number of
tuples, not that of the shards; a shard sends one row to each bucket it has
tuples for.

Defined cases: null text is empty; text shorter than ``length`` loses nothing;
a row without id loses nothing and takes nothing away; rows with the same id
are equally old, so neither takes from the other; an empty table gives none;
only the id and the text are read, other columns have no part in the result."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import ship, stored

LENGTH, GRAM = 50, 24
BUCKET_BYTES = 16 << 20  # of text whose tuples share a bucket: about a million
SHARD_BYTES = 4 << 20
MOST_BUCKETS = 50_000  # of a bucketed table
SEGMENT = 1 << 17  # windows hashed at a time
_BASE = 0x9E3779B97F4A7C13
_LOW = np.uint64((1 << 18) - 1)
_REACH = SEGMENT + 1024
_TABLE, _SECOND = np.random.default_rng(5).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_UP = np.multiply.accumulate(np.array([1] + [_BASE] * _REACH, np.uint64))
_DOWN = np.multiply.accumulate(np.array([1] + [pow(_BASE, -1, 1 << 64)] * _REACH, np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shard:
    """The documents of one shard as one array of bytes, its runs of windows
    with one sample (start, end, name, span hash, document), and what the
    rounds so far have found."""

    def __init__(self, ids: list, texts: list, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        bodies = [(t or "").encode() for t in texts]
        self.ids, self.bodies = ids, bodies
        self.ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
        self.starts = self.ends - [len(b) for b in bodies]
        self.data = np.frombuffer(b"".join(bodies), np.uint8)
        self.key = np.array([-1 if i is None else i for i in ids], np.int64)
        self.valid = np.zeros(len(self.data) + 1, bool)  # a window may start here
        for s, e, i in zip(self.starts.tolist(), self.ends.tolist(), ids):
            if e - s >= length and i is not None:
                self.valid[s : e - length + 1] = True
        parts = [self._segment(a) for a in range(0, max(0, len(self.data) - length + 1), SEGMENT)]
        self.start, self.end, self.name, self.span = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))
        self.name, self.span = self.name.astype(np.uint64), self.span.astype(np.uint64)
        self.doc = self.key[np.searchsorted(self.ends, self.start, "right")] if len(self.start) else np.zeros(0, np.int64)

    def _sums(self, a: int, table: np.ndarray = _TABLE) -> np.ndarray:
        """Running sums of table[byte] * base^position from place ``a``: any
        string's hash is a difference, shifted back."""
        block = self.data[a : a + SEGMENT + self.length - 1]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(table[block] * _UP[: len(block)], out=sums[1:])
        return sums

    def _segment(self, a: int):
        sums, width = self._sums(a), self.length - self.gram + 1
        at = np.arange(len(sums) - self.gram)
        names = _mix((sums[at + self.gram] - sums[at]) * _DOWN[at])
        low, reach = (names & ~_LOW) | at.astype(np.uint64), 1
        while reach * 2 <= width:
            low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        sample = (low & _LOW).astype(np.int64)
        valid = self.valid[a : a + len(sample)]
        same = np.zeros(len(sample) + 1, bool)  # window i goes on from window i - 1
        same[1:-1] = valid[1:] & valid[:-1] & (sample[1:] == sample[:-1])
        first = np.flatnonzero(valid & ~same[:-1])
        last = np.flatnonzero(valid & ~same[1:])
        span = _mix((sums[last + self.length] - sums[first]) * _DOWN[first])
        return first + a, last + 1 + a, names[sample[first]], span

    def window_hashes(self, at: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
        """Hashes of the windows at the sorted places ``at``."""
        out = np.zeros(len(at), np.uint64)
        cuts = np.searchsorted(at, np.arange(0, len(self.data) + SEGMENT, SEGMENT))
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if x < y:
                sums, p = self._sums(i * SEGMENT, table), at[x:y] - i * SEGMENT
                out[x:y] = _mix((sums[p + self.length] - sums[p]) * _DOWN[p])
        return out


def entries(buckets: int, by: np.ndarray, second: np.ndarray | None, doc: np.ndarray):
    """Distinct (by, second) in the order of the bucket, then the value: order
    of the input, entry of each sorted row, first row of each entry, bucket."""
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, *(() if second is None else (second,)), by, bucket))
    by_, two = by[order], None if second is None else second[order]
    new = np.ones(len(order), bool)
    new[1:] = (by_[1:] != by_[:-1]) | (False if two is None else two[1:] != two[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new), bucket


class Rounds:
    """The three rounds over one shard. Each makes tuples for the buckets and
    reads the bits that came back, in the same order."""

    def __init__(self, shard: Shard, buckets: int, answers: dict[int, dict[int, tuple[bytes, bytes]]]):
        self.s, self.buckets, self.answers = shard, buckets, answers

    def _bits(self, round_: int, n_of: np.ndarray, which: int) -> np.ndarray:
        got = self.answers.get(round_, {})
        some = np.flatnonzero(n_of)
        parts = [np.unpackbits(np.frombuffer(got[b][which], np.uint8), count=n) for b, n in zip(some.tolist(), n_of[some].tolist())]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)

    def _send(self, bucket: np.ndarray, first: np.ndarray, order: np.ndarray, columns: list[np.ndarray], flags: np.ndarray | None = None) -> list[tuple]:
        some, start = np.unique(bucket[order][first], return_index=True)
        end = np.append(start, len(first))[1:]
        blob = lambda c, x, y: c[x:y].tobytes()
        return [(i, *(blob(c, x, y) for c in columns), np.packbits(flags[x:y]).tobytes() if flags is not None else b"")
                for i, x, y in zip(some.tolist(), start.tolist(), end.tolist())]

    def names(self):
        s = self.s
        order, of, first, bucket = entries(self.buckets, s.name, None, s.doc)
        last = np.concatenate([first[1:], [len(order)]]) - 1 if len(first) else first
        doc = s.doc[order]
        short = (s.name[order][first] // np.uint64(self.buckets)).astype(np.uint32)
        return order, of, first, bucket, short, doc[first] != doc[last]

    def send_names(self):
        order, of, first, bucket, short, many = self.names()
        return self._send(bucket, first, order, [short, np.zeros(0), np.zeros(0)], many)

    def spans(self):
        """Runs whose name other documents have, and their entries."""
        s = self.s
        order, of, first, bucket, *_ = self.names()
        flags = self._bits(1, np.bincount(bucket[order][first], minlength=self.buckets), 0)
        shared = np.zeros(len(s.name), bool)
        if len(first):
            shared[order] = flags[of]
        runs = np.flatnonzero(shared)
        return runs, *entries(self.buckets, s.name[runs], s.span[runs], s.doc[runs])

    def send_spans(self):
        s = self.s
        runs, order, of, first, bucket = self.spans()
        pick = runs[order][first]
        short = (s.name[pick] // np.uint64(self.buckets)).astype(np.uint32)
        return self._send(bucket, first, order, [short, s.span[pick], s.doc[pick]])

    def decided(self):
        """Runs that go as a whole, and the windows that are still open."""
        s = self.s
        runs, order, of, first, bucket = self.spans()
        n_of = np.bincount(bucket[order][first], minlength=self.buckets)
        later, several = self._bits(2, n_of, 0), self._bits(2, n_of, 1)
        if not len(first):
            return runs, np.zeros(0, np.int64), np.zeros(0, np.int64)
        sorted_runs = runs[order]
        oldest = s.doc[sorted_runs][first]
        goes = later[of] | (s.doc[sorted_runs] > oldest[of])
        left = np.sort(sorted_runs[~goes & several[of]])
        n = s.end[left] - s.start[left]
        places = np.repeat(s.start[left] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(left) else np.zeros(0, np.int64)
        return sorted_runs[goes], places, np.repeat(s.doc[left], n)

    def windows(self):
        whole, places, doc = self.decided()
        hashes, second = self.s.window_hashes(places), self.s.window_hashes(places, _SECOND)
        return whole, places, doc, hashes, second, entries(self.buckets, hashes, second, doc)

    def send_windows(self):
        _, _, doc, hashes, second, (order, of, first, bucket) = self.windows()
        return self._send(bucket, first, order, [second[order][first], hashes[order][first], doc[order][first]])

    def removed(self) -> np.ndarray:
        """Which bytes go."""
        s = self.s
        whole, places, doc, _, _, (order, of, first, bucket) = self.windows()
        go = np.zeros(len(places), bool)
        if len(first):
            later = self._bits(3, np.bincount(bucket[order][first], minlength=self.buckets), 0)
            go[order] = later[of] | (doc[order] > doc[order][first][of])
        edge = np.zeros(len(s.data) + 1, np.int64)
        np.add.at(edge, s.start[whole], 1)
        np.add.at(edge, s.end[whole] - 1 + s.length, -1)
        np.add.at(edge, places[go], 1)
        np.add.at(edge, places[go] + s.length, -1)
        return np.cumsum(edge)[:-1] > 0


SEND = {1: Rounds.send_names, 2: Rounds.send_spans, 3: Rounds.send_windows}


def settle(round_: int, pdf: pd.DataFrame) -> list[tuple[bytes, bytes]]:
    """A bucket's tuples from all shards, sorted together: round 1, whether a
    name is in several documents; 2, whether a smaller document has the span,
    and whether its sample has several spans; 3, whether a smaller document
    has the window."""
    def column(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(pdf[name]), kind)

    if round_ == 1:
        names, n = column("name", np.uint32), [len(x) // 4 for x in pdf["name"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=k) for f, k in zip(pdf["flags"], n)]).astype(bool)
        _, which, count = np.unique(names, return_inverse=True, return_counts=True)
        one, two = (count[which] > 1) | many, np.zeros(len(names), bool)
    else:
        span, doc, n = column("hash", np.uint64), column("doc", np.int64), [len(x) // 8 for x in pdf["hash"]]
        name = column("name", np.uint32 if round_ == 2 else np.uint64)
        order = np.lexsort((doc, span, name))
        name, span, doc = name[order], span[order], doc[order]
        same_name = np.concatenate([[False], name[1:] == name[:-1]])
        same = same_name & np.concatenate([[False], span[1:] == span[:-1]])
        group = np.cumsum(~same) - 1
        one, two = np.zeros(len(order), bool), np.zeros(len(order), bool)
        one[order] = doc > doc[np.flatnonzero(~same)][group]
        by_name = np.cumsum(~same_name) - 1
        two[order] = (np.bincount(by_name, weights=~same) > 1)[by_name]
    cuts = np.cumsum([0, *n])
    return [(np.packbits(one[x:y]).tobytes(), np.packbits(two[x:y]).tobytes()) for x, y in zip(cuts[:-1], cuts[1:])]


def _answers(pdf: pd.DataFrame) -> dict[int, dict[int, tuple[bytes, bytes]]]:
    out: dict[int, dict[int, tuple[bytes, bytes]]] = {}
    for r, b, one, two in zip(pdf["round"], pdf["bucket"], pdf["one"], pdf["two"]):
        out.setdefault(int(r), {})[int(b)] = (one, two)
    return out


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with ``shard``: rows alike in id, or in all, are dealt apart.
    A row's number can change with the plan, so shards are stored, not dealt
    again in each round."""
    row = F.xxhash64("id", "text", F.monotonically_increasing_id())
    return docs.withColumn("shard", F.pmod(row, F.lit(shards)).cast("int"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept): the maximal removed
    runs of bytes as (start, end), and the bytes that stay."""
    ship(__name__)
    spark = docs.sparkSession
    # a null among whole numbers would make a task's ids floats
    own = F.col(id_col).cast("bigint")
    docs = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    buckets, parts = max(1, -(-size // BUCKET_BYTES)), min(shards, MOST_BUCKETS)
    name = f"repeats_{uuid.uuid4().hex}"
    (dealt(docs, shards).repartition(parts, "shard").write.bucketBy(parts, "shard").sortBy("shard")
     .option("compression", "zstd").saveAsTable(name))
    texts = spark.table(name)
    sent = "bucket int, name binary, hash binary, doc binary, flags binary, shard int"
    told = "shard int, round int, bucket int, one binary, two binary"
    answers = spark.createDataFrame([], told)

    def rounds(pdf: pd.DataFrame, known: pd.DataFrame) -> Rounds:
        ids = [None if none else i for i, none in zip(pdf["id"].tolist(), pdf["none"].tolist())]
        return Rounds(Shard(ids, pdf["text"].tolist(), length, gram), buckets, _answers(known))

    def sender(step: int):
        def send(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            rows = SEND[step](rounds(pdf, known)) if len(pdf) else []
            return pd.DataFrame(rows, columns=["bucket", "name", "hash", "doc", "flags"]).assign(shard=key[0])
        return send

    def teller(step: int):
        def tell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            one, two = zip(*settle(step, pdf))
            return pd.DataFrame({"shard": pdf["shard"], "round": step, "bucket": key[0], "one": one, "two": two})
        return tell

    for step in SEND:
        tuples = texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(sender(step), sent)
        answers = answers.unionByName(stored(tuples.groupBy("bucket").applyInPandas(teller(step), told), f"answers-{step}"))

    def finish(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in names})
        work = rounds(pdf, known)
        gone, rows = work.removed(), []
        for key, body, a, b in zip(work.s.ids, work.s.bodies, work.s.starts.tolist(), work.s.ends.tolist()):
            mine = gone[a:b]
            steps = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            runs = steps.reshape(-1, 2).tolist()
            kept = np.frombuffer(body, np.uint8)[~mine].tobytes()
            rows.append((key or 0, key is None, b - a, int(mine.sum()), len(runs), runs, kept))
        return pd.DataFrame(rows, columns=names)

    names = ["id", "none", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    result = texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(
        finish, "id bigint, none boolean, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<array<bigint>>, kept binary")
    result = stored(result, "without-repeats")
    spark.sql(f"DROP TABLE {name}")
    return result.select(F.when(~F.col("none"), F.col("id")).alias(id_col), *names[2:])

