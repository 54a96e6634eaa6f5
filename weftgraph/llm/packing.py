"""Best-fit packing of token pieces into fixed sequences, by large-item matching on length counts.

Lengths are integers up to the capacity, so what decides a packing is how many pieces have each
length: at most `capacity` numbers, whatever the corpus. The driver packs those counts; pieces
find their sequence by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import textcore
from weftgraph.llm.storage import written

CAPACITY, END_ID = 4096, 1
#: Words whose ids a Python worker keeps; beyond that it starts anew.
CACHE_WORDS = 1_000_000


#: Stands between words that are encoded together; words that hold a control string are encoded alone.
_BETWEEN, _CONTROL = "<|endoftext|>", b"<|"
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(range(97, 123))] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True


def split_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z in lower case, a space where an ASCII letter meets an ASCII mark, and a space after each text.

    The tokenizer lower-cases, drops white space and always parts letters from marks other than the
    apostrophe, so ids stay the same and fewer words differ.
    """
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    gap = np.zeros(len(low) + 1, np.int64)
    letter, mark = _LETTER[low], _MARK[low]
    gap[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    np.add.at(gap, offsets[1:], 1)
    moved = np.cumsum(gap[:-1])
    out = np.full(len(low) + int(gap.sum()), 32, np.uint8)
    out[np.arange(len(low)) + moved] = low
    shift = np.concatenate([[0], np.cumsum(gap)])
    return out, offsets + shift[np.minimum(offsets, len(gap) - 1) + (offsets > 0)]


class WordIds:
    """Ids of texts, by words between ASCII white space, which the tokenizer never merges across."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(_BETWEEN)
        self.start()

    def start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        alone = [w for w in words if _CONTROL in w]
        together = [w for w in words if _CONTROL not in w] if alone else words
        for k in range(0, len(together), 4096):
            part = together[k : k + 4096]
            ids = self.encode(_BETWEEN.join([w.decode("utf-8") for w in part]) + _BETWEEN)
            ends = np.flatnonzero(ids == self.between)
            self.add(part, ids[ids != self.between], np.diff(ends, prepend=-1) - 1)
        for w in alone:
            ids = self.encode(w.decode("utf-8"))
            self.add([w], ids, np.array([len(ids)]))

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        k = len(self.known)
        while k + len(words) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k : k + len(words)] = sizes
        self.at[k : k + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(k, k + len(words))))
        self.used += len(ids)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a step's texts, and how many each text has."""
        if _CONTROL in data.tobytes():
            gaps = np.arange(len(offsets) - 1)
            data, offsets = np.insert(data, offsets[1:], np.uint8(32)), offsets + np.append(0, gaps + 1)
        else:
            data, offsets = split_marks(data, offsets)
        words = data.tobytes().split()
        at = textcore.words(data, offsets)[2]
        if not words:
            return np.zeros(0, np.uint32), np.diff(at)
        get = self.known.get
        which = list(map(get, words))
        if None in which:
            if len(self.known) > CACHE_WORDS:
                self.start()
                which = [None] * len(words)
            lacking = [i for i, k in enumerate(which) if k is None]
            self.learn(list(dict.fromkeys([words[i] for i in lacking])))
            get = self.known.__getitem__
            for i in lacking:
                which[i] = get(words[i])
        which = np.array(which, np.int64)
        size = self.size[which]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.at[which] - ends + size, size)]
        return ids, np.diff(np.append(0, ends)[at])


#: A Python worker's tokenizers, kept from task to task.
_held: dict[str, WordIds] = {}


def pieces(path: str, capacity: int = CAPACITY, end_id: int = END_ID):
    """A mapInArrow function: texts to their token pieces."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _held:
            _held[path] = WordIds(path)
        ids_of = _held[path]
        end = np.array([end_id], np.uint32)
        for batch in batches:
            docs = batch.column("doc_id")
            row, piece, start, length, crc = [], [], [], [], []
            for first, after, data, offsets in textcore.steps(batch.column("text")):
                every, counts = ids_of(data, offsets)
                begins = np.append(0, np.cumsum(counts)).tolist()
                for k in range(after - first):
                    ids = np.concatenate([every[begins[k] : begins[k + 1]], end]).astype("<u4", copy=False)
                    for p, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        row.append(first + k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return of


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements of pieces, given how many there are of each length.

    Large pieces, above a third of the capacity, are at most two to a sequence: from the longest
    down, each takes the longest large partner that fits. Then smaller ones, longest first, go to
    the least gap that holds them, each sequence taking as many as fit before the next. Returns
    (length, first rank, pieces, first sequence, pieces to a sequence, offset of the first there).
    """
    left = {k: n for k, n in counts.items() if n}
    out: list[tuple[int, int, int, int, int, int]] = []
    ranks = dict.fromkeys(left, 0)
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, sequences)
    open_gaps: list[int] = []

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        out.append((length, ranks[length], n, sequence, each, offset))
        ranks[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, capacity - length + 1) - 1
            while at >= 0 and (not left[large[at]] or large[at] == length and left[length] < 2):
                at -= 1
            if at < 0:
                n = left[length]
                place(length, n, sequences, 1, 0)
                leave(capacity - length, sequences, n)
            else:
                other = large[at]
                n = left[length] // 2 if other == length else min(left[length], left[other])
                place(length, n, sequences, 1, 0)
                place(other, n, sequences, 1, length)
                leave(capacity - length - other, sequences, n)
            sequences += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length
                first, n, gap = sequences, -(-left[length] // each), capacity
                sequences += n
            else:
                gap = open_gaps[at]
                each = gap // length
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(at)
            full = min(n, left[length] // each)
            if full:
                place(length, full * each, first, each, capacity - gap)
                leave(gap - each * length, first, full)
            if full < n and left[length]:
                some = left[length]
                place(length, some, first + full, some, capacity - gap)
                leave(gap - some * length, first + full, 1)
                full += 1
            leave(gap, first + full, n - full)
    return out


def placed(placements: list[tuple[int, int, int, int, int, int]]):
    """A mapInArrow function: (length, rank) to (sequence_id, offset)."""
    table = np.array(sorted(placements), np.int64).reshape(-1, 6)
    key = (table[:, 0] << 48) + table[:, 1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1] if len(length) else table[:0]
            nth = rank - row[:, 1]
            columns = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            sequence = row[:, 3] + nth // np.maximum(row[:, 4], 1)
            offset = row[:, 5] + nth % np.maximum(row[:, 4], 1) * length
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return of


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document and their places in sequences of at most capacity tokens.

    docs: doc_id, text; other columns are ignored. A document is the tokenizer's ids of its text
    (null: empty), then end_id; longer ones are cut into pieces of the capacity, the last one
    shorter. Every row is a document, with repeated or null ids too. Full pieces are sequences of
    their own. The others are ranked by length; a length's pieces are dealt to as many parts as its
    share of all pieces asks, so that a frequent one isn't one task. Returns doc_id, piece, start,
    length, ids_crc32, sequence_id, offset; no rows give no rows.
    """
    spark = docs.sparkSession
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = written(docs.select("doc_id", "text").mapInArrow(pieces(tokenizer, capacity, end_id), schema), "pieces")
    part = cut.where(F.col("length") < capacity)
    # At most as many rows as the capacity.
    counts = {r.length: r.n for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(sum(counts.values()), 1)
    shares = spark.createDataFrame([(k, 1 + tasks * n // every) for k, n in counts.items()], "l long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")
    dealt = part.join(F.broadcast(shares), F.col("length") == F.col("l")).select(*columns, salt.alias("salt"))
    # At most capacity + tasks rows here, and in the broadcast below: a few MB at a million tasks.
    before, upto = [], dict.fromkeys(counts, 0)
    for r in sorted(dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):
        before.append((r.length, r.salt, upto[r.length]))
        upto[r.length] += r.n
    base = spark.createDataFrame(before, "l long, s int, before long")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("nth", nth).join(F.broadcast(base), (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.select(*columns, (F.col("before") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(placed(pack_counts(counts, capacity)), schema + ", sequence_id long, offset long")
    # Sequences above are numbered from 0, those of full pieces from -1 down.
    alone = cut.where(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return out.unionByName(alone)
