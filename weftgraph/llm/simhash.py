"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, each of 2**(r+1) - 1 masks keeps the bits whose code word is not orthogonal to the
mask's vector over GF(2). The code words of at most r differing bits span at most r dimensions of
r + 1, so some vector is orthogonal to all of them: its mask keeps none of the differing bits,
and the pair agrees there. Every pair within the radius thus meets in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import textcore
from weftgraph.llm.components import components
from weftgraph.llm.storage import Written, scratch, written

BITS = 64


def masks(radius: int = 3, bits: int = BITS, turn: int = 0) -> list[int]:
    """The covering masks; turn gives other code words, hence other masks with the same promise."""
    n = 2 ** (radius + 1)
    order = np.random.default_rng(turn).permutation(bits) if turn else np.arange(bits)
    words = np.empty(bits, int)
    words[order] = 1 + np.arange(bits) % (n - 1)
    return [sum(1 << i for i in range(bits) if bin(int(words[i]) & v).count("1") % 2) for v in range(1, n)]


def fingerprints(width: int = 3, seed: int = 42):
    """A mapInArrow function: texts to the majority bits of their word shingles' XXH64; other columns stay."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for first, after, data, offsets in textcore.steps(batch.column("text")):
                data = lower[data]
                starts, ends, at = textcore.words(data, offsets)
                n = len(starts)
                if not n:
                    continue
                # Words one space apart: each byte of a word moves to its place in the joined text.
                lengths = ends - starts
                new = np.zeros(n + 1, np.int64)
                np.cumsum(lengths + 1, out=new[1:])
                joined = np.full(new[-1], 32, np.uint8)
                inside = ~textcore.is_space(data)
                joined[np.flatnonzero(inside) + np.repeat(new[:-1] - starts, lengths)] = data[inside]
                raw = joined.tobytes()
                counts = np.diff(at)
                last = np.repeat(at[1:], counts) - 1
                index = np.arange(n)
                begins = np.repeat(at[:-1], counts)
                used = (index + width - 1 <= last) | (index == begins)  # a short text is one shingle
                upto = np.minimum(index + width - 1, last)[used]
                hashes = np.fromiter(
                    (digest(raw[s:e], seed) for s, e in zip(new[:-1][used].tolist(), (new[upto] + lengths[upto]).tolist())),
                    np.uint64,
                    len(upto),
                )
                owner = np.repeat(np.arange(after - first), counts)[used]
                per = np.bincount(owner, minlength=after - first)
                bounds = np.concatenate([[0], np.cumsum(per)])
                have = np.flatnonzero(per)
                value = np.zeros(after - first, np.uint64)
                for low in range(0, len(have), 512):  # bits take 64 bytes a shingle, so a few texts at a time
                    rows = have[low : low + 512]
                    cuts = bounds[rows] - bounds[rows[0]]
                    part = hashes[bounds[rows[0]] : bounds[rows[-1] + 1]]
                    for b in range(BITS):
                        ones = np.add.reduceat(((part >> np.uint64(b)) & np.uint64(1)).astype(np.int64), cuts)
                        value[rows] |= (2 * ones > per[rows]).astype(np.uint64) << np.uint64(b)
                out[first:after] = value
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, others), pa.array(out.view(np.int64), pa.int64())], names=[*others, "fp"]
            )

    return of


def _forest(values: np.ndarray, radius: int, turn: int) -> list[tuple[int, int]]:
    """Edges within the radius that connect what all such edges connect; at most len(values) - 1."""
    parent = np.arange(len(values))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []

    def join(x: int, y: int) -> None:
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            edges.append((int(values[x]), int(values[y])))

    def within(rows: np.ndarray, turn: int) -> None:
        if len(rows) <= 2048 or turn > 6:
            for i in range(len(rows) - 1):
                near = np.bitwise_count(values[rows[i + 1 :]] ^ values[rows[i]]) <= radius
                for j in np.flatnonzero(near):
                    join(rows[i], rows[i + 1 + j])
            return
        for mask in masks(radius, turn=turn):  # a large bucket: cover it again by other masks
            keys = values[rows] & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            for part in np.split(rows[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if 1 < len(part) < len(rows) or len(part) == len(rows) and turn >= 6:
                    within(part, turn + 1)
                elif len(part) == len(rows):
                    within(part, turn + 1)
                    return

    within(np.arange(len(values)), turn)
    return edges


def link(radius: int = 3):
    """A mapInArrow function over rows sorted by (t, key): streams buckets, returns linking edges."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
            size = end - begin
            two = begin[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            edges = list(zip(fp[two].tolist(), fp[two + 1].tolist()))
            for b, e in zip(begin[size > 2], end[size > 2]):
                edges += _forest(fp[b:e], radius, 1)
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=schema)

        held: list[list[np.ndarray]] = []  # rows of the bucket that isn't known to be whole yet
        for batch in batches:
            if not len(batch):
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("t", "key", "fp")]
            new[2] = new[2].view(np.uint64)
            ends = np.flatnonzero((np.diff(new[0]) != 0) | (np.diff(new[1]) != 0))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            goes_on = bool(held) and held[-1][0][-1] == new[0][0] and held[-1][1][-1] == new[1][0]
            if cut or held and not goes_on:
                yield runs(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in new])))
                held = []
            held.append([x[cut:] for x in new])
        if held:
            yield runs(*(np.concatenate(x) for x in zip(*held)))

    return of


def _groups(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (distinct fp, other columns) with root, the same for all that links within the radius connect."""
    tables = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >> 63 else m)).alias("key"))
            for t, m in enumerate(masks(radius))
        ]
    )
    keyed = nodes.select("fp", F.explode(tables).alias("x")).select(
        F.col("x.t").cast("long").alias("t"), F.col("x.key").alias("key"), "fp"
    )
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_rows = keyed.repartition(parts, "t", "key").sortWithinPartitions("t", "key", "fp")
    edges = sorted_rows.mapInArrow(link(radius), "a long, b long")
    with scratch() as kept:
        kept.append(table := Written(components(edges), "components"))
    found = table.read()
    return nodes.join(found, nodes.fp == found.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """SimHash fingerprints and the groups that links within the radius connect.

    docs: doc_id, text; other columns are ignored. Shingles of width words, A-Z lower-cased; a text
    with fewer words is one shingle, one without words (null, empty) has fingerprint 0 and links
    like any other. A bit is 1 if over half of the shingles' hashes have it. Equal fingerprints are
    one node, so copies never meet as pairs. component_id is the least doc_id of the group; a null
    doc_id takes part and is never the least unless there is no other. Repeated rows stay rows.
    Returns doc_id, fp (long), component_id.
    """
    schema = "doc_id long, fp long"
    marked = written(docs.select("doc_id", "text").mapInArrow(fingerprints(width, seed), schema), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = _groups(nodes, radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    return marked.join(of_fp, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each group: that of the least doc_id, and of equal ids the least text.

    All of docs' columns are kept. A group whose ids are all null keeps one row. Ids only put the
    rows of a group in order: documents of different groups that share an id, or have none, all stay.
    """
    marks = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    marked = written(marks.mapInArrow(fingerprints(width), "_id long, _key long, fp long"), "fingerprints")
    # The least id of a fingerprint and of a group, nulls last.
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    rooted = _groups(marked.groupBy("fp").agg(F.min(place).alias("least")), radius)
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    of_fp = rooted.join(best, "root").where("least = best").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("best.id").alias("_best"))
    first = marked.join(of_fp, (F.col("fp") == F.col("_fp")) & F.col("_id").eqNullSafe(F.col("_best")))
    first = first.select("_id", "_key", "_root").distinct()
    rows = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")))
    order = [F.coalesce("text", F.lit("")), *[F.xxhash64(c) for c in docs.columns if c != "text"]]
    nth = F.row_number().over(Window.partitionBy("_root").orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").select(*docs.columns)
