"""Line deduplication by MinHash over character shingles.

A line's shingles are its runs of 5 characters, every one of them, at every length; a line under 5
characters is one shingle. They are compared by hashes of 64 bits.

Signatures: a shingle's hash gives it one of PLACES places and a value there; a place holds the
least value, and an empty one what the next place holds. Every shingle is as likely as any other to
be the least, so two lines agree at a place exactly as often as their sets' Jaccard similarity.
BANDS times IN_BAND places, no place in two bands, make the bucket keys of a line: a pair at 0.8
meets with probability 0.99. Two bits of each of 32 places, packed in one number, travel with a
line, so that pairs that can't be similar end in the bucket.

A line is held against the least of its bucket and the NEIGHBOURS before it: all pairs of a bucket
of up to eight lines. One pair of each line is checked first, with the least line it meets; then all
other pairs that are still in different groups. Larger buckets that are not one connected group
after that, crowded ones, are compared whole: exact counts of shared shingles for all pairs of lines
of different groups, in one step for a bucket, which gives at most one row less than it has groups.
A line is held against at most WHOLE_LINES others by that. Lines of buckets too large for it get
narrower bands of new signatures, which a pair at 0.8 meets in with probability 0.99 again, and the
same steps. What is still too large has all its pairs between groups looked at: two sets of the
similarity share one of the first shingles of each, rarest first (the prefix filter), so lines meet
by those shingles, and no pair is left out but by its sketch. The check of all pairs is the exact
Jaccard similarity of the shingle sets. Connected components of what passes keep the first of their
lines.

Signatures, buckets and the exact check are Arrow functions, as DataFrame functions did not meet the
limits (the README has their figures); lines, joins and groups are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import textcore
from weftgraph.llm.components import components
from weftgraph.llm.storage import Written, scratch, written

SIMILARITY, NEIGHBOURS, WIDTH = 0.8, 7, 5
PLACES = 96
#: Places in a band, and signatures of other hashes that give bands: for all lines, and for those of crowded buckets.
IN_BAND, IN_BAND_CROWD, ROUNDS_CROWD = 6, 12, 8
BANDS = PLACES // IN_BAND
#: Of SKETCHED pairs of sketch bits, how many agree at least: 2.5 standard deviations below what the similarity gives.
SKETCHED, AGREE_LEAST = 32, 22
#: Lines, bytes of lines, and shingles that one numpy step works on.
STEP_LINES, STEP_BYTES, STEP_RUNS = 4096, 1 << 18, 1 << 20
#: One in so many lines tells which buckets are hot; only the dealing of rows depends on it.
HOT_SAMPLE, HOT_LEAST = 64, 4096
#: Lines and characters of a bucket that are compared whole, and shingles that one step of that takes.
WHOLE_LINES, WHOLE_CHARS, STEP_SHINGLES = 2048, 1 << 22, 4096
SLOT_BITS = 18
#: Stands after the end of a line under 5 characters; no character has this number.
NONE = 0x110000
FACTORS = textcore.mixed(np.arange(1, 3, dtype=np.uint64)) | np.uint64(1)
EMPTY = np.uint32(2**32 - 1)
PLACE = ("doc_id", "row", "line_no")


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters as numbers, and where each text begins (one more at the end). Bytes that are no UTF-8 count as one character each."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
        begins = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
        at = begins[offsets]
    except UnicodeDecodeError:
        each = [raw[a:b].decode("utf-8", "backslashreplace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        text, at = "".join(each), np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), at


def sums_of(chars: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each run of WIDTH characters: three of them, and two, side by side, each times an odd factor."""
    wide = chars.astype(np.uint64)
    two = wide[1:] << np.uint64(21)
    two |= wide[:-1]
    three = wide[2:] << np.uint64(42)
    three |= two[:-1]
    out = three[:-2] * FACTORS[0]
    out += two[3:] * FACTORS[1]
    return out


def run_hashes(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of WIDTH characters of each text, in order, and where each text's begin (one more at the end)."""
    length = np.diff(at)
    count = np.where(length > 0, np.maximum(length - WIDTH + 1, 1), 0)
    bounds = np.append(0, np.cumsum(count))
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    # Runs that go over a text's end are left out, but for those of short texts, which end in NONE.
    sums = sums_of(np.append(chars, np.full(WIDTH - 1, NONE, np.uint32)))
    for j in np.flatnonzero((length > 0) & (length < WIDTH)):
        sums[at[j]] = sums_of(np.append(chars[at[j] : at[j + 1]], np.full(WIDTH, NONE, np.uint32))[:WIDTH])[0]
    keep = np.zeros(len(chars) + 1, np.int32)
    some = count > 0
    np.add.at(keep, at[:-1][some], 1)
    np.add.at(keep, (at[:-1] + count)[some], -1)
    inside = np.cumsum(keep)[:-1] > 0
    return textcore.mixed(sums[inside]), bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The PLACES values of each text that has hashes."""
    n = len(bounds) - 1
    least = np.full(n * PLACES, EMPTY, np.uint32)
    text = np.repeat(np.arange(n), np.diff(bounds))
    for low in range(0, len(hashes), STEP_RUNS):
        h = hashes[low : low + STEP_RUNS]
        place = ((h >> np.uint64(32)) * np.uint64(PLACES)) >> np.uint64(32)
        np.minimum.at(least, text[low : low + STEP_RUNS] * PLACES + place.astype(np.int64), (h & np.uint64(2**32 - 1)).astype(np.uint32))
    least = least.reshape(n, PLACES)
    # The next place that holds something, going round.
    at = np.where(least != EMPTY, np.arange(PLACES, dtype=np.int32), np.int32(3 * PLACES))
    ahead = np.concatenate([at, at + PLACES], axis=1)[:, ::-1]
    ahead = np.minimum.accumulate(ahead, axis=1)[:, ::-1][:, :PLACES] % PLACES
    return np.take_along_axis(least, ahead, axis=1)


def band_keys(values: np.ndarray, in_band: int, seed: int) -> np.ndarray:
    """Bucket keys of signatures, 32 bits for each in_band places; no place is in two bands."""
    v, bands = values.astype(np.uint64), PLACES // in_band
    keys = np.empty((len(v), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(v), (seed * PLACES + b + 1) * (in_band + 1), np.uint64)
        for k in range(b, PLACES, bands):
            key = textcore.mixed(key * FACTORS[0] + v[:, k])
        keys[:, b] = key
    return keys.astype(np.uint32).view(np.int32)


def sketches(values: np.ndarray) -> np.ndarray:
    """Two bits of each of SKETCHED places."""
    out = np.zeros(len(values), np.uint64)
    for k in range(SKETCHED):
        out |= ((values[:, k * PLACES // SKETCHED].astype(np.uint64) >> np.uint64(9)) & np.uint64(3)) << np.uint64(2 * k)
    return out.view(np.int64)


def rows_of(keys: np.ndarray) -> pa.Array:
    flat = keys.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, keys.shape[1]), pa.int32()), pa.array(flat))


HELD = (*PLACE, "line")


def signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: HELD to HELD, sketch and keys."""
    for batch in batches:
        for low in range(0, len(batch), STEP_LINES):
            part = batch.slice(low, STEP_LINES)
            sketch, keys = [], []
            for _, _, data, offsets in textcore.steps(part.column("line"), STEP_BYTES):
                values = signatures(*run_hashes(*characters(data, offsets)))
                sketch.append(sketches(values))
                keys.append(band_keys(values, IN_BAND, 0))
            yield pa.RecordBatch.from_arrays([*map(part.column, HELD), pa.array(np.concatenate(sketch)), rows_of(np.concatenate(keys))], names=[*HELD, "sketch", "keys"])


def crowd_signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: id, sketch, line to id, sketch and keys of narrow bands."""
    for batch in batches:
        for low in range(0, len(batch), STEP_LINES):
            part = batch.slice(low, STEP_LINES)
            keys = []
            for _, _, data, offsets in textcore.steps(part.column("line"), STEP_BYTES):
                hashes, bounds = run_hashes(*characters(data, offsets))
                each = [signatures(textcore.mixed(hashes + np.uint64(seed)), bounds) for seed in range(1, ROUNDS_CROWD + 1)]
                keys.append(np.concatenate([band_keys(v, IN_BAND_CROWD, k + 1) for k, v in enumerate(each)], axis=1))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("sketch"), rows_of(np.concatenate(keys))], names=["id", "sketch", "keys"])


def distinct_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    for first, after, data, offsets in textcore.steps(column, STEP_BYTES):
        hashes, bounds = run_hashes(*characters(data, offsets))
        for k in range(after - first):
            # Sorted rather than by np.unique, which takes a hash table and several times as long for so few.
            h = np.sort(hashes[bounds[k] : bounds[k + 1]])
            yield h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def checker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: pairs a, b, line_a, line_b to the a, b of those with the similarity."""
    for batch in batches:
        holds = np.zeros(len(batch), bool)
        pairs = zip(distinct_hashes(batch.column("line_a")), distinct_hashes(batch.column("line_b")))
        for k, (x, y) in enumerate(pairs):
            each = len(x) + len(y)
            if min(len(x), len(y)) * (1 + SIMILARITY) >= SIMILARITY * each - 1e-9:
                held = np.sort(np.concatenate([x, y]))
                both = np.count_nonzero(held[1:] == held[:-1])
                # both / (each - both) >= SIMILARITY
                holds[k] = both * (1 + SIMILARITY) >= SIMILARITY * each - 1e-9
        kept = pa.array(holds)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in "ab"], names=["a", "b"])


def hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: id, root, crowd, sketch, line to all but line and the line's distinct shingle hashes."""
    names = ["id", "root", "crowd", "sketch"]
    for batch in batches:
        for low in range(0, len(batch), STEP_LINES):
            part = batch.slice(low, STEP_LINES)
            lists = list(distinct_hashes(part.column("line")))
            ends = np.append(0, np.cumsum([len(x) for x in lists]))
            flat = np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64)
            h = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*map(part.column, names), h], names=[*names, "h"])


def roots_alike(root: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of roots that connect what the similar ones of these lines connect, at most one less than there are roots.

    Each line comes with its distinct shingle hashes. How many two lines share are sums of products,
    taken for all pairs at once; lines of the root that most of them have are not held against each other.
    """
    roots, of = np.unique(root, return_inverse=True)
    order = np.argsort(of == np.bincount(of).argmax(), kind="stable")
    of, n = of[order], np.array([len(hashes[k]) for k in order])
    rest = int((of != of[-1]).sum())
    flat = np.concatenate([hashes[k] for k in order])
    at = np.argsort(flat, kind="stable")
    new = np.append(True, np.diff(flat[at]) != 0)
    # Shingles of one line alone are left out of the sums.
    shared = ~(new & np.append(new[1:], True))
    column, row = np.cumsum(new & shared)[shared] - 1, np.repeat(np.arange(len(n)), n)[at][shared]
    both = np.zeros((rest, len(n)), np.float32)  # whole numbers up to WHOLE_CHARS, which this holds exactly
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, STEP_SHINGLES):
        here = slice(*np.searchsorted(column, [low, low + STEP_SHINGLES]))
        holds = np.zeros((len(n), STEP_SHINGLES), np.float32)
        holds[row[here], column[here] - low] = 1
        both += holds[:rest] @ holds.T
    x, y = np.nonzero(both * np.float64(1 + SIMILARITY) >= SIMILARITY * (n[:rest, None] + n) - 1e-9)
    near = np.zeros((len(roots), len(roots)), bool)
    near[of[x], of[y]] = near[of[y], of[x]] = True
    fresh, a, b = np.ones(len(roots), bool), [], []
    for start in range(len(roots)):
        reached, fresh[start] = [start] if fresh[start] else [], False
        while reached:
            r = reached.pop()
            more = np.flatnonzero(near[r] & fresh)
            fresh[more] = False
            reached += more.tolist()
            a.append(np.full(len(more), roots[r]))
            b.append(roots[more])
    return np.concatenate([*a, roots[:0]]), np.concatenate([*b, roots[:0]])


def crowd_checker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function over rows (key, root, line) in order of key: a, b of roots_alike of each bucket."""
    names = ["a", "b"]
    key, root, held = None, [], []

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in roots_alike(np.array(root, np.int64), held)], names=names)

    for batch in batches:
        for low in range(0, len(batch), STEP_LINES):
            part = batch.slice(low, STEP_LINES)
            for k, r, x in zip(part.column("key").to_pylist(), part.column("root").to_pylist(), distinct_hashes(part.column("line"))):
                if k != key and held:
                    yield whole()
                    root, held = [], []
                key = k
                root.append(r)
                held.append(x)
    if held:
        yield whole()


def blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) == ""


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines that hold more than white space, trimmed, with a key of 128 bits: doc_id, row, line_no, line, k1, k2."""
    every = F.transform(F.split("text", "\n"), trimmed)  # before they are rows, so that each is trimmed once
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(every).alias("line_no", "line"))
    return keyed.where("line <> ''").withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit("2"), "line"))


def signed(docs: DataFrame) -> DataFrame:
    """The distinct lines: their first place, line, sketch and keys. Copies of a line meet in partial aggregates before they are shuffled."""
    lines = lines_of(docs).groupBy("k1", "k2").agg(F.min(F.struct(*PLACE)).alias("at"), F.first("line").alias("line"))
    schema = "doc_id long, row long, line_no int, line string, sketch long, keys array<int>"
    return lines.select("at.*", "line").mapInArrow(signer, schema)


def dealt(sets: DataFrame) -> DataFrame:
    """key, id, sketch, hot of each line and band; hot buckets are dealt over several keys, and hot is what theirs was.

    Which are hot is told by a sample of the lines; a bucket counts as hot beyond a quarter of a
    partition's share, so there are at most about 4 x partitions of them, small enough to broadcast.
    """
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select("id", "sketch", F.posexplode("keys").alias("band", "key"))
    # A key of 32 bits is one of its band only.
    rows = rows.select("id", "sketch", (F.col("band").cast("long") * 2**32 + F.col("key")).alias("key"))
    limit = max(HOT_LEAST, (sets.agg(F.sum(F.size("keys"))).first()[0] or 0) // (4 * parts))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).groupBy("key").count()
    crowd = sample.where(F.col("count") * HOT_SAMPLE >= limit).select("key", F.ceil(F.col("count") * HOT_SAMPLE * 2 / limit).alias("salts"))
    hot = [(r.key, int(r.salts)) for r in crowd.limit(64 * parts).collect()]
    if not hot:
        return rows.withColumn("hot", F.lit(None).cast("long"))
    known = F.broadcast(spark.createDataFrame(hot, "key long, salts long"))
    salt = F.pmod(F.xxhash64(F.lit("salt"), "id"), F.col("salts"))
    out = rows.join(known, "key", "left")
    return out.select("id", "sketch", F.when(salt.isNotNull(), F.xxhash64("key", salt)).otherwise(F.col("key")).alias("key"), F.when(salt.isNotNull(), F.col("key")).alias("hot"))


def can(x: Column, y: Column) -> Column:
    """Whether two sketches are alike enough."""
    differ = x.bitwiseXOR(y)
    odd = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(odd) <= SKETCHED - AGREE_LEAST


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same, for arrays."""
    differ = (x ^ y).view(np.uint64)
    return np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= SKETCHED - AGREE_LEAST


MET = "id long, other long, first boolean, key long, head long"


def meeter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function over rows (key, id, sketch, hot) in order of key and id: MET, bucket by bucket.

    A row with other: a pair that can be similar; first: with the least line of the bucket. A row
    without: a line of a bucket (key) not all of whose pairs are looked at; head: the sketch of the
    first line of a part of a hot bucket. Buckets of one line, which most are, give nothing.
    """

    def whole(key: np.ndarray, id_: np.ndarray, sketch: np.ndarray, hot: np.ndarray, is_hot: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        of = np.cumsum(new) - 1
        keep = (size[of] > 1) | is_hot
        nth, n = (np.arange(len(key)) - begin[of])[keep], size[of][keep]
        key, id_, sketch, hot, is_hot = (x[keep] for x in (key, id_, sketch, hot, is_hot))
        at = np.arange(len(key))
        a, b, first = [], [], []
        for k in range(NEIGHBOURS + 1):
            # k = 0: the bucket's first line; else the k-th before, but for that first one.
            here = np.flatnonzero(nth > k)
            there = here - k if k else here - nth[here]
            hit = alike(sketch[here], sketch[there])
            a.append(id_[here[hit]])
            b.append(id_[there[hit]])
            first.append(np.full(int(hit.sum()), k == 0))
        open_ = at[(n > NEIGHBOURS + 1) | is_hot]
        pairs, lone = sum(map(len, a)), len(open_)
        none = pa.nulls(lone, pa.int64())
        heads = is_hot[open_] & (nth[open_] == 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([*a, id_[open_]])),
                pa.concat_arrays([pa.array(np.concatenate(b)), none]),
                pa.array(np.concatenate([*first, np.zeros(lone, bool)])),
                pa.concat_arrays([pa.nulls(pairs, pa.int64()), pa.array(np.where(is_hot, hot, key)[open_])]),
                pa.concat_arrays([pa.nulls(pairs, pa.int64()), pa.array(sketch[open_], mask=~heads)]),
            ],
            names=[x.split()[0] for x in MET.split(", ")],
        )

    held: list[list[np.ndarray]] = []  # of the bucket that isn't known to be whole yet
    for batch in batches:
        if not len(batch):
            continue
        hot = batch.column("hot")
        new = [batch.column(k).to_numpy() for k in ("key", "id", "sketch")] + [hot.fill_null(0).to_numpy(), hot.is_valid().to_numpy(zero_copy_only=False)]
        ends = np.flatnonzero(np.diff(new[0]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut or held and held[-1][0][-1] != new[0][0]:
            yield whole(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in new])))
            held = []
        held.append([x[cut:] for x in new])
    if held:
        yield whole(*(np.concatenate(x) for x in zip(*held)))


def looked_at(sets: DataFrame) -> DataFrame:
    """MET of the lines of sets (id, sketch, keys), hot buckets' heads also held against each other."""
    meet = lambda rows: Written(rows.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "sketch", "hot").mapInArrow(meeter, MET), "line-meetings")
    met = meet(dealt(sets)).read()
    heads = met.where("head is not null").select("key", "id", F.col("head").alias("sketch"), F.lit(None).cast("long").alias("hot"))
    return met if heads.isEmpty() else met.unionByName(meet(heads).read())


def met_lines(sets: DataFrame, met: DataFrame) -> DataFrame:
    """id, sketch, line, n_chars of the lines that met others; a fraction of all lines, which later joins take."""
    ids = met.select("id").unionByName(met.where("other is not null").select(F.col("other").alias("id"))).distinct()
    line = sets.select("id", "sketch", "line", F.length("line").alias("n_chars"))
    # A hash table of the ids, so that the lines, the larger side by far, aren't sorted.
    return written(line.join(ids.hint("shuffle_hash"), "id", "left_semi"), "met-lines")


def similar(pairs: DataFrame, line: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b) whose lines' shingle sets have a Jaccard similarity of at least SIMILARITY."""
    left, right = (line.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "line_a", "line_b").mapInArrow(checker, "a long, b long")


def grouped(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found (node, root) with the groups that edges (a, b) connect made one."""
    a, b = (found.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    ends = edges.join(a, "a", "left").join(b, "b", "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = components(ends.where("a <> b")).select(F.col("node").alias("n"), F.col("root").alias("r"))
    out = found.join(more, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    fresh = more.join(found, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("r").alias("root"))
    return out.unionByName(fresh)


def with_roots(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different groups, with root_a and root_b."""
    for k in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(k), F.col("root").alias("_r")), k, "left").withColumn(f"root_{k}", F.coalesce("_r", k)).drop("_r")
    return pairs.where("root_a <> root_b")


def joined(met: DataFrame, found: DataFrame | None, line: DataFrame) -> DataFrame:
    """found (node, root) with what the similar ones of met's pairs connect."""
    pair = (F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    pairs = met.where("other is not null")
    every = Written(pairs.select(*pair).distinct(), "line-pairs").read()
    if found is None:
        least = pairs.where("first").groupBy("id").agg(F.min("other").alias("other")).select(*pair)
        found = written(components(written(similar(least, line), "line-edges")), "line-groups")
    # Every other pair that is still between groups.
    edges = written(similar(with_roots(every, found).select("a", "b"), line), "line-edges")
    return found if edges.isEmpty() else written(grouped(found, edges), "line-groups")


def in_crowds(met: DataFrame, found: DataFrame, line: DataFrame) -> DataFrame:
    """key, id, root of the lines in buckets not all of whose pairs were looked at and that aren't all of one group; whole: of those that can be compared at once."""
    large = met.where("key is not null").select("id", "key").join(line.select("id", "n_chars"), "id")
    rooted = large.join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"), "n_chars")
    crowds = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")).where("low < high")
    whole = ((F.col("n") <= WHOLE_LINES) & (F.col("chars") <= WHOLE_CHARS)).alias("whole")
    return written(rooted.drop("n_chars").join(crowds.select("key", whole), "key"), "crowded-lines")


def whole_crowds(crowded: DataFrame, found: DataFrame, line: DataFrame) -> DataFrame:
    """found with all that the lines of crowded's whole buckets connect."""
    rows = crowded.where("whole").join(line, "id").select("key", "root", "line")
    edges = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(crowd_checker, "a long, b long"), "line-edges")
    return found if edges.isEmpty() else written(grouped(found, edges), "line-groups")


def rare_pairs(lines: DataFrame) -> DataFrame:
    """Pairs of lines (id, root, crowd, sketch, line) of one crowded bucket and different roots that can be similar: a, b, a < b.

    Of n shingles a similar line has at least SIMILARITY * n, so it holds one of any n - that + 1 of
    them, and the least that both hold, in one order for all lines, is among the first so many of
    each. Rarest first, few lines meet by one; and where that least one stands, enough must follow it
    in both for the similarity. Roots are paired before their lines, so lines of one root never meet.
    """
    made = lines.select("id", "root", "crowd", "sketch", "line").mapInArrow(hash_lists, "id long, root long, crowd long, sketch long, h array<long>")
    # How often is counted by slots of hashes and kept as a power of two, one byte a slot: any order of
    # shingles leaves out no pair, so slots that are shared only cost time.
    slot = lambda h: F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")
    slots = made.select(F.explode(F.transform("h", slot)).alias("slot")).groupBy("slot").agg(F.bin(F.count("*")).alias("often"))
    often = bytearray(2**SLOT_BITS)
    for row in slots.select("slot", F.length("often").alias("bits")).toLocalIterator():
        often[row.slot] = row.bits
    table = F.lit(bytes(often))

    def ordered(h: Column) -> Column:
        bits = F.ascii(F.substring(table, slot(h) + 1, F.lit(1)).cast("string")).cast("long")
        return F.call_function("shiftleft", bits, F.lit(56)).bitwiseOR(F.shiftrightunsigned(h, 8))

    made = made.select("id", "root", "crowd", "sketch", F.size("h").alias("n"), F.sort_array(F.transform("h", ordered)).alias("h"))
    most = (F.floor(F.col("n") * (1 - SIMILARITY) + 1e-9) + 1).cast("int")
    rare = made.select("id", "root", "crowd", "sketch", "n", F.posexplode(F.slice("h", F.lit(1), most)).alias("nth", "h"))
    rare = rare.withColumn("nth", F.col("nth") + 1).withColumn("h", F.xxhash64("crowd", "h")).drop("crowd")
    shared = rare.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    rare = written(rare.join(shared, "h", "left_semi"), "rare-shingles")
    roots = rare.select("h", "root").distinct()
    met = roots.join(roots.withColumnRenamed("root", "root_b"), "h").where("root < root_b").withColumnRenamed("root", "root_a")
    for k in "ab":
        side = rare.select("h", F.col("root").alias(f"root_{k}"), F.col("id").alias(k), F.col("sketch").alias(f"sketch_{k}"), F.col("n").alias(f"n_{k}"), (F.col("n") - F.col("nth") + 1).alias(f"left_{k}"))
        met = met.join(side, ["h", f"root_{k}"])
    fits = F.least("left_a", "left_b") * (1 + SIMILARITY) >= SIMILARITY * (F.col("n_a") + F.col("n_b")) - 1e-9
    return met.where(fits & can(F.col("sketch_a"), F.col("sketch_b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stays_of(docs: DataFrame) -> DataFrame:
    """d, r, stays: for each document and row, bits of the lines that stay, by line number and 63 to a part."""
    sets = written(signed(docs).withColumn("id", F.monotonically_increasing_id()), "lines")
    met = looked_at(sets.select("id", "sketch", "keys"))
    line = met_lines(sets, met)
    found = joined(met, None, line)
    crowded = in_crowds(met, found, line)
    found = whole_crowds(crowded, found, line)
    # What is too large for that meets in narrower bands.
    crowded = crowded.where("not whole")
    if not crowded.isEmpty():
        again = line.join(crowded.select("id").distinct(), "id").mapInArrow(crowd_signer, "id long, sketch long, keys array<int>")
        met = looked_at(written(again, "crowded-keys"))
        found = joined(met, found, line)
        crowded = in_crowds(met, found, line)
        found = whole_crowds(crowded, found, line)
        crowded = crowded.where("not whole").drop("whole")
        if not crowded.isEmpty():
            more = written(rare_pairs(line.join(crowded.withColumnRenamed("key", "crowd"), "id")), "crowded-pairs")
            edges = written(similar(more, line), "line-edges")
            found = written(grouped(found, edges), "line-groups")
    kept = sets.select("id", "doc_id", "row", "line_no").join(found, F.col("id") == F.col("node"), "left")
    # A group's first line stays; its place comes from the aggregate, so nothing is joined by group.
    best = kept.where("root is not null").groupBy("root").agg(F.min(F.struct(*PLACE)).alias("best")).select("best.*")
    kept = kept.where("root is null").select("doc_id", "row", "line_no").unionByName(best)
    words = kept.groupBy("doc_id", "row", F.floor(F.col("line_no") / 63).cast("int").alias("part")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line_no") % 63)).alias("bits")
    )
    return words.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("stays"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with each line that is like a line before it removed, and n_lines, n_removed.

    docs: doc_id, text, and columns that stay as they are (ones named n_lines or n_removed give way);
    n_chars, if there, is that of the text returned. Lines end at newlines and are compared without
    white space around them; lines of white space only are no lines, and stay. Lines are in order of
    (doc_id, hash of the text, line number), null ids first; of each connected group of lines with
    similarity 0.8 or more, copies included, the first stays. Documents equal in id and text are
    treated alike. A text all of whose lines go is what white-space lines leave; a null text stays
    null with no lines. No rows give no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    with scratch() as kept_tables:
        kept_tables.append(stays := Written(stays_of(docs), "kept-lines"))
    keyed = docs.select(*names, F.xxhash64("text").alias("_row"))
    s = stays.read()
    # A hash table of the bits, so that the texts, the larger side by far, aren't sorted.
    out = keyed.join(s.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(s.d) & (F.col("_row") == s.r), "left")
    out = out.withColumn("_all", F.split("text", "\n"))

    def keeps(x: Column, i: Column) -> Column:
        bits = F.coalesce(F.try_element_at("stays", F.floor(i / 63).cast("int")), F.lit(0).cast("long"))
        return blank(x) | (F.call_function("getbit", bits, i % 63) == 1)

    out = out.withColumn("_kept", F.filter("_all", keeps))
    real = F.coalesce(F.size(F.filter("_all", lambda x: ~blank(x))), F.lit(0)).cast("long")
    removed = F.when(F.col("text").isNull(), 0).otherwise(F.size("_all") - F.size("_kept")).cast("long")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(real).cast("long")
    out = out.withColumns({"n_lines": n_lines, "n_removed": removed}).withColumn("text", F.array_join("_kept", "\n"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*names, "n_lines", "n_removed")
