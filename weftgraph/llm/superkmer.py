"""Substring deduplication by super-k-mer partitioning over words.

A window is `width` consecutive words of one document. Its minimiser is the least hash among its
runs of `inner` words. Consecutive windows with the same minimiser travel as one packed string to
the minimiser's bucket; equal windows have equal minimisers, so all copies of a window meet in one
bucket, where sorting their hashes, and comparing the bytes of those that agree, counts them
exactly. Copies of a packed string within a step of texts travel once, with the places they come from.

A minimiser that very many windows share would make its bucket hot. Hot buckets, as a sample of the
texts tells them, are dealt over parts by a second minimiser, the least hash among the window's
longer runs, which equal windows share too; so the counts stay exact, however the sample falls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import textcore

WIDTH, INNER, INNER_HOT = 13, 2, 6
#: One in so many texts tells which buckets are hot: those of HOT times the mean size. Only the dealing depends on it.
HOT_SAMPLE, HOT = 64, 4
PACKED = "bucket int, strings binary, size long, places binary, n long"
FOUND = "doc long, row long, start int, upto int"
#: Arrays that tell where packed strings come from; doc travels as differences.
PLACES = (("ref", np.int32), ("doc", np.int64), ("row", np.int64), ("start", np.int32))
LEVEL = 5


def squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def squeezed_places(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays' bytes, first bytes of all numbers first, so that the high ones are runs."""
    arrays = arrays | {"doc": np.diff(arrays["doc"], prepend=np.int64(0))}
    parts = [np.ascontiguousarray(arrays[k].astype(t)).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for k, t in PLACES]
    return squeezed(b"".join(parts))


def opened_places(raw: bytes, n: int) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in PLACES)
    data = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for k, t in PLACES:
        size = np.dtype(t).itemsize
        out[k] = np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(t).ravel()
        at += n * size
    return out | {"doc": np.cumsum(out["doc"])}


def joined_words(data: np.ndarray, offsets: np.ndarray):
    """Bytes with one space after each word, each word's start there and its length, and the texts' first words."""
    starts, ends, at = textcore.words(data, offsets)
    lengths = ends - starts
    new = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=new[1:])
    out = np.full(new[-1], 32, np.uint8)
    inside = ~textcore.is_space(data)
    out[np.flatnonzero(inside) + np.repeat(new[:-1] - starts, lengths)] = data[inside]
    return out, new, lengths, at


def minimisers(hashed: textcore.RangeHash, new: np.ndarray, lengths: np.ndarray, width: int, inner: int) -> np.ndarray:
    """The least hash among each window's runs of inner words, for every run of width words of a step."""
    n = len(lengths)
    return textcore.sliding_min(hashed(new[: n - inner + 1], new[inner - 1 : n] + lengths[inner - 1 :]), width - inner + 1)


def loads(buckets: int, width: int, inner: int):
    """A mapInArrow function: texts to how many windows each bucket gets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in textcore.steps(batch.column("text")):
                data, new, lengths, at = joined_words(data, offsets)
                if len(lengths) < width:
                    continue
                least = minimisers(textcore.RangeHash(data), new, lengths, width, inner)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                valid = text[: len(least)] == text[width - 1 :]
                total += np.bincount((least[valid] % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return of


def hot_parts(texts: DataFrame, buckets: int, width: int, inner: int) -> dict[int, tuple[int, int]]:
    """Hot buckets: the first of the numbers their parts have, and how many. At most 1.25 x buckets parts in all."""
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(HOT_SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(loads(buckets, width, inner), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    mean = sum(r.n for r in found) / buckets
    out, upto = {}, buckets
    for r in sorted(found):
        if r.n > HOT * mean:
            out[r.bucket] = (upto, -int(-r.n // mean))
            upto += out[r.bucket][1]
    return out


def packer(buckets: int, width: int, inner: int, hot: dict[int, tuple[int, int]]):
    """A mapInArrow function: (doc, row, text) to packed strings by bucket."""
    first_of, parts_of = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for k, (first_part, n_parts) in hot.items():
        first_of[k], parts_of[k] = first_part, n_parts

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_of = batch.column("doc").to_numpy()
            row_of = batch.column("row").to_numpy()
            for first, after, data, offsets in textcore.steps(batch.column("text")):
                data, new, lengths, at = joined_words(data, offsets)
                n = len(lengths)
                if n < width:
                    continue
                hashed = textcore.RangeHash(data)
                least = minimisers(hashed, new, lengths, width, inner)
                goes = (least % np.uint64(buckets)).astype(np.int64)
                if hot:
                    finer = minimisers(hashed, new, lengths, width, min(INNER_HOT, width))
                    warm = parts_of[goes] > 0
                    least = np.where(warm, finer, least)
                    goes[warm] = first_of[goes[warm]] + (finer[warm] % parts_of[goes[warm]].astype(np.uint64)).astype(np.int64)
                text = np.repeat(np.arange(after - first), np.diff(at))
                valid = text[: n - width + 1] == text[width - 1 :]
                opens = valid.copy()
                opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (goes[1:] != goes[:-1]) | (text[1 : len(valid)] != text[: len(valid) - 1])
                closes = valid.copy()
                closes[:-1] &= ~valid[1:] | opens[1:]
                begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + width  # words
                if not len(begin):
                    continue
                to = goes[begin]
                order = np.argsort(to, kind="stable")
                begin, end, to = begin[order], end[order], to[order]
                raw = data.tobytes()
                cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
                low, high = new[begin].tolist(), (new[end] - 1).tolist()
                text = text[begin]
                start = (begin - at[text]).astype(np.int32)
                doc, row = doc_of[first + text], row_of[first + text]
                columns: list[list] = [[] for _ in range(5)]
                for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    seen: dict[bytes, int] = {}
                    ref = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(low[i:j], high[i:j])], np.int32)
                    strings = b"\n".join(seen)
                    places = squeezed_places({"ref": ref, "doc": doc[i:j], "row": row[i:j], "start": start[i:j]})
                    for c, x in zip(columns, (int(to[i]), squeezed(strings), len(strings), places, j - i)):
                        c.append(x)
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
                names = ["bucket", "strings", "size", "places", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return of


def same_windows(raw: bytes, low: np.ndarray, high: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A number for each window, equal for equal bytes only; -1 for windows whose hash is alone."""
    order = np.argsort(hashed, kind="stable")
    in_order = hashed[order]
    new = np.ones(len(order), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    number = np.cumsum(new) - 1
    alone = np.bincount(number, minlength=1)[number] == 1 if len(number) else np.zeros(0, bool)
    again = np.flatnonzero(~new)
    a, b = order[again - 1], order[again]
    equal = (high[a] - low[a]) == (high[b] - low[b])
    equal &= np.fromiter(
        (raw[s:e] == raw[t:f] for s, e, t, f in zip(low[a].tolist(), high[a].tolist(), low[b].tolist(), high[b].tolist())), bool, len(a)
    )
    if not equal.all():  # different bytes under one hash: number those windows by their bytes
        fresh = int(number[-1]) + 1
        for group in np.unique(number[again[~equal]]):
            names: dict[bytes, int] = {}
            for k in np.flatnonzero(number == group):
                number[k] = fresh + names.setdefault(raw[low[order[k]] : high[order[k]]], len(names))
            fresh += len(names)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(alone, -1, number)
    return out


def counter(width: int):
    """An applyInArrow function: a bucket's packed strings to word ranges that earlier documents have."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("upto", pa.int32())])

    def of(table: pa.Table) -> pa.Table:
        strings, ref, doc, row, start, known = [], [], [], [], [], 0
        for r in table.select(["strings", "size", "places", "n"]).to_batches():
            for packed, size, places, n in zip(*(x.to_pylist() for x in r.columns)):
                text = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
                own = opened_places(places, n)
                strings.append(text)
                ref.append(own["ref"].astype(np.int64) + known)
                known += text.count(b"\n") + 1
                doc.append(own["doc"])
                row.append(own["row"])
                start.append(own["start"])
        raw = b"\n".join(strings)
        del strings
        ref, doc, row, start = (np.concatenate(x) for x in (ref, doc, row, start))
        data = np.frombuffer(raw, np.uint8)
        ends = np.append(np.flatnonzero((data == 32) | (data == 10)), len(data))  # of words
        starts = np.concatenate([[0], ends[:-1] + 1])
        # A word of either document never holds 0x0A, so it only ends packed strings.
        last = np.append(np.flatnonzero(data[ends[:-1]] == 10), len(ends) - 1)  # last word of each string
        first_word = np.concatenate([[0], last[:-1] + 1])
        string_of = np.repeat(np.arange(known), last - first_word + 1)
        valid = np.flatnonzero(string_of[: len(starts) - width + 1] == string_of[width - 1 :])
        low, high = starts[valid], ends[valid + width - 1]
        number = same_windows(raw, low, high, textcore.RangeHash(data)(low, high))
        owner = string_of[valid]
        earliest = np.full(known, np.iinfo(np.int64).max)
        np.minimum.at(earliest, ref, doc)
        latest = np.full(known, np.iinfo(np.int64).min)
        np.maximum.at(latest, ref, doc)
        least = earliest[owner]
        shared = np.flatnonzero(number >= 0)
        if len(shared):
            order = shared[np.argsort(number[shared], kind="stable")]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(number[order])) + 1])
            least[order] = np.repeat(np.minimum.reduceat(least[order], cut), np.diff(np.append(cut, len(order))))
        # Only strings with a window that some of their documents must give up are looked at by place.
        hit = np.zeros(known, bool)
        hit[owner[least < latest[owner]]] = True
        at = np.searchsorted(owner, np.arange(known + 1))
        out: list[list[np.ndarray]] = [[], [], [], []]
        places = np.flatnonzero(hit[ref])
        for begin in range(0, len(places), 20_000):
            p = places[begin : begin + 20_000]
            count = at[ref[p] + 1] - at[ref[p]]
            upto = np.cumsum(count)
            inner = np.arange(upto[-1]) - np.repeat(upto - count, count)
            place = np.repeat(p, count)
            given = least[np.repeat(at[ref[p]], count) + inner] < doc[place]
            place, word = place[given], start[place[given]] + inner[given]
            if not len(place):
                continue
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (word[1:] != word[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(place)) - 1
            for x, y in zip(out, (doc[place[a]], row[place[a]], word[a], word[b] + width)):
                x.append(y)
        kinds = (np.int64, np.int64, np.int32, np.int32)
        return pa.Table.from_arrays(
            [pa.array(np.concatenate(x).astype(k) if x else np.zeros(0, k)) for x, k in zip(out, kinds)], schema=schema
        )

    return of


def keeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (doc_id, text, ranges) to what is kept of each text."""
    for batch in batches:
        spans = batch.column("ranges").to_pylist()
        total, removed, kept = [], [], []
        for first, after, data, offsets in textcore.steps(batch.column("text")):
            data, new, lengths, at = joined_words(data, offsets)
            raw = data.tobytes()
            for k in range(after - first):
                a, b = int(at[k]), int(at[k + 1])
                ranges = spans[first + k]
                total.append(b - a)
                if not ranges:
                    removed.append(0)
                    kept.append(raw[new[a] : new[b] - 1].decode("utf-8") if b > a else "")
                    continue
                stay = np.ones(b - a, bool)
                for r in ranges:
                    stay[r["start"] : r["upto"]] = False
                bytes_stay = np.repeat(stay, lengths[a:b] + 1)
                kept.append(data[new[a] : new[b]][bytes_stay].tobytes()[:-1].decode("utf-8"))
                removed.append(int((~stay).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            names=["doc_id", "text", "n_words", "n_removed"],
        )


def dedup_substrings(docs: DataFrame, width: int = WIDTH, inner: int = INNER, buckets: int | None = None) -> DataFrame:
    """Each text without the words of windows that a document with a smaller id also has.

    docs: doc_id, text; other columns are ignored. Windows are judged on the input. A null text has
    no words. A null doc_id counts as larger than any, as 2**63 - 1 does; rows with one doc_id, or
    none, are one document as to which is smaller, and rows stay rows. buckets: parts that windows
    go to, eight to a shuffle partition where not given, besides those of hot ones. Returns doc_id, text (kept words, joined by single spaces), n_words,
    n_removed; no rows give no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id are told apart by their text: by 32 bits, of which squeezed places stay small, and by 64 without an id.
    key = F.xxhash64("text")
    row = F.when(F.col("doc_id").isNull(), key).otherwise(key.bitwiseAND(F.lit(2**32 - 1)))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), row.alias("row"), "text")
    buckets = buckets or 8 * parts
    hot = hot_parts(docs, buckets, width, inner)
    packed = keyed.select("doc", "row", "text").mapInArrow(packer(buckets, width, inner, hot), PACKED)
    found = packed.groupBy("bucket").applyInArrow(counter(width), FOUND)
    ranges = found.groupBy(F.col("doc").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "upto")).alias("ranges"))
    with_ranges = keyed.join(ranges, (F.col("doc") == F.col("d")) & (F.col("row") == F.col("r")), "left")
    return with_ranges.select("doc_id", "text", "ranges").mapInArrow(
        keeper, "doc_id long, text string, n_words long, n_removed long"
    )
