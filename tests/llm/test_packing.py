import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import packing
from weftgraph.llm.queries import tokenizer_path

TEXTS = ["", None, "Hello, World!  it's", "a<|endoftext|>b <|startoftext|>", "é́  x\x1cy z İΣ Ⅷ", "word " * 9000, "日本語 テキスト", "x", "Don't STOP!!--now... (a)b[c]é.d e\u0301.f A\u0301", "<|ENDOFTEXT|> <| |>"]
PLAIN = ["Don't 'Tis we'LL a'b x's. STOP!!--now... (a)b[c]é.d e\u0301.f A\u0301 1a2 a1.b", "", "z", "İK ſ"]


def check_places(rows, capacity):
    taken = defaultdict(list)
    for r in rows:
        taken[r.sequence_id].append((r.offset, r.length))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(taken)


def test_pieces_are_the_tokenizers_ids(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(0, "", "again"), (None, "y", "z")], "doc_id long, text string, length string")
    rows = packing.pack(docs, tokenizer_path()).collect()
    check_places(rows, packing.CAPACITY)
    own = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in [*enumerate(TEXTS), (0, ""), (None, "y")]:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096])) for p, a in enumerate(range(0, len(ids), 4096))]
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)


def test_steps_without_control_strings_split_marks():
    own, ids_of = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    raw = [t.encode() for t in PLAIN]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    ids, counts = ids_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [own.encode(t, add_special_tokens=False).ids for t in PLAIN]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == sum(want, [])


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
def test_counts_are_packed_whole(counts):
    capacity = 60
    places = packing.pack_counts(counts, capacity)
    seen = defaultdict(set)
    bins = defaultdict(list)
    for length, rank, n, sequence, each, offset in places:
        for k in range(n):
            assert rank + k not in seen[length]
            seen[length].add(rank + k)
            bins[sequence + k // each].append((offset + k % each * length, length))
    assert {k: len(v) for k, v in seen.items()} == {k: n for k, n in counts.items() if n}
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= least_sequences(counts, capacity) * 11 / 9 + 4


def least_sequences(counts, capacity):
    """A lower bound: volume, volume beside the items that nothing of a length joins, and two large items to a sequence."""
    n = lambda low, high: sum(m for k, m in counts.items() if low <= k <= high)
    found = [-(-sum(k * m for k, m in counts.items()) // capacity), n(capacity // 2 + 1, capacity)]
    for t in [k for k in counts if 2 * k <= capacity]:
        room = sum((capacity - k) * m for k, m in counts.items() if capacity < 2 * k <= 2 * (capacity - t))
        small = sum(k * m for k, m in counts.items() if t <= k and 2 * k <= capacity)
        found.append(n(capacity - t + 1, capacity) + n(capacity // 2 + 1, capacity - t) + max(0, -(-(small - room) // capacity)))
        if 3 * t > capacity:
            found.append(n(capacity - t + 1, capacity) + -(-n(t, capacity - t) // 2))
    return max(found)


def optimum(items, capacity):
    """The fewest sequences, by trying every place of each item, longest first."""
    items, best = sorted(items, reverse=True), len(items)

    def put(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(items):
            best = len(room)
            return
        for at in {r: i for i, r in enumerate(room) if r >= items[k]}.values():
            put(k + 1, room[:at] + [room[at] - items[k]] + room[at + 1 :])
        put(k + 1, room + [capacity - items[k]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
def test_few_pieces_are_packed_almost_best(items):
    counts = {k: items.count(k) for k in items}
    used = {s + k // each for _, _, n, s, each, _ in packing.pack_counts(counts, 60) for k in range(n)}
    best = optimum(items, 60)
    assert least_sequences(counts, 60) <= best <= len(used) <= best + 1


def test_full_pieces_and_frequent_lengths(spark):
    docs = spark.createDataFrame([(i, "word " * (4095 if i % 2 else 3)) for i in range(40)], "doc_id long, text string")
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert len(rows) >= 40
    n = check_places(rows, packing.CAPACITY)
    total = sum(r.length for r in rows)
    assert -(-total // packing.CAPACITY) <= n <= -(-total // packing.CAPACITY) + 1
