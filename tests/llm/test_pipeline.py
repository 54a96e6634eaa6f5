import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import fuzzy_lines, mixing, packing, queries, simhash, toxicity
from weftgraph.llm.storage import Written

from tests.llm.test_fuzzy_lines import brute as brute_lines
from tests.llm.test_mixing import water
from tests.llm.test_packing import check_places
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_stages_compose(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "source mix", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Written(stage(spark, docs, SF), "stage").read()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[1] > sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_each_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    kept = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, SF).collect()}
    assert kept == {d for d, s in scores.items() if s < toxicity.THRESHOLD}
    groups = {r.component_id for r in simhash.near_duplicates(docs, 5).collect()}
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()} == groups
    lines = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()} == lines
    taken = {r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()}
    mixed: dict = {}
    for r in corpus_pipeline.source_mix(spark, docs, SF).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(r.text.split())
    assert mixed == {d: n for d, n in taken.items() if n}
    assert packing.pack(docs, queries.tokenizer_path()).count() == len(corpus_pipeline.pack_sequences(spark, docs, SF).collect())


def test_every_operator_is_registered():
    found = {n.split("_")[0] for n in queries.QUERIES}
    assert found == {f"op{k}" for k in range(1, 11)}


def test_the_chain_against_brute_force(spark):
    """Each stage's rows, made from what the stage before wrote, against plain versions that share no code with it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Written(stage(spark, docs, SF), "stage").read()
        kept.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    clean, lines, one_each, mixed = kept
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    stays = {d for d, _, _ in clean}
    known = [d for d in every if toxic.get(d) is not None]
    assert np.mean([(d in stays) == (toxic[d] == 0) for d in known]) > 0.97
    # Lines: none goes that brute force keeps; MinHash may miss a link.
    want = {d: (text, gone) for (d, text, _, gone) in brute_lines([(d, t) for d, t, _ in clean])}
    have = {d: t for d, t, _ in lines}
    assert have.keys() == want.keys() and len(lines) == len(clean)
    same = [have[d] == want[d][0] for d in have]
    assert np.mean(same) > 0.97
    assert all(set((want[d][0] or "").split("\n")) <= set((have[d] or "").split("\n")) for d in have)
    # One document of each group of fingerprints.
    groups = brute_components([(d, brute_fp(t, 5)) for d, t, _ in lines])
    assert sorted(d for d, _, _ in one_each) == sorted(set(groups))
    assert {(d, t) for d, t, _ in one_each} <= {(d, t) for d, t, _ in lines}
    # Words of each source near its target, whole documents but for the last.
    names = sorted({s for _, _, s in one_each})
    sizes = [sum(len(t.split()) for _, t, s in one_each if s == n) for n in names]
    for n, target in zip(names, water(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])):
        assert abs(sum(len(t.split()) for _, t, s in mixed if s == n) - target) <= 1
    whole = {d: t for d, t, _ in one_each}
    assert sum(t != whole[d] for d, t, _ in mixed) <= len(names)
    # Every token of every pass, packed without gaps.
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_places(packed, packing.CAPACITY)
    own, pieces = Tokenizer.from_file(queries.tokenizer_path()), []
    for d, t, _ in mixed:
        ids = np.array(own.encode(t, add_special_tokens=False).ids + [1], "<u4")
        pieces += [(d, k, zlib.crc32(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == sorted(pieces)
