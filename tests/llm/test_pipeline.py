"""Every stage on its own input, against brute force."""

import collections
import zlib

import numpy as np
import pytest
from helpers import EDGE, edge, empty
from test_dedup import ASCII, brute_simhash

import __spark_entry__ as contract
import corpus_pipeline
from foldstack.llm import packing, queries, quality
from foldstack.llm.common import store, table


def _texts(frame):
    return [(r.doc_id, r.text or "") for r in frame.collect()]


@pytest.fixture(scope="module")
def outputs(spark, sf):
    """Each stage's input and output on the documents."""
    docs, out = table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = store(stage(spark, docs, sf), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert {n for n in contract.queries() if n.startswith("op")} >= {f.__name__ for f in queries.QUERIES.values()}


def test_columns_and_rows_come_from_the_input(outputs):
    for name, (given, made) in outputs.items():
        if name not in ("mix", "pack"):
            assert made.columns == given.columns
            assert not collections.Counter(map(tuple, made.collect())) - collections.Counter(map(tuple, given.collect()))
            assert made.count() < given.count() or name == "near"


def test_quality_stage(spark, sf, outputs):
    given, made = outputs["quality"]
    model = quality.unpack(quality.fit(given, table(spark, sf, "labels")))
    assert {i for i, _ in _texts(made)} == {i for i, t in _texts(given) if quality.score_text(model, t) >= 0.5}


def test_exact_stage(outputs):
    given, made = outputs["exact"]
    last = {}
    for i, t in _texts(given):
        key = t.translate(ASCII)
        last[key] = max(i, last.get(key, -1))
    assert sorted(i for i, _ in _texts(made)) == sorted(last.values())


def test_near_stage(outputs):
    given, made = outputs["near"]
    rows = sorted(_texts(given))
    texts = [t.translate(ASCII) for _, t in rows]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    fps = np.array([brute_simhash(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= corpus_pipeline.NEAR_BITS) + i + 1:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert sorted(i for i, _ in _texts(made)) == sorted({rows[x][0] for x in root})


def test_mix_stage(outputs):
    given, made = outputs["mix"]
    before, after = dict(_texts(given)), dict(_texts(made))
    count = lambda t: len(t.split())
    assert set(after) <= set(before) and len(after) == made.count()
    cut = [i for i, t in after.items() if t != before[i]]
    assert all(before[i].startswith(after[i]) and 0 < count(after[i]) < count(before[i]) for i in cut)
    total = sum(map(count, before.values()))
    leaves = given.select("lang", "source").distinct().count()
    assert total * corpus_pipeline.MIX_SHARE - leaves <= sum(map(count, after.values())) <= total * corpus_pipeline.MIX_SHARE
    assert {r.doc_id: r.n_chars for r in made.collect() if r.doc_id in cut} == {i: len(after[i]) for i in cut}


def test_pack_stage(outputs):
    given, made = outputs["pack"]
    tokenizer = packing.Encoder(queries.vocabulary("word_bpe_49k.json")).tokenizer
    rows = made.toPandas().sort_values("piece")
    for i, t in _texts(given):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id == i]
        assert own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32))
    assert rows.groupby("sequence_id").length.sum().max() <= packing.TOKENS


def test_run_gives_the_last_stage(spark, sf, outputs):
    key = lambda f: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in f.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(outputs["pack"][1])


def test_edge_rows_pass_every_stage(spark, sf):
    for start in (edge(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            made = store(stage(spark, start, sf), f"edge-{name}")
            if name != "pack":
                assert made.columns == start.columns and made.count() <= len(EDGE)
    assert all(stage(spark, empty(spark), sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
