"""Mixing, quality, fingerprints, archives, packing and personal data against brute force."""

import base64
import hashlib
import itertools
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from helpers import EDGE, LONG, SENTENCE, by_id, docs, edge, empty
from pyspark.sql import functions as F

from foldstack.llm import mixing, packing, personal, quality, queries, warc, winnowing
from foldstack.llm.common import table

# mixing


def brute_shares(budget, capacity, weight):
    """Water filling: raise everyone by weight until full or the budget is spent."""
    got = dict.fromkeys(capacity, 0.0)
    left = min(budget, sum(capacity.values()))
    while left > 1e-9:
        live = [k for k in capacity if weight[k] > 0 and got[k] < capacity[k] - 1e-9]
        if not live:
            break
        total = sum(weight[k] for k in live)
        step = min(min((capacity[k] - got[k]) / weight[k] for k in live), left / total)
        for k in live:
            got[k] += step * weight[k]
        left -= step * total
    return got


@pytest.mark.parametrize("seed", range(4))
def test_budgets_flow_down_the_tree(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"domain{d}", lang, f"s{s}"): rng.randrange(1, 500) for d in range(3) for lang in ("en", "de") for s in range(rng.randrange(1, 4))}
    total = sum(leaves.values())
    budget, epochs = rng.randrange(1, 3 * total), 2
    frame = spark.createDataFrame([(*k, v, 1) for k, v in leaves.items()], "domain string, lang string, source string, tokens long, n long")
    weights = {"domain": F.substring("domain", 7, 1).cast("double"), "lang": F.when(F.col("lang") == "en", 3.0).otherwise(1.0), "source": F.lit(1.0)}
    found = {(r.domain, r.lang, r.source): r["take"] for r in mixing.leaf_budgets(frame, F.lit(budget), weights, epochs).collect()}
    top = brute_shares(budget, {d: epochs * sum(v for k, v in leaves.items() if k[0] == d) for d in {k[0] for k in leaves}}, {f"domain{i}": float(i) for i in range(3)})
    for d, share in top.items():
        langs = {k[1] for k in leaves if k[0] == d}
        middle = brute_shares(share, {x: epochs * sum(v for k, v in leaves.items() if k[:2] == (d, x)) for x in langs}, {"en": 3.0, "de": 1.0})
        for lang, part in middle.items():
            some = {k: epochs * v for k, v in leaves.items() if k[:2] == (d, lang)}
            for k, value in brute_shares(part, some, dict.fromkeys(some, 1.0)).items():
                assert abs(found[k] - value) <= 1 + 1e-6, (k, found[k], value)


def test_selection_is_a_prefix_of_seeded_epochs(spark, sf):
    taken = queries.op1_mixture(spark, sf).collect()
    rows = {r.id: r for r in queries.mix_input(table(spark, sf, "documents")).collect()}
    leaves = {}
    for r in taken:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    for leaf, some in leaves.items():
        own = sorted(r.id for r in rows.values() if (r.domain, r.lang, r.source) == leaf and r.tokens)
        total = sum(rows[i].tokens for i in own)
        full, rest = divmod(some[0].leaf_take, total)
        order = sorted(own, key=lambda i: (hashlib.md5(f"{queries.MIX_SEED}:{full}:{i}".encode()).hexdigest()[:15], i))
        expected = [(i, e, rows[i].tokens) for e in range(full) for i in own]
        for i in order:
            if rest > 0:
                expected.append((i, full, min(rest, rows[i].tokens)))
                rest -= rows[i].tokens
        assert sorted((r.doc_id, r.epoch, r["take"]) for r in some) == sorted(expected)


def test_mixing_edge_cases(spark):
    inputs = queries.mix_input(edge(spark))
    taken = mixing.mix(inputs, F.lit(10**6), queries.mix_weights(), 2, 1).collect()
    assert {r.id for r in taken} == {1, 2, None, 5, 6, 8, 9} and max(r.epoch for r in taken) <= 1
    assert mixing.mix(queries.mix_input(empty(spark)), F.lit(100), queries.mix_weights(), 2, 1).count() == 0
    assert mixing.mix(inputs, F.lit(0), queries.mix_weights(), 2, 1).count() == 0
    whole = mixing.mixed_documents(edge(spark), queries.domain_of("source"), 1.0, queries.mix_weights(), 1)
    assert whole.columns == edge(spark).columns and whole.count() == 9
    half = mixing.mixed_documents(edge(spark), queries.domain_of("source"), 0.5, queries.mix_weights(), 1).collect()
    texts = {t for _, t, *_ in EDGE}
    cut = [r for r in half if r.text not in texts]
    assert cut and all(any(t and t.startswith(r.text) for t in texts) and r.n_chars == len(r.text) for r in cut)


# quality


def test_quality_on_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = by_id(queries.op2_quality(spark, sf))
    labels = [r for r in table(spark, sf, "labels").collect() if r.quality is not None]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[x.doc_id].score, x.quality) for x in labels if rows[x.doc_id].held_out]
    good, bad = ([s for s, q in held if q == v] for v in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.9


def test_quality_reads_the_end_of_long_texts():
    texts = ["good words here " * 8, "bad&&& words### here%%% " * 6] * 30
    model = quality.train(texts, [1, 0] * 30)
    plain = "good words here " * 6000
    assert quality.score_text(model, plain) > 0.9 > quality.score_text(model, plain + "bad&&& words### here%%% " * 400)
    assert 0 <= quality.score_text(model, "") <= 1


def brute_score(model, text):
    """The network by plain loops over chunks, filters and bytes."""
    data = text.encode()
    count = max(1, -(-max(len(data) - quality.WIDTH, 0) // quality.STRIDE) + 1)
    count = -(-count // quality.POOL) * quality.POOL
    byte = lambda i: data[i] + 1 if i < len(data) else 0
    pooled = []
    for first in range(0, count, quality.POOL):
        best = [-float("inf")] * quality.FILTERS
        for chunk in range(first, first + quality.POOL):
            embedded = np.concatenate([model["embed"][byte(chunk * quality.STRIDE + k)] for k in range(quality.WIDTH)]).astype(float)
            for f in range(quality.FILTERS):
                best[f] = max(best[f], float(embedded @ model["filters"][:, f].astype(float)))
        pooled.append([max(0.0, b + float(bias)) for b, bias in zip(best, model["bias"])])
    features = [sum(c) / len(pooled) for c in zip(*pooled)] + [max(c) for c in zip(*pooled)]
    z = sum(a * float(b) for a, b in zip(features, model["out"])) + float(model["out_bias"][0])
    return 1 / (1 + np.exp(-z))


def test_quality_score_against_brute_force():
    model = quality._start(np.random.default_rng(4))
    model["bias"] += 0.1
    edge_of = quality.POOL * quality.STRIDE
    sizes = [0, 1, quality.WIDTH - 1, quality.WIDTH, quality.WIDTH + 1, edge_of - 1, edge_of, edge_of + quality.WIDTH, 3 * edge_of + 5]
    rng = random.Random(1)
    for text in ["é日本" * 30, *("".join(rng.choice("abc \n.") for _ in range(n)) for n in sizes)]:
        assert quality.score_text(model, text) == pytest.approx(brute_score(model, text), abs=1e-4)


def test_quality_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in quality._start(rng).items()}
    data = b"some text, long enough for a few chunks of the network" * 12

    def loss(m):
        z = float(quality._joined(quality._pooled(m, data)) @ m["out"] + m["out_bias"][0])
        return float(np.log1p(np.exp(-z)))

    grads = {k: np.zeros_like(v) for k, v in model.items()}
    quality._gradient(model, data, 1, 1.0, grads)
    for name in ("filters", "out", "bias", "embed"):
        spot = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        moved = {k: v.copy() for k, v in model.items()}
        moved[name][spot] += 1e-5
        assert abs((loss(moved) - loss(model)) / 1e-5 - grads[name][spot]) < 1e-3 * max(1, abs(grads[name][spot]))


def test_quality_edge_cases(spark, sf):
    labels = table(spark, sf, "labels")
    rows = quality.report(edge(spark), labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    assert quality.report(empty(spark), labels).count() == 0
    few = spark.createDataFrame([(1, None), (None, 1), (5, 1)], "doc_id long, quality int")
    kept = quality.keep_good(edge(spark), few)
    assert kept.columns == edge(spark).columns and kept.count() == len(EDGE)
    other = edge(spark).withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    assert sorted(r.score for r in quality.report(other, few).collect()) == sorted(r.score for r in quality.report(edge(spark), few).collect())


# fingerprints


def brute_choices(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) >> 33 for w in words]
    if not hashes:
        return []
    roll = lambda some: __import__("functools").reduce(lambda a, x: (a * winnowing._BASE + x) % winnowing._PRIME, some, 0)
    k, w = winnowing.GRAM, winnowing.WINDOW
    if len(hashes) < k:
        return [(roll(hashes), 0)]
    grams = [roll(hashes[i : i + k]) for i in range(len(hashes) - k + 1)]
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        window = list(enumerate(grams))[i : i + w]
        at, value = min(window, key=lambda x: (x[1], -x[0]))
        if (value, at) not in chosen[-1:]:
            chosen.append((value, at))
    return list(dict.fromkeys(chosen))


def brute_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choice("abcdefg") * rng.randrange(1, 40) for _ in range(rng.randrange(40)))) for i in range(40)]
    rows += [(200, ""), (201, "é"), (202, "\U0001f600 x"), (203, "same same same same same same same same same same")]
    found = by_id(winnowing.report(docs(spark, rows)))
    order = sorted(rows, reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(brute_choices, (text, edited, following))
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{h:X}:{p}" for h, p in a) and r.edited_fingerprint == " ".join(f"{h:X}:{p}" for h, p in b)
        assert r.near_edited == pytest.approx(brute_likeness(a, b)) and r.near_next == pytest.approx(brute_likeness(a, c))


def test_winnowing_keeps_its_promise(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(20):
        shared = [word() for _ in range(winnowing.GRAM + winnowing.WINDOW - 1)]
        rows += [(2 * i + side, " ".join([word() for _ in range(rng.randrange(20))] + shared + [word() for _ in range(rng.randrange(20))])) for side in (0, 1)]
    found = {r.id: {x >> 32 for x in r.choices} for r in winnowing.fingerprints(docs(spark, rows)).collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(20))


def test_winnowing_edge_cases(spark):
    rows = winnowing.report(edge(spark)).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert winnowing.report(empty(spark)).count() == 0
    alone = winnowing.report(docs(spark, [(1, SENTENCE)])).first()
    assert alone.near_next == 1.0 and alone.n_chars == len(SENTENCE)


# archives

PAGES = "page_id long, url string, html string, id string, archive string"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


def brute_pages(rows):
    top = {}
    for i, _, h in rows:
        h, number = h or "", -1 if i is None else i
        top[h] = max(number, top.get(h, -1))
    out = []
    for i, _, h in rows:
        data, number = (h or "").encode(), -1 if i is None else i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = top[h or ""] == number
        out.append((i, len(data), digest, "response" if first else "revisit", None if first else top[h or ""]))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    rng = random.Random(8)
    bodies = ["<p>" + "".join(rng.choice("abc \r\nü") for _ in range(rng.randrange(3000))) for _ in range(15)]
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice(bodies)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "http://n", "null id"), (None, "http://n", bodies[0]), (7, "http://again", rows[7][2]), (102, "http://long", LONG)]
    found = sorted((tuple(r) for r in warc.report(_pages(spark, rows)).collect()), key=str)
    assert found == brute_pages(rows)
    assert warc.report(_pages(spark, [])).count() == 0


def test_archive_layout_and_small_payloads(spark, tmp_path):
    rows = [(1, "http://a", "tiny"), (2, "http://b", "tiny"), (3, "http://c", "a longer payload " * 9), (4, "http://d", "a longer payload " * 9)]
    marked = warc.with_originals(_pages(spark, rows), min_bytes=10)
    dictionary = warc.train_dictionary([b"a longer payload of pages " * 4 + bytes([i]) for i in range(200)])
    listed = warc.write_archives(marked.repartition(1), str(tmp_path / "out"), dictionary, archive_bytes=1)
    archives = listed.collect()
    assert len(archives) == 4 and all(a.records == 1 for a in archives)  # each record begins an archive here
    data = open(archives[0].archive, "rb").read()
    assert struct.unpack("<II", data[:8]) == (warc.SKIPPABLE, len(dictionary))
    kinds = {r.id: (r.record_type, r.refers_to) for r in warc.read_archives(listed).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_compressed_and_missing_dictionaries(tmp_path):
    trained = warc.train_dictionary([f"<html><body>page {i} of many</body></html>".encode() * 3 for i in range(400)])
    for name, stored, used in (("full", trained, trained), ("packed", zstandard.compress(trained), trained), ("raw", b"raw text" * 9, b"raw text" * 9), ("none", b"", b"")):
        path = tmp_path / f"{name}.warc.zst"
        compressor = zstandard.ZstdCompressor(dict_data=warc._as_dictionary(used), write_checksum=True)
        records = [warc.build(i, None, f"<html>{i}</html>".encode() * i) for i in range(5)]
        path.write_bytes(warc.dictionary_frame(stored) + b"".join(map(compressor.compress, records)))
        assert [r.payload for r in warc.read_archive(str(path))] == [f"<html>{i}</html>".encode() * i for i in range(5)]


def test_broken_archives_are_refused(tmp_path):
    good = warc.build(1, "http://a", b"payload")
    frame = zstandard.ZstdCompressor(write_checksum=True).compress
    lead = warc.dictionary_frame(b"")
    cases = {
        "no dictionary frame": frame(good),
        "cut dictionary": struct.pack("<II", warc.SKIPPABLE, 99) + b"short",
        "cut frame": lead + frame(good)[:-3],
        "flipped bits": lead + bytes(b ^ (i == 30) for i, b in enumerate(frame(good))),
        "version": lead + frame(good.replace(b"WARC/1.1", b"WARC/9.9", 1)),
        "length": lead + frame(good.replace(b"Content-Length: ", b"Content-Length: 9", 1)),
        "letters": lead + frame(good.replace(b"Content-Length: ", b"Content-Length: x", 1)),
        "digest": lead + frame(good.replace(b"payload", b"paYload")),
        "missing header": lead + frame(good.replace(b"WARC-Date", b"X-Date", 1)),
        "end": lead + frame(good[:-2] + b"xx"),
        "type": lead + frame(good.replace(b"WARC-Type: response", b"WARC-Type: whatever", 1)),
    }
    for name, data in cases.items():
        path = tmp_path / "bad.warc.zst"
        path.write_bytes(data)
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(str(path)))
            pytest.fail(name)


# packing


def _vocabulary():
    return queries.vocabulary("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    rng = random.Random(2)
    encoder = packing.Encoder(_vocabulary())
    texts = ["", " ", "I'll DON'T <|endoftext|> don't's", "a\x1cb\u0085c d", "ΑΣ İı ß ŉ ﬁ é", "x" * 500, "12ab_-9 ½²"] + [
        "".join(rng.choice("aB'sé1_. \t\nßÉñ<|>日×") for _ in range(rng.randrange(60))) for _ in range(400)
    ]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_takes_other_vocabularies_whole():
    encoder = packing.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    texts = ["", " two  blanks", "I'll DON'T", "new\n\nline 日本 é", "x" * 300]
    ids, bounds = encoder.encode(pa.array(texts))
    assert not encoder.by_words and packing.Encoder(_vocabulary()).by_words
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_production_weights_act():
    assert all(w > 0 for w in packing.PRODUCTION.weights)
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2500, 600)
    alone, acting = packing.best_fit(lengths, packing.Capacity()), packing.best_fit(lengths, packing.PRODUCTION)
    assert (alone[0] != acting[0]).any()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 400, 900)
    capacity = packing.Capacity(tokens=1000, documents=6, attention=300_000, weights=(1.0, 0.3, 0.5), rule=rule)
    sequence, offset = packing.best_fit(lengths, capacity)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert (np.cumsum(lengths[own]) - lengths[own] == offset[own]).all()
        assert lengths[own].sum() <= 1000 and len(own) <= 6 and (lengths[own].astype(int) ** 2).sum() <= 300_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([600]), capacity)


def test_best_fit_is_best_fit():
    lengths = np.array([60, 50, 40, 30, 20, 10, 5, 5])
    sequence, _ = packing.best_fit(lengths, packing.Capacity(tokens=100))
    left, expected = [], []
    for size in lengths:
        fits = [i for i, room in enumerate(left) if room >= size]
        pick = min(fits, key=lambda i: left[i], default=None)
        if pick is None:
            left.append(100)
            pick = len(left) - 1
        left[pick] -= size
        expected.append(pick)
    assert [sorted(lengths[sequence == s]) for s in np.unique(sequence)] == [sorted(lengths[np.array(expected) == s]) for s in sorted(set(expected))]


def test_packed_documents(spark, sf):
    rows = queries.op8_packing(spark, sf).toPandas()
    tokenizer = packing.Encoder(_vocabulary()).tokenizer
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for i, some in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids + [1], dtype="<u4")
        assert some.length.sum() == len(ids) and (some.length.iloc[:-1] == 4096).all() and (some.start == 4096 * some.piece).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(some.start, some.length, some.ids_crc32))
    assert set(rows.doc_id) == set(texts)
    placed = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (placed.cumsum() - rows.sort_values(["sequence_id", "offset"]).length == rows.sort_values(["sequence_id", "offset"]).offset).all()
    assert placed.sum().max() <= 4096 and rows.sequence_id.nunique() <= 1.01 * rows.length.sum() / 4096 + 1


def test_packing_edge_cases(spark):
    rows = packing.report(edge(spark), _vocabulary()).collect()
    assert len([r for r in rows if r.piece == 0]) == len(EDGE)
    assert sum(r.length for r in rows if r.doc_id in (3, 4, 7)) == 3
    assert packing.report(empty(spark), _vocabulary()).count() == 0
    many = spark.createDataFrame([(i, 0, 0, 1 + i % 7) for i in range(500)], "doc_id long, piece int, start long, length long")
    packed = packing.pack(many, packing.Capacity(tokens=10), group=100).toPandas()
    assert len(packed) == 500 and packed.groupby("sequence_id").length.sum().max() <= 10


# personal data


def naive_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and check % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_rules_against_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("aB1.@+- ()0-4%_\n5é") for _ in range(rng.randrange(70)))
        assert personal.base_spans(text) == naive_base(text), text
    assert personal.base_spans("a" * 200_000 + "@" + "1" * 100_000) == []


@pytest.fixture(scope="module")
def weights():
    return personal.train([SENTENCE, "some other carrier words for made examples"])


def test_field_gradient_is_the_slope(weights):
    text, spans = "call (555) 123-4567 or 4111 1111", [("phone", 5, 19)]
    lattice = personal.Lattice.of(text, 0, len(text))
    first = {a: i for i, (a, _) in enumerate(lattice.places)}
    last = {b: i + 1 for i, (_, b) in enumerate(lattice.places)}
    truth = [(first[a], last[b], personal.KINDS.index(k)) for k, a, b in spans]
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.3, weights.shape)
    segments = [(int(a), int(b), k) for a, b in zip(lattice.first, lattice.last) for k in range(4)]
    value = {(a, b, k): lattice.values[[i for i, x in enumerate(zip(lattice.first, lattice.last)) if x == (a, b)][0]] for a, b, k in segments}

    def log_likelihood(m):
        total = [0.0] + [-np.inf] * len(lattice.places)
        for j in range(1, len(total)):
            total[j] = np.logaddexp.reduce([total[j - 1]] + [total[a] + value[a, b, k] @ m[k] for a, b, k in segments if b == j])
        return sum(value[t] @ m[t[2]] for t in truth) - total[-1]

    g = personal.gradient(lattice, truth, w)
    for spot in itertools.islice(zip(*np.nonzero(g)), 0, 40, 5):
        moved = w.copy()
        moved[spot] += 1e-6
        assert abs((log_likelihood(moved) - log_likelihood(w)) / 1e-6 - g[spot]) < 1e-4


def test_decoding_is_the_best_segmentation():
    text = "x (555) 123-4567 y"
    lattice = personal.Lattice.of(text, 0, len(text))
    rng = np.random.default_rng(5)
    for _ in range(5):
        w = rng.normal(0, 1, (4, len(personal.NAMES)))
        scores = (lattice.values @ w.T).max(axis=1)
        spans = list(zip(lattice.first, lattice.last, scores))

        def best(at):
            if at == len(lattice.places):
                return 0.0
            return max([best(at + 1)] + [s + best(b) for a, b, s in spans if a == at])

        found = personal.decode(lattice, w)
        ends = {(lattice.places[a][0], lattice.places[b - 1][1]): s for a, b, s in spans}
        assert sum(ends[a, b] for _, a, b in found) == pytest.approx(best(0))


def test_field_on_made_examples(weights):
    rng, words, right = random.Random(99), ["river", "stone,", "Window", "of", "the"], 0
    for _ in range(300):
        text, spans = personal.made_example(rng, words)
        right += personal.decode(personal.Lattice.of(text, 0, len(text)), weights) == spans
    assert right / 300 > 0.85


def test_field_adds_and_never_takes(weights):
    text = "mail joe.doe [at] mail [dot] org or (212) 555-0187, else a@b.example.com and 10.0.0.1; born 2001-02-03, no 1234567812345678"
    base, every = personal.all_spans(text, weights)
    assert set(base) <= set(every) and ("phone", text.index("(212)"), text.index(", else")) in every
    assert not any(a < y and x < b for i, (_, a, b) in enumerate(every) for _, x, y in every[:i])
    assert not any("2001" in text[a:b] or "12345678" in text[a:b] for _, a, b in every)


def test_regions_hold_whole_spans(weights):
    mail = "jane [at] mail [dot] example-company [dot] com"
    long = "a.very.long.local.part.of.an.address1 [at] mail [dot] org"
    for span in (mail, long, "10[.]0[.]0[.]1", "8[.]8[.]8[.]8", "8(.)8(.)8(.)8"):
        text = f"some words before {span} and words after it\nnext line"
        at = text.index(span)
        assert any(a <= at and at + len(span) <= b for a, b in personal.regions(text, personal.base_spans(text))), span
    for span in ("10[.]0[.]0[.]1", "8[.]8[.]8[.]8"):
        text = f"the host {span} of the net"
        assert ("ip", 9, 9 + len(span)) in personal.all_spans(text, weights)[1]
    assert not personal.regions("versions 1.2.3 and words only", [])


def test_personal_edge_cases(spark):
    rows = personal.report(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    texts = [t or "" for _, t, *_ in EDGE]
    expected = sorted(hashlib.sha256(personal.joined(naive_base(t)).encode()).hexdigest() for t in texts)
    assert sorted(r.base_sha256 for r in rows) == expected
    assert personal.report(empty(spark)).count() == 0


def test_personal_on_documents(spark, sf):
    found = by_id(queries.op9_personal(spark, sf))
    for r in table(spark, sf, "documents").collect():
        base, row = naive_base(r.text or ""), found[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(personal.joined(base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, _, _ in base) for x in personal.KINDS]
        assert set(filter(None, personal.joined(base).split(","))) <= set(row.spans.split(","))


# SQL twins


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for view in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{sf}/{view}.parquet'")
    ours = queries.QUERIES[name](spark, sf)
    theirs = con.sql(queries.ORACLE[name])
    order = [theirs.columns.index(c) for c in ours.columns]
    found = sorted(tuple(map(repr, r)) for r in ours.collect())
    assert found == sorted(tuple(repr(r[i]) for i in order) for r in theirs.fetchall()) and found
