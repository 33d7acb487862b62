"""Exact, near, line and passage duplicates against brute force."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGE, LONG, SENTENCE, by_id, docs, edge, empty

from foldstack.llm import components, exact, passages, simhash, units

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact


def test_fingerprints_combine():
    rng = random.Random(1)
    for _ in range(40):
        a, b = (bytes(rng.randrange(1, 256) for _ in range(rng.randrange(5000))) for _ in range(2))
        for which in (0, 1):
            left = (exact.polynomial(a)[which], len(a))
            right = (exact.polynomial(b)[which], len(b))
            assert exact.combine(left, right, which) == (exact.polynomial(a + b)[which], len(a + b))


def test_fingerprint_is_the_polynomial():
    data = bytes(random.Random(2).randrange(256) for _ in range(3000))
    for which, prime in enumerate(exact.PRIMES):
        value = 0
        for byte in data:
            value = (value * exact.BASES[which] + byte) % prime
        assert exact.polynomial(data)[which] == value


def test_exact_edge_cases(spark):
    rows = exact.report(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    groups = defaultdict(list)
    for i, t, *_ in EDGE:
        groups[(t or "").translate(ASCII)].append(i)
    found = defaultdict(list)
    for r in rows:
        found[r.text_sha256].append(r)
    for text, ids in groups.items():
        some = found[hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in some)
        assert all(r.keep_id == keep and r.group_size == len(ids) and r.kept == (r.doc_id == keep) for r in some)


def test_collisions_are_told_apart(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcdefgh") * 3 + rng.choice("ab")) for i in range(120)]
    classes = exact.exact_classes(docs(spark, rows), primes=(3, 2)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    expected = {i: (max(g), len(g)) for g in groups.values() for i in g}
    assert {r.id: (r.keep, r.size) for r in classes} == expected


def test_keep_latest(spark):
    kept = exact.keep_latest(edge(spark))
    assert kept.columns == edge(spark).columns
    rows = kept.collect()
    assert len(rows) == len({(t or "").translate(ASCII) for _, t, *_ in EDGE})
    assert {r.doc_id for r in rows if r.text and r.text.lower() == SENTENCE} == {2}
    assert exact.keep_latest(empty(spark)).count() == 0 and exact.report(empty(spark)).count() == 0


# near


def brute_simhash(text, n=3):
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", text.translate(ASCII).encode())
    pieces = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    values = sorted(set(fps.values()))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fps.items():
        root = find(f)
        least[root] = min(i, least.get(root, i))
    return {i: least[find(f)] for i, f in fps.items()}


@pytest.mark.parametrize("text", ["", "one", "one two", SENTENCE, SENTENCE.upper(), "a\x1fb\tc\x0bd é É", "x " * 300, LONG[:70_000]])
def test_simhash_value(text):
    assert simhash.simhash(text) == brute_simhash(text)


def _cluster(rng, n, flips):
    centres = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    out = set()
    for _ in range(n):
        value = centres[rng.integers(5)]
        for bit in set(rng.integers(0, 64, rng.integers(0, flips + 1)).tolist()):
            value ^= 1 << bit
        out.add(value)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_trie_join_finds_every_pair(bits, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 1)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    values = _cluster(np.random.default_rng(bits), 300, 3)
    found = {(min(a, b), max(a, b)) for left, right in simhash.linked_pairs(values, bits) for a, b in zip(left.tolist(), right.tolist())}
    i, j = np.triu_indices(len(values), 1)
    near = np.bitwise_count(values[i] ^ values[j]) <= bits
    assert found == set(zip(i[near].tolist(), j[near].tolist()))


@pytest.mark.parametrize("subtree", [1 << 16, 20])
def test_links_join_what_is_near(spark, subtree):
    values = _cluster(np.random.default_rng(9), 400, 4)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.connected(simhash.links(frame, 2, subtree)).collect()}
    signed = {int(v): int(s) for v, s in zip(values, values.view(np.int64))}
    expected = brute_components({v: v for v in signed}, 2)
    ours = {v: roots.get(s, s) for v, s in signed.items()}
    together = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert together(ours) == together(expected)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "src long, dst long")
    roots = {r.node: r.root for r in components.connected(edges).collect()}
    assert roots == dict.fromkeys(range(201), 0) | {1000: 1000, 1001: 1000}


def test_simhash_edge_cases(spark):
    rows = simhash.report(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    fps = {(2**63 - 1 if i is None else i, t): brute_simhash(t or "") for i, t, *_ in EDGE}
    expected = brute_components({k: v for k, v in fps.items()} and {(i, str(t)): v for (i, t), v in fps.items()}, 2)
    shown = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows)
    want = []
    for i, t, *_ in EDGE:
        number = 2**63 - 1 if i is None else i
        least = expected[(number, str(t))][0]
        want.append((str(i), f"{fps[(number, t)]:016x}", str(None if least == 2**63 - 1 else least)))
    assert shown == sorted(want)
    kept = simhash.keep_first(edge(spark))
    assert kept.columns == edge(spark).columns and kept.count() == len({c for _, _, c in want})
    assert simhash.keep_first(empty(spark)).count() == 0 and simhash.report(empty(spark)).count() == 0


# lines


BLANK = " \t\r\v\f\n"


def brute_units(text):
    """Units by a scan of characters."""
    out, at, i = [], 0, 0
    while i < len(text):
        stop = text[i] in "\n\u3002\uff01\uff1f" or text[i] in ".!?" and i + 1 < len(text) and text[i + 1] in BLANK
        i += 1
        if stop:
            while i < len(text) and text[i] in BLANK:
                i += 1
            out.append((at, i))
            at = i
    return out + ([(at, len(text))] if at < len(text) else [])


def brute_dedup(rows, least):
    seen, expected = set(), {}
    for i, text in rows:
        cut, later = brute_units(text), []
        for a, b in cut:
            form = " ".join(text[a:b].lower().split())
            later.append((a, b, len(form), form in seen and form != ""))
            seen.add(form)
        gone, k = [], 0
        while k < len(later):
            m = k
            while m < len(later) and later[m][3]:
                m += 1
            if sum(x[2] for x in later[k:m]) >= least and m > k:
                gone += [(a, b) for a, b, _, _ in later[k:m]]
            k = m + 1
        kept = "".join(text[a:b] for a, b in cut if (a, b) not in gone)
        spans = ",".join(f"{a}:{b}" for a, b in gone)
        expected[i] = (len(cut), len(gone), spans, hashlib.sha256(kept.encode()).hexdigest())
    return expected


def test_units_are_the_text():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice("ab.!? \n\t\u3002") for _ in range(rng.randrange(40)))
        assert units.split_units(text) == brute_units(text)


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "3.5", "\u65e5\u672c\u8a9e\u3002", "www.example.org/" + "x" * 130]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 12))) + rng.choice([".", "!?", ""]) for _ in range(40)]
    rows = []
    for i in range(120):
        some = [rng.choice(pool) + rng.choice(["\n", " ", "\n\n ", "\t"]) for _ in range(rng.randrange(9))]
        rows.append((i, "".join(some) + (" ".join(f"own{i}" for _ in range(rng.randrange(3))))))
    expected = brute_dedup(rows, units.STRETCH)
    assert {i: tuple(r)[1:] for i, r in by_id(units.report(docs(spark, rows))).items()} == expected
    assert 20 < sum(e[1] > 0 for e in expected.values()) < 115


def test_lines_edge_cases(spark):
    rows = units.report(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    lost = {r.doc_id: r.n_removed for r in rows}
    assert len(SENTENCE) < units.STRETCH and lost[2] == 0  # a repeat that is too short stays
    assert lost[6] == 1 and lost[1] == 0 and lost[5] == 0 and lost[3] == 0
    assert units.report(empty(spark)).count() == 0


# passages


def brute_passages(rows):
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], 1 << 63))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].any())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def _passage_rows(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab c") for _ in range(3000))
    rows = []
    for d in range(50):
        text = ""
        for _ in range(rng.randrange(5)):
            at = rng.randrange(2800)
            text += rng.choice(
                [base[at : at + rng.randrange(20, 200)], "a" * rng.randrange(150), "ab" * rng.randrange(70), "".join(rng.choice("xyzé\x00") for _ in range(40))]
            )
        rows.append((d, text))
    return rows + [(60, ""), (61, "a" * 49), (62, "a" * 50), (63, "b" * 51), (63, "a" * 60)]


@pytest.mark.parametrize("seed", range(4))
def test_passages_in_pieces_and_batches(seed, monkeypatch):
    monkeypatch.setattr(passages, "PIECE_BYTES", 700)
    monkeypatch.setattr(passages, "BATCH", 60)
    rows = [(d, t.encode()) for d, t in _passage_rows(seed)]
    for groups, parts in ((1, 1), (3, 2), (7, 5)):
        made = [
            passages.Group(pa.table({"id": pa.array([d for d, _ in some], pa.int64()), "text": pa.array([t.decode() for _, t in some], pa.string())}), parts)
            for g in range(groups)
            for some in [[r for r in rows if r[0] % groups == g]]
        ]

        def meet(sent, answer):
            replies = [[] for _ in made]
            for part in range(parts):
                who = [(i, dict(s)[part]) for i, s in enumerate(sent) if part in dict(s)]
                for (i, _), reply in zip(who, answer([b for _, b in who]) if who else []):
                    replies[i].append((part, reply))
            return replies

        for group, bits in zip(made, meet([g.keys() for g in made], passages.shared_keys)):
            group.choose(bits)
        out = []
        for group, replies in zip(made, meet([passages.send(g) for g in made], passages.match)):
            gone = passages.covered(group, replies)
            for k, d in enumerate(group.ids):
                lo, hi = group.bounds[k], group.bounds[k + 1]
                m = gone[lo:hi]
                spans = int(np.count_nonzero(m[1:] & ~m[:-1]) + m[:1].any())
                out.append((int(d), int(hi - lo), int(m.sum()), spans, hashlib.sha256(group.data[lo:hi][~m].tobytes()).hexdigest()))
        assert sorted(out) == brute_passages(rows)


def test_family_merges_levels():
    rng = np.random.default_rng(3)
    family, seen = passages.Family(), {}
    for _ in range(40):
        docs_ = rng.integers(0, 1000, 64)
        windows = np.array([b"%050d" % x for x in rng.integers(0, 1500, 64)], dtype="S50")
        numbers = family.add(windows, docs_)
        for w, d, n in zip(windows.tolist(), docs_.tolist(), numbers.tolist()):
            number, least = seen.get(w, (n, d))
            assert number == n
            seen[w] = (n, min(least, d))
    assert all(family.earliest[n] == d for n, d in seen.values())
    assert len(family.levels) <= 12 and sum(len(k) for k, _ in family.levels) == len(seen)


def test_passages_in_spark(spark, monkeypatch):
    monkeypatch.setattr(passages, "GROUP_BYTES", 3000)
    monkeypatch.setattr(passages, "ANCHOR_BYTES", 2000)
    rows = _passage_rows(9)
    found = sorted(tuple(r) for r in passages.report(docs(spark, rows)).collect())
    assert found == brute_passages([(d, t.encode()) for d, t in rows])


def test_passages_edge_cases(spark):
    rows = passages.report(edge(spark)).collect()
    expected = brute_passages([(2**63 - 1 if i is None else i, (t or "").encode()) for i, t, *_ in EDGE if i not in (5, 6)])
    found = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in rows if r.doc_id not in (5, 6))
    assert found == expected
    long = {r.doc_id: r for r in rows}
    assert long[6].n_removed == long[6].n_bytes == len(LONG) and long[6].n_spans == 1 and long[5].n_removed == 0
    assert passages.report(empty(spark)).count() == 0


# near copies that are more than a few bits apart


def test_near_copies_of_many_bits(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    edit = lambda places: " ".join("changed" if i in places else w for i, w in enumerate(base))
    # copies with one word changed (0.94), three (0.82) and nine (0.55), and an unrelated text
    rows = [(1, edit({80})), (2, edit({20, 80, 140})), (3, edit(set(range(8, 160, 17)))), (4, " ".join(base)), (5, " ".join(reversed(base)))]
    rows += [(6, None), (7, " \n"), (None, " ".join(base)), (8, "one two"), (8, "one three")]

    def jaccard(a, b):
        cut = lambda t: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))}
        return len(cut(a) & cut(b)) / len(cut(a) | cut(b))

    apart = (brute_simhash(rows[0][1]) ^ brute_simhash(rows[1][1])).bit_count()
    assert 4 < apart and jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1])
    bits = max((brute_simhash(rows[0][1]) ^ brute_simhash(rows[i][1])).bit_count() for i in (1, 2, 3))
    kept = simhash.keep_first_alike(docs(spark, rows), bits)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(rows[i] for i in (0, 2, 4, 5, 8, 9))


def test_confirmed_links_against_brute_force(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    rows = sorted((r.doc_id, r.text or "") for r in given.collect())
    sets = [{tuple(t.translate(ASCII).split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    fps, root = [brute_simhash(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if (fps[i] ^ fps[j]).bit_count() <= 11 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert sorted(r.doc_id for r in simhash.keep_first_alike(given, 11).collect()) == sorted({rows[x][0] for x in root})


def test_direct_pairs_equal_the_trie():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 20, 500, dtype=np.uint64))
    pairs = {(int(a), int(b)) for x in simhash.linked_pairs(values, 5) for a, b in zip(*x)}
    assert pairs == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).item().bit_count() <= 5}


def test_large_groups_are_confirmed_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    # one group of candidates: unlike texts under a wide budget, with chains of near copies among them
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    for i in range(60, 120):
        words = rows[rng.randrange(i)][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    for block in (7, 1000):
        monkeypatch.setattr(simhash, "BLOCK", block)
        kept = simhash.keep_first_alike(docs(spark, rows), 45, share=0.7)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("many", [3, 1000])
def test_only_texts_with_a_run_in_common_are_compared(spark, many):
    rng = np.random.default_rng(6)
    heads = rng.integers(0, 2**63, 6).astype(np.uint64)
    fps = np.concatenate([h ^ (np.uint64(1) << rng.integers(0, 63, 25).astype(np.uint64)) for h in heads])  # all of a head are near
    runs = [sorted({int(x) for x in rng.integers(0, 30, 2)} | ({99} if i % 25 < 20 and i < 25 else set())) for i in range(len(fps))]
    rows = spark.createDataFrame([(int(f), r) for f, r in zip(fps.view(np.int64), runs)], "fp long, runs array<long>")
    found = simhash.shared_links(rows, 4, many=many)
    root = {int(f): int(f) for f in fps.view(np.int64)}
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4 and set(runs[i]) & set(runs[j]):
                a, b = sorted((root[int(fps.view(np.int64)[i])], root[int(fps.view(np.int64)[j])]))
                root = {k: a if v == b else v for k, v in root.items()}
    joined = {r.node: r.root for r in components.connected(found).collect()}
    for i, j in itertools.combinations(root, 2):
        if root[i] == root[j]:
            assert joined[i] == joined[j]  # every such pair is a candidate
    if many == 1000:
        shared = {int(f): set() for f in fps.view(np.int64)}
        for f, r in zip(fps.view(np.int64), runs):
            shared[int(f)] |= set(r)
        assert all(shared[r.src] & shared[r.dst] for r in found.collect())  # and no other: near ones without a run are apart


def test_alike_texts_share_a_first_run(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(3, 90, 60)]
    for t in list(texts):
        w = t.split()
        w[int(rng.integers(len(w)))] = "other"
        texts += [" ".join(w), t + " end", " ".join(t.split()[1:])]
    frame = spark.createDataFrame([(i, t, bytes([i % 256])) for i, t in enumerate(texts)], "id long, text string, mark binary")
    first = {r.id: set(r.runs) for r in simhash._first_shingles(frame, 5, 0.8).collect()}
    sets = [simhash.shingles(t) for t in texts]
    alike = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if simhash.alike(sets[i], sets[j])]
    assert len(alike) > 60 and all(first[i] & first[j] for i, j in alike)
    assert sum(map(len, first.values())) < 0.35 * sum(map(len, sets))
