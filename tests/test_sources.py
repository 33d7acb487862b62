import hashlib
import os
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from foldstack.operators import contract, splits
from foldstack.queries import modelling
from foldstack.sources import artifacts, snapshots, scratch, synthetic, tables


@pytest.fixture()
def windows(spark):
    return spark.createDataFrame(
        [(str(i), "ab"[i % 2], [float(i), i / 3]) for i in range(20)],
        "window_id string, label string, features array<double>",
    )


@pytest.mark.parametrize("fmt", tables.FORMATS)
def test_formats_round_trip(spark, windows, tmp_path, fmt):
    path = str(tmp_path / fmt)
    tables.write_dataset(windows, path, fmt)
    back = contract.conform(tables.read_dataset(spark, path, fmt))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, windows.collect()))


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="csv, parquet, json"):
        tables.read_dataset(spark, "x", "feather")


def test_splits_are_kept_per_seed_and_k(spark, windows, tmp_path):
    base = str(tmp_path)
    for seed, k in [(1, 3), (2, 3), (1, 4)]:
        tables.save_split(splits.fit_folds(windows, seed, k), windows, base)
    assert tables.load_split(spark, base, 2, 3) == splits.fit_folds(windows, 2, 3)
    assert tables.load_folds(spark, base, 1, 4).count() == 20
    stored = {r["window_id"]: r["fold"] for r in tables.load_folds(spark, base, 1, 3).collect()}
    fresh = {r["window_id"]: r["fold"] for r in splits.assign_folds(windows, 1, 3).collect()}
    assert stored == fresh
    for load in (tables.load_split, tables.load_folds):
        with pytest.raises(FileNotFoundError):
            load(spark, base, 9, 3)


def test_saving_oof_replaces_only_its_own_partition(spark, tmp_path):
    base = str(tmp_path)

    def rows(model, value):
        return spark.createDataFrame(
            [("1", 0, [value], model, 5)],
            "window_id string, fold int, proba array<double>, model string, seed long",
        )

    tables.save_oof(rows("a", 0.1), base)
    tables.save_oof(rows("b", 0.2), base)
    tables.save_oof(rows("a", 0.3), base)
    got = {r["model"]: r["proba"] for r in tables.load_oof(spark, base, ["a", "b"], 5).collect()}
    assert got == {"a": [0.3], "b": [0.2]}
    with pytest.raises(FileNotFoundError, match="model=c"):
        tables.load_oof(spark, base, ["a", "c"], 5)
    read = tables.load_oof(spark, base, ["a"], 5).inputFiles()
    assert read and all("/model=a/" in path for path in read)


def test_synthetic_values_do_not_depend_on_partitioning(spark):
    table = synthetic.synthetic_windows(spark, 400)
    ids = spark.range(400).repartition(13)
    again = synthetic.windows_for(ids, "id", 1337)
    assert table.exceptAll(again).isEmpty()
    assert {r["label"]: r["count"] for r in table.groupBy("label").count().collect()} == {
        "class_A": 200,
        "class_B": 200,
    }
    stats = table.select(F.explode("features").alias("x")).agg(F.avg("x"), F.stddev("x"), F.count("x")).first()
    assert abs(stats[0]) < 0.06 and abs(stats[1] - 1) < 0.06 and stats[2] == 4000
    other = synthetic.synthetic_windows(spark, 400, seed=1)
    assert other.exceptAll(table).count() == 400


def _write(path: Path, text: str):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_manifest_detects_changes(spark, tmp_path):
    root = tmp_path / "artifacts"
    for name in ("a/part-0.json", "a/x.csv", "b/deep/y.parquet"):
        _write(root / name, name)
    _write(root / "notes.txt", "not an artifact")
    _write(root / "manifest.json", "{}")
    hashes = {r["rel_path"]: r["sha256"] for r in artifacts.artifact_hashes(spark, str(root)).collect()}
    assert hashes == {
        n: hashlib.sha256(n.encode()).hexdigest() for n in ("a/part-0.json", "a/x.csv", "b/deep/y.parquet")
    }
    header, entries = artifacts.create_manifest(spark, str(root), ["rf"], "abc1234", {"seed": 7})
    artifacts.write_manifest(header, entries, str(root))
    head = artifacts.read_manifest(spark, str(root))[0].first()
    assert head["models"] == ["rf"] and head["git_sha"] == "abc1234" and head["metadata"] == {"seed": "7"}
    assert head["created_at"].endswith("Z")

    def verified():
        return {r["rel_path"]: r["ok"] for r in artifacts.verify_manifest(spark, str(root)).collect()}

    assert set(verified().values()) == {True}
    _write(root / "a/x.csv", "tampered")
    os.remove(root / "b/deep/y.parquet")
    _write(root / "a/extra.csv", "unlisted")
    assert verified() == {"a/part-0.json": True, "a/x.csv": False, "b/deep/y.parquet": False}
    failed = artifacts.first_failures(artifacts.verify_manifest(spark, str(root)))
    assert [r["rel_path"] for r in failed.collect()] == ["a/x.csv", "b/deep/y.parquet"]


def test_relative_paths_start_at_the_root(spark, tmp_path):
    root = tmp_path / "run"
    _write(root / "models" / "run" / "x.csv", "x")
    for uri in (str(root), f"file:{root}", f"file://{root}/"):
        rows = artifacts.artifact_hashes(spark, uri).collect()
        assert [r["rel_path"] for r in rows] == ["models/run/x.csv"]


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "PIECE_BYTES", 16)
    _write(tmp_path / "small.csv", "x")
    _write(tmp_path / "large file%.csv", "x" * 100)
    rows = artifacts.artifact_hashes(spark, str(tmp_path), whole_bytes=50).collect()
    hashes = {r["rel_path"]: r["sha256"] for r in rows}
    assert hashes == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in (("small.csv", "x"), ("large file%.csv", "x" * 100))}
    assert all(r["error"] is None for r in rows)


def test_tampering_with_a_large_file_is_seen(spark, tmp_path):
    _write(tmp_path / "large.csv", "x" * 100)
    hashed = artifacts.artifact_hashes(spark, str(tmp_path), whole_bytes=50)
    before = spark.createDataFrame(hashed.collect(), hashed.schema)
    _write(tmp_path / "large.csv", "y" * 100)
    after = artifacts.artifact_hashes(spark, str(tmp_path), whole_bytes=50)
    assert [r["ok"] for r in artifacts.compare_hashes(before, after).collect()] == [False]


def test_error_texts_never_match(spark):
    same = spark.createDataFrame([("a", "error: file of 100 bytes"), ("b", None)], "rel_path string, sha256 string")
    assert [r["ok"] for r in artifacts.compare_hashes(same, same).collect()] == [False, False]


def test_unreadable_files_have_an_error(spark, tmp_path):
    paths = spark.createDataFrame([("x", f"file:{tmp_path}/none.bin")], "rel_path string, path string")
    row = artifacts._streamed(paths).first()
    assert row["sha256"] is None and "none.bin" in row["error"]
    assert artifacts.unreadable(artifacts._streamed(paths)).count() == 1


def test_only_the_roots_own_manifest_is_left_out(spark, tmp_path):
    for name in ("manifest/part-0.json", "manifest.json", "sub/manifest/part-0.parquet", "sub/manifest.json", "a.csv"):
        _write(tmp_path / name, name)
    rows = artifacts.artifact_hashes(spark, str(tmp_path)).collect()
    assert {r["rel_path"] for r in rows} == {"sub/manifest/part-0.parquet", "a.csv"}


def test_no_manifest_verifies_nothing(spark, tmp_path):
    assert artifacts.verify_manifest(spark, str(tmp_path)).isEmpty()


def test_one_file(spark, tmp_path):
    _write(tmp_path / "d/x.bin", "hello")
    digest = hashlib.sha256(b"hello").hexdigest()
    assert artifacts.verify_file(spark, str(tmp_path), "d/x.bin", digest.upper())
    assert not artifacts.verify_file(spark, str(tmp_path), "d/x.bin", "0" * 64)
    assert not artifacts.verify_file(spark, str(tmp_path), "d/none.bin", digest)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert scratch.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_uri(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_cluster_must_name_the_shared_folder():
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.checkpoint_dir(session)


def test_run_text_format(spark):
    run = spark.createDataFrame([("dev", "rf", "abc", 0.123456, 0.5, 1.239)], tables.RUNS_SCHEMA)
    row = tables.runs_as_text(run).first()
    assert (row["accuracy"], row["f1"], row["duration"]) == ("0.1235", "0.5000", "1.24")


STEPS = ("write", "switch", "sweep")


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("what", ["table", "split", "oof", "metrics", "manifest"])
def test_a_writer_that_dies_leaves_the_old_table_or_the_new_one(spark, windows, tmp_path, monkeypatch, what, step):
    base = str(tmp_path)
    fold = splits.fit_folds(windows, 1, 3)
    oof = lambda v: spark.createDataFrame([("1", 0, [v], "a", 5)], "window_id string, fold int, proba array<double>, model string, seed long")

    def store(n):
        """One of several generations of the table."""
        if what == "table":
            tables.write_windows(windows.limit(n), base)
        elif what == "split":
            tables.save_split(fold, windows.limit(n), base, f"v{n}")
        elif what == "oof":
            tables.save_oof(oof(float(n)), base, f"v{n}")
        elif what == "metrics":
            tables.save_metrics(spark.createDataFrame([("a", float(n))], "model string, accuracy double"), base, "a")
        else:
            header, entries = artifacts.create_manifest(spark, base, metadata={"n": n})
            artifacts.write_manifest(header, entries, base)

    def seen():
        """The generation that a reader sees, table and version alike."""
        if what == "table":
            rows, version = tables.windows_and_version(spark, base)
            assert version.split(":")[0] == str(rows.count())
            return rows.count()
        if what == "split":
            n = tables.load_folds(spark, base, 1, 3).count()
            assert tables.load_split(spark, base, 1, 3) == fold and tables.marked_version(spark, base, tables.split_key(1, 3)) == f"v{n}"
            return n
        if what == "oof":
            n = int(tables.load_oof(spark, base, ["a"], 5).first()["proba"][0])
            assert tables.marked_version(spark, base, tables.oof_key("a", 5)) == f"v{n}"
            return n
        if what == "metrics":
            return int(tables.load_metrics(spark, base, ["a"]).first()["accuracy"])
        return int(artifacts.read_manifest(spark, base)[0].first()["metadata"]["n"])

    def fail(*args, **rest):
        raise RuntimeError("the writer died")

    for n in (4, 6, 8):
        store(n)
        assert seen() == n
    if step == "write":
        monkeypatch.setattr(snapshots, "point", fail)
    elif step == "switch":
        monkeypatch.setattr(snapshots, "_switch", fail)
    else:
        monkeypatch.setattr(snapshots, "remove", fail)
    with pytest.raises(RuntimeError, match="died"):
        store(10)
    monkeypatch.undo()
    assert seen() == (10 if step == "sweep" else 8)
    store(12)
    assert seen() == 12


def test_readers_keep_the_snapshot_they_hold(spark, windows, tmp_path):
    base = str(tmp_path)
    tables.write_windows(windows.limit(4), base)
    held = tables.read_windows(spark, base)
    tables.write_windows(windows.limit(6), base)
    assert held.count() == 4 and tables.read_windows(spark, base).count() == 6
    tables.write_windows(windows.limit(8), base)  # the first one goes now
    assert len(list((tmp_path / "snapshots" / "train").iterdir())) == 2


def test_ranges_of_a_file_are_hashed_and_checked_apart(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    data = bytes(i * 7 % 251 for i in range(10_000))
    (root / "large.csv").write_bytes(data)
    (root / "empty.csv").write_bytes(b"")
    (root / "even.csv").write_bytes(data[:2000])
    (root / "gone.csv").write_bytes(data[:10])
    ranges = artifacts.range_digests(spark, str(root), range_bytes=1000)
    found = {(r["rel_path"], r["start"]): (r["length"], r["sha256"]) for r in ranges.collect()}
    wanted = {("large.csv", i): (1000, hashlib.sha256(data[i : i + 1000]).hexdigest()) for i in range(0, 10_000, 1000)}
    wanted |= {("even.csv", i): (1000, hashlib.sha256(data[i : i + 1000]).hexdigest()) for i in (0, 1000)}
    wanted["gone.csv", 0] = (10, hashlib.sha256(data[:10]).hexdigest())
    assert found == wanted  # Spark lists no empty files
    trees = {r["rel_path"]: r for r in artifacts.tree_digests(ranges).collect()}
    joined = "".join(wanted["large.csv", i][1] for i in range(0, 10_000, 1000))
    assert trees["large.csv"]["sha256"] == hashlib.sha256(joined.encode()).hexdigest() and trees["large.csv"]["n_bytes"] == 10_000
    assert artifacts.verify_ranges(spark, str(root), 1000).isEmpty()
    header, entries = artifacts.create_manifest(spark, str(root))
    artifacts.write_manifest(header, entries, str(root), ranges)
    assert artifacts.verify_ranges(spark, str(root), 1000).where("not ok").isEmpty()
    (root / "large.csv").write_bytes(data[:3500] + b"!" + data[3501:] + b"more")
    (root / "even.csv").write_bytes(data[:1500])
    (root / "gone.csv").unlink()
    (root / "other.csv").write_bytes(b"not listed")
    failed = {(r["rel_path"], r["start"]) for r in artifacts.verify_ranges(spark, str(root), 1000).where("not ok").collect()}
    assert failed == {("large.csv", 3000), ("large.csv", 10_000), ("even.csv", 1000), ("gone.csv", 0)}


def test_a_file_per_label_is_written_without_a_sort(spark, tmp_path, monkeypatch):
    labels = ["A", "N", None, "A", "N/x", "A"]
    rows = spark.createDataFrame([(f"w{i}", c, [float(i)]) for i, c in enumerate(labels)], "window_id string, label string, features array<double>")
    monkeypatch.setattr(modelling.fx, "large_windows", lambda *args: rows.repartition(3))

    def refused(*args):
        raise AssertionError("a partitioned write sorts the rows of its task")

    monkeypatch.setattr(DataFrameWriter, "partitionBy", refused)
    root = modelling._files_by_label(spark, "unused")
    found = artifacts.artifact_hashes(spark, root)
    assert found.count() == 4 and found.where("error is not null").isEmpty()
    read = spark.read.parquet(f"{root}/windows").groupBy("label").agg(F.sort_array(F.collect_list("window_id")).alias("ids"))
    assert {r["label"]: r["ids"] for r in read.collect()} == {"A": ["w0", "w3", "w5"], "N": ["w1"], None: ["w2"], "N/x": ["w4"]}
