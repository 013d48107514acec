"""Exactly-one selection: ties, nulls, repeated rows, batches, skew, failures between batches."""

import random

import pytest

from plumbline.operators import delivery
from plumbline.operators.delivery import SeenStore
from plumbline.scratch import shared_dir
from plumbline.streaming import ledger

SCHEMA = "no long, job string, gen long, at long, bits string"
KEYS = {"job": "string", "gen": "long"}


def store(spark, tmp_path, shards=4):
    return SeenStore(spark, f"file://{tmp_path}/seen", KEYS, shards)


def ids(df):
    return sorted(r.no for r in df.collect())


def test_earliest_then_smallest_stays(spark, tmp_path):
    rows = [(1, "a", 1, 5, None), (2, "a", 1, 4, None), (3, "a", 1, 4, None), (4, "a", 2, 9, None), (5, None, 1, 1, None), (6, "b", None, 1, None), (7, "c", 1, None, None), (8, "c", 1, 3, None)]
    batch = store(spark, tmp_path).accept(spark.createDataFrame(rows, SCHEMA), "no", ["at"])
    assert ids(batch.kept) == [2, 4, 8]
    assert ids(batch.dropped) == [1, 3, 7]


def test_exactly_repeated_rows_keep_one(spark, tmp_path):
    rows = [(1, "a", 1, 5, None)] * 3
    batch = store(spark, tmp_path).accept(spark.createDataFrame(rows, SCHEMA), "no", ["at"])
    assert ids(batch.kept) == [1]
    assert ids(batch.dropped) == [1, 1]


def test_empty_and_clashing_columns(spark, tmp_path):
    seen = store(spark, tmp_path)
    empty = seen.accept(spark.createDataFrame([], SCHEMA), "no", ["at"])
    assert ids(empty.kept) == [] and ids(empty.dropped) == [] and seen.count() == 0
    named = spark.createDataFrame([(1, "a", 1, 5, "x", 3, 4)], SCHEMA + ", shard long, ordinal long")
    kept = seen.accept(named, "no", ["at"]).kept
    assert kept.columns == named.columns
    assert kept.first().shard == 3


def test_batches_match_one_pass(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", *map(str, range(40))]) if rng.random() < 0.7 else "hot", rng.randrange(3), i, None) for i in range(600)]
    seen, kept = store(spark, tmp_path), []
    for start in range(0, 600, 200):
        kept += ids(seen.accept(spark.createDataFrame(rows[start : start + 200], SCHEMA), "no", ["at"]).kept)
    first = {}
    for no, job, gen, at, _ in rows:
        first.setdefault((job, gen), no)
    assert sorted(kept) == sorted(first.values())
    assert seen.count() == len(first) and seen.version() == 3


def _files(tmp_path):
    return {f.relative_to(tmp_path / "seen"): f.stat().st_size for f in (tmp_path / "seen").rglob("*.parquet")}


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    """A second small batch leaves the first one's parts alone and adds little."""
    seen = store(spark, tmp_path)
    first = spark.range(60_000).selectExpr("id AS no", "concat('job-', id) AS job", "id % 3 AS gen", "id AS at", "CAST(NULL AS STRING) AS bits")
    seen.accept(first, "no", ["at"])
    before = _files(tmp_path)
    again = spark.createDataFrame([(70_000, "job-5", 2, 9, None), (70_001, "new", 1, 9, None)], SCHEMA)
    assert ids(seen.accept(again, "no", ["at"]).kept) == [70_001]
    after = _files(tmp_path)
    added = {f: n for f, n in after.items() if f not in before}
    assert {f for f in before if f not in after and not str(f).startswith("tops")} == set()
    assert sum(n for f, n in added.items() if str(f).startswith("dictionary")) < 5_000 < sum(before.values()) / 20
    assert seen.count() == 60_001


def test_parts_are_compacted_and_swept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "COMPACT", 2)
    seen, kept = store(spark, tmp_path), []
    rows = [(i, f"j{i % 7}", i % 2, i, None) for i in range(28)]
    for start in range(0, 28, 7):
        kept += ids(seen.accept(spark.createDataFrame(rows[start : start + 7], SCHEMA), "no", ["at"]).kept)
    assert sorted(kept) == list(range(14)) and seen.count() == 14 and seen.version() == 4
    # Three parts were written as one, and the fourth came after.
    assert len({str(f).split("/")[0] for f in _files(tmp_path) if str(f).startswith("bitmaps")}) <= 2
    seen.compact()
    assert len({str(f).split("/")[0] for f in _files(tmp_path)}) == 3 and seen.count() == 14
    assert ids(seen.accept(spark.createDataFrame(rows, SCHEMA), "no", ["at"]).kept) == []


def test_a_job_that_dies_before_the_rename_leaves_the_former_state(spark, tmp_path, monkeypatch):
    seen = store(spark, tmp_path)
    seen.accept(spark.createDataFrame([(1, "a", 1, 5, None)], SCHEMA), "no", ["at"])
    later = spark.createDataFrame([(2, "a", 1, 6, None), (3, "b", 1, 6, None)], SCHEMA)

    def dies(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(SeenStore, "_commit", dies)
        with pytest.raises(OSError, match="lost"):
            seen.accept(later, "no", ["at"])
    again = store(spark, tmp_path)
    assert again.version() == 1 and again.count() == 1
    assert ids(again.accept(later, "no", ["at"]).kept) == [3] and again.count() == 2


def test_session_names_the_shared_folder(spark):
    assert shared_dir(spark).startswith("file:") or "checkpoint" in shared_dir(spark)


def test_kept_rows_of_a_stream_are_written_before_their_batch_is_committed(spark, tmp_path, scratch, monkeypatch):
    spark.createDataFrame([(1, "a", 1, 5, None), (2, "a", 1, 6, None)], SCHEMA).write.parquet(f"{tmp_path}/in")
    written, commit = [], SeenStore._commit

    def watched(self, manifest):
        written.append(spark.read.parquet(f"{self.root.removesuffix('-seen')}/batch={manifest['version'] - 1}").count())
        commit(self, manifest)

    monkeypatch.setattr(SeenStore, "_commit", watched)
    stream = ledger.read_ledger(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 99)
    assert ids(ledger.select_once(stream, KEYS, "no", ["at"], scratch)) == [1] and written == [1]
