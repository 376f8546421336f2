"""Detection from stored facts per file: equal to detection over all files, scanning only new ones."""

import time

import pandas as pd
import pytest

from fraudframe.operators import detect, facts
from fraudframe.session import scratch_path

SCHEMA = "amount double, is_fraud string, date string, merchant string, user_id string"


def part(n, start=0, label=("fraud", "legitimate"), date="{m:02}/{d:02}/2024", merchant=("a", "b"), bad=None):
    rows = [(float(i), label[i % len(label)], date.format(m=i % 12 + 1, d=i % 12 + 1), merchant[i % len(merchant)], f"u{start + i}") for i in range(n)]
    if bad:
        rows[n // 2] = (*rows[n // 2][:2], bad, *rows[n // 2][3:])
    return pd.DataFrame(rows, columns=["amount", "is_fraud", "date", "merchant", "user_id"])


CASES = {
    "all fit": [part(30), part(30, 30), part(30, 60)],
    "day above twelve in a later file": [part(30), part(30, 30, date="{d:02}/05/2024"), part(30, 60, date="{m:02}/25/2024")],
    "no form fits all": [part(30, date="25/{m:02}/2024"), part(30, 30, date="{m:02}/25/2024")],
    "a bad value in one file": [part(30), part(30, 30, bad="soon")],
    "labels of different sets": [part(30), part(30, 30, label=("yes", "no"))],
    "labels complete only together": [part(30, label=("yes",)), part(30, 30, label=("no",)), part(30, 60, label=("maybe",))],
    "one merchant a file": [part(30, merchant=("a",)), part(30, 30, merchant=("b",))],
    "one merchant in all": [part(30, merchant=("a",)), part(30, 30, merchant=("a",))],
    "the same ids in all files": [part(40), part(40), part(40)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_detection_over_all_files(spark, tmp_path, name):
    paths = []
    for i, frame in enumerate(CASES[name]):
        frame.to_parquet(tmp_path / f"{i}.parquet", index=False)
        paths.append(f"file:{tmp_path}/{i}.parquet")
    scanned = []

    def read(files):
        scanned.append(list(files))
        return spark.read.parquet(*files)
    store = scratch_path(spark, "facts")
    for n in range(1, len(paths) + 1):
        scanned.clear()
        assert facts.update_facts(spark, paths[:n], read, store) == [paths[n - 1]] and scanned == [[paths[n - 1]]]
        want = detect.detect_columns(spark.read.parquet(*paths[:n]))
        assert facts.detect_from_facts(spark, store, paths[:n], read) == want
    assert facts.update_facts(spark, paths, read, store) == []


def test_many_new_files_are_one_scan_and_any_of_them_can_be_asked_for(spark, tmp_path):
    frames = [part(30, date="25/{m:02}/2024"), part(30, 30, date="{m:02}/25/2024"), part(0), part(30, 60, date="{m:02}/26/2024")]
    paths, scanned = [], []
    for i, frame in enumerate(frames):
        frame.astype({"amount": float, **dict.fromkeys(["is_fraud", "date", "merchant", "user_id"], "string")}).to_parquet(
            tmp_path / f"a b{i}.parquet", index=False)
        paths.append(f"{tmp_path}/a b{i}.parquet")

    def read(files):
        scanned.append(list(files))
        return spark.read.parquet(*files)
    store = scratch_path(spark, "facts")
    assert facts.update_facts(spark, paths, read, store) == paths and scanned == [paths]
    assert facts.update_facts(spark, paths, read, store) == []
    for some in ([0], [1], [1, 3], [0, 1], [1, 2, 3], [0, 1, 2, 3], [2]):
        chosen = [paths[i] for i in some]
        assert facts.detect_from_facts(spark, store, chosen, read) == detect.detect_columns(spark.read.parquet(*chosen)), some


def test_a_changed_file_is_scanned_again(spark, tmp_path):
    part(30).to_parquet(tmp_path / "a.parquet", index=False)
    paths, read, store = [f"file:{tmp_path}/a.parquet"], lambda files: spark.read.parquet(*files), scratch_path(spark, "facts")
    facts.update_facts(spark, paths, read, store)
    assert "timestamp" in facts.detect_from_facts(spark, store, paths, read)
    time.sleep(1.1)
    part(30, bad="soon").to_parquet(tmp_path / "a.parquet", index=False)
    assert facts.update_facts(spark, paths, read, store) == paths
    assert "timestamp" not in facts.detect_from_facts(spark, store, paths, read)
