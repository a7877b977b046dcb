"""Resumable scoring: every row is asked once across a killed and a second run."""

import os
from collections import Counter

import pytest

from convlens.operators import scoring as K


def counting(folder, fail=(), kill=()):
    """A scorer that leaves a file per call and row; it fails on some texts and ends its process on others."""

    def score(texts):
        import uuid

        for t in texts:
            if t in kill:
                raise KeyboardInterrupt
        if len(texts) > 1 and any(t in fail for t in texts):
            raise ValueError("ask one by one")  # nothing counted yet
        for t in texts:
            with open(os.path.join(folder, f"{t}-{uuid.uuid4().hex}"), "w"):
                pass
            if t in fail:
                raise ValueError("no answer")
        return [f"{len(t)}." for t in texts]

    return score


def calls(folder):
    return Counter(n.split("-")[0] for n in os.listdir(folder))


def test_each_row_is_asked_once_across_a_killed_and_a_second_run(spark, tmp_path):
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    rows = [(i, f"t{i}") for i in range(60)] + [(3, "t3"), (None, "t60")]
    df = spark.createDataFrame(rows, "id long, prompt string")
    with pytest.raises(Exception):  # noqa: B017 - the job of one slice dies
        K.score_with_ledger(df, "id", "prompt", ledger, counting(str(folder), kill=("t40",)), slices=12)
    before = calls(folder)
    assert 0 < len(before) < 61
    done = {r.prompt_md5 for r in spark.read.parquet(ledger).collect()}
    got = K.score_with_ledger(df, "id", "prompt", ledger, counting(str(folder)), slices=12).collect()
    assert len(got) == len(rows) and all(r.error is None and r.attempts == 1 and r.analysis for r in got)
    after = calls(folder)
    assert set(after) == {f"t{i}" for i in range(61)}
    import hashlib

    # what a finished slice filed is never asked again
    assert all(after[t] == 1 for t in after if hashlib.md5(t.encode()).hexdigest() in done)
    assert sum(n > 1 for n in after.values()) <= 61 / 12 * 3  # rows of the slice that died, at most
    K.score_with_ledger(df, "id", "prompt", ledger, counting(str(folder)), slices=12).collect()
    assert calls(folder) == after


def test_failures_are_tried_again_and_changed_prompts_are_new(spark, tmp_path):
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")
    got = {r.id: r for r in K.score_with_ledger(df, "id", "prompt", ledger, counting(str(folder), fail=("bad",)), slices=2, attempts=2).collect()}
    assert got[1].error is None and got[2].error.startswith("ValueError") and got[2].attempts == 2
    assert calls(folder) == {"good": 1, "bad": 2}
    again = {r.id: r for r in K.score_with_ledger(df, "id", "prompt", ledger, counting(str(folder)), slices=2, attempts=3).collect()}
    assert again[2].error is None and again[2].analysis == "3." and again[2].attempts == 3
    changed = spark.createDataFrame([(1, "better")], "id long, prompt string")
    assert K.score_with_ledger(changed, "id", "prompt", ledger, counting(str(folder)), slices=2).first().analysis == "6."
    assert K.score_with_ledger(df.limit(0), "id", "prompt", ledger, counting(str(folder)), slices=1).count() == 0
