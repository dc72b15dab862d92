"""Stages of the pipeline leave no large tables behind."""

from pathlib import Path

import pytest

from tradeq.llm import near_dedup, suffix_dedup
from tradeq.session import settle, settle_alone, shared_dir

WORDS = [f"w{i}" for i in range(400)]


def written(spark) -> set[str]:
    folder = Path(shared_dir(spark, "look")).parent
    return {p.name.rsplit("-", 1)[0] + str(p) for p in folder.glob("*")} if folder.exists() else set()


@pytest.mark.parametrize("stage, left", [(near_dedup.without_copies, "gone"), (suffix_dedup.without_repeats, "cuts")])
def test_only_what_goes_is_written_for_good(spark, stage, left):
    text = " ".join(WORDS[:120])
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, " ".join(WORDS[200:]))], "doc_id long, text string")
    before = written(spark)
    rows = {r["doc_id"]: r["text"] for r in stage(docs).collect()}
    assert [Path(p).name.rsplit("-", 1)[0] for p in written(spark) - before] == [left]
    assert rows[1] == text and len(rows[3].split()) == 200
    assert 2 not in rows or rows[2] == "more"


def test_nested_steps_go_with_the_outer_one(spark):
    before = written(spark)

    def outer():
        return settle_alone(spark, lambda: settle(spark.range(5), "deep").filter("id > 1"), "inner").filter("id > 2")

    kept = settle_alone(spark, outer, "outer")
    assert sorted(r["id"] for r in kept.collect()) == [3, 4]
    assert [Path(p).name.rsplit("-", 1)[0] for p in written(spark) - before] == ["outer"]
