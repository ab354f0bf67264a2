"""Completions that count only what prompts reach: against plain loops, and how much of the disk they take."""

from __future__ import annotations

import os
import random
import threading

import pytest
from test_ngrams import TEXTS, Plain

from dialoom import catalog
from dialoom.operators import greedy


@pytest.mark.parametrize("order, mu", [(2, 1.0), (3, 2.0), (4, 0.5)])
def test_completions(spark, order, mu):
    texts = [*TEXTS, "é 日本 é\tx", "a   b", "é 日本"]
    plain = Plain(texts, order, mu)
    prompts = list(enumerate(["", "a", "b c", "zz", "a b c d e", "zz a", None, "e e", "é", "a  "]))
    got = greedy.complete(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(prompts, "id int, prompt string"), 8, order=order, mu=mu)
    assert {r.id: r.completion for r in got.collect()} == {i: plain.complete(t, 8) for i, t in prompts}


def test_no_texts(spark):
    got = greedy.complete(spark.createDataFrame([], "text string"), spark.createDataFrame([(1, "a")], "id int, prompt string"), 4)
    assert got.first().completion is None


def test_tables_stay_small(spark, tmp_path):
    """The tables that greedy_texts writes don't hold all n-grams: 120,000 words of 20,000, and at no time more than 8 MB."""
    rng = random.Random(5)
    rows = [(i // 4, i % 4, " ".join(f"w{rng.randrange(20000)}" for _ in range(60))) for i in range(2000)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/shared")
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    over, most = threading.Event(), [0]

    def held():
        found = 0
        for folder, _, names in os.walk(top):
            for name in names:
                try:
                    found += os.path.getsize(os.path.join(folder, name))
                except OSError:  # it went meanwhile
                    pass
        return found

    def watch():
        while not over.wait(0.05):
            most[0] = max(most[0], held())

    before = held()
    watching = threading.Thread(target=watch)
    watching.start()
    try:
        assert catalog.queries()["greedy_texts"](spark, str(tmp_path)).count() == len(rows)
    finally:
        over.set()
        watching.join()
    assert max(most[0], held()) - before < 8e6
