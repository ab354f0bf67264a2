"""Labelling stages: what each stage may see, its prompt, what it records, and the extension points.

A stage is a function from a frame of turns (and an index) to a frame of predictions; the protocols below
name the parts that a user may replace. Completion itself is outside: a scorer or generator comes in as a
frame-to-frame function, such as ``candidates.mock_scorer``.
"""

from __future__ import annotations

import time
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators import acts as A
from dialoom.operators import metrics as M
from dialoom.operators import state as S

#: Columns of a turn that each stage may read.
VISIBLE = {
    "dst": ("dialogue_id", "turn_id", "user_utterances", "system_utterances", "last_slot_values", "last_system_response_acts"),
    "act_tag": ("dialogue_id", "turn_id", "user_utterances", "system_utterances", "slot_values", "turn_slot_values", "last_slot_values", "last_system_response_acts", "system_response"),
    "policy": ("dialogue_id", "turn_id", "user_utterances", "system_utterances", "slot_values", "last_system_response_acts"),
    "response": ("dialogue_id", "turn_id", "user_utterances", "system_utterances", "slot_values", "system_response_acts"),
}


class Retriever(Protocol):
    def __call__(self, queries: DataFrame, index: DataFrame) -> DataFrame: ...


class Normaliser(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Delexer(Protocol):
    def __call__(self, text: Column, acts: Column) -> Column: ...


class Venues(Protocol):
    def __call__(self, domain: str, constraints: dict[str, str | None]) -> DataFrame: ...


class Scorer(Protocol):
    """(prefix, text) -> those with logprobs."""

    def __call__(self, texts: DataFrame) -> DataFrame: ...


class Viewer(Protocol):
    def __call__(self, rows: DataFrame) -> None: ...


def visible(turns: DataFrame, stage: str) -> DataFrame:
    """The columns that a stage may see; act tagging also sees the change of the state."""
    if stage == "act_tag" and "turn_slot_values" not in turns.columns:
        turns = turns.withColumn("turn_slot_values", S.compute_delta(F.col("last_slot_values"), F.col("slot_values")))
    return turns.select(*[c for c in VISIBLE[stage] if c in turns.columns])


def index_rows(turns: DataFrame, predicted: str, schema: dict[str, list[str]] | None = None) -> DataFrame:
    """A stage's predictions as rows of its index: state, cleaned by the schema, and its change."""
    clean = (lambda c: S.clean_state(c, schema)) if schema else S.remove_blank_values
    own = turns.withColumn("slot_values", clean(F.col(predicted))).withColumn("last_slot_values", clean(F.col("last_slot_values")))
    return own.withColumn("turn_slot_values", S.compute_delta(F.col("last_slot_values"), F.col("slot_values")))


def recorded(turns: DataFrame) -> DataFrame:
    """(pred, gold, last states as maps) with delta, joint match of state and change, and ``failed``: a missing prediction, which counts as the empty state.

    With ``pred_acts`` and ``gold_acts`` (act lists) also act_scores: precision, recall and f1 of the acts' slot values.
    """
    p = F.coalesce(F.col("pred"), S.empty())
    t = turns.withColumn("failed", F.col("pred").isNull())
    t = t.withColumn("pred_delta", S.compute_delta(F.col("last"), p)).withColumn("gold_delta", S.compute_delta(F.col("last"), F.col("gold")))
    t = t.withColumn("jga", S.joint_match(p, F.col("gold"))).withColumn("turn_accuracy", S.joint_match(F.col("pred_delta"), F.col("gold_delta")))
    if not {"pred_acts", "gold_acts"} <= set(turns.columns):
        return t
    said = lambda c: A.slot_values(F.coalesce(c, F.expr(f"cast(array() as array<{A.ACT}>)")))
    return t.withColumn("act_scores", M.scores_of(M.counts_of(said(F.col("pred_acts")), said(F.col("gold_acts")))))


def evaluate(turns: DataFrame | None = None, references: tuple[str, str] | None = None, words: str | None = None, judged: DataFrame | None = None, states: tuple[DataFrame, DataFrame, str] | None = None) -> dict[str, DataFrame]:
    """The metrics asked for, each a frame: bleu, richness, success, dst."""
    out = {}
    if references:
        out["bleu"] = M.bleu(turns, *references)
    if words:
        out["richness"] = M.richness(turns, words)
    if judged is not None:
        out["success"] = M.rates(judged)
    if states:
        out["dst"] = M.slot_f1(states[0], states[1], states[2])
    return out


class Throughput:
    """Rows a second, by batch and in all."""

    def __init__(self):
        self.began, self.rows = time.monotonic(), 0
        self.last = self.began

    def add(self, rows: int) -> tuple[float, float]:
        now = time.monotonic()
        own = rows / max(now - self.last, 1e-9)
        self.rows, self.last = self.rows + rows, now
        return own, self.rows / max(now - self.began, 1e-9)


def batch_size(memory_gb: float, full: int, best_of: int = 1) -> int:
    """A batch for a device: all of it from 50 GB on, half from 25 GB, one below; less with many samples."""
    return max(1, (full if memory_gb >= 50 else full // 2 if memory_gb >= 25 else 1) // max(1, best_of))
