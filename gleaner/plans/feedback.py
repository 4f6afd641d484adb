"""Feedback loop (Q4): stored notes -> labels (V3) -> exemplars (X4) ->
few-shot block (P28) for the gate prompt, plus label totals (A4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators.metrics import label_totals
from ..operators.notes import exemplar_block, harvest_labels, select_exemplars


@dataclass
class Feedback:
    labels: DataFrame
    exemplars: DataFrame
    block: Column        # scalar subquery column with the prompt block
    totals: DataFrame    # one row: positives, negatives


def feedback_block(note_files: DataFrame, n_pos: int = 4, n_neg: int = 4, reddit_only: bool = True) -> Feedback:
    labels = harvest_labels(note_files, reddit_only=reddit_only)
    ex = select_exemplars(labels, n_pos, n_neg)
    return Feedback(labels=labels, exemplars=ex, block=exemplar_block(ex), totals=label_totals(labels))
