"""Decisions and what they mean as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decision's action signal.
SIGNALS = {"buy": 1, "hold": 0, "sell": -1}


def normal_decision(decision: Column) -> Column:
    """buy, hold or sell; anything else is hold."""
    word = F.lower(F.trim(decision))
    return F.when(word.isin(*SIGNALS), word).otherwise(F.lit("hold"))


def is_valid_decision(decision: Column) -> Column:
    return F.coalesce(F.lower(F.trim(decision)).isin(*SIGNALS), F.lit(False))


def decision_signal(decision: Column) -> Column:
    word = F.lower(F.trim(decision))
    return F.when(word == "buy", 1).when(word == "sell", -1).otherwise(0)


def train_direction(record: Column) -> Column:
    """1 if the price rose to the next day, else -1."""
    return F.when(record > 0, 1).otherwise(-1)


def test_direction(decision: Column) -> Column:
    """buy 1, hold or nothing 0, else -1."""
    word = F.coalesce(decision, F.lit(""))
    return F.when(word == "buy", 1).when(word.isin("hold", ""), 0).otherwise(-1)
