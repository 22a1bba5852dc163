"""Ticket text classification on Spark: preparation, models, evaluation, scoring."""

from ticketmill.config import PrepConfig, ScoreConfig, TrainConfig
from ticketmill.plans.prepare import prepare, prepare_text
from ticketmill.plans.profile import profile
from ticketmill.plans.score import score
from ticketmill.plans.train import train

__all__ = [
    "PrepConfig",
    "ScoreConfig",
    "TrainConfig",
    "prepare",
    "prepare_text",
    "profile",
    "score",
    "train",
]
