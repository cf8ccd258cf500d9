"""Small helpers that several operators share."""

from __future__ import annotations

import string
import sys
import types
from collections.abc import Callable, Iterable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_az(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def text_of(name: str = "text") -> Column:
    """The text column; a null text is an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_value(module_name: str) -> None:
    """Let the functions of a module travel to the executors by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def process_state(name: str) -> dict:
    """A dictionary that lives as long as the worker process, shared by all of its tasks."""
    module = sys.modules.setdefault("_llm_process_state", types.ModuleType("_llm_process_state"))
    return module.__dict__.setdefault(name, {})


class TwoGenerations:
    """What has been worked out for words, of bounded size: when ``limit`` words are known they become the old
    generation, and words that come up again move to the new one. So frequent words are never worked out anew."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def get(self, word: str) -> Any:
        return self.young.get(word, self.old.get(word))

    def holding(self, words: set[str], learn: Callable[[list[str]], Iterable[tuple[str, Any]]]) -> dict[str, Any]:
        """A dictionary that holds all of ``words``; ``learn`` gives (word, value) of those not known."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        unknown = []
        for w in words.difference(young):
            if w in old:
                young[w] = old[w]
            else:
                unknown.append(w)
        young.update(learn(unknown))
        return young


by_value(__name__)
