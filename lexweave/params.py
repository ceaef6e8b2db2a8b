"""Parameters of all pipelines: one frozen object, passed along; no global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """window: context words on either side. fewer_than: vocabulary words need more occurrences. min_length: words must be
    longer. sources: how many words are induced. keep: candidates kept for each. dictionary: size of the seed dictionary.
    ngram: longest phrase. days: days of the dated corpus. window_days: size of re-binned time windows. gap: tokens between
    phrases that still count as near. neighbours: neighbours of a phrase that order scores look at."""

    window: int = 2
    fewer_than: int = 5
    min_length: int = 2
    sources: int = 20
    keep: int = 10
    dictionary: int = 500
    ngram: int = 3
    phrases: int = 200
    days: int = 30
    window_days: int = 3
    gap: int = 2
    neighbours: int = 1000
    ks: tuple[int, ...] = (1, 5, 10, 20, 30, 40, 50, 60, 80, 100, 200, 300, 400, 500)


DEFAULTS = Params()
#: Sources ranked and candidates kept as in the reference's configuration.
FULL = Params(sources=200, keep=500)
