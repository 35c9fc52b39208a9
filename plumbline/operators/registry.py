"""Operators by name: detectors score a text, corpus tests judge a corpus or an ordered set of examples, so the two do not share an interface."""

from __future__ import annotations

from plumbline.operators import contamination, order_test
from plumbline.operators.scoring import DEFAULT_SUITE, DETECTORS

#: Tests of a corpus by name (fixed values); they are not part of DEFAULT_SUITE.
CORPUS_TESTS = {"ngram_overlap": contamination.overlap, "oren_permutation": order_test.permutation_test}

__all__ = ["CORPUS_TESTS", "DEFAULT_SUITE", "DETECTORS", "corpus_test"]


def corpus_test(name: str):
    if name not in CORPUS_TESTS:
        raise ValueError(f"unknown corpus test {name!r}; known: {', '.join(CORPUS_TESTS)}")
    return CORPUS_TESTS[name]
