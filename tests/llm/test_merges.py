"""The merge automaton against the tokenizers library, on merge lists drawn at random."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from fiscal_ledger.llm.bpe import MergeAutomaton


def random_merges(rng, alphabet: str, most: int) -> list[tuple[str, str]]:
    """Merges of letters and of what earlier merges make; also ones whose parts are always taken before."""
    tokens, merges, seen = list(alphabet), [], set()
    for _ in range(rng.integers(1, most)):
        pair = str(rng.choice(tokens)), str(rng.choice(tokens))
        if pair in seen or len(pair[0] + pair[1]) > 12:
            continue
        seen.add(pair)
        try:
            automaton(alphabet, [*merges, pair])
        except ValueError:  # a part was named before
            continue
        merges.append(pair)
        if pair[0] + pair[1] not in tokens:
            tokens.append(pair[0] + pair[1])
    return merges


def automaton(alphabet: str, merges: list[tuple[str, str]]) -> tuple[MergeAutomaton, dict[str, int]]:
    vocabulary: dict[str, int] = {}
    for token in [*alphabet, *(u + v for u, v in merges)]:
        vocabulary.setdefault(token, len(vocabulary))
    labels = {number: token.encode() for token, number in vocabulary.items()}
    return MergeAutomaton(labels, [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges]), vocabulary


def differing(alphabet: str, merges: list[tuple[str, str]], words: list[str]) -> list[str]:
    ours, vocabulary = automaton(alphabet, merges)
    library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
    return [word for word in words if list(ours.encode(word.encode())) != library.encode(word).ids]


def test_taken_parts():
    assert differing("abc", [("b", "c"), ("a", "b"), ("ab", "c")], ["abc", "ab", "aabc", "abcabc", "bca"]) == []


@pytest.mark.parametrize("seed", range(60))
def test_random_merge_lists(seed):
    rng = np.random.default_rng(seed)
    alphabet = "abcd"[: rng.integers(1, 5)]
    merges = random_merges(rng, alphabet, 20)
    words = ["".join(rng.choice(list(alphabet), rng.integers(1, 30))) for _ in range(200)]
    assert differing(alphabet, merges, words) == []


def test_merge_before_its_parts():
    with pytest.raises(ValueError, match="comes before"):
        automaton("abc", [("ab", "c"), ("a", "b")])
