"""Token counts on odd rows and long words."""

import random

import pytest

from groundgrid.llm import unigram

PIECES = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.0, "abab": -5.0, "▁a": -2.2, "bbbbbbbb": -6.0}


def plain(word):
    """Best segmentation over all positions."""
    best = [(0.0, 0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[b][0] + PIECES[word[b:end]], best[b][1] - 1, best[b][2]) for b in range(end) if word[b:end] in PIECES]
        if word[end - 1] not in PIECES:
            options.append((best[-1][0] + min(PIECES.values()) - 10, best[-1][1] - 1, best[-1][2] - 1))
        best.append(max(options))
    return -best[-1][1], -best[-1][2]


@pytest.mark.parametrize("most_nodes", [5, 60, 400_000])
def test_trie_equals_plain_with_any_bound_of_nodes(most_nodes):
    rng, trie = random.Random(most_nodes), unigram.PrefixTrie(PIECES, most_nodes)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("aabbbc") for _ in range(rng.randrange(40)))
        assert trie.insert(word) == plain(word)
        assert len(trie.best) <= most_nodes + 1
    long = "▁" + "".join(rng.choice("ab") for _ in range(5000))
    assert trie.insert(long) == plain(long)


def test_long_words_keep_memory_bounded():
    trie = unigram.PrefixTrie(PIECES, 1000)
    assert trie.insert("ab" * 300_000)[1] == 0 and len(trie.best) <= 1001


def test_counts_on_odd_rows(spark):
    schema = "doc_id long, text string, n_words string, keep string"
    rows = [(1, "a word", "x", "k"), (1, "a word", "x", "k"), (2, None, None, None), (3, "", "x", "k"), (None, "日本" * 50_000, "x", "k")]
    got = unigram.token_counts(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "keep", "n_words", "n_tokens", "n_unknown"}
    by = sorted((r.doc_id or 0, r.n_words, r.n_tokens > 0) for r in got)
    assert by == [(0, 1, True), (1, 2, True), (1, 2, True), (2, 0, False), (3, 0, False)]
    assert unigram.token_counts(spark.createDataFrame([], schema)).count() == 0
