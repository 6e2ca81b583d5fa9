import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pitsight.llm.wordpiece import Automaton, token_counts, vocabulary


def greedy(word, initial, continuing):
    at = n = 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


PIECES = st.sets(st.text("abc", min_size=1, max_size=5), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES, st.lists(st.text("abcd", min_size=1, max_size=14), max_size=20))
def test_counts_equal_greedy_matching(initial, continuing, words):
    automaton = Automaton(initial, continuing)
    assert [automaton.count(w) for w in words] == [greedy(w, initial, continuing) for w in words]


def test_public_vocabulary_against_a_word_piece_library():
    from tokenizers import models

    initial, continuing = vocabulary()
    initial = {p for p in initial if not p.startswith("##")}
    automaton = Automaton(initial, continuing)
    numbers = {p: i for i, p in enumerate(["[UNK]", *initial, *("##" + p for p in continuing)])}
    model = models.WordPiece(numbers, unk_token="[UNK]", max_input_chars_per_word=10**6)
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinéñß.,!x") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for word in [*words, "x" * 5000, "☃"]:
        pieces = model.tokenize(word)
        assert automaton.count(word) == (0 if [p.value for p in pieces] == ["[UNK]"] else len(pieces)), word


def test_rows(spark):
    automaton = Automaton({"a", "ab"}, {"b", "c"})
    rows = [(1, "ab abc x", "k"), (1, "ab abc x", "k"), (2, None, "k"), (3, " \n", "k"), (None, "ac", "k")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), automaton)
    assert got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, 3, 4, 1), (1, 3, 4, 1), (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 2, 0)], key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), automaton).count() == 0
