from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pitsight.llm import line_quality as L

GOOD = "The committee met on Tuesday and agreed that the plan should go ahead without further delay. "


def brute_repeat(tokens, k=8):
    count = Counter(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
    covered = set()
    for i in range(len(tokens) - k + 1):
        if count[tuple(tokens[i : i + k])] > 1:
            covered.update(range(i, i + k))
    return len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60), st.lists(st.sampled_from([b"x", b"y", b"z"]), max_size=30))
def test_repeated_words(a, b):
    assert L.repeated_words(a + b + a) == brute_repeat(a + b + a)


@pytest.mark.parametrize(
    "line, rule",
    [
        ("Home | About | Contact | Imprint", "navigation"), ("start > news > sport > today", "navigation"), ("word### other*** more%%% last", "symbols"), ("BUY NOW!! THE BEST DEAL!! EVER SEEN!!", "shouting"),
        ("the the the the the the end.", "stutter"), ("This site uses cookies to be better.", "boilerplate"), ("Licensed under some terms.", "boilerplate"), ("Three word heading", "punctuation"),
        ("A plain sentence.", None), ('He said: "Yes."', None), ("¿Qué pasa?", None), ("a long line that has no end at all but has very many plain words in it", None),
    ],
)
def test_line_rules(line, rule):
    assert L.line_fails(line) == rule


def test_documents(spark):
    rows = [
        (1, GOOD * 3, "x"), (2, None, "x"), (3, "", "x"), (4, "Short text.", "x"), (5, "\n".join(f"Entry {i} | page | more" for i in range(20)) + "\n" + GOOD.strip(), "x"), (6, GOOD * 2 + "\n" + GOOD * 2, "x"),
        (7, " ".join(f"word{i}" for i in range(60_000)) + ".", None), (None, "Ünï cödé " * 12 + "end.", "x"), (1, GOOD * 3, "x"),
    ]
    out = L.evaluate(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and out.columns == ["doc_id", *L.FIELDS]
    for i, text, _ in rows:
        tokens = (text or "").encode().split()
        lines = [x for x in (text or "").split("\n") if x.split()]
        r = got[i]
        assert r["n_words"] == len(tokens) and r["word_chars"] == sum(len(t.decode()) for t in tokens)
        assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>") and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == brute_repeat(tokens)
        assert r["base_failed"] == (len(tokens) < 20 or 100 * r["n_repeat_words"] > 30 * len(tokens))
        assert not (r["kept"] and r["base_failed"])
    assert got[7]["kept"] and not got[5]["kept"] and got[5]["n_failed_lines"] == 20 and got[5]["clean_text"] == GOOD.strip()
    assert not got[2]["kept"] and not got[3]["kept"] and not got[4]["kept"]
    assert L.evaluate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("line", ["Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Haga clic aquí.", "Click here.", "Hier klicken", "Diese Seite verwendet Cookies.", "Copyright 2020 by the publisher of this page.", "En savoir plus"])
def test_page_furniture_of_four_languages(line):
    assert L.line_fails(line) is not None


@pytest.mark.parametrize("line", ["Copyright law is discussed in this chapter.", "We read more books than in any year before.", "Wir teilen uns die Arbeit in diesem Jahr.", "JavaScript was designed in ten days by one person.", "Nous allons partager le pain avec les voisins."])
def test_sentences_that_hold_such_words_stay(line):
    assert L.line_fails(line) is None
