"""Secret scans: the contexts of a credential, and the values that count."""

from __future__ import annotations

import random
import time

import pytest

from hiremill.llm import secrets

VALUE = "T7#kQ!9zPw2x"


def guesses(text: str) -> list[str]:
    return [text[s:e] for s, e, kind in secrets.find_secrets(text) if kind == "guess"]


@pytest.mark.parametrize(
    "context", ["DB_PASSWORD=", "APP_SECRET=", "MY_TOKEN: ", "Login password: ", "auth token: ", "secret key: ", "AWS_SECRET_ACCESS_KEY="]
)
def test_contexts(context):
    assert guesses(f"set {context}{VALUE} now") == [VALUE]


def test_url_passwords():
    assert guesses("redis://:T7kQ9zPw2xLm4@host/0") == ["T7kQ9zPw2xLm4"]
    long = "T7kQ9zPw2xLm4b" * 40
    assert guesses(f"http://{'u' * 300}:{long}@host") == [long]


def test_values_that_count():
    rng = random.Random(4)
    for symbols in ("abcdefghijkmnpqrstuvwxyz23456789", "ABCdefGHJkmn234567#!%$"):
        values = ["".join(rng.choices(symbols, k=6)) + "k7" for _ in range(50)]
        assert sum(guesses(f"pwd: {v} now") == [v] for v in values) >= 45
    assert guesses("pwd: T7#kQ!9zP") == ["T7#kQ!9zP"]
    assert guesses("pwd: T7#kQ!9z") == ["T7#kQ!9z"]
    assert guesses("pwd: xK!qZ#vBnW$mTr") == ["xK!qZ#vBnW$mTr"]
    for prose in ("important", "well-known", "and/or/either", "Administrator", "www.example.com", "2024-10-12", "password1", "555-123-4567"):
        assert not guesses(f"pwd: {prose} now")


@pytest.mark.parametrize("unit", ["token=x9#", "key:", "password ", "token=", "pwd=aB3$ ", "://a:b9Kx@", "secret:token:"])
def test_time_grows_with_the_text(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.process_time()
    secrets.find_secrets(text)
    assert time.process_time() - start < (2 if unit == "token=x9#" else 8)


def test_first_value_of_a_token_decides():
    assert guesses(f"pwd: a=b;token:{VALUE}") == [f"a=b;token:{VALUE}"]
    assert guesses("pwd: key:key:key:key") == []


def test_words_of_the_corpus_are_cheap(spark):
    docs = spark.createDataFrame([(i, "überholung der kesselwagen bestellung") for i in range(50)] + [(50, None)], "doc_id long, text string")
    words = secrets.corpus_words(docs)
    assert set(words) == {"überholung", "kesselwagen", "bestellung"}
    known = secrets.Lexicon.of([*secrets.COMMON_WORDS, *words])
    assert secrets.guess_cost("kesselwagen7", lexicon=known) < 5 < secrets.guess_cost("kesselwagen7")
    assert secrets.corpus_words(docs.limit(0)) == ()


def test_words_are_counted_in_all_documents(spark):
    own = ["".join(chr(97 + int(d)) for d in f"{i:04d}") + "qx" for i in range(4500)]
    rows = [(i, f"{word} everywhere") for i, word in enumerate(own)] + [(-i, f"{own[0]} {own[0]} \u00fcber{own[0]}") for i in range(1, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = secrets.corpus_words(docs)
    assert words[:3] == ("everywhere", own[0], f"\u00fcber{own[0]}")
    assert set(words) == {*own, "everywhere", f"\u00fcber{own[0]}"}
    assert secrets.corpus_words(docs, most=2) == ("everywhere", own[0])
