import random

import pytest
from tokenizers import Tokenizer

from rategrid.llm import tokencount

from .data import documents, frame


@pytest.fixture(scope="module")
def pair():
    path = tokencount.default_vocabulary()
    lib = Tokenizer.from_file(path)
    return tokencount.Transducer(path), lambda x: len(lib.encode(x, add_special_tokens=False).ids)


def test_counts_equal_the_library(pair):
    t, want = pair
    r = random.Random(3)
    chars = list("abcdefgtheinsr'  \n\t.,!0129éß漢𐍈  \x85\x1c\x1f​²½ՠ꟎") + ["<|endoftext|>", "'s", "'ll", " the", "  ", "tion"]
    for _ in range(3000):
        s = "".join(r.choice(chars) for _ in range(r.randint(0, 25)))
        assert t.count_text(s) == want(s), s
        for chunk in (1, 2, 5):
            assert t.count_text(s, chunk) == want(s), (s, chunk)


def test_every_transition_sums_to_bpe(pair):
    t, _ = pair
    r = random.Random(4)
    for _ in range(500):
        w = "".join(r.choice("aeinrstohd") for _ in range(r.randint(1, 30)))
        assert t.count_word(w) == len(t.merge(w.encode()))


def test_character_classes_follow_the_library(pair):
    t, _ = pair
    lib = Tokenizer.from_file(tokencount.default_vocabulary()).pre_tokenizer
    for c in (*range(0x20, 0x3000), *range(0xA700, 0xABFF), *range(0x10000, 0x11000)):
        s = "a" + chr(c) + " 1" + chr(c)
        assert len(t.words(s)) == len(lib.pre_tokenize_str(s)), hex(c)


def test_state_limit_does_not_change_counts(pair, monkeypatch):
    t, want = pair
    monkeypatch.setattr(tokencount, "_STATES", 5)
    monkeypatch.setattr(tokencount, "_WORDS", 3)
    s = "Some unusual wordings, repeated unusually often; 12345 ünïcödé"
    assert t.count_text(s) == want(s)


def test_query_rows(spark, pair):
    _, want = pair
    rows = tokencount.token_counts(frame(spark, extra=True)).collect()
    key = lambda x: tuple(str(v) for v in x)
    expect = [(d[0], len((d[1] or "").encode()), want(d[1] or ""), want(d[1] or "") > 512) for d in documents()]
    assert sorted((tuple(r) for r in rows), key=key) == sorted(expect, key=key)
    assert tokencount.token_counts(frame(spark, [])).count() == 0
