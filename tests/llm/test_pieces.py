import random
import re

import pytest

from rategrid.llm import pieces

from .data import documents, frame


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.default_model())


def every_segmentation(model, unit):
    edges = model.edges(unit)

    def walk(j):
        if j == 0:
            yield 0.0, ()
            return
        for i, s, k in edges[j]:
            for t, q in walk(i):
                yield t + s, q + k

    return sorted(walk(len(unit)), key=lambda x: -x[0])


def test_a_star_gives_the_n_best_of_all_segmentations(model):
    r = random.Random(2)
    for _ in range(200):
        u = "".join(r.choice("▁theanditor éß漢𐍈.") for _ in range(r.randint(1, 9))).replace(" ", "▁")
        want, got = every_segmentation(model, u), model.n_best(u, 5)
        assert len(got) == min(5, len(want))
        assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(want, got))


def test_texts_equal_the_search_over_the_whole_lattice(model, monkeypatch):
    r = random.Random(3)
    for block in (1 << 20, 3):
        monkeypatch.setattr(pieces, "_BLOCK", block)
        for _ in range(120):
            t = "".join(r.choice("theanditor éß漢𐍈.\n  ▁") for _ in range(r.randint(0, 13)))
            got = model.encode(t, 4)
            want = every_segmentation(model, (" " + t).replace(" ", "▁")) if t else [(0.0, ())]
            assert len(got["scores"]) == min(4, len(want))
            assert all(abs(a - b[0]) < 1e-9 for a, b in zip(got["scores"], want))
            assert got["round_trip"] and model.decode(model.ids_of(t)) == t.replace("▁", " ")


def test_words_learnt_together_or_alone_agree(model):
    texts = [d[1] for d in documents()]
    together = model.encode_many(texts, 4)
    model.reset()
    assert [model.encode(t, 4) for t in texts] == together
    assert all(x["round_trip"] for x in together)


def test_long_words_take_the_search(model):
    u = "a" * 50 + "the" * 20
    assert model.encode(u, 3)["scores"] == pytest.approx([s for s, _ in model.n_best("▁" + u, 3)])


def test_query_rows(spark):
    rows = pieces.segment(frame(spark, extra=True)).collect()
    assert len(rows) == len(documents())
    by = {r["doc_id"]: r for r in rows}
    assert by[103]["n_pieces"] == by[104]["n_pieces"] == 0 and by[104]["scores"] == [0.0]
    assert all(r["round_trip"] for r in rows)
    assert all(list(r["scores"]) == sorted(r["scores"], reverse=True) for r in rows)
    assert pieces.segment(frame(spark, [])).count() == 0


def test_encode_then_decode_gives_the_text(spark):
    df = frame(spark)
    back = pieces.decode(pieces.encode(df).drop("text"))
    want = sorted((str(d[0]), d[1] or "") for d in documents())
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == want


def test_words_of_all_lengths_take_one_array_step(model, monkeypatch):
    r = random.Random(4)
    units = ["▁" + "".join(r.choice("theandior éß漢𐍈.▁") for _ in range(n)).replace(" ", "") for n in list(range(31)) * 4]
    steps, run = [], model._viterbi
    monkeypatch.setattr(model, "_viterbi", lambda part, *a: steps.append(len(part)) or run(part, *a))
    model.reset()
    model.learn(units)
    assert steps == [len(units)]
    for i, u in enumerate(units):
        two = model.n_best(u, 2)
        assert abs(model.best[i] - two[0][0]) < 1e-9
        assert model.gap[i] == pytest.approx(two[0][0] - two[1][0] if len(two) > 1 else float("inf"), abs=1e-9)
        ids = model.flat[model.first[i]:model.first[i] + model.count[i]].tolist()
        assert b"".join(model.bytes[k] for k in ids) == u.replace("▁", " ").encode()


def test_keys_stand_for_the_words_of_a_block():
    r = random.Random(6)
    for _ in range(2000):
        t = " " + "".join(r.choice("ab \n▁é") for _ in range(r.randint(0, 9)))
        got = [pieces.unit_of(k) for k in pieces.keys_of(t)]
        assert [u for u in got if u] == re.findall("▁[^▁\n]*|[^▁\n]+|\n", t.replace(" ", "▁"))
