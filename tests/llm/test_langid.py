import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rategrid.llm import langid

from .data import SF, documents, frame


def naive_model(texts, n_symbols):
    """Interpolated Kneser-Ney by its textbook sums over symbol tuples."""
    full = collections.Counter()
    for t in texts:
        for s in langid.symbol_pieces(t):
            s = [int(x) for x in s]
            full.update(tuple(s[i:i + 4]) for i in range(len(s) - 3))
    counts = {4: full}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def prob(g):
        k = len(g)
        c = counts[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        lower = 1 / n_symbols if k == 1 else prob(g[1:])
        if not same:
            return lower
        total = sum(same.values())
        return max(c[g] - d, 0) / total + sum(min(d, v) for v in same.values()) / total * lower

    return counts, prob


def test_probabilities_equal_the_textbook_sums():
    texts = {"a": ["abba abab cab", "bab a cabb"], "b": ["xyx yxxy abz", "zzy xyz"]}
    langs = ["a", "b"]
    at, gram, n = [], [], []
    for i, l in enumerate(langs):
        for g, c in naive_model(texts[l], 1)[0][4].items():
            at.append(i)
            gram.append(sum(x << 16 * (3 - k) for k, x in enumerate(g)))
            n.append(c)
    m = langid.build_model(langs, np.array(at), np.array(gram, np.uint64), np.array(n))
    for i, l in enumerate(langs):
        _, prob = naive_model(texts[l], m.n_symbols)
        probe = [s for t in texts["a"] + texts["b"] + ["qqq ab"] for s in langid.symbol_pieces(t)]
        g = np.concatenate([langid.grams(s) for s in probe])
        got = m.log2p(g)[:, i]
        want = [math.log2(prob(tuple(int(x) >> sh & 0xFFFF for sh in (48, 32, 16, 0)))) for x in g]
        assert np.allclose(got, want, atol=1e-4)


def test_held_out_accuracy_and_no_clean_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    r = p.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"),
                                F.count_if("rejected").alias("rej"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 20 and r["acc"] >= 0.98 and r["rej"] == 0


def test_gibberish_is_rejected_and_folds_follow_crc32(spark):
    import zlib

    rows = documents()
    model = langid.train(frame(spark))
    probe = [(1, "zxqk vvkx qqzz wxkq jjqx zzkv " * 5, None, None, None)]
    assert langid.keep_known(frame(spark, probe), model).count() == 0
    got = langid.predict(frame(spark, extra=True), model).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (True if i is None else zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1


def test_odd_texts(spark):
    model = langid.train(frame(spark))
    by = {}
    for r, d in zip(langid.predict(frame(spark).coalesce(1), model).collect(), documents()):
        by[d[1]] = r
    for t in (None, "", " \n\t ", "123 456 !!"):
        assert by[t]["lang_pred"] == "und" and by[t]["score"] == 0 and by[t]["rejected"]
    assert all(by[d[1]]["lang_pred"] == d[2] for d in documents()[:60])


def test_pieces_of_long_texts_agree_with_whole(monkeypatch):
    text = "Some words, 123 and   more-words é " * 50
    whole = np.concatenate([langid.grams(s) for s in langid.symbol_pieces(text)])
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "_PIECE", size)
        parts = np.concatenate([langid.grams(s) for s in langid.symbol_pieces(text)])
        assert (parts == whole).all()


@pytest.mark.parametrize("rows", [[], [(5, "nur text ohne sprache", None, None, None)]])
def test_nothing_to_learn_from(spark, rows):
    df = frame(spark, rows)
    model = langid.train(df)
    assert model is None
    assert [r["lang_pred"] for r in langid.predict(df, model).collect()] == ["und"] * len(rows)
    assert langid.keep_known(df, model).count() == 0


def test_keep_known_passes_columns_through(spark):
    df = frame(spark, extra=True)
    kept = langid.keep_known(df, langid.train(df))
    assert kept.columns == df.columns
    assert {d[0] for d in documents()[:60]} <= {r["doc_id"] for r in kept.collect()}


def test_a_model_beyond_the_broadcast_bound_is_whole(spark):
    # same figures from tables as from the broadcast: nothing is cut above max_grams
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small, large = langid.train(docs), langid.train(docs, max_grams=1000)
    assert isinstance(small, langid.Model) and isinstance(large, langid.TableModel)
    assert 0 < len(large.hot_hash) <= 1000
    a, b = ({r["doc_id"]: r for r in langid.predict(docs, m).collect()} for m in (small, large))
    assert len(a) == len(b) > 0
    for i in a:
        assert a[i][:3] == b[i][:3] and a[i]["n_symbols"] == b[i]["n_symbols"] and a[i]["rejected"] == b[i]["rejected"]
        assert math.isclose(a[i]["cross_entropy"], b[i]["cross_entropy"], abs_tol=1e-4)
    for l, (limit, sigma) in small.limits.items():
        assert np.allclose(large.limits[l], (limit, sigma), atol=1e-3)
    df = frame(spark, extra=True)
    kept = langid.keep_known(df, large)
    assert kept.columns == df.columns and sorted(map(repr, kept.collect())) == sorted(
        map(repr, langid.keep_known(df, small).collect()))


def test_a_rare_language_beside_a_hot_one_keeps_its_label(spark):
    import random

    r = random.Random(3)
    hot = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(r.choice(hot) for _ in range(200)), "hot", None, None) for i in range(60)]
    rows += [(1000 + i, "qxv wzk yun " + "vkw " * (i % 2), "rare", None, None) for i in range(6)]
    df = frame(spark, rows)
    model = langid.train(df, max_grams=1)
    got = {p["doc_id"]: p for p in langid.predict(df, model).collect()}
    assert model.langs == ["hot", "rare"] and set(model.limits) == {"hot", "rare"}
    assert all(got[i]["lang_pred"] == l and not got[i]["rejected"] for i, _, l, *_ in rows)
