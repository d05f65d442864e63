import numpy as np

from rategrid.llm import resample

from .data import documents, frame


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_log_ratio_equals_counts_by_hand(spark):
    good = {0, 2, 4, 101, 777}
    ratio = resample.fit(frame(spark), labels(spark, [(i, int(i in good), 0) for i in (0, 1, 2, 3, 4, 101, 777)]), buckets=50)
    raw, target = np.ones(50), np.ones(50)
    for d in documents():
        for part in resample.buckets_of(d[1], 50)[1]:
            c = np.bincount(part, minlength=50)
            raw += c
            target += c * (d[0] in good)
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))


def test_pairs_run_across_pieces(monkeypatch):
    whole = np.bincount(np.concatenate(resample.buckets_of("a b c d e f g", 97)[1]), minlength=97)
    monkeypatch.setattr(resample, "_PIECE", 2)
    assert (np.bincount(np.concatenate(resample.buckets_of("a b c d e f g", 97)[1]), minlength=97) == whole).all()


def test_kth_largest_is_exact(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=9000) * 50, np.full(6000, 3.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 2, 100, 3000, 5000, 9000, 15001, 15002, 99999):
        assert resample.kth_largest(df, "x", k) == np.sort(x)[::-1][min(k, len(x)) - 1]
    assert resample.kth_largest(df, "x", 0) is None


def test_weights_separate_held_out_labels(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen, rest = lab.where("doc_id % 2 = 0"), lab.where("doc_id % 2 = 1")
    got = resample.resample(docs, seen).join(rest, "doc_id").select("mean_log_ratio", "quality").collect()
    good = [r[0] for r in got if r[1] == 1]
    bad = [r[0] for r in got if r[1] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9


def test_sample_size_and_odd_rows(spark):
    lab = labels(spark, [(0, 1, 0), (0, 1, 0), (1, 0, 0), (555, None, None), (None, 1, 0)])
    rows = resample.resample(frame(spark, extra=True), lab, share=0.5).collect()
    assert len(rows) == len(documents())
    k = round(0.5 * len(rows))
    assert k <= sum(r["kept"] for r in rows) <= k + 2           # equal rows are sampled together
    again = resample.resample(frame(spark), lab, share=0.5).collect()
    assert {(r["doc_id"], r["n_words"], r["kept"]) for r in rows} == {(r["doc_id"], r["n_words"], r["kept"]) for r in again}
    assert resample.resample(frame(spark, []), lab).count() == 0
    assert resample.resample(frame(spark), labels(spark, [])).where("NOT kept").count() == 0


def test_all_columns_equal_brute_force(spark):
    """Weights, keys and the sample, from the ratio and the texts, one row at a time."""
    import math

    import xxhash

    rows = [d for d in documents() if d[0] is not None]
    lab = labels(spark, [(i, i % 2, 0) for i in range(40)])
    ratio = resample.fit(frame(spark, rows), lab, buckets=500)
    got = resample.resample(frame(spark, rows), lab, share=0.3, buckets=500).collect()
    want = []
    for d in rows:
        n, parts = resample.buckets_of(d[1], 500)
        grams = [g for p in parts for g in p]
        weight = sum(ratio[g] for g in grams)
        u = ((xxhash.xxh64_intdigest(f"gumbel:{d[0]}".encode(), 42) >> 11) + 0.5) / 2**53
        want.append((d[0], n, weight, weight / max(1, len(grams)), weight - math.log(-math.log(u))))
    limit = sorted((w[4] for w in want), reverse=True)[round(0.3 * len(rows)) - 1]
    order = lambda x: (x[0], x[1], round(x[2], 6))
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert g[:2] == w[:2] and np.allclose(g[2:5], w[2:5], atol=1e-7) and g[5] == (w[4] >= limit - 1e-7)
