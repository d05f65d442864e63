"""Language identification with interpolated Kneser-Ney character models.

Text is reduced to lower-case letters with one space symbol between letter
runs.  Per language, 4-gram counts of all training texts (Spark aggregation)
give an interpolated Kneser-Ney model: counts at order 4, continuation counts
below, one absolute discount per order ``n1 / (n1 + 2 n2)``.  The model is a
set of sorted hash arrays: for each order the sorted hashes of the n-grams seen
in any language with one row of log2 probabilities (all languages, lower orders
already interpolated), and the sorted hashes of contexts with their log2
back-off weights.  A text gets the language of the lowest cross-entropy per
symbol.

Rejection is calibrated on training texts: per language the limit is the larger
of the 99.9 % quantile of the cross-entropy of its own texts and the midpoint
between their median and the entropy of uniform letters, plus an allowance of
``4 * sigma / sqrt(n)`` for a text of ``n`` symbols (``sigma``: deviation per
symbol of the training texts).

Training rows: text and label not null and crc32(doc_id as text) mod 5 not 0;
a null doc_id is never trained on.  Every n-gram of every training text is in
the model and every training text calibrates it.  Up to ``max_grams`` (language,
n-gram) rows the model is a broadcast (:class:`Model`); above, it stays in Spark
tables (:class:`TableModel`) which the distinct n-grams of the scored texts join,
with the resolved rows of the most frequent n-grams as a broadcast of bounded
size, so that only rare n-grams are shuffled.  Both give the same figures up to
the rounding of 32-bit floats.  Label, source and id are never inputs of a
prediction.

Cases: null text or text without a letter is ``und`` with score 0 and rejected;
ties go to the smaller language name; no training rows: everything is ``und``;
rows repeating an id each get their row; very long texts are scored in pieces
of bounded size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import prepare, stage
from rategrid.operators.skew import key_join

ORDER = 4
FOLDS = 5
MAX_GRAMS = 400_000              # rows of a model that is broadcast whole
MAX_CELLS = 8_000_000            # n-grams x languages of the broadcast tables
QUANTILE = 0.999
UNKNOWN = "und"
_PIECE = 1 << 19                 # characters or symbols handled at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd: the product is a bijection of 64-bit words


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> 16-bit symbol: lower-cased letters, 0 for all else.
    Letters beyond 16 bits are folded into the private-use range."""
    out = np.zeros(0x110000, np.uint64)
    for i in range(0x32400):
        c = chr(i)
        if c.isalpha():
            x = ord(c.lower()[0])
            out[i] = x if x < 0x10000 else 0xE000 + x % 0x1900
    return out


def symbol_pieces(text: str) -> Iterator[np.ndarray]:
    """Symbols of a text in pieces; each begins with the ``ORDER - 1`` symbols
    before it (spaces at the start of the text) as context."""
    tab = _letters()
    head = np.zeros(ORDER - 1, np.uint64)
    for at in range(0, len(text), _PIECE):
        s = tab[np.frombuffer(text[at:at + _PIECE].encode("utf-32-le"), np.uint32)]
        s = np.concatenate((head, s))
        keep = np.ones(len(s), bool)
        keep[ORDER - 1:] = (s[ORDER - 1:] != 0) | (s[ORDER - 2:-1] != 0)
        s = s[keep]
        if len(s) >= ORDER:
            yield s
        head = s[-(ORDER - 1):]


def grams(symbols: np.ndarray) -> np.ndarray:
    """Packed 4-grams (16 bits a symbol, the last symbol lowest)."""
    g = symbols[:-3] << np.uint64(48)
    for k, shift in ((1, 32), (2, 16), (3, 0)):
        g |= symbols[k:len(symbols) - 3 + k] << np.uint64(shift)
    return g


def has_letter(text: str | None) -> bool:
    return bool(text) and any(s[ORDER - 1:].any() for s in symbol_pieces(text))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0 (null ids are held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over ``(lang, text)`` rows; tasks send distinct
    n-grams with counts, which Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)),
                                       pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for s in symbol_pieces(text.as_py()):
                    held.setdefault(lang, []).append(grams(s))
                    size += len(s)
                if size >= 4 * _PIECE:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return (rows.mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class _Order:
    """Counts of one order and language: sorted keys, contexts with totals."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(float)
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        self.discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        self.ctx = ctx
        self.total = np.bincount(at, weights=self.counts, minlength=len(ctx))
        lost = np.bincount(at, weights=np.minimum(self.counts, self.discount), minlength=len(ctx))
        self.backoff = lost / self.total

    def weights(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, back-off weight) of contexts; unseen: (inf, 1)."""
        at = np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)
        hit = self.ctx[at] == ctx
        return np.where(hit, self.total[at], np.inf), np.where(hit, self.backoff[at], 1.0)


class _KneserNey:
    """Interpolated Kneser-Ney over packed n-grams of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_symbols: int):
        order = np.argsort(keys)
        self.orders = {ORDER: _Order(keys[order], counts[order])}
        for k in range(ORDER - 1, 0, -1):
            suffix = self.orders[k + 1].keys & np.uint64((1 << 16 * k) - 1)
            self.orders[k] = _Order(*np.unique(suffix, return_counts=True))
        self.uniform = 1.0 / n_symbols

    def prob(self, keys: np.ndarray, k: int) -> np.ndarray:
        o = self.orders[k]
        at = np.minimum(np.searchsorted(o.keys, keys), len(o.keys) - 1)
        count = np.where(o.keys[at] == keys, np.maximum(o.counts[at] - o.discount, 0), 0.0)
        total, back = o.weights(keys >> np.uint64(16))
        lower = self.uniform if k == 1 else self.prob(keys & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
        return count / total + back * lower


@dataclass
class Model:
    """Sorted hash arrays, one row of log2 values per entry, a column a language."""

    langs: list[str]
    gram_hash: dict          # order -> sorted hashes
    gram_logp: dict          # order -> (entries, languages)
    ctx_hash: dict           # order -> sorted hashes of its contexts
    ctx_logw: dict
    floor: np.ndarray        # log2 probability of an unseen symbol
    n_symbols: int
    limits: dict             # language -> (limit, sigma)

    def log2p(self, g: np.ndarray) -> np.ndarray:
        """log2 probabilities (n-grams x languages)."""
        out = np.zeros((len(g), len(self.langs)))
        todo = np.arange(len(g))
        for k in range(ORDER, 0, -1):
            part = g[todo] & np.uint64((1 << 16 * k) - 1) if k < ORDER else g
            at, hit = _find(self.gram_hash[k], part * _MIX)
            out[todo[hit]] += self.gram_logp[k][at[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            at, hit = _find(self.ctx_hash[k], (part >> np.uint64(16)) * _MIX)
            out[todo[hit]] += self.ctx_logw[k][at[hit]]
        out[todo] += self.floor
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def build_model(langs: list[str], lang_at: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Model from aggregated counts (``lang_at`` indexes the sorted ``langs``)."""
    n_symbols = len(np.unique(gram & np.uint64(0xFFFF))) + 1
    models = [_KneserNey(gram[lang_at == i], n[lang_at == i], n_symbols) for i in range(len(langs))]
    gram_hash, gram_logp, ctx_hash, ctx_logw = {}, {}, {}, {}
    for k in range(ORDER, 0, -1):
        keys = np.unique(np.concatenate([m.orders[k].keys for m in models]))
        order = np.argsort(keys * _MIX)
        gram_hash[k] = (keys * _MIX)[order]
        gram_logp[k] = np.log2(np.stack([m.prob(keys, k) for m in models], axis=1))[order].astype(np.float32)
        ctx = np.unique(np.concatenate([m.orders[k].ctx for m in models]))
        order = np.argsort(ctx * _MIX)
        ctx_hash[k] = (ctx * _MIX)[order]
        weights = np.stack([m.orders[k].weights(ctx)[1] for m in models], axis=1)
        ctx_logw[k] = np.log2(np.maximum(weights, 1e-12))[order].astype(np.float32)
    floor = np.log2(np.full(len(langs), 1.0 / n_symbols))
    return Model(langs, gram_hash, gram_logp, ctx_hash, ctx_logw, floor, n_symbols, {})


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cross-entropy per language, symbols, has a letter)`` per text."""
    bits = np.zeros((len(texts), len(model.langs)))
    count = np.zeros(len(texts), np.int64)
    letter = np.zeros(len(texts), bool)
    held, owner, size = [], [], 0

    def flush():
        nonlocal held, owner, size
        if held:
            g = np.concatenate(held)
            cut = np.concatenate(([0], np.cumsum([len(h) for h in held])[:-1]))
            np.add.at(bits, owner, -np.add.reduceat(model.log2p(g), cut, axis=0))
        held, owner, size = [], [], 0

    for i, t in enumerate(texts):
        for s in symbol_pieces(t or ""):
            letter[i] |= bool(s[ORDER - 1:].any())
            g = grams(s)
            held.append(g)
            owner.append(i)
            count[i] += len(g)
            size += len(g)
            if size >= _PIECE:
                flush()
    flush()
    return bits / np.maximum(count, 1)[:, None], count, letter


@dataclass
class TableModel:
    """The model of all n-grams as Spark tables, a row an n-gram or context with a
    map from language (index) to its log2 value; ``hot`` n-grams are resolved."""

    langs: list[str]
    n_symbols: int
    probs: dict              # order -> (gram, m)
    weights: dict            # order -> (ctx, w)
    hot_hash: np.ndarray
    hot_logp: np.ndarray     # (entries, languages)
    limits: dict

    def resolve(self, keys: DataFrame) -> DataFrame:
        """``(gram, v)``: log2 probabilities of all languages per distinct ``gram``."""
        low = None
        for k in range(1, ORDER + 1):
            x = (keys.select(_suffix("gram", k).alias("gram")).distinct()
                 .withColumn("ctx", F.shiftrightunsigned("gram", 16))
                 .join(self.probs[k], "gram", "left").join(self.weights[k], "ctx", "left"))
            if low is None:
                x = x.withColumn("v", F.array_repeat(F.lit(-float(np.log2(self.n_symbols))), len(self.langs)))
            else:
                x = x.withColumn("low", _suffix("gram", k - 1)).join(low.withColumnRenamed("gram", "low"), "low")
            low = x.select("gram", F.transform("v", lambda y, i: F.coalesce(
                F.try_element_at("m", i), y + F.coalesce(F.try_element_at("w", i), F.lit(0.0)))).alias("v"))
        return low


def _suffix(gram: str, k: int) -> Column:
    return F.col(gram) if k == ORDER else F.col(gram).bitwiseAND(F.lit((1 << 16 * k) - 1))


def build_tables(counts: DataFrame, langs: list[str], bound: int) -> TableModel:
    """:func:`build_model` in Spark, of any number of n-grams."""
    n_symbols = counts.agg(F.count_distinct(_suffix("gram", 1)).alias("n")).first()["n"] + 1
    rows = {ORDER: stage(counts.select((F.array_position(F.lit(langs), F.col("lang")) - 1).cast("int").alias("l"),
                                       "gram", "n"), "lang-order")}
    for k in range(ORDER - 1, 0, -1):
        rows[k] = stage(rows[k + 1].groupBy("l", _suffix("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("n")),
                        "lang-order")
    probs, weights, low = {}, {}, None

    def per_key(x: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        return stage(x.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("l", value))).alias(name)), "lang-map")

    for k in range(1, ORDER + 1):
        discounts = [0.5] * len(langs)
        for r in rows[k].groupBy("l").agg(F.count_if(F.col("n") == 1).alias("n1"),
                                          F.count_if(F.col("n") == 2).alias("n2")).collect():
            if r["n1"] and r["n2"]:
                discounts[r["l"]] = r["n1"] / (r["n1"] + 2 * r["n2"])
        x = rows[k].withColumn("d", F.element_at(F.lit(discounts), F.col("l") + 1)).withColumn(
            "ctx", F.shiftrightunsigned("gram", 16))
        ctx = stage(x.groupBy("l", "ctx").agg(F.sum("n").alias("total"), F.sum(F.least(F.col("n").cast("double"), "d"))
                                              .alias("lost")).withColumn("back", F.col("lost") / F.col("total")), "lang-ctx")
        x = x.join(ctx, ["l", "ctx"])
        if low is None:
            x = x.withColumn("p", F.lit(1.0 / n_symbols))
        else:
            x = x.withColumn("low", _suffix("gram", k - 1)).join(low.withColumnRenamed("gram", "low"), ["l", "low"])
        low = stage(x.select("l", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
                                           + F.col("back") * F.col("p")).alias("p")), "lang-prob")
        probs[k] = per_key(low, "gram", F.log2("p"), "m")
        weights[k] = per_key(ctx, "ctx", F.log2(F.greatest("back", F.lit(1e-12))), "w")
    model = TableModel(langs, n_symbols, probs, weights, np.zeros(0, np.uint64), np.zeros((0, len(langs))), {})
    # whole count classes from the top, as many as the bound takes, are resolved once
    total = stage(rows[ORDER].groupBy("gram").agg(F.floor(F.log2(F.sum("n")) * 4).alias("b")), "lang-total")
    hot, level = 0, None
    for r in sorted(total.groupBy("b").count().collect(), reverse=True):
        hot += r["count"]
        if hot > bound:
            break
        level = r["b"]
    if level is not None:
        t = stage(model.resolve(total.where(F.col("b") >= level)), "lang-hot").toArrow()
        keys = t.column("gram").to_numpy().view(np.uint64) * _MIX
        order = np.argsort(keys)
        model.hot_hash = keys[order]
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks])
        model.hot_logp = values.reshape(-1, len(langs))[order].astype(np.float32)
    return model


def table_scores(rows: DataFrame, model: TableModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``_ce array<double>, _n, _letter`` per row of ``rows``
    (``text`` first): frequent n-grams are summed in the task, the distinct rare
    ones of a text join the tables."""
    spark = rows.sparkSession
    fields, width = rows.select(*keep).schema, len(model.langs)
    shared = spark.sparkContext.broadcast((model.hot_hash, model.hot_logp))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] +
                    ["_bits array<double>, _n long, _letter boolean, _g array<long>, _c array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logp = shared.value
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in b.column(0).to_pylist():
                parts, letter, n = [np.zeros(0, np.uint64)], False, 0
                for s in symbol_pieces(text or ""):
                    letter |= bool(s[ORDER - 1:].any())
                    parts.append(grams(s))
                    n += len(parts[-1])
                g, c = np.unique(np.concatenate(parts), return_counts=True)
                bits = np.zeros(width)
                if len(hashes):
                    at, hit = _find(hashes, g * _MIX)
                    bits -= c[hit] @ logp[at[hit]].astype(float)
                    g, c = g[~hit], c[~hit]
                for col, x in zip(cols, (bits, n, letter, g.view(np.int64), c)):
                    col.append(x)
            types = (pa.list_(pa.float64()), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([b.column(i) for i in range(1, b.num_columns)] +
                                  [pa.array(c, t) for c, t in zip(cols, types)],
                                  names=[f.name for f in fields] + ["_bits", "_n", "_letter", "_g", "_c"])

    part = stage(rows.select("text", *keep).mapInArrow(run, out)
                 .withColumn("_at", F.monotonically_increasing_id()), "lang-part")
    rare = part.select("_at", F.explode(F.arrays_zip("_g", "_c")).alias("x")).select(
        "_at", F.col("x._g").alias("gram"), F.col("x._c").alias("c"))
    values = stage(model.resolve(stage(rare.select("gram").distinct(), "lang-seen")), "lang-values")
    sums = (key_join(rare, values, key="gram", by=["_at"]).groupBy("_at")
            .agg(*[F.sum(F.col("c") * F.col("v")[i]).alias(f"s{i}") for i in range(width)])
            .select("_at", F.array(*[f"s{i}" for i in range(width)]).alias("s")))
    bits = F.when(F.col("s").isNull(), F.col("_bits")).otherwise(F.zip_with("_bits", "s", lambda x, y: x - y))
    return part.join(sums, "_at", "left").select(
        *[F.col(c) for c in keep], F.transform(bits, lambda x: x / F.greatest("_n", F.lit(1))).alias("_ce"), "_n", "_letter")


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          max_grams: int = MAX_GRAMS) -> Model | TableModel | None:
    """Model and rejection limits from the training rows of ``docs``; None if
    there is none with a letter.  Above ``max_grams`` rows it stays in tables."""
    prepare(docs.sparkSession)
    rows = (docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
                        held_out(F.col(id_col)).alias("held"))
            .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.col("held")))
    counts = stage(gram_counts(rows.select("lang", "text")), "char-grams")
    # space-only n-grams come from texts without a letter
    counts = counts.where("gram <> 0")
    per_lang = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    langs = sorted(per_lang, key=lambda x: x.encode("utf-8"))
    if not langs:
        return None
    bound = max(1000, min(max_grams, MAX_CELLS // len(langs)))
    if sum(per_lang.values()) > bound:
        model = build_tables(counts, langs, bound)
    else:
        table = counts.toArrow()
        index = {x: i for i, x in enumerate(langs)}
        lang_at = np.array([index[x] for x in table.column("lang").to_pylist()], np.int64)
        model = build_model(langs, lang_at, table.column("gram").to_numpy().view(np.uint64),
                            table.column("n").to_numpy())
    own = predictions(rows.select("text", "lang"), model, ["lang"]).where(F.col("lang") == F.col("lang_pred"))
    for r in own.groupBy("lang").agg(
            F.percentile_approx("cross_entropy", [0.5, QUANTILE], 10000).alias("q"),
            F.avg("cross_entropy").alias("mean"),
            F.avg(F.col("n_symbols") * F.col("cross_entropy") * F.col("cross_entropy")).alias("s2"),
            F.avg(F.col("n_symbols") * F.col("cross_entropy")).alias("s1"),
            F.avg("n_symbols").alias("s0")).collect():
        var = max(0.0, r["s2"] - 2 * r["mean"] * r["s1"] + r["mean"] ** 2 * r["s0"])
        middle = (r["q"][0] + np.log2(model.n_symbols)) / 2
        model.limits[r["lang"]] = (max(r["q"][1], float(middle)), float(np.sqrt(var)))
    return model


def _decide(model: Model | None, texts: list[str | None]):
    n = len(texts)
    if model is None:
        return ([UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.ones(n, bool))
    return _verdict(model.langs, model.limits, *score_texts(model, texts))


def _verdict(langs: list[str], limits: dict, ce: np.ndarray, count: np.ndarray, letter: np.ndarray):
    best = ce.argmin(axis=1)
    low = ce[np.arange(len(ce)), best]
    gap = (ce - low[:, None]) * np.minimum(count, 100)[:, None]
    score = 1.0 / np.exp2(-np.minimum(gap, 500)).sum(axis=1)
    limit = np.array([limits.get(x, (np.inf, 0.0)) for x in langs])
    rejected = ~letter | (low > limit[best, 0] + 4 * limit[best, 1] / np.sqrt(np.maximum(count, 1)))
    pred = [langs[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
    return pred, np.where(letter, score, 0.0), np.where(letter, low, 0.0), count, rejected


def predictions(rows: DataFrame, model: Model | TableModel | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred, score, cross_entropy, n_symbols,
    rejected``; ``rows`` has ``text`` first."""
    fields = rows.select(*keep).schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] +
                    ["lang_pred string, score double, cross_entropy double, n_symbols long, rejected boolean"])
    names = [f.name for f in fields] + ["lang_pred", "score", "cross_entropy", "n_symbols", "rejected"]

    def batch(kept: list, verdict: tuple) -> pa.RecordBatch:
        pred, score, ce, n, rejected = verdict
        return pa.record_batch([*kept, pa.array(pred, pa.string()), pa.array(score), pa.array(ce), pa.array(n),
                                pa.array(rejected)], names=names)

    if isinstance(model, TableModel):
        langs, limits = model.langs, dict(model.limits)

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ce, n, letter = b.column("_ce"), b.column("_n"), b.column("_letter")
                ce = ce.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
                yield batch(b.columns[:-3], _verdict(langs, limits, ce, n.to_numpy(),
                                                     letter.to_numpy(zero_copy_only=False)))

        return table_scores(rows, model, keep).mapInArrow(decide, out)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(b.columns[1:], _decide(shared.value, b.column(0).to_pylist()))

    return rows.select("text", *keep).mapInArrow(run, out)


def predict(docs: DataFrame, model: Model | TableModel | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, n_symbols, rejected``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).alias("doc_id"),
                       held_out(F.col(id_col)).alias("held_out"))
    return predictions(rows, model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, model: Model | TableModel | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows the model rejects (all columns pass through)."""
    spark = prepare(docs.sparkSession)
    if isinstance(model, TableModel):
        # renamed: a column of docs may have the name of one used inside
        rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        rows = rows.select(F.col(f"c{docs.columns.index(text)}").cast("string").alias("text"), *rows.columns)
        kept = predictions(rows, model, rows.columns[1:]).where(~F.col("rejected"))
        return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rejected = _decide(shared.value, b.column(at).to_pylist())[-1]
            yield b.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
