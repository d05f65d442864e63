"""Mixing sources to target weights with a low-discrepancy schedule.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the
total of all sizes; a target stops at ``max_repeat`` times its source's size and
the excess is shared again by weight until none is above (exact integer sums).

Each source's documents are shuffled (by md5 of seed and id) and form a stream
that repeats.  The stream is cut into blocks of ``block_words`` words.  Slot
``s`` of the mix maps the golden-ratio point ``frac((s + 0.5) * phi)`` through the
cumulative target shares to a source; the rank of a slot among the slots of its
source names the block that it holds.  A block past the target is cut at it, so
every source's words come to its target (rounded down) exactly, and a block
that no slot reaches is appended, so nothing is lost.  A document's first slot
is the first one that reads a block with words of it; ``apply_mix`` can write its
rows in the order of the slots.

Running sums use buckets of the shuffled order (see
:func:`rategrid.llm.common.running_start`), so no source is sorted in one task.

Cases: null text has size 0 and is never taken; rows repeating an id are
separate rows; a null id shuffles by the empty string; an empty table or a total
of 0 gives targets 0 and an empty mix; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.llm.common import running_start, stage, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 65536
SEED = "mix"
GOLDEN = 0.6180339887498949
_SLOT_BUCKET = 1 << 16


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """md5 of seed and id as text (32 hex digits)."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Narrow rows ``doc_id, source, size, key, u``; ``u`` in [0, 1) from the key."""
    key = shuffle_key(F.col(id_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), key.alias("key"),
        (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))).alias("u"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, rank, weight, target`` per source.

    Ranks come from a range-partitioned sort of the sources; each round of the
    resharing is one aggregate over the (staged) source table, whose two exact
    sums are all that reaches the driver."""
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = sizes.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")).rdd.zipWithIndex().map(
        lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    src = spark.createDataFrame(ranked, "source string, source_size long, rank long")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = stage(src.withColumn("weight", pick.cast("long")), "sources")
    cap = F.col("source_size") * max_repeat
    total = src.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = None       # words per unit of weight for the sources below their cap
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        r = src.agg(F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if not r["w"]:
            break
        now = (total - (r["full"] or 0)) / r["w"]
        if now == level:
            break
        level = now
    target = F.least(F.col("weight") * F.lit(float(level or 0)), cap.cast("double"))
    return src.withColumn("target", target)


def stream(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with ``source_size``, ``target`` and ``start``, their offset in the
    shuffled source."""
    placed = running_start(rows, ["source"], ["u", "key", "size"], "size", "u", "start")
    s = sources.select("source", "source_size", "rank", "target")
    return placed.alias("d").join(s.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "inner").select(
        "d.*", "s.source_size", "s.rank", "s.target")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Taken pieces ``rank, block, pass, start, from_word, n_words``: the words
    of a document that one block of the repeated stream takes."""
    t = F.floor("target").cast("long")
    size, length = F.col("size"), F.col("source_size")
    passes = placed.where((size > 0) & (F.col("start") < t)).withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((t - F.col("start") - 1) / length).cast("long"))))
    at = F.col("pass") * length + F.col("start")
    passes = passes.withColumn("_a", at).withColumn("_b", F.least(F.col("_a") + size, t))
    block = F.explode(F.sequence(F.floor(F.col("_a") / block_words), F.floor((F.col("_b") - 1) / block_words)))
    cut = passes.withColumn("block", block)
    lo = F.greatest(F.col("_a"), F.col("block") * block_words)
    hi = F.least(F.col("_b"), (F.col("block") + 1) * block_words)
    return cut.select("doc_id", "source", "rank", "start", "pass", "block",
                      (lo - F.col("_a")).alias("from_word"), (hi - lo).alias("n_words"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots ``slot, rank, block`` of the mix: golden-ratio points mapped through
    the cumulative target shares, ranked per source (slots past a source's last
    block left out)."""
    spark = sources.sparkSession
    words = F.floor("target").cast("long")
    r = sources.agg(F.sum(words).alias("t"), F.count_if(words >= 1).alias("k")).first()
    total = int(r["t"] or 0)
    need = F.ceil(F.floor("target") / block_words).cast("long")
    share = running_share(sources, total).withColumn("need", need)
    n_slots = total * 102 // (100 * block_words) + 8 * int(r["k"] or 0) + 8 if total else 0
    point = (F.col("slot") + 0.5) * GOLDEN
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").select(
        "slot", (point - F.floor(point)).alias("x"), F.floor(F.col("slot") / _SLOT_BUCKET).alias("chunk"),
        (F.floor((point - F.floor(point)) * 4096)).cast("int").alias("cell"))
    cells = share.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * 4096).cast("int"),
                                     F.least(F.floor(F.col("hi") * 4096), F.lit(4095)).cast("int"))))
    drawn = slots.join(cells, "cell").where("x >= lo AND x < hi").select(
        "slot", "rank", "need", (F.col("slot") / F.lit(float(max(1, n_slots)))).alias("u"),
        F.lit(1).alias("one"))
    ranked = running_start(drawn, ["rank"], ["slot"], "one", "u", "block")
    return ranked.where("block < need").select("slot", "rank", "block")


def running_share(sources: DataFrame, total: int) -> DataFrame:
    """Sources with their interval ``[lo, hi)`` of the cumulative target shares."""
    n = sources.count()
    placed = running_start(
        sources.withColumn("_all", F.lit(0)).withColumn("_pos", F.col("rank") / F.lit(float(max(1, n))))
        .withColumn("_units", F.floor("target").cast("long")),
        ["_all"], ["rank"], "_units", "_pos", "_before")
    scale = F.lit(float(max(total, 1)))
    return placed.select("rank", "target", (F.col("_before") / scale).alias("lo"),
                         ((F.col("_before") + F.col("_units")) / scale).alias("hi"))


def mix(placed: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: taken pieces with the ``slot`` their block is read at.  Blocks no
    slot reached come after all slots, in order of source and block."""
    got = pieces(placed, block_words)
    slots = schedule(sources, block_words)
    after = F.lit(1 << 40) + F.col("p.block") * F.lit(1 << 20) + F.col("p.rank")
    return got.alias("p").join(
        slots.alias("s"), (F.col("p.rank") == F.col("s.rank")) & (F.col("p.block") == F.col("s.block")), "left"
    ).select("p.*", F.coalesce(F.col("s.slot"), after).alias("slot"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
         weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """``(placed rows, sources)``, both staged."""
    rows = stage(sized(docs, id_col, text, source), "sizes")
    sources = stage(source_targets(rows, weights, max_repeat), "targets")
    return stage(stream(rows, sources), "stream"), sources


def taken_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken, first_slot``
    (null where nothing is taken)."""
    placed, sources = plan(docs, id_col, text, source)
    per_row = mix(placed, sources, block_words).groupBy("rank", "start").agg(
        F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.alias("d").join(
        per_row.alias("t"),
        (F.col("d.rank") == F.col("t.rank")) & (F.col("d.start") == F.col("t.start")) & (F.col("d.size") > 0), "left"
    ).select("d.doc_id", "d.size", "d.source_size", "d.target",
             F.coalesce(F.col("t.taken"), F.lit(0)).cast("long").alias("taken"), F.col("t.first_slot"))


TAKEN_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s0),
lv AS (
  SELECT 0 AS i, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS lam, -1.0::DOUBLE AS prev
  UNION ALL
  SELECT i + 1,
         ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(source_size * 3), 0) FROM s WHERE w * lam > source_size * 3))::DOUBLE
         / (SELECT sum(w) FROM s WHERE NOT w * lam > source_size * 3), lam
  FROM lv WHERE lam <> prev AND (SELECT count(*) FROM s WHERE NOT w * lam > source_size * 3) > 0),
t AS (SELECT source, source_size, least(w * (SELECT arg_max(lam, i) FROM lv WHERE lam IS NOT NULL), source_size * 3.0) AS target FROM s),
r AS (SELECT source, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank,
             floor(target)::BIGINT AS tt FROM t),
share AS (
  SELECT rank, tt, coalesce(sum(tt) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE
                   / greatest(sum(tt) OVER (), 1)::DOUBLE AS lo,
         sum(tt) OVER (ORDER BY rank)::DOUBLE / greatest(sum(tt) OVER (), 1)::DOUBLE AS hi FROM r),
points AS (
  SELECT i AS slot, (i::DOUBLE + 0.5::DOUBLE) * CAST('0.6180339887498949' AS DOUBLE) AS y
  FROM (SELECT unnest(range((SELECT CASE WHEN sum(tt) > 0 THEN sum(tt)::BIGINT * 102 // 6553600
                                              + 8 * count(*) FILTER (tt >= 1) + 8 ELSE 0 END FROM r)::BIGINT)) AS i)),
drawn AS (
  SELECT slot, rank, tt, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS block
  FROM points JOIN share ON y - floor(y) >= lo AND y - floor(y) < hi),
slots AS (SELECT slot, rank, block FROM drawn WHERE block * 65536 < tt),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target::DOUBLE AS target, floor(t.target)::BIGINT AS tt, r.rank,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN r ON d.source IS NOT DISTINCT FROM r.source),
passes AS (
  SELECT rank, st, size, tt, source_size, unnest(range((tt - st - 1) // source_size + 1)) AS pass
  FROM p WHERE size > 0 AND st < tt),
blocks AS (
  SELECT rank, st, unnest(range((pass * source_size + st) // 65536,
                                (least(pass * source_size + st + size, tt) - 1) // 65536 + 1)) AS block FROM passes),
firsts AS (
  SELECT b.rank, b.st, min(coalesce(slot, 1099511627776 + b.block * 1048576 + b.rank))::BIGINT AS first_slot
  FROM blocks b LEFT JOIN slots s ON b.rank = s.rank AND b.block = s.block GROUP BY 1, 2)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         size * (tt // source_size) + greatest(0, least(size, tt % source_size - p.st)) END::BIGINT AS taken,
       first_slot
FROM p LEFT JOIN firsts f ON p.rank = f.rank AND p.st = f.st AND p.size > 0
"""


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
              block_words: int = BLOCK_WORDS, ordered: bool = False) -> DataFrame:
    """The mixed rows with the columns of ``docs``: a row once for each pass that
    takes all of it, cut after its last taken word in a pass that ends inside it.
    ``ordered`` sorts them by slot over range partitions (one more exchange of the
    texts): written, the files follow the schedule.

    A row's take is attached through its id, size and source; rows that agree in
    these are told apart by their order among such rows."""
    placed, sources = plan(docs, id_col, text, source)
    takes = mix(placed, sources, block_words).groupBy("rank", "start", "pass").agg(
        F.sum("n_words").alias("n"), F.min("slot").alias("slot"))
    per_row = takes.groupBy("rank", "start").agg(F.sort_array(F.collect_list(F.struct("n", "slot")), asc=False).alias("takes"))
    narrow = placed.alias("d").join(
        per_row.alias("t"), (F.col("d.rank") == F.col("t.rank")) & (F.col("d.start") == F.col("t.start")), "inner"
    ).where("d.size > 0").select("d.doc_id", "d.source", "d.size", "d.start", "t.takes")
    # rows that share id, source and size are interchangeable in size: their takes are dealt by rank among them
    twin = Window.partitionBy("doc_id", "source", "size")
    dealt = stage(narrow.withColumn("nth", F.row_number().over(twin.orderBy("start"))), "takes")
    many = dealt.where("nth > 1").select("doc_id", "source", "size").distinct()
    row = F.struct(*[F.col(c) for c in docs.columns])
    base = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.col(source).cast("string").alias("_src"),
                       word_count(F.col(text)).alias("_size"))
    twins = base.join(many, (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("_src").eqNullSafe(F.col("source")))
                      & (F.col("_size") == F.col("size")), "left_semi")
    numbered = twins.withColumn(
        "_nth", F.row_number().over(Window.partitionBy("_id", "_src", "_size").orderBy(F.xxhash64("_row"))))
    single = base.join(many, (F.col("_id").eqNullSafe(F.col("doc_id"))) & (F.col("_src").eqNullSafe(F.col("source")))
                       & (F.col("_size") == F.col("size")), "left_anti").withColumn("_nth", F.lit(1))
    joined = single.unionByName(numbered).join(
        dealt, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_src").eqNullSafe(F.col("source"))
        & (F.col("_size") == F.col("size")) & (F.col("_nth") == F.col("nth")), "inner")
    out = joined.select("_row", "_size", "start", F.explode("takes").alias("_t")).select(
        "_row", "_size", "start", F.col("_t.n").alias("_take"), F.col("_t.slot").alias("_slot"))
    if ordered:
        out = out.repartitionByRange("_slot", "start").sortWithinPartitions("_slot", "start")
    body = F.col(f"_row.{text}")
    words = F.regexp_extract_all(body, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.when(F.col("_take") >= F.col("_size"), body).otherwise(
        F.rtrim(F.array_join(F.slice(words, 1, F.col("_take").cast("int")), "")))
    return out.select(*[(cut if c == text else F.col(f"_row.{c}")).alias(c) for c in docs.columns])
