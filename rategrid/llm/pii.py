"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans (leftmost, non-overlapping per kind; failing matches dropped): email,
ip, card (Luhn), phone.  Each whole span, with spaces or not, is a seed instance;
each identifier-like word (one with a digit or ``@``) that touches no span is an
instance too.  An instance has lexical patterns: the two words before it, and
the word on either side, where the neighbouring identifier counts as one
placeholder word and the ends of the text as markers (a pattern has at least one
word or placeholder).  Words of a seed shape (``SEED_SHAPES``: long hexadecimal
strings, as keys and tokens have) are seeds of the graph too, but are spans only
where their context is trusted.

A context says something only if it rarely holds an ordinary word.  Patterns
without a letter in their words are left out, and the ordinary words (no digit,
no ``@``) in every other pattern's context are counted over all texts: at least
``MIN_FILL`` of a context's words must be instances.  Separators and common words
next to a few identifiers by chance fail this, mostly by a small part of the texts.

Spark scores the pattern-instance graph in rounds: a
pattern's confidence is the mean score of its distinct instances, an instance's
score the best confidence of its trusted patterns (seeds: 1).  A pattern is
trusted from ``MIN_SUPPORT`` distinct seeds or identifiers found in the round
before, and confidence ``MIN_CONFIDENCE`` on.  Identifier-like words in a trusted
pattern that touch no base span are added as kind ``id``.

Limits, all module parameters: an instance has ``MIN_TOKEN`` characters or more; an
added span and an instance that supports a later round have ``MIN_DIGITS`` digits
or more, or a seed shape; context words are cut at ``CONTEXT`` code points from
the instance.

Offsets are code points, end exclusive; they come from the lengths of the
pieces between matches, so no text is searched twice for a position.  All
regular expressions use possessive quantifiers where nothing can be given
back, which keeps long digit runs from recursing.

Cases: null text is empty (no spans); a null doc_id keeps its row; rows
repeating an id each keep their row; overlapping spans of different kinds are
all listed and redacted once; empty tables give empty results; extra columns
are ignored (``redact`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import stage
from rategrid.operators.skew import key_join

# (?:(?<!x)|\G) starts only at the start of a run of x, or right after the
# previous match: the leftmost match is the same and a run is scanned once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}  # a literal every match has
_IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)(?:\.|$)){4}$"
WORDLIKE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.7
ROUNDS = 3
MIN_FILL = 0.2                   # share of the words in a trusted context that are instances
MIN_TOKEN = 5
MIN_DIGITS = 3
SEED_SHAPES = ("[0-9a-fA-F]{32,}",)
CONTEXT = 64                     # code points of context looked at on either side
BROADCAST_PATTERNS = 1_000_000
PARTS = (1, 8, 64)               # ends of the parts of the texts (by hash) in which ordinary words are counted
_BLANK = " \t\n\x0b\x0c\r"
_START, _END, _NEIGHBOUR = "<s>", "</s>", "<id>"
_SPANS = "array<struct<s:int,e:int,m:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str) -> Column:
    """Matches as ``array<struct<s, e, m, before, after>>``: code-point offsets,
    the match and the pieces of text around it."""
    found = F.struct(F.split(text, pattern, -1).alias("p"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def place(x: Column) -> Column:
        parts = F.transform(x["m"], lambda m, i: F.struct(
            F.length(F.get(x["p"], i)).alias("gap"), F.length(m).alias("len")))
        ends = F.aggregate(
            parts, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("ends")),
            lambda a, y: F.struct((a["at"] + y["gap"] + y["len"]).alias("at"),
                                  F.concat(a["ends"], F.array(a["at"] + y["gap"] + y["len"])).alias("ends")),
            lambda a: a["ends"])
        return let(ends, lambda e: F.transform(x["m"], lambda m, i: F.struct(
            (F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), m.alias("m"),
            F.get(x["p"], i).alias("before"), F.get(x["p"], i + 1).alias("after"))))

    return let(found, place)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a digit string."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", F.lit(0)).otherwise(
            let(d.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(_IP_PARTS)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(8, 15)


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind with their text, ``array<struct<s, e, m>>``."""
    spans = F.transform(F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"])),
                        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    none = F.expr(f"CAST(array() AS {_SPANS})")
    need = _NEEDS[kind]
    if need is not None:
        return F.when(F.contains(text, F.lit(need)), spans).otherwise(none)
    return F.when(text.rlike("[0-9]"), spans).otherwise(none)


def _items(words: Column, spaced: Column) -> Column:
    """Identifier-like words, those that one of the ``spaced`` spans joins as one:
    ``array<struct<s, e, m, before, after>>``."""
    def joined(i: Column) -> Column:
        left, right = F.get(words, i - 1), F.get(words, i)
        return F.exists(spaced, lambda b: (b["s"] < left["e"]) & (right["s"] < b["e"]))

    first = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | ~joined(i))
    many = let(first, lambda f: F.transform(f, lambda i, j: let(
        F.coalesce(F.get(f, j + 1), F.size(words)) - 1, lambda last: F.struct(
            F.get(words, i)["s"].alias("s"), F.get(words, last)["e"].alias("e"), F.get(words, i)["m"].alias("m"),
            F.get(words, i)["before"].alias("before"), F.get(words, last)["after"].alias("after")))))
    return F.when((F.size(words) > 1) & (F.size(spaced) > 0), many).otherwise(words)


def _instances(text: Column, base: Column, spaced: Column) -> Column:
    """Whole base spans and the other identifier-like words with their two
    patterns, ``array<struct<s, e, token, patterns, seed>>``.  ``base`` are all
    spans, ``spaced`` those that may hold a space."""
    def words_before(before: Column) -> Column:
        return let(F.rtrim(before, F.lit(_BLANK)), lambda x: F.struct(
            F.slice(F.reverse(F.filter(F.split(F.lower(F.right(x, F.lit(CONTEXT))), r"[\x20\x09-\x0D]+"),
                                       lambda w: w != "")), 1, 2).alias("w"),
            (F.length(x) > CONTEXT).alias("more")))

    def describe(items: Column, near: Column):
        def edge(i: Column) -> Column:
            return F.when(i > 0, F.lit(_NEIGHBOUR)).otherwise(F.lit(_START))

        def run(x: Column, i: Column) -> Column:
            own = F.get(near, i)
            one = F.coalesce(F.get(own["w"], 0), edge(i))
            two = (F.when(F.size(own["w"]) == 2, F.get(own["w"], 1))
                   .when(F.size(own["w"]) == 1, F.when(~own["more"], edge(i)))
                   .when(i > 0, F.coalesce(F.get(F.get(near, i - 1)["w"], 0), edge(i - 1))))
            nxt = F.lower(F.regexp_extract(F.left(F.ltrim(x["after"], F.lit(_BLANK)), F.lit(CONTEXT)),
                                           r"^[^\x20\x09-\x0D]+", 0))
            nxt = F.when(nxt != "", nxt).when(i < F.size(items) - 1, F.lit(_NEIGHBOUR)).otherwise(F.lit(_END))
            patterns = let(F.struct(one.alias("one"), two.alias("two"), nxt.alias("nxt")), lambda c: F.array(
                F.when(c["one"] != _START, F.concat(F.lit("LL "), c["two"], F.lit(" "), c["one"])),
                F.when((c["one"] != _START) | (c["nxt"] != _END),
                       F.concat(F.lit("LR "), c["one"], F.lit(" _ "), c["nxt"]))))
            lead = F.length(F.regexp_extract(x["m"], r"^[^A-Za-z0-9]*", 0))
            token = F.regexp_extract(x["m"], r"^[^A-Za-z0-9]*(.*?)[^A-Za-z0-9]*$", 1)
            inside = F.filter(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            return let(F.struct(inside.alias("b"), patterns.alias("p")), lambda y: F.when(
                F.size(y["b"]) > 0, F.transform(y["b"], lambda b: F.struct(
                    b["s"].alias("s"), b["e"].alias("e"), b["m"].alias("token"), y["p"].alias("patterns"),
                    F.lit(True).alias("seed"))))
                .otherwise(F.array(F.struct(
                    (x["s"] + lead).alias("s"), (x["s"] + lead + F.length(token)).alias("e"), token.alias("token"),
                    y["p"].alias("patterns"), F.lit(False).alias("seed")))))

        return F.flatten(F.transform(items, run))

    none = F.expr("CAST(array() AS array<struct<s:int,e:int,token:string,patterns:array<string>,seed:boolean>>)")
    every = let(located(text, WORDLIKE), lambda words: let(_items(words, spaced), lambda items: let(
        F.transform(items, lambda x: words_before(x["before"])), lambda near: describe(items, near))))
    return F.when(text.rlike("[0-9@]"), every).otherwise(none)


def extraction(text: Column) -> Column:
    """``struct<email, ip, card, phone, words>``: base spans per kind and the
    instances, each marked ``seed`` if it is a base span."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    found = F.struct(*[base_spans(t, k).alias(k) for k in KINDS])

    def mark(x: Column) -> Column:
        return F.struct(*[x[k].alias(k) for k in KINDS], _instances(
            t, F.concat(*[x[k] for k in KINDS]), F.concat(x["card"], x["phone"])).alias("words"))

    return let(found, mark)


def shaped(token: Column, shapes: tuple[str, ...] = SEED_SHAPES) -> Column:
    """Whether a whole word has one of the seed shapes."""
    return token.rlike(f"^(?:{'|'.join(shapes)})$") if shapes else F.lit(False)


def ordinary_contexts(texts: DataFrame) -> DataFrame:
    """``pattern``: the two patterns of every ordinary word (no digit, no ``@``) of the
    column ``text``.  Words with a digit or ``@`` are placeholders, text ends are
    markers, words are cut as in :func:`extraction`."""
    def near(text: Column) -> Column:
        # a letter for each cut word, blank words out: the ends give the markers
        word = F.split(F.regexp_replace(text, f"^[{_BLANK}]++|[{_BLANK}]++$", ""), f"[{_BLANK}]+")
        return let(word, lambda w: F.concat(
            F.array(F.lit(_START)), F.transform(w, lambda y: F.when(y.rlike("[0-9@]"), F.lit(_NEIGHBOUR)).otherwise(F.lower(y))),
            F.array(F.lit(_END))))

    def both(w: Column) -> Column:
        def contexts(y: Column, i: Column) -> Column:
            one, nxt = F.get(w, i - 1), F.get(w, i + 1)
            return F.when((i > 0) & (i < F.size(w) - 1) & (y != _NEIGHBOUR), F.array(
                F.when(one != _START, F.concat(
                    F.lit("LL "), F.right(F.get(w, i - 2), F.lit(CONTEXT)), F.lit(" "), F.right(one, F.lit(CONTEXT)))),
                F.concat(F.lit("LR "), F.right(one, F.lit(CONTEXT)), F.lit(" _ "), F.left(nxt, F.lit(CONTEXT)))))

        return F.flatten(F.filter(F.transform(w, contexts), lambda y: y.isNotNull()))

    text = F.col("text").cast("string")
    return texts.where(text.rlike(f"[^{_BLANK}]")).select(near(text).alias("w")).select(
        F.explode(let(F.col("w"), both)).alias("pattern")).where(F.col("pattern").isNotNull())


def telling(edges: DataFrame, texts: DataFrame, min_support: int = MIN_SUPPORT, min_fill: float = MIN_FILL) -> DataFrame:
    """``pattern``: the patterns with a letter, ``min_support`` distinct instances and
    ``min_fill`` of the words in their context instances.  Ordinary words are counted
    for these patterns only, over one part of the texts after the other (``PARTS``): a
    pattern that has too many in the parts so far has too many in all, so the frequent
    contexts go after the first, small part and the rest meets few.  The patterns
    are broadcast up to ``BROADCAST_PATTERNS``; above that all contexts of the part are
    counted, combined map-side."""
    names = F.regexp_replace(F.substring("pattern", 4, 1 << 30), "<id>|<s>|</s>", "")
    left = stage(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"))
                 .where((F.col("n") >= min_support) & names.rlike(r"\p{L}"))
                 .select("pattern", "times", F.lit(0).cast("long").alias("plain")), "pii-contexts")
    part, start = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(PARTS[-1])), 0
    for end in PARTS:
        n = left.count()
        if not n:
            break
        every = ordinary_contexts(texts.where((part >= start) & (part < end)))
        if n <= BROADCAST_PATTERNS:
            every = every.join(F.broadcast(left.select("pattern")), "pattern", "left_semi")
        found = every.groupBy("pattern").agg(F.count(F.lit(1)).alias("found"))
        left = stage(left.join(found, "pattern", "left")
                     .select("pattern", "times", (F.col("plain") + F.coalesce("found", F.lit(0))).alias("plain"))
                     .where(F.col("times") >= F.lit(min_fill) * (F.col("times") + F.col("plain"))), "pii-telling")
        start = end
    return left.select("pattern")


def trusted_patterns(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
                     min_confidence: float = MIN_CONFIDENCE, min_fill: float = MIN_FILL,
                     shapes: tuple[str, ...] = SEED_SHAPES) -> DataFrame:
    """All patterns (column ``pattern``) the pattern-instance graph trusts, from
    rows with a ``words`` array; ``texts`` has all texts (column ``text``).  Edges are
    distinct (pattern, instance) pairs, combined before they are shuffled; nothing
    is collected."""
    words = found.select(F.explode("words").alias("w"))
    seed = F.col("w.seed") | shaped(F.col("w.token"), shapes)
    edges = stage(
        words.select(F.explode("w.patterns").alias("pattern"), F.lower("w.token").alias("instance"), seed.alias("seed"))
        .where(F.col("pattern").isNotNull() & (F.length("instance") >= MIN_TOKEN))
        .groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times")), "pii-edges")
    # a pattern with fewer distinct instances is never trusted and says nothing about them
    enough = telling(edges, texts, min_support, min_fill)
    edges = edges.drop("times")
    graph = stage(key_join(edges, enough.select("pattern"), key="pattern", how="left_semi", by=["instance"]), "pii-graph")
    scored = graph.withColumn("score", F.col("seed").cast("double"))
    counts = (F.col("score") > 0) & (F.col("seed") | (F.length(_digits(F.col("instance"))) >= MIN_DIGITS))
    for r in range(rounds):
        conf = (scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if(counts).alias("support"))
                .where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)))
        if r == rounds - 1:
            break
        conf = stage(conf, "pii-conf")
        if conf.isEmpty():
            break
        best = (key_join(graph.where(~F.col("seed")), conf.select("pattern", "confidence"), key="pattern", by=["instance"])
                .groupBy("instance").agg(F.max("confidence").alias("best")))
        scored = stage(key_join(graph, best, key="instance", how="left", by=["pattern"]).withColumn(
            "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))).drop("best"), "pii-round")
    return stage(conf.select("pattern"), "pii-trusted")


def added_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(_at, added)``: the identifier-like words in a trusted pattern that touch
    no base span, of the rows ``(_at, words)`` that have one; ``added`` is
    ``array<struct<s, e>>`` in text order."""
    words = (found.select("_at", F.explode(F.filter("words", lambda w: ~w["seed"])).alias("w"))
             .where((F.length("w.token") >= MIN_TOKEN)
                    & ((F.length(_digits(F.col("w.token"))) >= MIN_DIGITS) | shaped(F.col("w.token"))))
             .select("_at", "w.s", "w.e", F.explode("w.patterns").alias("pattern")).where(F.col("pattern").isNotNull()))
    hit = key_join(words, patterns, key="pattern", how="left_semi", by=["_at", "s"]).select("_at", "s", "e").distinct()
    return hit.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("added"))


def _with_added(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` (staged, with ``_at`` and ``words``) with their ``added`` spans."""
    none = F.expr("CAST(array() AS array<struct<s:int,e:int>>)")
    if patterns.isEmpty():
        return rows.withColumn("added", none)
    return (rows.join(added_spans(rows.select("_at", "words"), patterns), "_at", "left")
            .withColumn("added", F.coalesce("added", none)))


def _listing(kinds: dict[str, Column]) -> Column:
    def named(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))

    return F.array_join(F.concat(*[F.transform(spans, named(k)) for k, spans in kinds.items()]), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), extraction(F.col(text)).alias("x"))
    rows = stage(rows.select("doc_id", "x.*", F.monotonically_increasing_id().alias("_at")), "pii")
    found = _with_added(rows, trusted_patterns(rows.select("words").where(F.size("words") > 0),
                                               docs.select(F.col(text).alias("text"))))
    base = {k: F.col(k) for k in KINDS}
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listing(base), 256).alias("base_sha256"),
        _listing({**base, "id": F.col("added")}).alias("spans"))


def _replaced(t: Column, kinds: dict[str, Column]) -> Column:
    def marked(kind: str):
        return lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k"))

    def rebuild(all_spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))
        step = F.aggregate(
            all_spans, start,
            lambda a, y: F.when(y["s"] < a["at"], F.struct(F.greatest(a["at"], y["e"]).alias("at"), a["out"].alias("out")))
            .otherwise(F.struct(y["e"].alias("at"), F.concat(
                a["out"], F.array(t.substr(a["at"] + 1, y["s"] - a["at"]), y["k"])).alias("out"))),
            lambda a: F.concat(F.array_join(a["out"], ""), t.substr(a["at"] + 1, F.length(t) - a["at"])))
        return F.when(F.size(all_spans) == 0, t).otherwise(step)

    return let(F.sort_array(F.concat(*[F.transform(v, marked(k)) for k, v in kinds.items()])), rebuild)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of :func:`find` replaced by ``[KIND]`` (spans that
    overlap are replaced once, by the kind that starts first).  Rows are staged with
    what was found, so their texts are searched once; only where no pattern is
    trusted are the rows of ``docs`` left in place and their base spans replaced."""
    # the columns of docs stay in one struct: they may be named like those used here
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("d"), extraction(F.col(text)).alias("x"),
                       F.monotonically_increasing_id().alias("_at"))
    rows = stage(rows.select("d", "x.*", "_at"), "pii")
    patterns = trusted_patterns(rows.select("words").where(F.size("words") > 0), rows.select(F.col("d")[text].alias("text")))
    if patterns.isEmpty():
        t = F.col(text).cast("string")
        base = F.struct(*[base_spans(t, k).alias(k) for k in KINDS])
        clean = F.when(t.rlike("[0-9@]"), let(base, lambda b: _replaced(t, {k: b[k] for k in KINDS}))).otherwise(t)
        return docs.select(*[(clean if c == text else F.col(c)).alias(c) for c in docs.columns])
    found = _with_added(rows, patterns)
    clean = _replaced(F.col("d")[text].cast("string"), {**{k: F.col(k) for k in KINDS}, "id": F.col("added")})
    return found.select(*[(clean if c == text else F.col("d")[c]).alias(c) for c in docs.columns])
