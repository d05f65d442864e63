"""Line-first cleaning in DataFrame functions only.

Every line of a text is judged on its own: punctuation (a longer line needs an
end mark somewhere or few symbol characters), navigation (short entries between
separators, or link-list words) and boilerplate (phrases of notices and
banners).  Failing lines are removed, whatever their length; a text that loses
more than ``MAX_LOST`` of its word characters is rejected.

Base measures per text: words, word characters, symbol characters, repeated
lines and words inside repeated 3-word windows.  Windows are compared by a
64-bit hash of their words: a text whose hashes all differ repeats none, any
other sorts them (linear memory, no pairs), and the windows that share a hash are
compared word by word as well, so a collision cannot count.  Characters of a set
are counted by a regular expression, which costs a fraction of ``translate``.

Cases: null text has no words (all measures 0, base_failed, not kept); blank
lines are neither judged nor counted; repeated rows each keep their row; a null
id keeps its row; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST = 0.5                   # share of word characters that removed lines may hold
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\f\r"
_BLANK = r"[\x20\x09-\x0D]"
_FULL = r"[^\x20\x09-\x0D]"
# a line of navigation: at least three short entries between separators, or a lone link word
_SEPARATORS = "|»·•>"
_LINK_BAR = r"^(?:[^|»·•>\n]{0,40}+[|»·•>]){3,}+[^|»·•>\n]{0,40}$"
_LINK_WORD = r"^(?i:home|menu|login|log in|sign in|sign up|search|next|previous|back to top|read more|share)\W*$"
# the two classes hold the first and the second character of every phrase
_BOILERPLATE = (r"(?i)(?=[acejlpst(][acelnoru])"
                r"(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript"
                r"|javascript is (?:disabled|required)|subscribe to our newsletter|lorem ipsum|click here to"
                r"|copyright ©|\(c\) [0-9]{4})")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def code_points(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are one of ``chars`` (the inside of a
    character class)."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{_BLANK}++", ""))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    If no two windows have the same hash, none is repeated.  Otherwise
    ``(hash, position)`` pairs of the windows are sorted; a window is repeated if
    a neighbour in the sorted order has its hash and its words.  Every repeated
    window covers the words from its start that the next one does not."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def same(a: Column, b: Column) -> Column:
        w = [F.get(words, a["i"] + k) == F.get(words, b["i"] + k) for k in range(3)]
        return (a["h"] == b["h"]) & w[0] & w[1] & w[2]

    def starts(s: Column) -> Column:
        hit = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False))
                       | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(F.sort_array(windows), starts), covered))

    return F.when(F.size(words) >= 4, let(hashes, count)).otherwise(F.lit(0))


def line_fails(line: Column) -> Column:
    """The line rules: true if the line is to be removed.  Blank lines pass."""
    symbols = code_points(line, SYMBOLS)
    no_mark = ~line.rlike(r"[.!?…:;。！？]")
    punctuation = ((symbols > 0) & (symbols * 10 > word_chars(line))) | (no_mark & (F.regexp_count(line, F.lit(WORD)) > 25))
    navigation = ((code_points(line, _SEPARATORS) >= 3) & line.rlike(_LINK_BAR)) | line.rlike(_LINK_WORD)
    return line.rlike(_FULL) & (punctuation | navigation | line.rlike(_BOILERPLATE))


def judge(text: Column) -> Column:
    """``struct`` of all measures of a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.struct(F.split(F.btrim(t, F.lit(_SPACE)), f"{_BLANK}+").alias("words"), F.split(t, "\n", -1).alias("lines"))

    def measure(x: Column) -> Column:
        full = F.filter(x["lines"], lambda y: y.rlike(_FULL))
        marked = F.transform(full, lambda y: F.struct(y.alias("t"), line_fails(y).alias("bad")))

        def finish(m: Column) -> Column:
            lines = F.transform(m, lambda y: y["t"])
            lost = F.aggregate(F.filter(m, lambda y: y["bad"]), F.lit(0), lambda a, y: a + word_chars(y["t"]))
            return F.struct(
                F.when(x["words"][0] == "", 0).otherwise(F.size(x["words"])).cast("long").alias("n_words"),
                F.length(F.array_join(x["words"], "")).cast("long").alias("word_chars"),
                code_points(t, SYMBOLS).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeat_words(x["words"]).cast("long").alias("n_repeat_words"),
                F.size(m).cast("long").alias("n_lines"),
                F.size(F.filter(m, lambda y: y["bad"])).cast("long").alias("n_bad_lines"),
                lost.cast("long").alias("lost_chars"))

        return let(marked, finish)

    return let(parts, measure)


def measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, base measures, line counts, ``base_failed, kept``."""
    x = docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text)).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("lost_chars") > F.lit(MAX_LOST) * F.col("word_chars")
    return x.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` that are kept, without their failing lines (columns unchanged)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    m = judge(F.col(text))
    ok = let(m, lambda x: (x["n_words"] >= MIN_WORDS)
             & (100 * x["n_repeat_words"] <= MAX_REPEAT_PERCENT * x["n_words"])
             & (x["lost_chars"] <= F.lit(MAX_LOST) * x["word_chars"]))
    body = F.array_join(F.filter(F.split(t, "\n", -1), lambda y: ~line_fails(y)), "\n")
    return docs.where(ok).withColumn(text, body)
