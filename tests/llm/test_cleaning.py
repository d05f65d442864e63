import collections
import random
import re

from rategrid.llm import cleaning

from .data import documents, frame


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    covered = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(spark, rows):
    got = sorted((str(r["doc_id"]), *[r[c] for c in COLS]) for r in cleaning.measures(frame(spark, rows, extra=True)).collect())
    assert got == sorted((str(d[0]), *brute(d[1])) for d in rows)


def test_measures_equal_brute_force(spark):
    r = random.Random(5)
    bits = ["a", "b", " ", "\n", "c ", " \x0b", "é", "𐍈 ", "#", "|"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 80))), None, None, None) for i in range(600)]
    rows += [(9000, "a b c " * 20000, None, None, None), (9001, " ".join(map(str, range(50000))), None, None, None)]
    check(spark, rows)
    check(spark, documents())


PROSE = "\n".join("Line " + " ".join(f"w{8 * i + j}" for j in range(8)) + " ends." for i in range(12))


def test_line_rules_and_verdict(spark):
    menu = "\n".join("Home | News | Sports | About us | Contact" for _ in range(2))
    noise = " ".join(f"w{i}%%% x{i}***" for i in range(60))
    table = " | ".join(f"entry{i}" for i in range(80))
    rows = [(1, PROSE, None, None, None), (2, menu + "\n" + PROSE, None, None, None), (3, noise, None, None, None),
            (4, table, None, None, None), (5, PROSE + "\nAll rights reserved.", None, None, None), (6, None, None, None, None)]
    df = frame(spark, rows)
    kept = {r["doc_id"]: (r["kept"], r["n_bad_lines"]) for r in cleaning.measures(df).collect()}
    assert kept[1] == (True, 0) and kept[2] == (True, 2) and kept[5] == (True, 1)
    assert not kept[3][0] and not kept[4][0] and not kept[6][0]
    text = {r["doc_id"]: r["text"] for r in cleaning.clean(df).collect()}
    assert text == {1: PROSE, 2: PROSE, 5: PROSE}


def test_no_python_in_the_plan(spark):
    for df in (cleaning.measures(frame(spark)), cleaning.clean(frame(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert cleaning.measures(frame(spark, [])).count() == 0
    assert cleaning.clean(frame(spark, [])).count() == 0


def test_link_bars_of_any_length_and_separator_go(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    bars = [f" {sep} ".join(f"Entry {i}." for i in range(n)) for sep in "|»·•>" for n in (10, 60)]
    rows = [(i, prose + "\n" + bar, "en", "s", 0) for i, bar in enumerate(bars)] + [(99, prose + "\n" + " . ".join(["a b"] * 60), "en", "s", 0)]
    got = {r["doc_id"]: r["n_bad_lines"] for r in cleaning.measures(frame(spark, rows)).collect()}
    assert got == {**{i: 1 for i in range(len(bars))}, 99: 0}


def test_characters_are_counted_without_translate_and_only_repeats_are_sorted(spark):
    plan = cleaning.measures(frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan
    assert "array_distinct" in plan and plan.index("array_distinct(lambda") < plan.index("sort_array")


def test_symbols_and_phrases_of_any_case_and_place(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    phrases = ["All rights reserved", "Cookie policy", "PRIVACY POLICY", "terms of use", "Terms Of Service", "enable JavaScript",
               "javascript is disabled", "JAVASCRIPT is required", "subscribe to our newsletter", "Lorem ipsum", "click HERE to",
               "Copyright ©", "(C) 1999"]
    lines = [x for p in phrases for x in (p, f"a \t{p} b.", f"xx{p}")] + ["ab#", "#*$%&|<> word.", "\t\x0b #\x0c\r"]
    fine = ["terms off use", "(c) 199", "copyright (c)", "a policy", "abcdefghij#", "\x0b\r\t ", "»·plain"]
    rows = [(i, prose + "\n" + x, "en", "s", 0) for i, x in enumerate(lines + fine)]
    got = {r["doc_id"]: r for r in cleaning.measures(frame(spark, rows)).collect()}
    assert [i for i, r in sorted(got.items()) if r["n_bad_lines"]] == list(range(len(lines)))
    for i, t, *_ in rows:
        assert got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert got[i]["lost_chars"] == (len(re.sub(r"[\x20\x09-\x0D]", "", lines[i])) if i < len(lines) else 0)


def test_blanks_before_a_last_line_or_paragraph_separator(spark):
    tails = (" ", *(a + b for a in (" ", "\n", " \t") for b in ("\x85", "\u2028", "\u2029", "\u2028 \n")))
    check(spark, [(i, "a b c " * 4 + x, None, None, None) for i, x in enumerate(tails)])
