import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rategrid.llm import pii

from .data import documents, frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                    or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)):
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    r = random.Random(1)
    chars = "0123456789  ..--@+()aZ_%é𐍈\n"
    rows = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    rows += [None, "", "4" * 30000, "1 2-" * 9000, "+1" + "2.3 " * 9000, "a.b" * 20000 + "@x.y" + ".z" * 9000,
             "1.2.3.4" * 3000, "a@b.c_d@e.f 0000255.1.2.3 256.1.1.1", "4111 1111 1111 1111 4111111111111112",
             "+1 (234) 555-0199"]
    return [(i, t, None, None, None) for i, t in enumerate(rows)]


def test_base_spans_equal_brute_force(spark):
    rows = texts()
    got = {r["doc_id"]: r for r in pii.find(frame(spark, rows, extra=True)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = brute(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["spans"].startswith(listed)


def test_trusted_patterns_find_unseen_identifiers(spark):
    seen = ["a1@x.org", "b2@x.org", "c3@y.org", "d4@z.net"]
    rows = [(i, f"please mail user id {k} today", None, None, None) for i, k in enumerate([*seen, "ZX-48213", "abcdef"])]
    rows += [(50, "chapter number 12345 begins", None, None, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, rows)).collect()}
    assert got[4] == "id:20:28" and got[5] == "" and got[50] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert text[4] == "please mail user id [ID] today" and text[0] == "please mail user id [EMAIL] today"
    assert text[50] == rows[-1][1]


def test_confidence_counts_distinct_instances(spark):
    # one seed repeated often is one instance: no trust from repetition
    rows = [(i, "my code is a1@x.org now", None, None, None) for i in range(50)]
    rows += [(99, "my code is QQ-77777 now", None, None, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, rows)).collect()}
    assert got[99] == ""


def test_redaction_replaces_base_spans_only(spark):
    df = frame(spark, extra=True)
    out = pii.redact(df)
    assert out.columns == df.columns
    for r, d in zip(out.coalesce(1).collect(), documents()):
        t, at, want = d[1], 0, ""
        for kind, a, b in sorted(brute(t), key=lambda x: (x[1], x[2])):
            if a >= at:
                want += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert r["text"] == (None if t is None else want + t[at:])


def test_no_python_in_the_plan(spark):
    plan = pii.find(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert pii.find(frame(spark, [])).count() == 0
    assert pii.redact(frame(spark, [])).count() == 0


def test_luhn_column(spark):
    r = random.Random(2)
    digits = ["".join(r.choice("0123456789") for _ in range(r.randint(1, 19))) for _ in range(300)]
    got = spark.createDataFrame([(d,) for d in digits], "d string").select("d", pii.luhn(F.col("d")).alias("ok")).collect()
    assert all(x["ok"] == luhn(x["d"]) for x in got)


def added(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, rows)).collect()}
    return [[t[int(x.split(":")[1]):int(x.split(":")[2])] for x in spans[i].split(",") if x.startswith("id:")]
            for i, t in enumerate(texts)]


def test_spans_with_spaces_are_whole_seeds(spark):
    phones = [f"reach agent desk +1 (017) 555-77{i} tonight" for i in range(10, 14)]
    cards = [f"charge the card {c} please" for c in ("4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 0000 6")
             if luhn(re.sub(" ", "", c))] + ["charge the card 4012 8888 8888 1881 please", "charge the card 4222 2222 2222 2220 please"]
    got = added(spark, [*phones, *cards, "reach agent desk EXT-90210 tonight", "charge the card TOK-55512 please"])
    assert got[-2:] == [["EXT-90210"], ["TOK-55512"]] and not any(got[:-2])


def test_neighbouring_identifiers_and_text_ends_are_context(spark):
    seen = [f"call +1 (017) 555-77{i} u{i}@x.org" for i in range(10, 14)] + [f"mail: v{i}@y.org" for i in range(4)]
    got = added(spark, [*seen, "call +1 (017) 555-8800 ZX-48213", "mail: QQ-77777"])
    assert got[-2:] == [["ZX-48213"], ["QQ-77777"]]


def test_found_identifiers_support_patterns_of_the_next_round(spark):
    seeds = [f"first user id a{i}@x.org today" for i in range(9)]
    found = [f"first user id ZX-4821{i} today" for i in range(3)]
    again = [f"second badge code ZX-4821{i} now" for i in range(3)]
    got = added(spark, [*seeds, *found, *again, "second badge code YY-30303 now"])
    assert got[-1] == ["YY-30303"]


def test_more_than_a_thousand_trusted_contexts(spark):
    names = ["".join(chr(97 + int(c)) for c in str(10000 + i)) for i in range(1100)]
    rows = [f"left{w} word{w} {w}{k}@x.org right{w}" for w in names for k in range(3)]
    got = added(spark, [*rows, *[f"left{w} word{w} ZX-{10000 + i} right{w}" for i, w in enumerate(names)]])
    assert got[len(rows):] == [[f"ZX-{10000 + i}"] for i in range(len(names))]


def test_ordinary_contexts_equal_brute_force(spark):
    r = random.Random(8)
    bits = ["the", "Of,", "|", "a1", "x@y", "é", " ", "  \n", "\x0b", "tokens"]
    texts = ["".join(r.choice(bits) + r.choice([" ", ""]) for _ in range(r.randint(0, 15))) for _ in range(300)] + [None, "", " \t"]
    want = []
    for t in texts:
        w = ["<s>", *[("<id>" if re.search("[0-9@]", x) else x.lower()) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")], "</s>"]
        for i in range(1, len(w) - 1):
            if w[i] != "<id>":
                want += ([f"LL {w[i - 2]} {w[i - 1]}"] if i > 1 else []) + [f"LR {w[i - 1]} _ {w[i + 1]}"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(x[0] for x in pii.ordinary_contexts(df).collect()) == sorted(want)


def test_frequent_contexts_are_counted_in_a_small_part_of_the_texts(spark, monkeypatch):
    """Exact counts decide, and a context that is frequent in the first part meets no other text."""
    r = random.Random(5)
    texts = [f"w{'abcdefgh'[r.randrange(8)]} of the {r.choice('klmnopqrst')}{'xyz'[i % 3] * (i % 40)} end" for i in range(3000)]
    texts += ["seen in rare"] * 4 + [f"rare{i % 7} known in rare place" for i in range(16)] + ["twice in twin place"] * 17
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    edges = spark.createDataFrame([("LL of the", f"id{i}", 1) for i in range(4)] + [("LL in rare", f"id{i}", 1) for i in range(4)]
                                  + [("LL in twin", f"id{i}", 1) for i in range(4)] + [("LL in none", "id1", 9)],
                                  "pattern string, instance string, times long")
    seen, every = [], pii.ordinary_contexts

    def counted(some):
        out = every(some)
        seen.append({x["pattern"]: x["count"] for x in out.groupBy("pattern").count().collect()})
        return out

    stages, write = [], pii.stage
    monkeypatch.setattr(pii, "ordinary_contexts", counted)
    monkeypatch.setattr(pii, "stage", lambda df, name: stages.append(write(df, name)) or stages[-1])
    # 16 ordinary words beside 4 instances fill a fifth of the context, 17 do not
    assert [x["pattern"] for x in pii.telling(edges, docs).collect()] == ["LL in rare"]
    assert sum(x.get("LL in rare", 0) for x in seen) == 16 and sum(x.get("LL of the", 0) for x in seen) == 3000
    left = [{x["pattern"] for x in s.collect()} for s in stages]
    assert "LL of the" in left[0] and "LL of the" not in left[1]
    assert seen[0]["LL of the"] < 3000 / 8


def test_separators_and_common_words_are_not_trusted(spark):
    seeds = [f"cell | u{i}@x.org | end" for i in range(5)] + [f"one of the v{i}@y.org told" for i in range(5)]
    prose = ["out of the house and in of the garden or of the river"] * 10
    got = added(spark, [*seeds, *prose, "row | 4111111111111112 | stop", "some of the AB-12345 people"])
    assert not any(got)


def test_contexts_of_shaped_words_are_trusted(spark):
    r = random.Random(9)
    keys = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(5)]
    got = added(spark, [*[f"with token = {k} inside" for k in keys], "with token = SK-774-193 inside", f"commit {keys[0][::-1]} merged"])
    assert got == [*[[k] for k in keys], ["SK-774-193"], []]


def planted(unseen, n=400):
    """Prose with unseen identifiers in contexts that base spans also fill, and
    with numbers and codes in ordinary contexts; (text, planted identifiers)."""
    r = random.Random(12)
    prose = "the of and river walked house under stone with a bright green over near it was then from".split()
    contexts = ["customer account {} was", "please contact {} before", "login name: {} and", "registered under id {} since"]
    out = []
    for i in range(n):
        parts, ids = [], []
        for _ in range(r.randint(2, 6)):
            parts += [r.choice(prose) for _ in range(r.randint(5, 30))]
            kind = r.random()
            if kind < 0.35:
                base = r.choice([f"user{r.randint(0, 9999)}@mail{r.randint(1, 9)}.org", f"10.{r.randint(0, 255)}.3.{r.randint(0, 255)}",
                                 f"+1 (017) 555-{r.randint(1000, 9999)}"])
                parts.append(r.choice(contexts).format(base))
            elif kind < 0.35 + unseen:
                ids.append(f"{r.choice('ABCXYZ')}{r.choice('KLM')}-{r.randint(10000, 99999)}")
                parts.append(r.choice(contexts).format(ids[-1]))
            elif kind < 0.7:
                parts.append(r.choice(["in 2019 it", "| 48213 |", "about 12500 stones", "chapter 10077 begins", f"of {r.randint(1000, 99999)} the"]))
            elif kind < 0.75:
                parts.append(f"{r.choice(prose)} user{r.randint(0, 9999)}@mail.org {r.choice(prose)}")
        out.append((" ".join(parts), ids))
    return out


@pytest.mark.parametrize("unseen, least", [(0.05, 0.95), (0.15, 0.4)])
def test_planted_identifiers_recall_and_precision(spark, unseen, least):
    """In contexts whose instances are seeds to 87 % nearly all are found; to 70 %,
    which is the confidence asked for, only the contexts that happen to reach it."""
    rows = planted(unseen)
    got = added(spark, [t for t, _ in rows])
    hit = sum(len(set(g) & set(ids)) for g, (_, ids) in zip(got, rows))
    recall, precision = hit / sum(len(ids) for _, ids in rows), hit / max(1, sum(map(len, got)))
    print("recall", recall, "precision", precision)
    assert recall >= least and precision >= 0.95
