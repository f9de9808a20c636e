import random
import re

from pyspark.sql import functions as F

from lodestone.llm import secrets

KEYWORD = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text, out = text or "", []
    for kind, pattern, group, least in (("assign", KEYWORD, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def texts():
    r = random.Random(7)
    digits = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    words = ["thonst", "ciónñ", "naïve", "password", "token", "of", "AKIA", "cafe", "deadbeef", "ſecret", "toKen", "x=y", "secret=token: abcdefgh"]
    out = [None, "", "token=abc", 'API_KEY : "aB3/+=-_.9"', "😀 token='abcdef' 😀", "AKIA" + "Z" * 15, "AKIA" + "Z" * 16 + "9", digits(23) + "g" + digits(24), "secret=token: abcdefgh"]
    for i in range(400):
        parts = [r.choice(words) for _ in range(r.randint(1, 30))]
        parts.insert(r.randrange(len(parts) + 1), [f"password={digits(18)}", f'token = "{digits(40)}"', "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), digits(20), "bosbt.42@mail8.example.com", str(r.randrange(10**15, 10**16))][i % 6])
        out.append(r.choice([" ", "\n"]).join(parts))
    return out


def test_base_spans_and_learnt_ones(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in secrets.scan_secrets(frame).select("doc_id", "spans", secrets.span_text(F.filter("spans", lambda s: s["kind"] != "format")).alias("base")).collect()}
    assert len(got) == len(rows)
    found, false = 0, 0
    for i, text in rows:
        assert got[i].base == brute(text), text
        learnt = [s.value for s in got[i].spans if s.kind == "format"]
        if i >= 9 and (i - 9) % 6 == 3:
            found += bool(learnt)
        elif i >= 9 and (i - 9) % 6 > 3:
            false += bool(learnt)
        assert all(text[s.start : s.end] == s.value for s in got[i].spans if s.kind != "assign")
    assert found >= 50 and false <= 5, (found, false)


def test_short_and_letter_only_formats_are_learnt(spark):
    """Values of 8 letters that a keyword marks teach their format; the same format is found without the keyword."""
    r = random.Random(3)
    key = lambda: "".join(r.choice("QXZWKJVB") for _ in range(8))
    word = lambda: "".join(r.choice(["th", "on", "er", "an", "ing", "ed", "re"]) for _ in range(r.randint(2, 5)))
    text = lambda extra: " ".join([*(word() for _ in range(20)), extra, *(word() for _ in range(5))])
    bare = [key() for _ in range(100)]
    rows = [(i, text(f"token={key()}")) for i in range(200)] + [(1000 + i, text(f"({k})")) for i, k in enumerate(bare)] + [(2000 + i, text(word())) for i in range(200)]
    got = {r.doc_id: [s.value for s in r.spans if s.kind == "format"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(k in got[1000 + i] for i, k in enumerate(bare)) >= 90
    assert sum(bool(v) for i, v in got.items() if not 1000 <= i < 2000) <= 4


def test_scores_of_all_strings_at_once(monkeypatch):
    import pyarrow as pa

    r = random.Random(5)
    words = ["".join(r.choice("abcAB01+/_.=-") for _ in range(r.randint(1, 40))) for _ in range(300)]
    automata = [secrets.Automaton(words[:100], 0.05), secrets.Automaton(["abc", "ab", "ba"] * 20, 0.05)]
    monkeypatch.setattr(secrets, "_FAR", 30)
    for automaton, scores in zip(automata, secrets.score_all(automata, pa.array(words, pa.large_string())), strict=True):
        assert [round(x, 9) for x in scores] == [round(automaton.score(w), 9) for w in words]


def test_long_texts_and_clashing_columns(spark):
    long = "word " * 200_000 + "token=" + "a1" * 20 + " " + "x" * 500_000 + " AKIA" + "Q" * 16
    frame = spark.createDataFrame([(1, long, "s", "v", 0.5)], "doc_id long, text string, spans string, value string, score double")
    got = secrets.scan_secrets(frame)
    assert got.columns == ["doc_id", "th", "spans"]
    assert [(s.kind, s.start, s.end) for s in got.first().spans] == [("assign", 1_000_000, 1_000_046), ("hex", 1_000_006, 1_000_046), ("access", len(long) - 20, len(long))]


def test_automata_tell_formats_apart():
    r = random.Random(1)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 40]))) for _ in range(300)]
    words = ["".join(r.choice(["th", "on", "er", "an", "ing", "ed"]) for _ in range(r.randint(2, 6))) for _ in range(300)]
    a, b = secrets.Automaton(hexes, 0.05), secrets.Automaton(words, 0.05)
    assert len(a.states) < 200
    fresh = "".join(r.choice("0123456789abcdef") for _ in range(18))
    assert a.score(fresh) > b.score(fresh) and a.score("thonering") < b.score("thonering")


def test_redaction_and_odd_tables(spark, empty):
    assert secrets.scan_secrets(empty).count() == 0
    text = "é token=abcdefgh, AKIA" + "Q" * 16 + " end"
    frame = spark.createDataFrame([(None, text), (1, None), (1, None), (2, "clean")], "doc_id long, text string")
    spans = secrets.scan_secrets(frame).select("th", "spans").distinct()
    text = F.coalesce("text", F.lit(""))
    out = {tuple(r) for r in frame.withColumn("th", F.xxhash64(text)).join(spans, "th").select("doc_id", secrets.redacted(text, F.col("spans"))).collect()}
    assert out == {(None, "é [secret:assign], [secret:access] end"), (1, ""), (2, "clean")}
