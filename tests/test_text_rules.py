"""Decomposition, Treebank tokens, syllables and the weighted tagger."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import grammar


def test_decomposition_of_all_characters(spark):
    codes = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}z") for c in codes], "c int, t string")
    for r in df.select("c", text.ascii_decomposed(F.col("t")).alias("p")).collect():
        assert r.p == "a" + unicodedata.normalize("NFKD", chr(r.c)).encode("ascii", "ignore").decode() + "z"


def test_line_ends(spark):
    whole = "a".join("\n \r \r\n \x0b \x0c \x1c \x1d \x1e \x85    ".split(" ")) + "b"
    df = spark.createDataFrame([(whole,), ("one\n\n two ",)], "x string")
    got = [r.s for r in df.select(text.segment(F.col("x")).alias("s")).collect()]
    assert got == [[s.strip() for s in x.splitlines() if s.strip()] for x in (whole, "one\n\n two ")]


@pytest.mark.parametrize("given, want", [
    ("can't we go?", "ca n't we go ?"), ("they're gonna win -- i'll see.", "they 're gon na win -- i 'll see ."),
    ('he said "well, no."', "he said `` well , no . ''"), ("it's 3,000 dogs' toys; cannot", "it 's 3,000 dogs ' toys ; can not"),
    ("first one. second one...", "first one . second one ..."), ("", ""), ("o'brien's u.s. trip", "o'brien 's u.s . trip"),
])
def test_treebank(spark, given, want):
    got = spark.createDataFrame([(given,)], "x string").select(text.treebank_tokens(F.col("x")).alias("t")).first().t
    assert got == want.split()


#: Worked out by hand: q-u-e | u | e; e-x | t-r-a; ba | na | na.
SYLLABLES = {"banana": 3, "queue": 3, "extra": 2, "strengths": 1, "rhythm": 1, "justification": 5, "b2b": 1, "": 1, "aeon": 2, "h": 1, "area": 2}


def test_syllables(spark):
    words = spark.createDataFrame([(w,) for w in SYLLABLES] + [("Fire",), ("fire",)], "word string")
    said = spark.createDataFrame([("fire", ["F", "AY1", "ER0"]), ("FIRE", ["F", "AY1", "R"]), ("h", ["EY1", "CH"]), ("unused", ["AH0"])], "word string, phones array<string>")
    got = {r.word: r.n_syllables for r in grammar.syllable_counts(words, said).collect()}
    assert got == SYLLABLES | {"Fire": 2, "fire": 2}


def test_weighted_tagger(spark):
    weights = [
        ("bias", "NN", 0.1), ("i word the", "DT", 2.0), ("i-1 tag DT", "NN", 1.0), ("i-1 tag DT", "JJ", 1.2), ("i suffix ree", "JJ", 0.5), ("i-1 tag+i word DT free", "VB", 9.0),
        ("i-1 word free", "NN", 0.3), ("i-2 tag DT", "NNS", 1.0), ("i tag+i-2 tag VB DT", "NNP", 5.0), ("i+1 word dogs", "RB", 0.2),
    ]
    w = spark.createDataFrame(weights, "feature string, tag string, weight double")
    df = spark.createDataFrame([(1, ["the", "free", "dogs"]), (2, ["the", "tree"]), (3, []), (4, ["free", "dogs"]), (5, None), (1, ["the"])], "id int, tokens array<string>")
    got = sorted((r.id, " ".join(x.t for x in r.tagged)) for r in grammar.tag_by_weights(df, ["id"], w).collect())
    # free after a determiner is a verb by one weight; after the start JJ 0.5 beats RB 0.2 and NN 0.1;
    # dogs after free has NN 0.1 + 0.3; tree has JJ 1.2 + 0.5 against NN 1.1.
    assert got == [(1, "DT"), (1, "DT VB NNP"), (2, "DT JJ"), (3, ""), (4, "JJ NN"), (5, "")]


def test_tagged_features(spark):
    """Features are computed from whatever tags come in."""
    w = spark.createDataFrame([("i word the", "DT", 1.0), ("bias", "NN", 0.1)], "feature string, tag string, weight double")
    df = grammar.tag_by_weights(spark.createDataFrame([(1, ["the", "cat"])], "id int, tokens array<string>"), ["id"], w)
    f = grammar.features(df, ["id"]).first()
    assert (f.noun_ratio, f.determiner_ratio) == (0.5, 0.5)


def test_many_rows_equal_plain_decoding(spark):
    """Rows tagged together come out as each one decoded by itself."""
    import random

    rng = random.Random(3)
    words, tags = ["the", "a", "dog", "dogs", "runs", "-START-"], ["DT", "NN", "VB"]
    names = ["bias", *(f"{k} {w}" for k in ("i word", "i-1 word", "i-2 word", "i+1 word", "i+2 word") for w in words[:5]), "i suffix ogs", "i pref1 d", "i-1 suffix ogs", "i+1 suffix uns", "i-1 word -START-", "i+2 word -END-", "i+1 suffix ND-"]
    links = [*(f"{k} {t}" for k in ("i-1 tag", "i-2 tag") for t in (*tags, "-START-")), "i-2 tag -START2-", "i tag+i-2 tag DT NN", "i tag+i-2 tag NN -START-", "i-1 tag+i word DT dog", "i-1 tag+i word -START- runs"]
    table = [(f, t, rng.randrange(-64, 64) / 64) for f in names + links for t in tags]
    of: dict = {}
    for f, t, x in table:
        of.setdefault(f, {})[t] = x
    rows = [(k, [rng.choice([*words, None]) for _ in range(rng.randrange(9))]) for k in range(60)]
    want = {}
    for k, said in rows:
        at = lambda i, d: said[i + d] if 0 <= i + d < len(said) and said[i + d] is not None else "-START-" if d < 0 else "-END-"  # noqa: B023, E731
        own, by_word = [], []
        for i, w in enumerate(said):
            total = dict(of["bias"])
            for d, parts in grammar.WORD_FEATURES:
                for part in parts:
                    x = at(i, d)
                    for t, y in of.get(f"i{f'{d:+d}' if d else ''} {part} " + {"word": x, "suffix": x[-3:], "pref1": x[0]}[part], {}).items():
                        total[t] += y
            own.append(total)
            by_word.append({last: of[f"i-1 tag+i word {last} {w}"] for last in ("DT", "-START-") if f"i-1 tag+i word {last} {w}" in of})
        kind = lambda p: {f[len(p) :]: x for f, x in of.items() if f.startswith(p)}
        want[k] = grammar.decode(own, by_word, tags, kind("i-1 tag "), kind("i-2 tag "), {tuple(f.split(" ")): x for f, x in kind("i tag+i-2 tag ").items()})
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    got = {r.id: [x.t for x in r.tagged] for r in grammar.tag_by_weights(df, ["id"], spark.createDataFrame(table, "feature string, tag string, weight double")).collect()}
    assert got == want
