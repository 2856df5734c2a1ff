import random

import pytest

WORDS = "lor ipsum dolor sit amet nunc ver quam éclair straße naïve tempor elit sed magna aliqua ut enim minim".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies."""
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 90)
    words = base.split()
    near = " ".join("changed" if i == 60 else w for i, w in enumerate(words))
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1),
        (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t ", "en", "b", 4), (7, "word", "en", "a", 4), (8, "word", "en", "a", 4), (9, "two words", "fr", "b", 9),
        (None, base, "en", "a", 1), (None, "no id here", "en", "a", 1),
        (10, sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 30), "en", "a", 1), (11, sentence(rng, 25) + "  " + passage, "en", None, 1),
        (12, "ab" * 500, "en", "a", 1), (13, "é" * 700, "en", "a", 1), (14, sentence(rng, 6000), "en", "a", 1), (15, (sentence(rng, 4) + "\n") * 30, "de", "b", 1),
        (16, " x　y  z<|endoftext|>", "en", "a", 1), (17, sentence(rng, 3000), "en", "a", 1), (11, "another text of one id", "en", "a", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in ("score", "row", "key", "mark", "spans", "mix_copy", "host", "start", "part", "text_", "class", "n_matches", "hit", "doc", "plain", "id", "toxic"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_vectors():
    """Nulls in every column, zero and broken vectors, copies, scaled and near copies,
    rows of one id, another length."""
    rng = random.Random(9)
    draw = lambda n=16: [rng.gauss(0, 1) for _ in range(n)]
    near = lambda v, by: [x + rng.gauss(0, by) for x in v]
    a, b, short = draw(), draw(), draw(3)
    rows = [(1, a), (2, a), (2, a), (3, [2 * x for x in a]), (4, [-x for x in a]), (5, [0.0] * 16), (6, [0.0] * 16), (7, None), (8, []), (9, [*a[:-1], None]), (10, [*a[:-1], float("nan")])]
    rows += [(11, [*a[:-1], float("inf")]), (None, a), (12, short), (13, [1e-30 * x for x in short]), (14, [0.0, 1.0, -0.0]), (15, [-0.0, 1.0, 0.0]), (16, b), (16, draw())]
    rows += [(100 + i, near(b, 0.1)) for i in range(40)] + [(200 + i, draw()) for i in range(200)]
    return [(i, v, None if i is None else i % 3, "clash") for i, v in rows]


def odd_items():
    words = odd_rows()[0][1].split()
    texts = [" ".join(words[:30]), "word", "WORD word Word", "nowhere at-all", "", None, "  . ", "lor1 ipsum2 dolor3 " * 40, "naïve7 straße8 Éclair9", "two words no id here", "word"]
    return [(k if k < 9 else (None if k == 9 else 1), t, "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def folder(odd, none, tmp_path_factory, spark):
    """Folders as the queries read them: the odd rows, and empty tables."""
    out = {}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(
        [
            (1, "http://A.com/x", '<a href="http://b.org/">b</a><a href="//c.net/es/">'), (2, "https://c.net/es/1?q#f", None), (3, None, "x"), (4, "no scheme", ""), (None, "http://b.org", '<a href="http://c.net/">'),
            (5, "http://www.example.com/en/1", ""), (6, "http://x.example.com/en/1", ""), (7, "http://net", ""), (8, "ftp://d.org#a/b", '<a href="http://c.net/es/">'), (8, "ftp://d.org#a/b", '<a href="http://c.net/es/">'),
        ],
        "page_id long, url string, html string",
    )
    vectors = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, label int, class string")
    items = spark.createDataFrame(odd_items(), "item_id long, text string, term string")
    for name, docs, la, pg in (("odd", odd, labels, pages), ("none", none, labels.limit(0), pages.limit(0))):
        d = str(tmp_path_factory.mktemp(name))
        (vectors if name == "odd" else vectors.limit(0)).write.parquet(f"{d}/embeddings.parquet")
        (items if name == "odd" else items.limit(0)).write.parquet(f"{d}/benchmark.parquet")
        docs.write.parquet(f"{d}/documents.parquet")
        la.write.parquet(f"{d}/labels.parquet")
        pg.write.parquet(f"{d}/pages.parquet")
        out[name] = d
    return out
