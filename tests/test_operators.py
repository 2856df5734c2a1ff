"""Hand-computed cases and properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import alignment, coherence, grammar, language_model, models, relational, statistics, synthesis, utterances


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, f, want", [
    ("Don't STOP—now!", text.normalize, "don't stop now"),
    ("you_know well-known", text.clean_sentences, "you know well known"),
    ("it's ok, hafta", text.clean_sentences, "it is okay, have to"),
    ("I was... um", text.clean_sentences, "I was.  um"),
    ("Hello. World?", text.split_sentences, ["Hello.", "World?"]),
    ("a b", text.split_sentences, ["a b"]),
    ("I, uh -- went", text.clean_utterance, "i uh  went"),
    ("`Tis", text.norm_word, "tis"), ("don't!", text.norm_word, "don't"), (None, text.norm_word, ""),
    ("café", text.normalize_text, "cafe"), ("a\n\nb", lambda x: text.segment(x, "paragraph"), ["a", "b"]),
    ("hi", text.close_sentence, "hi."), ("", text.word_count, 1),
])
def test_text(spark, value, f, want):
    assert one(spark, value, f) == want


def test_contractions_and_padding(spark):
    assert one(spark, "ca n't go", lambda x: text.expand_contractions(F.split(x, " "))) == ["can", "not", "go"]
    assert len(one(spark, "the NN", lambda x: text.ngrams(text.pad(F.split(x, " "), 3), 3))) == 4
    assert one(spark, "a", lambda x: text.ngrams(F.split(x, " "), 3)) == []


def ops(r, h, **k):
    return [o[0] for o in alignment.align(r.split(), h.split(), **k)]


def test_alignment_cases():
    assert ops("a b c", "a x c d") == ["hit", "sub", "hit", "ins"]
    assert ops("a", "b c") == ["ins", "sub"]
    assert ops("a b", "b") == ["del", "hit"]
    assert [o[0] for o in alignment.align([""], [""], False)] == ["sub"]
    assert alignment.align([], []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_alignment_properties(r, h):
    got = alignment.align(r, h)
    c = alignment.counts_of(got)
    assert c["hits"] + c["subs"] + c["dels"] == len(r) and c["hits"] + c["subs"] + c["ins"] == len(h)
    d = list(range(len(h) + 1))
    for i, x in enumerate(r, 1):
        e = [i]
        for j, y in enumerate(h, 1):
            e.append(min(d[j - 1] + (x != y), d[j] + 1, e[-1] + 1))
        d = e
    assert c["subs"] + c["dels"] + c["ins"] == d[-1] == alignment.distance(r, h)
    assert [h[j] for _, _, j in got if j is not None] == h


def test_wer(spark):
    df = spark.createDataFrame([("s", 1, ["the", "cat", "sat"], ["the", "cat", "sat", "down"]), ("s", 2, [], []), ("s", 3, [], ["a"])], "srcID string, pID int, ref array<string>, hyp array<string>")
    got = {r.pID: r for r in alignment.wer_components(df).collect()}
    assert got[1].WER == pytest.approx(1 / 3) and got[1].MER == pytest.approx(1 / 4) and got[1].WIP == pytest.approx(0.75)
    assert got[2].WER == 0.0 and got[3].WER == 1.0
    near = df.select("pID", alignment.encoded_distance(F.col("ref"), F.col("hyp")).alias("d")).collect()
    assert {r.pID: r.d for r in near} == {1: 1, 2: 0, 3: 1}


def test_utterances(spark):
    u = spark.createDataFrame([(1, 1, "a", "P"), (1, 2, "a", "P"), (1, 3, "b", "P"), (1, 4, "b", "I")], "pID int, pos int, t string, s string")
    got = utterances.number_utterances(u, ["pID"], "pos", ["t", "s"]).orderBy("pos")
    assert [r.uttID for r in got.collect()] == [1, 1, 2, 3]
    w = spark.createDataFrame([(1, 0, 0.0, None), (1, 1, None, None), (1, 2, None, None), (1, 3, None, 2.0), (None, 4, 1.0, 2.0)], "u int, pos int, s double, e double")
    filled = utterances.fill_times(w, ["u"], "pos").orderBy("pos").collect()
    assert [r.s for r in filled] == [0, 0.5, 1, 1.5] and [r.e for r in filled] == [0.5, 1, 1.5, 2]
    refs = spark.createDataFrame([(1, 0, 0.0, 1.0, "PAR"), (1, 1, 1.0, 2.0, "INV")], "pID int, pos int, s double, e double, speaker string")
    q = spark.createDataFrame([(1, 0, 0.8, 1.5), (1, 1, 5.0, 6.0), (1, 2, 0.5, 1.5), (1, 3, None, 1.0)], "pID int, q int, s double, e double")
    got = {r.q: r.speaker_true for r in utterances.speaker_by_time(q, refs, ["pID"]).collect()}
    assert got == {0: "INV", 1: "INV", 2: "PAR", 3: None}


def test_label_speakers(spark):
    ref = spark.createDataFrame([(1, 0, "hello", 0.0, 1.0, "PAR"), (1, 1, "there", 1.0, 2.0, "INV")], "pID int, pos int, word string, s double, e double, speaker string")
    asr = spark.createDataFrame([(1, 0, "Hello!", 0.0, 1.0), (1, 1, "uh", 1.4, 1.6), (1, 2, "their", 1.6, 2.0), (2, 0, "x", 0.0, 1.0)], "pID int, pos int, word string, s double, e double")
    got = {r.pos: r for r in alignment.label_speakers(ref, asr, ["pID"]).collect()}
    assert [got[i].align_op for i in range(3)] == ["equal", "ins", "sub"] and len(got) == 3
    assert [got[i].speaker_true for i in range(3)] == ["PAR", "INV", "INV"]


def test_label_speakers_aligns_once(spark):
    """Words are aligned once, and take what they were aligned to without joins of all words;
    those without a counterpart take the speaker with the largest overlap."""
    rng = random.Random(4)
    refs = [(s, p, i, rng.choice("abcd"), float(i), i + 0.9, rng.choice(["PAR", "INV", None])) for s in "uv" for p in range(3) for i in range(12)]
    heard = [(s, p, i, rng.choice("abcde"), f"w{i}", i * 0.7, i * 0.7 + 0.5) for s in "uv" for p in range(1, 4) for i in range(17)]
    ref = spark.createDataFrame(refs, "srcID string, pID int, pos int, word string, s double, e double, speaker string").repartition(3)
    asr = spark.createDataFrame(heard, "srcID string, pID int, pos int, word string, uttID string, s double, e double").repartition(3)
    out = alignment.label_speakers(ref, asr, ["srcID", "pID"])
    assert out.columns == [*asr.columns, "speaker_true", "align_op", "truth_word", "truth_word_idx"]
    assert "word_ops" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for s in "uv":
        for p in (1, 2):
            r, h = ([x for x in xs if x[:2] == (s, p)] for xs in (refs, heard))
            for op, i, j in alignment.align([x[3] for x in r], [x[3] for x in h]):
                if op == "del":
                    continue
                said = None if i is None else r[i][6]
                if said is None:
                    a, b = h[j][5:]
                    over = lambda x: max(0.0, min(b, x[5]) - max(a, x[4]))
                    said = min(r, key=lambda x: (-over(x), 0 if over(x) else abs((a + b) / 2 - (x[4] + x[5]) / 2), x[2]))[6]
                want.append((*h[j], said, {"hit": "equal"}.get(op, op), None if i is None else r[i][3], i))
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in out.collect())


def features(spark, pairs):
    df = spark.createDataFrame([(1, pairs)], "pID int, tagged array<struct<w: string, t: string>>")
    return grammar.features(df, ["pID"]).first()


def test_grammar(spark):
    f = features(spark, [("I", "PRP"), ("I", "PRP"), ("I", "PRP")])
    assert f.nearby_reps_k3 == 2
    f = features(spark, [("I", "PRP"), ("uh", "UH"), ("I", "PRP")])
    assert (f.nearby_reps_k3, f.immediate_reps) == (1, 0)
    f = features(spark, [("the", "DT"), ("the", "DT"), ("the", "DT"), ("cat", "NN")])
    assert (f.immediate_reps, f.nearby_reps_k3) == (2, 2)
    f = features(spark, [("a", "DT"), ("b", "NN"), ("a", "DT"), ("c", "NN")])
    assert f.honores_statistic == pytest.approx(415.888, abs=1e-3) and f.mattr == pytest.approx(4 / 3)
    f = features(spark, [("w", t) for t in ("DT", "NN", "VBZ", "DT", "NN")])
    assert f.pos_pattern_variety == 6 and f.pos_pattern_density == pytest.approx(6 / 7)
    assert features(spark, [(w, t) for w, t in zip("abcd", ("VBZ", "DT", "JJ", "NN"))]).num_predicates_approx == 0.25
    assert features(spark, [(w, t) for w, t in zip("abcde", ("VBZ", "DT", "JJ", "JJ", "NN"))]).num_predicates_approx == 0
    assert features(spark, [("!", ".")]) is None


def test_features_sort_and_tag_once(spark):
    """Words are sorted once a row and not once a word, and tags are worked out once although
    rows without words are left out."""
    df = spark.createDataFrame([(1, "b a b c a d"), (2, "! ?")], "pID int, x string")
    f = grammar.features(df.select("pID", grammar.tagged(F.split(F.regexp_replace("x", "q", "u"), " ")).alias("tagged")), ["pID"])
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") + plan.count("sort_array") == 1 and plan.count("regexp_replace") == 1
    (r,) = f.collect()
    assert r.honores_statistic == pytest.approx(100 * np.log(6) / (1 - 2 / 4)) and r.type_token_ratio == pytest.approx(4 / 6)


def test_language_model(spark):
    p = spark.range(1).select(F.exp(language_model.log_probability(F.lit(1), F.lit(1), 4, 1.0)).alias("p"), language_model.log_probability(F.lit(0), F.lit(5), 4, smoothing=False).alias("z")).first()
    assert p.p == pytest.approx(0.4) and p.z == 0.0


def test_leave_one_out_is_a_rebuild(spark):
    rng = random.Random(1)
    grams = spark.createDataFrame([(p, rng.choice("ab"), rng.choice("xyz")) for p in range(4) for _ in range(12)], "pID int, ctx string, nxt string")
    meta = spark.createDataFrame([(p, "A" if p % 2 else "B") for p in range(4)], "pID int, dx string")
    fast = {r.pID: r.ppl_a for r in language_model.perplexity(grams, ["pID"], meta, ("A", "B"), 9, leave_one_out=True).collect()}
    for p in range(4):
        left = meta.where(f"pID <> {p}")
        slow = language_model.perplexity(grams, ["pID"], left, ("A", "B"), 9).where(f"pID = {p}").first()
        assert fast[p] == pytest.approx(slow.ppl_a)


@pytest.mark.parametrize("leave_one_out", [False, True])
def test_perplexity_shuffles_all_ngrams_once(spark, monkeypatch, leave_one_out):
    """Rare contexts are counted where one shuffle puts them, frequent ones by joins, with equal
    results; plain rows cross the cluster once, and sums per transcript once more."""
    rng = random.Random(2)
    rows = [(s, p, "AB-"[p % 3], rng.choice("abc"), rng.choice("xyz")) for s in "uv" for p in range(6) for _ in range(15)]
    grams = spark.createDataFrame(rows, "srcID string, pID int, dx string, ctx string, nxt string")
    found = []
    for hot in (lambda g, by: [], language_model.frequent_contexts, lambda g, by: [r.h for r in g.where("ctx = 'a'").select(F.xxhash64(*by, "ctx").alias("h")).distinct().collect()]):
        monkeypatch.setattr(language_model, "frequent_contexts", hot)
        out = language_model.perplexity(grams, ["srcID", "pID"], None, ("A", "B"), 9, leave_one_out=leave_one_out, within=["srcID"])
        if not found:
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        found.append({(r.srcID, r.pID): (r.ppl_a, r.ppl_b) for r in out.collect()})
    for s, p in found[0]:
        own = [r for r in rows if r[:2] == (s, p)]
        for k, dx in enumerate("AB"):
            model = [r for r in rows if r[0] == s and r[2] == dx and not (leave_one_out and r[1] == p)]
            ln = [np.log((sum(m[3:] == r[3:] for m in model) + 10) / (sum(m[3] == r[3] for m in model) + 90)) for r in own]
            assert all(f[s, p][k] == pytest.approx(np.exp(-np.mean(ln))) for f in found)


def test_coherence(spark):
    import numpy as np

    vec = [[1.0, 0.0], [0.0, 1.0]]
    for how, want in (("mean", 0.4714), ("p10", 0.1414)):
        c = coherence.Coherence(window=1, least_tokens=1, weighting="none", aggregation=how)
        assert coherence.score_tokens(vec, np.ones(2), np.array([0, 0, 1]), c) == pytest.approx(want, abs=1e-4)
    vocab = spark.createDataFrame([("x", 0, [1.0, 0.0], 1.0), ("y", 1, [0.0, 1.0], 1.0)], "token string, id long, vec array<double>, entropy double")
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate("xxy")] + [(2, 0, "?")], "pID int, pos int, token string")
    got = {r.pID: r.gc for r in coherence.coherence(tokens, vocab, ["pID"], coherence.Coherence(window=1, least_tokens=1, weighting="none")).collect()}
    assert got[1] == pytest.approx(0.4714, abs=1e-4) and got[2] == 0.0
    with pytest.raises(ValueError):
        coherence.Coherence(weighting="other")


def profile(spark, **given):
    none = {"subs": "ref string, hyp string, n long", "ins": "hyp string, n long", "dels": "ref string, n long", "vocab": "hyp string, n long", "ops": "op string, n long", "dropout": "length int, n long"}
    return {k: spark.createDataFrame(given.get(k, []), s) for k, s in none.items()}


def test_synthesis(spark):
    p = profile(spark, ops=[("hit", 8), ("sub", 2), ("del", 1), ("ins", 1)], vocab=[("z", 1)], subs=[("t1", "u", 3), ("t1", "v", 1)], dels=[("t2", 5)])
    toks = [f"t{i}" for i in range(40)]
    refs = spark.createDataFrame([(i, toks) for i in range(6)] + [(7, []), (8, None)], "pID int, tokens array<string>")
    a, b = (sorted(map(tuple, synthesis.synthesise(refs.repartition(n), p, (0.1, 0.3), 2).collect())) for n in (1, 5))
    assert a == b and len(a) == 32 and a[0][0] == "Synth_W10_r0"
    for _, pid, target, _, text, wer in a:
        made = text.split()
        assert wer == (alignment.distance(toks, made) / 40 if pid < 7 else 0.0)
        assert set(made) <= {*toks, "u", "v", "z"} and (pid < 7 or text == "")
    # More attempts are never farther from the target, and the first is among them.
    gaps = [sum(abs(r.wer - r.target) for r in synthesis.synthesise(refs, p, (0.3,), 5, attempts=n).where("pID < 7").collect()) for n in (1, 10)]
    assert gaps[1] <= gaps[0]


def test_synthesis_with_a_seed(spark):
    """A fixed seed gives fixed transcripts."""
    p = profile(spark, ops=[("hit", 8), ("sub", 2), ("del", 1), ("ins", 1)], vocab=[("z", 1), ("y", 2)], subs=[("b", "u", 3)], ins=[("er", 1)], dropout=[(2, 1)])
    refs = spark.createDataFrame([(1, list("abcdefghij"))], "pID int, tokens array<string>")
    got = [(r.srcID, r.text, r.wer) for r in synthesis.synthesise(refs, p, (0.2, 0.5), 1, seed=3).orderBy("srcID").collect()]
    assert got == GOLDEN


GOLDEN = [("Synth_W20_r0", "a b c d e f z h er i j", 0.2), ("Synth_W50_r0", "z c d y g h er i j", 0.5)]


def test_plans_keep_the_rule():
    """Numbers of errors of each kind, stretches that are lost, and words that cannot be drawn."""
    s = object.__new__(synthesis.Settings)
    s.subs, s.dels, s.lost, s.often, s.vocab, s.ins = 0.5, 0.25, np.array([3]), np.array([1]), 10, 4
    zero, rng = np.zeros(40, np.int64), np.random.default_rng(0)
    for _ in range(50):
        items, line, point = synthesis.plan_attempt(rng, 40, 0.4, 0.25, zero, zero, zero, s)
        # 16 errors: 4 lost, then 12 with 6 substituted, 3 deleted, 3 inserted.
        assert len(items) == 40 - 4 - 3 + 3 and (items >= 0).sum() == 40 - 4 - 3 - 6
        assert sorted(-1 - items[items < 0]) == list(range(9)) and line.tolist() == [synthesis.VOCAB] * 6 + [synthesis.INS] * 3
        assert (point < np.where(line == synthesis.INS, 4, 10)).all() and (np.diff(items[items >= 0]) > 0).all()
    often = np.where(np.arange(40) == 7, 10**9, 0)
    assert all(7 not in synthesis.plan_attempt(rng, 40, 0.1, 0.0, zero, zero, often, s)[0] for _ in range(20))
    s.vocab = s.ins = 0
    items, line, _ = synthesis.plan_attempt(rng, 40, 0.4, 0.0, zero, zero, zero, s)
    assert len(items) == 36 and not len(line)
    assert len(synthesis.plan_attempt(rng, 7, 1.0, 1.0, zero[:7], zero[:7], zero[:7], s)[0]) == 0


def test_attempts_end_early(spark, monkeypatch):
    """Without words to draw one attempt at a target is planned and nothing is stored but the
    profile; with them, only targets that are not met as nearly as can be go on."""
    tags, wide = [], synthesis.planned
    monkeypatch.setattr(synthesis, "stored", lambda df, tag, f=synthesis.stored: (tags.append(tag), f(df, tag))[1])
    monkeypatch.setattr(synthesis, "planned", lambda *a: (tags.append(list(a[3])), wide(*a))[1])
    refs = spark.createDataFrame([(1, list("abcdefghij")), (2, [])], "pID int, tokens array<string>")
    got = synthesis.synthesise(refs, profile(spark, ops=[("hit", 9), ("del", 1)], dels=[("a", 3)]), (0.2, 0.55), 2).collect()
    assert sorted((r.pID, r.target, r.wer) for r in got) == sorted([(1, 0.2, 0.2)] * 2 + [(1, 0.55, 0.6)] * 2 + [(2, t, 0.0) for t in (0.2, 0.2, 0.55, 0.55)])
    assert [0] in tags and not {"synth-plans", "synth-judged", "synth-rows"} & {t for t in tags if isinstance(t, str)}
    tags.clear()
    # Words that stand nowhere in the text: the first attempt is as near as any.
    synthesis.synthesise(refs, profile(spark, ops=[("sub", 1)], vocab=[("z", 1)]), (0.2, 0.5), 1).collect()
    assert [t for t in tags if isinstance(t, list)] == [[0]]


def test_profile_lines(spark):
    """Every entry has its place on a line and in a bounded number of slots, however uneven
    the counts are."""
    n = 5000
    words = spark.range(n).selectExpr("concat('w', id % 50) AS ref", "concat('h', id) AS hyp", "if(id = 17, 1000000000, id + 1) AS n")
    slots, places, lengths = synthesis.lines({**profile(spark), "subs": words, "vocab": words.drop("ref")})
    assert slots.count() <= 4 * n + 4 and set(lengths) == {synthesis.SUBS, synthesis.VOCAB}
    ends = {(r.line, r.lo, r.hi, r.word) for r in slots.select("line", "lo", "hi", "word").collect()}
    for line in (synthesis.SUBS, synthesis.VOCAB):
        spans = sorted((lo, hi) for k, lo, hi, _ in ends if k == line)
        assert len(spans) == n and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == lengths[line][0]
    assert {r.word: r.subs for r in places.collect()} == {r.ref: r.n for r in words.groupBy("ref").agg(F.sum("n").alias("n")).collect()}


def test_profile_queries(spark, tmp_path):
    """All parts of the profile, and all repetitions of the synthetic sources."""
    from tests.conftest import SF

    from tessera.plans.queries_text import error_profile, synthetic_transcripts

    parts = {r.kind: r.n for r in error_profile(spark, SF).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    counts = {r.a: r.n for r in error_profile(spark, SF).where("kind = 'op'").collect()}
    assert parts["ins"] == counts["ins"] > 0 and parts["del"] == counts["del"]
    talk = spark.createDataFrame([(1, 0, "user", "one text of some nine words to be heard")], "conv_id long, turn long, role string, text string")
    talk.write.parquet(f"{tmp_path}/conversations.parquet")
    assert synthetic_transcripts(spark, str(tmp_path)).select("srcID").distinct().count() == 75


def test_profile_pairing(spark):
    pairs = spark.createDataFrame([(1, 0, ["a", "b"], ["a", "x"]), (1, 1, ["a", "b"], ["b"]), (2, 0, ["a"] * 30, ["a"])], "pID int, src_rank int, ref array<string>, hyp array<string>")
    first = synthesis.profile_tables(pairs)
    assert {r.op: r.n for r in first["ops"].collect()} == {"hit": 1, "sub": 1}
    assert first["dropout"].first().length == 30
    assert {r.op for r in synthesis.profile_tables(pairs, pairing="all")["ops"].collect()} == {"hit", "sub", "del"}


def test_statistics(spark):
    assert statistics.pearson_p(0.576, 12) == pytest.approx(0.05, abs=1e-3)
    assert statistics.mann_whitney_p(0, 3, 3) == pytest.approx(0.1)
    assert statistics.beta_inc(0.5, 0.5, 0.25) == pytest.approx(1 / 3, abs=1e-9)
    v = spark.createDataFrame([("g", float(x)) for x in (0, 1, 2, 3, 100)], "g string, v double")
    assert statistics.trimmed_by_rank(v, "g", "v").first().trimmed == pytest.approx(21.2)
    assert statistics.trimmed_by_quantile(v, "g", "v").first().trimmed == pytest.approx(2.0)
    m = spark.createDataFrame([("h", 1, 2.0), ("a", 1, 1.0), ("h", 2, 0.0), ("a", 2, 0.0)], "s string, p int, v double")
    assert statistics.stability(m, "s", "p", "v", "h", 0).first().stability == pytest.approx(2 / 3)
    flat = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0)], "g string, x double, y double")
    assert statistics.correlate_by(flat, "g", "y", ["x"]).first().x is None


def test_canonical(spark):
    df = spark.createDataFrame([(1, "w")], "start int, content string")
    assert relational.canonical(df, {"s": ["s_ts", "start"], "word": ["text", "content"]}).columns == ["s", "word"]
    with pytest.raises(ValueError):
        relational.canonical(df, {"e": ["end"]}, ("e",))


def test_sources(spark, tmp_path):
    from tessera.sources import transcripts

    for n in ("p1", "p2"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.csv").write_text("content,start,end\nhi,0.0,1.0\nyou,x,2.0\n")
    df = transcripts.read_catalogue(spark, [transcripts.Source("Azure", str(tmp_path / "in"), ".csv")])
    assert {(r.srcID, r.pID, r.word, r.s) for r in df.collect()} == {("Azure", p, w, s) for p in ("p1", "p2") for w, s in (("hi", 0.0), ("you", None))}
    out = str(tmp_path / "out")
    transcripts.write_missing(df, out)
    transcripts.write_missing(df, out)
    assert spark.read.parquet(out).count() == 4


def test_streams(spark, tmp_path):
    from tessera.streaming import transcripts

    spark.sql("SELECT 'p' AS pID, timestamp'2024-01-01 00:00:00' AS ts, 'user' AS speaker, 'a b' AS full_text").write.parquet(str(tmp_path / "in"))
    q = transcripts.talk_sessions(transcripts.read_utterances(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("talk").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("talk").first().n_tokens == 2


def test_recode_keeps_stop_words(spark):
    from tessera.functions import text
    from tessera.operators import grammar

    df = spark.createDataFrame([(["the", "dogs", "ran", "quickly", "to", "me", "", "42"],)], "w array<string>")
    r = df.select(grammar.recode(F.col("w")).alias("a"), grammar.recode(F.col("w"), keep_stop_words=False).alias("b")).first()
    assert r.a == ["the", "NNS", "NN", "RB", "to", "me", ".", "CD"]
    assert r.b == ["DT", "NNS", "NN", "RB", "TO", "PRP", ".", "CD"]
    assert len(text.PENN_TAGS) + len(set(text.STOP_WORDS)) == 215


def test_mann_whitney_p():
    from tessera.operators.statistics import mann_whitney_p

    # Exact: groups of 3 and 3 fully apart have 2 of 20 arrangements as extreme.
    assert abs(mann_whitney_p(9, 3, 3) - 0.1) < 1e-12
    assert abs(mann_whitney_p(4.5, 3, 3, 6.0) - 1.0) < 1e-12
    # Normal with continuity correction, 10 and 10 without ties: z = (80 - 50 - 0.5) / sqrt(175).
    import math

    assert abs(mann_whitney_p(80, 10, 10) - math.erfc(29.5 / math.sqrt(175) / math.sqrt(2))) < 1e-12


def test_folds_of_groups_and_classes(spark):
    import numpy as np
    from tessera.operators import models, statistics

    rng = np.random.default_rng(0)
    rows = [(i, "abc"[i % 3], ["x", "y", None][i // 60 % 3], float(rng.normal() + 4 * (i % 3 == 0)), float(rng.normal() + 4 * (i % 3 == 1))) for i in range(180)]
    df = spark.createDataFrame(rows, "id long, label string, site string, u double, v double")
    out = models.leave_groups_out(df, "site")
    assert out.count() == 180 and out.select("site", "fold").distinct().count() == 3
    got = models.out_of_fold_classes(out.withColumn("g", F.lit("all")), "g", "id", "label", ["u", "v"], ["c", "a", "b"]).collect()
    assert len(got) == 180 and sum(r.y_true == r.oof_pred for r in got) > 150
    assert all(abs(sum(r.oof_proba) - 1) < 1e-9 and "abc"[int(np.argmax(r.oof_proba))] == r.oof_pred for r in got)
    m = statistics.classification_metrics(spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.2), (0, 1, 0.4), (0, 0, 0.4), (1, 1, 0.1), (1, 1, 0.7)], "f int, y int, p double"), ["f"], "y", "p")
    got = {r.f: (r.n, r.acc, round(r.f1, 6), r.auc) for r in m.collect()}
    assert got == {0: (4, 0.75, 0.666667, 0.875), 1: (2, 0.5, 0.666667, None)}
    spread = {r.metric: (r["mean"], round(r.sd, 6)) for r in statistics.fold_spread(m, ["acc"]).collect()}
    assert spread == {"acc": (0.625, 0.125)}
