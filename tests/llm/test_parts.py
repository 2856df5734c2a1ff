"""Parts of the operators on their own."""

import hashlib
import io
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bitplane, components, cross_polytope, media, mixing, near_dup, packing, repeats, runs, shared, suffix_levels, tokens, toxicity, windows, word_windows


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_planes(ids, bits):
    a = np.array(ids, np.uint32)
    assert (bitplane.from_planes(bitplane.to_planes(a, bits), len(a), bits) == a).all()


@pytest.mark.parametrize("bits", [False, True])
def test_shards(bits):
    out, rng = io.BytesIO(), np.random.default_rng(0)
    w, all_ids = bitplane.ShardWriter(out, 64, bits), []
    for k in range(5):
        lens = rng.integers(0, 40, 6)
        ids = rng.integers(0, 60000, lens.sum()).astype(np.uint32)
        w.add(np.arange(6) + 6 * k, np.ones(6, bool), ids, lens)
        all_ids.append(ids)
    w.close()
    r, ids = bitplane.ShardReader(io.BytesIO(out.getvalue())), np.concatenate(all_ids)
    assert (r.ids(0, len(ids)) == ids).all() and (r.ids(70, 131) == ids[70:131]).all()
    assert sum(len(d[0]) for d in r.documents()) == 30
    with pytest.raises(ValueError):
        bitplane.ShardReader(io.BytesIO(b"something else entirely"))


def test_units_that_return_stay_known():
    import public_tokenizers

    enc, sent = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most_units=40), []
    inner = enc._encode
    enc._encode = lambda texts: sent.extend(texts) or inner(texts)
    for k in range(5):
        enc(pa.array([f"over under between {' '.join(f'n{k}x{i}' for i in range(12))}"]))
    assert sum("under" in t for t in sent) == 1 and sum("n4x7" in t for t in sent) == 1


@pytest.mark.parametrize("most", [0, 30, 800_000])
def test_ids_of_odd_texts(most):
    import public_tokenizers

    enc, rng = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most), random.Random(24)
    parts = ["the", "'s", "don't", "É", "\u0301", "日本", "🙂", "|", "$$$", ".", ",", "42", "<|", "<|endoftext|>", "Ġ", "Ċ", "\t", "\r\n", "\n\n", "", *["\n", " "] * 6]
    for k in range(40):
        rows = [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20)]
        if k % 2:
            rows = ["\n".join(" ".join(x.split()) for x in (r or "").split("\n") if x.strip()) for r in rows]
        ids, lens = enc(pa.array(rows, pa.string()))
        want = [enc.tokenizer.encode(r or "", add_special_tokens=False).ids for r in rows]
        assert lens.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), min_size=1, max_size=8))
def test_plan(hist):
    steps, bound = packing.plan(hist, 20)
    used: dict = {}
    for items, times in steps:
        assert sum(items) <= 20
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == hist and sum(t for _, t in steps) >= bound


def test_plan_is_optimal_on_small_cases():
    from functools import lru_cache

    @lru_cache(None)
    def best(items):
        if not items:
            return 0
        low, rest, out = 10**9, items[1:], []
        for mask in range(1 << len(rest)):
            if items[0] + sum(x for i, x in enumerate(rest) if mask >> i & 1) <= 10:
                out.append(1 + best(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return min([low, *out])

    rng = random.Random(3)
    for _ in range(40):
        items = tuple(sorted((rng.randint(1, 10) for _ in range(8)), reverse=True))
        hist = {x: items.count(x) for x in items}
        assert sum(t for _, t in packing.plan(hist, 10)[0]) == best(items)


def test_many_tiny_pieces():
    """More pieces in a sequence than a call stack is deep."""
    steps, bound = packing.plan({1: 50_000, 2: 3, 2000: 4, 2048: 1})
    packed = Counter()
    for items, times in steps:
        assert sum(items) <= 2048
        packed.update({x: n * times for x, n in Counter(items).items()})
    assert packed == {1: 50_000, 2: 3, 2000: 4, 2048: 1} and sum(t for _, t in steps) == bound


def test_dominated_fillings():
    # 3 can be exchanged for the 4 that is left, 5 fits beside; nothing longer is left over.
    assert packing.dominated([(3, 1)], 1, [3, 4], {3: 1, 4: 1})
    assert packing.dominated([(3, 1)], 5, [3, 5], {3: 1, 5: 1})
    assert not packing.dominated([(4, 2)], 1, [3, 4], {3: 2, 4: 2})
    assert not packing.dominated([(4, 1)], 0, [3, 4, 9], {3: 2, 4: 2, 9: 1})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=6))
def test_anchors_cover_all_windows(texts):
    raw, offs = shared.utf8(pa.array(texts, pa.string()))
    e = windows.entries(raw, offs, 12, 6)
    got = sorted((int(s) + k) for s, c in zip(e.start, e.count) for k in range(int(c)))
    want = [int(o) + s for t, o in zip(texts, offs) for s in range(len(t) - 11)]
    assert got == sorted(want)
    # Equal windows have equal anchors at the same place.
    place = {}
    data = raw.tobytes()
    for s, c, g in zip(e.start, e.count, e.gram):
        for k in range(int(c)):
            w = data[s + k : s + k + 12]
            assert place.setdefault(w, g) == g


def test_segments_change_nothing():
    """Windows that are found a segment at a time have the same anchors; only runs are cut."""
    rng = random.Random(8)
    raw, offs = shared.utf8(pa.array(["".join(rng.choice("abc") for _ in range(n)) for n in (300, 5, 0, 90, 700)]))
    each = lambda e: sorted((int(s) + k, int(a), int(g), int(r)) for r, s, c, a, g in zip(e.row, e.start, e.count, e.anchor, e.gram) for k in range(int(c)))
    assert each(windows.entries(raw, offs, 12, 6)) == each(windows.entries(raw, offs, 12, 6, segment=50))


def test_window_hashes_by_segments(monkeypatch):
    raw = np.frombuffer(("abcde" * 100 + "xyz" * 70).encode(), np.uint8)
    starts = np.array([600, 3, 0, 498, 250, 8, 3])
    whole = windows.hashes_at(raw, starts, starts + 20, (1, 2))
    monkeypatch.setattr(windows, "SEGMENT", 64)
    assert all((a == b).all() for a, b in zip(whole, windows.hashes_at(raw, starts, starts + 20, (1, 2))))
    assert whole[0][1] == whole[0][5] and whole[0][1] != whole[0][0]


def test_words_hash_alike_in_pieces(monkeypatch):
    raw, offs = shared.utf8(pa.array(["a bb " + "c" * 400 + " bb", "C bb"]))
    begin, end, _ = shared.word_bounds(raw, offs)
    monkeypatch.setattr(shared, "WORD_BYTES", 100)
    h = shared.word_hashes(raw, begin, end)
    assert h[1] == h[3] == h[5] and len(set(h.tolist())) == 4


def test_hot_head(spark):
    """A passage in many surroundings, over more batches than one level holds, against a
    comparison of all strings."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef") for _ in range(60))
    texts = ["".join(rng.choice("xyz") for _ in range(30)) + passage + "".join(rng.choice("uvw") for _ in range(30)) for i in range(60)]
    texts += [texts[3], texts[4][:50] + texts[5][50:], passage[5:44], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [(t or "").encode() for t in texts]
    often = Counter(b[s : s + 40] for b in data for s in range(len(b) - 39))
    want = {}
    for i, b in enumerate(data):
        gone = {x for s in range(len(b) - 39) if often[b[s : s + 40]] > 1 for x in range(s, s + 40)}
        kept = bytes(c for x, c in enumerate(b) if x not in gone)
        want[i] = (len(b), len(gone), sum(x - 1 not in gone for x in gone), hashlib.sha256(kept).hexdigest())
    for batches in (1, 11):
        got = {r.doc_id: tuple(r)[1:] for r in suffix_levels.removed_bytes(docs, suffix_levels.suffixes(40, 12), batches).collect()}
        assert got == want


def test_runs_merge(spark):
    index = runs.SortedRuns(spark, "test-runs", "key", runs.BY_DOCUMENT)
    for b in range(5):
        found = {r.key: r.n for r in index.add(spark.createDataFrame([(k, b) for k in (1, 10 + b)], "key long, doc long")).collect()}
        assert found == ({1: b + 1} if b else {})
    assert [r.level for r in index.runs] == [2, 0]
    index.close()


def test_forest_roots(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    hub = [(i, 100) for i in range(50, 90)]
    got = components.forest_roots(spark.createDataFrame(chain + hub + [(40, 99)], "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 99) for i in range(1, 41)] + [(i, 100) for i in range(50, 90)] + [(99, 99), (100, 100)]
    assert components.forest_roots(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(k in got or all(k != x or a == b for a, b in edges for x in (a, b)) for k in root)


def test_match_limit():
    how = near_dup.NearDup(3, 85)
    assert how.matches() == 37
    assert near_dup.NearDup().matches() == 33


def test_large_groups_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(9999)}" for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    root = list(range(120))
    for _ in range(6):
        for a in range(120):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, near_dup.NearDup(3, 85, block=16)).collect()}
    assert got == dict(enumerate(root))


def by_brute_force(rows, percent=85):
    """Component of every row, by all pairs of sets of three-word shingles."""
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and top(a) != top(b):
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("common, own, n", [(3, 12, 1500), (60, 12, 300), (60, 7, 300)])
def test_near_copies_under_common_shingles(spark, common, own, n):
    """One shingle (or a long template) in every document, and hundreds of components."""
    rng = random.Random(11)
    template = [f"c{i}" for i in range(common)]
    rows = []
    for i in range(n):
        w = template + [f"w{rng.randrange(99999)}" for _ in range(own)]
        if i % 3 == 0 and rows:
            w = rng.choice(rows)[1].split()
            w[-1] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_brute_force(rows)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, near_dup.NearDup(3, 85, block=32)).collect()}
    assert got == want and len(set(want.values())) < n


def test_blocks_alone_find_every_link(spark, monkeypatch):
    """Without central partners all links come from the collisions counted in blocks."""
    rng = random.Random(13)
    template, rows = [f"c{i}" for i in range(40)], []
    for i in range(160):
        w = template + [f"w{rng.randrange(99999)}" for _ in range(12)]
        if i % 2 and rows:
            w = rng.choice(rows)[1].split()
            w[rng.randrange(52)] = f"x{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dup, "hub_pairs", lambda lists, how: lists.selectExpr("class u", "class v").where("false"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, near_dup.NearDup(3, 85, block=24)).collect()}
    want = by_brute_force(rows)
    assert got == want and len(set(want.values())) < 150


def test_hot_groups_are_named_whole(spark):
    """One class and one component hold most rows; both joins by group give every row."""
    rows = [(i, "one two three four five six seven") for i in range(900)] + [(900 + i, f"a{i} b{i} c{i} d{i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, near_dup.NearDup(3, 85)).collect()}
    assert got == {i: 0 if i < 900 else i for i, _ in rows}


def test_poisson_rates(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "CASE WHEN id < 15000 THEN 'big' ELSE 'small' END AS source")
    w = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    got = {r.source: r.n for r in mixing.poisson_mix(docs, weights=w).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert abs(got["big"] - 10000) < 400 and abs(got["small"] - 10000) < 400
    only = mixing.poisson_mix(docs, weights=w.where("source = 'big'")).select("source").distinct().collect()
    assert [r.source for r in only] == ["big"]


def test_folding():
    assert toxicity.fold("1D10T, іdіоt! $tupid Stupid$$$ 2024") == " idiot idiot stupid stupid "
    m = toxicity.Matcher(toxicity.Model({" trash ": 3.0, " lowe": 2.0}, [" trash can "]))
    assert m.matches(toxicity.fold("trash can, a LOWeix")) == {10: 2.0} or sum(m.matches(toxicity.fold("trash can, a LOWeix")).values()) == 2.0
    assert sum(m.matches(toxicity.fold("tr4sh talk")).values()) == 3.0


def test_toxicity_held_out(spark):
    from tests.conftest import SF

    sf = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).where("held_out").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [got[k].predicted == v for k, v in labels.items() if k in got]
    assert len(right) > 500 and sum(right) / len(right) > 0.97


def test_media_round_trip():
    data = media.padded("héllo".encode())
    assert len(data) == 192 and media.from_wav(media.to_wav(data)) == data
    x = (128 + 100 * np.sin(np.arange(9600) * 0.3)).astype(np.uint8).tobytes()
    assert (media.fingerprint(x) == media.fingerprint(x)).all()


def test_cut_characters():
    assert suffix_levels.cut_characters("aéb".encode(), [(2, 4)]) == "aé"
    assert suffix_levels.cut_spans(b"abcdef", *windows.merge_spans(np.array([1, 2]), np.array([3, 4]))) == (b"aef", 1)


def test_keyed_rows(spark):
    df = spark.createDataFrame([(None, None), (1, "x")], "doc_id long, text string")
    assert {r.doc for r in repeats.keyed(df).collect()} == {repeats.SMALLEST, 1}


def test_repeated_rows_leave_others(spark):
    """A row given twice costs its copy only; rows without words or ids all stay."""
    rows = [(1, "one two three four five six")] * 2 + [(None, "a text without an id")] * 3 + [(None, None)] * 2 + [(7, "")] * 2 + [(8, "something else that is said only once here")]
    kept = near_dup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDup(shingle=5, percent=80))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows[1:]))


def test_batches_of_wide_ids(spark):
    """Every id has a batch, also where the ids span more than doubles can tell apart."""
    lo, hi = 5, (1 << 62) + 7
    entries = spark.createDataFrame([(3, b"", d, d, 0, 1, 0) for d in (lo, hi)] + [(4, b"", hi, hi, 0, 1, 0)], "key long, context binary, doc long, mark long, start int, count int, lead int")
    again = repeats.repeated_entries(entries, word_windows.words(), runs.BY_DOCUMENT, F.col("lo") < F.col("hi"), 4, "wide").collect()
    assert sorted((r.key, r.doc) for r in again) == [(3, lo), (3, hi)]
    step = -(-(hi - lo + 1) // 4)
    ids = spark.createDataFrame([(repeats.SMALLEST,), (lo,), (hi // 2,), (hi,)], "doc long")
    assert [r.n for r in ids.select(repeats.batch_number("doc", lo, step, 4).alias("n")).collect()] == [0, 0, 1, 3]


def test_thue_morse_words(spark):
    """Words on which polynomial hashes modulo a power of two collide are told apart: two
    texts that differ in such a word only share no window."""
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    for salt in range(5):
        raw = np.frombuffer(f"{one} {other}".encode(), np.uint8)
        a, b = shared.word_hashes(raw, np.array([0, 1025]), np.array([1024, 2049]), salt=salt)
        assert a != b
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:30] + [x] + words[30:59]) for x in (one, other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in word_windows.removed_words(docs).collect()} == {0}
    # Byte strings of 1024 symbols that differ everywhere have no common string of 400 by hash.
    assert len(set(windows.hashes_at(np.frombuffer((one + other).encode(), np.uint8), np.array([0, 1024]), np.array([1024, 2048]), (1,))[0].tolist())) == 2


def test_lanes():
    """Hashes are the polynomials that they stand for, whatever stands before."""
    rng = np.random.default_rng(1)
    for symbols in (rng.integers(0, 256, 3000).astype(np.uint8), rng.integers(0, 1 << 63, 3000).astype(np.uint64)):
        a, b = np.array([0, 7, 2000, 2999]), np.array([3000, 400, 2900, 2999])
        got = shared.Rolling(symbols, 2).of(a, b)
        for x, y, h in zip(a.tolist(), b.tolist(), got.tolist()):
            word = (y - x) * 0x9E3779B97F4A7C15 % (1 << 64)
            for lane in (0, 1):
                base, _, table = shared._lane(2, lane)
                values = [int(table[s]) if symbols.dtype == np.uint8 else int(s) >> 31 * lane & shared.PRIME for s in symbols[x:y].tolist()]
                word ^= sum(v * pow(base, k, shared.PRIME) for k, v in enumerate(values)) % shared.PRIME << 32 * lane
            assert shared.mix64(np.array([word], np.uint64))[0] == h


def test_repeated_rows_are_one_set(spark):
    """Rows that are repeated very often give one set a class, not one a row."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(300)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 50, "doc_id long, text string")
    how = near_dup.NearDup(shingle=1, percent=85)
    rows = near_dup.described(docs, how)
    classes = rows.groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("place"), (F.count(F.lit(1)) > 1).alias("many"))
    sets = near_dup.full_sets(docs, classes.select("class", "place.doc_id", "place.mark", "many"), how)
    assert sets.count() == sets.select("class").distinct().count() == classes.count()


def naive_links(x, cosine):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= cosine
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_recall(spark, block):
    """Links and components of planted groups, among them one of very many near copies and
    pairs at the limit, against brute force; in whole buckets and in many small blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[:300] = x[0] + rng.normal(size=(300, 32)) * 0.12
    for k in range(300, 700, 2):
        y = x[k + 1] - (x[k] @ x[k + 1]) / (x[k] @ x[k]) * x[k]
        x[k + 1] = 0.905 * x[k] / np.linalg.norm(x[k]) + (1 - 0.905**2) ** 0.5 * y / np.linalg.norm(y)
    x = x.astype(np.float32).astype(float)
    hit = naive_links(x, 0.9)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = sorted(cross_polytope.near_vectors(docs, cross_polytope.CrossPolytope(block=block)).collect())
    links = np.array([r.n_links for r in got])
    assert (links <= hit.sum(axis=1)).all() and links.sum() >= 0.99 * hit.sum()
    if links.sum() == hit.sum():
        a, b = np.nonzero(hit)
        assert [r.component_id for r in got] == cross_polytope.forest(a, b, len(x)).tolist()


def test_tables_reach_the_limit():
    """Pairs exactly at the cosine limit meet but for the stated share."""
    rng = np.random.default_rng(5)
    for length, vectors in ((64, 500), (64, 50_000), (20, 10**6), (3, 1000)):
        tables = cross_polytope.tables_for(length, vectors, cross_polytope.CrossPolytope())
        a, b = rng.normal(size=(2, 1500, length))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + (1 - 0.81) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
        met, where = cross_polytope.meeting(tables(a), tables(b))
        assert met.mean() > 0.985 and (cross_polytope.meeting(tables(b), tables(a))[1] == where).all()


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = np.array([[1]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(cross_polytope.hadamard(x), x @ h.T)


def test_word_index_in_calls(spark, tmp_path):
    """Batches added one by one, with the index saved and opened again between them, give what
    one call over all of them gives."""
    rng = random.Random(21)
    draw = lambda n: " ".join(rng.choice("abc") + str(rng.randrange(60)) for _ in range(n))
    passages = [draw(30) for _ in range(4)]
    texts = [f"{draw(rng.randrange(30))} {passages[i % 4]} {draw(20)}" for i in range(40)] + ["", None, passages[0]]
    texts[30] = texts[2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    how = word_windows.words(12, 6)
    want = sorted(map(tuple, word_windows.removed_words(docs, how).collect()))
    index, got = word_windows.WindowIndex(spark, how), []
    for k, (lo, hi) in enumerate(((0, 9), (9, 10), (10, 35), (35, 99))):
        got += map(tuple, index.add(docs.where(f"doc_id >= {lo} and doc_id < {hi}")).collect())
        index.save(f"{tmp_path}/{k}")
        index = word_windows.WindowIndex(spark, how, saved=f"{tmp_path}/{k}")
    assert sorted(got) == want and any(r[2] for r in want)
    assert len(index.history.index.runs) <= 3
    with pytest.raises(ValueError):
        index.add(docs.where("doc_id = 3"))


def test_suffix_index_in_calls(spark, tmp_path):
    rng = random.Random(22)
    draw = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    passages = [draw(70) for _ in range(4)]
    texts = [draw(rng.randrange(50)) + passages[i % 4][: rng.randrange(30, 71)] + draw(30) for i in range(30)] + ["", None, passages[1], passages[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    how = suffix_levels.suffixes(40, 12)
    want = sorted(map(tuple, suffix_levels.removed_bytes(docs, how).collect()))
    index, got = suffix_levels.SuffixIndex(spark, how), {}
    for k, (lo, hi) in enumerate(((0, 5), (5, 20), (20, 99))):
        got |= {r.doc_id: tuple(r) for r in index.add(docs.where(f"doc_id >= {lo} and doc_id < {hi}"), 2).collect()}
        index.save(f"{tmp_path}/{k}")
        index = suffix_levels.SuffixIndex(spark, how, saved=f"{tmp_path}/{k}")
    assert sorted(got.values()) == want and any(r[2] for r in want)


def test_texts_over_a_slice(spark):
    """Texts longer than a slice and a segment, next to short ones, with passages in common."""
    rng = random.Random(23)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    long = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(190_000)) for c in "xy"]
    assert all(len(t) > 1 << 20 for t in long)
    texts = [f"{long[0]} {passage} end", "short one", f"{passage} {long[1]}", passage, long[0][:2000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = {r.doc_id: r.n_removed for r in word_windows.removed_words(docs).collect()}
    assert words == {0: 0, 1: 0, 2: 80, 3: 80, 4: len(long[0][:2000].split()) - (not long[0][1999].isspace() and not long[0][2000].isspace())}
    cut = {r.doc_id: r.n_removed for r in suffix_levels.removed_bytes(docs).collect()}
    assert cut[1] == 0 and cut[0] >= 2000 + len(passage) and cut[3] == len(passage) and cut[4] == 2000 and len(passage) <= cut[2] <= len(passage) + 2
