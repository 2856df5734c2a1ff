"""Every query on the odd rows and on empty tables, against SQL or brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tests.conftest import SF

from tessera.llm import link_graph, mixing, queries, toxicity
from tessera.llm.toxicity import fold
from tests.llm.conftest import odd_items, odd_rows, odd_vectors

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1": "doc_id start n_tokens ids_crc32", "op2": "doc_id n_shingles component_id kept", "op3": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4": "doc_id n_bytes n_removed n_spans kept_sha256", "op6": "doc_id n_words n_removed kept_sha256", "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "doc_id held_out score predicted", "op9": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op10": "page_id host path rule verdict",
    "op11": "vec_id n_links component_id kept", "op12": "item_id rank doc_id score", "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def result(spark, folder, op, which="odd"):
    name = next(k for k in queries.QUERIES if k.startswith(op + "_"))
    return queries.QUERIES[name](spark, folder[which])


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, folder, name):
    df = queries.QUERIES[name](spark, folder["none"])
    assert df.count() == 0
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(df.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name]).df())


def tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_op1(spark, folder):
    got = result(spark, folder, "op1").orderBy("start").collect()
    rows = odd_rows()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    want = Counter((i, len(t), zlib.crc32(t.tobytes())) for i, t in ((r[0], tokens(r[1])) for r in rows))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]


def test_op2(spark, folder):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                both = len(sets[a] & sets[b])
                if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b], key=lambda k: rows[k][0])
    want = sorted(((i, len(s), rows[root[k]][0], rows[root[k]][0] == i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)
    assert listed(result(spark, folder, "op2"), "doc_id", "n_shingles", "component_id", "kept") == want


def test_op3(spark, folder):
    got = result(spark, folder, "op3").collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1
    want = Counter()
    for i, t, *_ in odd_rows():
        ids, at, k = tokens(t), 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 2048 or 2048
            want[i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_op4(spark, folder):
    rows = [(i, (t or "").encode()) for i, t, *_ in odd_rows()]
    often = Counter(b[s : s + 400] for _, b in rows for s in range(len(b) - 399))
    want = []
    for i, b in rows:
        keep, runs, until, before = [], 0, 0, False
        for s in range(len(b)):
            if often[b[s : s + 400]] > 1 and s + 400 <= len(b):
                until = s + 400
            runs += s < until and not before
            before = s < until
            if not before:
                keep.append(b[s])
        want.append((i, len(b), len(b) - len(keep), runs, hashlib.sha256(bytes(keep)).hexdigest()))
    assert listed(result(spark, folder, "op4"), *COLUMNS["op4"].split()) == sorted(want, key=repr)


def test_op6(spark, folder):
    rows = [(i, WORD.findall((t or "").encode())) for i, t, *_ in odd_rows()]
    first = {}
    low = lambda i: -1 if i is None else i
    for i, w in rows:
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            first[k] = min(first.get(k, 10**9), low(i))
    want = []
    for i, w in rows:
        gone = {j for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < low(i) for j in range(s, s + 50)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert listed(result(spark, folder, "op6"), *COLUMNS["op6"].split()) == sorted(want, key=repr)


def test_op7(spark, folder):
    want = []
    for i, t, *_ in odd_rows():
        w = [x.decode() for x in WORD.findall((t or "").encode())]
        grams = defaultdict(list)
        for s in range(len(w) - 2):
            grams[tuple(w[s : s + 3])].append(s)
        rep = len({p for v in grams.values() if len(v) > 1 for s in v for p in (s, s + 1, s + 2)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x.encode())]
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        want.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    got = result(spark, folder, "op7")
    assert listed(got, *COLUMNS["op7"].split()[:-1]) == sorted(want, key=repr)
    assert got.where("base_failed and kept").count() == 0


def naive_score(model, text):
    """The score by looking for every entry at every word."""
    t = fold(text)
    total, n = 0.0, 0
    for at in [i for i, c in enumerate(t[:-1]) if c == " "]:
        hits = [w for k, w in model.weights.items() if t.startswith(k, at) and w > 0]
        safe = any(t.startswith(p, s) and s <= at < s + len(p) - 1 for p in model.exceptions for s in range(max(0, at - len(p) + 2), at + 1))
        if hits and not safe:
            total, n = total + max(hits), n + 1
    words = len(t.split())
    x = model.bias + model.slopes[0] * math.log1p(total) + model.slopes[1] * math.log1p(10 * total / math.sqrt(max(words, 1)))
    return 1 / (1 + math.exp(-x)), n


def test_op8_scores(spark, odd):
    """Scores of the odd rows and of made-up texts against a search without automaton."""
    rng = random.Random(6)
    model = toxicity.Model({" lor": 1.5, " amet ": 2.0, " word ": 0.7, " idiot ": 3.0, " lorem ": 0.5, " changed ": 1.0}, [" sit amet ", " amet sit ", " two words "], -1.0, (0.8, 0.4))
    texts = [r[1] for r in odd_rows()] + [" ".join(rng.choice(["lor", "lorem", "sit", "amet", "1d10t", "ІDIOT", "x", "word", "Amet.", "-"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(rows, model).select("row.doc_id", "score", "n_matches").collect():
        want, n = naive_score(model, texts[r.doc_id] or "")
        assert abs(r.score - want) < 1e-9 and r.n_matches == n
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns
    assert sorted(map(repr, (r[:5] for r in kept.collect()))) == sorted(repr(r) for r in map(tuple, odd_rows()) if naive_score(model, r[1] or "")[0] < 0.5)


def naive_model(rows, how):
    """Entries, exceptions and curve by plain counting over (text, toxic)."""
    size, bad = len(rows), sum(y for _, y in rows)
    n, hits = Counter(), Counter()
    for text, y in rows:
        words = set(fold(text or "").split())
        got = {f" {w} " for w in words} | {" " + w[:k] for w in words for k in range(how.shortest_prefix, how.longest_prefix + 1) if len(w) > k}
        n.update(got)
        hits.update(got if y else ())
    p = bad / size

    def gain(e):
        t, m = hits[e], n[e]
        if t <= m * p:
            return 0.0
        return 2 * (t * math.log(t / (m * p)) + ((m - t) * math.log((m - t) / (m * (1 - p))) if m > t else 0))

    often = [e for e in n if n[e] >= how.least_rows]
    limit = 2 * math.log(20 * len(often))
    weights = {e: round(math.log((hits[e] + 0.5) / (bad + 1)) - math.log((n[e] - hits[e] + 0.5) / (size - bad + 1)), 6) for e in often if gain(e) > limit}
    seen, seen_bad = Counter(), Counter()
    for text, y in rows:
        t, got = fold(text or ""), set()
        at = [i for i, c in enumerate(t[:-1]) if c == " "]
        for k, i in enumerate(at):
            if any(t.startswith(e, i) and w > 0 for e, w in weights.items()):
                if k:
                    got.add(t[at[k - 1] : t.index(" ", i + 1) + 1])
                if k + 1 < len(at):
                    got.add(t[i : t.index(" ", at[k + 1] + 1) + 1])
        seen.update(got)
        seen_bad.update(got if y else ())
    exceptions = sorted(e for e in seen if seen[e] - seen_bad[e] >= how.least_clean and seen_bad[e] <= seen[e] * p)
    return weights, exceptions


def test_op8_learning(spark):
    """The learned lexicon and exceptions against plain counting; the curve is at the least of
    its penalised loss."""
    rng = random.Random(13)
    plain = [f"{a}{b}" for a in "bcdfg" for b in ("ala", "ero", "inu", "oso", "ume", "arti", "elon", "idor")]
    rows = []
    for i in range(400):
        words, y = [rng.choice(plain) for _ in range(rng.randrange(5, 40))], int(rng.random() < 0.3)
        if y:
            words[rng.randrange(len(words))] = rng.choice(["vileone", "vileones", "nastyish", "N4sty1sh"])
        elif rng.random() < 0.3:
            at = rng.randrange(len(words) - 1)
            words[at : at + 2] = ["not", "vileone"]
        rows.append((i + 1, " ".join(words), y))
    how = toxicity.Training()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, how)
    train = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    weights, exceptions = naive_model(train, how)
    assert model.weights == weights and model.exceptions == exceptions and " not vileone " in exceptions
    found = [toxicity.Matcher(model).features(t)[:2] for t, _ in train]
    x = toxicity.inputs(*(np.array(v, float) for v in zip(*found)))
    y = np.array([v for _, v in train])

    def loss(b):
        z = b[0] + x @ b[1:]
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (b[1:] ** 2).sum()

    best = np.array([model.bias, *model.slopes])
    assert all(loss(best) <= loss(best + d) for d in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3)


def test_op5_odd(spark, odd):
    """Copies of the odd rows against an inversion by hand; own columns stay as they are."""
    rows = odd_rows()
    of = Counter(r[3] for r in rows)
    weight = {s: n**0.5 for s, n in of.items()}
    want = Counter()
    for r in rows:
        rate = len(rows) * weight[r[3]] / sum(weight.values()) / of[r[3]]
        u = int(hashlib.md5(f"17|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, total, term = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n, term = n + 1, term * rate / (n + 1)
            total += term
        want[r] += n
    got = mixing.mixed(odd)
    assert got.columns == odd.columns and got.select("mix_copy").distinct().collect() == [("clash",)]
    assert Counter(tuple(r[:5]) for r in got.collect()) == +want


def test_op8(spark, folder):
    got = result(spark, folder, "op8").collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def naive_pairs(samples):
    """Landmarks and their pairs frame by frame."""
    frames = [np.frombuffer(samples[i : i + 192], np.uint8).astype(np.float32) - 128 for i in range(0, len(samples) - 191, 96)]
    peaks = []
    for x in frames:
        level = np.rint(16 * np.log2(np.abs(np.fft.rfft(x * np.hanning(192).astype(np.float32)))[1:] + 1)).astype(int).tolist()
        peaks.append((max(level), level.index(max(level)) + 1))
    heights = [-1, *(h for h, _ in peaks), -1]
    marks = [i for i in range(len(peaks)) if heights[i + 1] > heights[i] and heights[i + 1] >= heights[i + 2]]
    pairs = [(a, b) for k, a in enumerate(marks) for b in marks[k + 1 : k + 4] if b - a <= 255]
    return sorted(a << 24 | peaks[a][1] << 16 | peaks[b][1] << 8 | b - a for a, b in pairs)


def test_op9(spark, folder):
    got = {(r.doc_id, r.payload_sha256): r for r in result(spark, folder, "op9").collect()}
    for i, t, *_ in odd_rows():
        data = (t or "").encode()
        pay = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        r = got[i, hashlib.sha256(pay).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(data), len(pay), zlib.crc32(pay[-16:]), len(pay) + 44)
        head = b"RIFF" + (len(pay) + 36).to_bytes(4, "little") + b"WAVEfmt " + b"".join(x.to_bytes(n, "little") for x, n in ((16, 4), (1, 2), (1, 2), (8000, 4), (8000, 4), (1, 2), (8, 2)))
        assert r.media_sha256 == hashlib.sha256(head + b"data" + len(pay).to_bytes(4, "little") + pay).hexdigest()
        pairs = naive_pairs(pay)
        assert r.fingerprint == pairs
        assert r.feature == f"{len(pay) // 96 - 1}f{len(pairs)}p{zlib.crc32(np.array(pairs, '<i8').tobytes()):08x}"


def test_op10(spark, folder):
    got = {r.page_id: r for r in result(spark, folder, "op10").collect() if r.page_id is not None}
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("c.net", "/es/1", "net/es/", "block")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("", "", None, "allow")
    assert got[5].rule == "www.example.com/en/" and got[6].rule == "example.com/en/" and got[6].verdict == "block"
    assert (got[8].host, got[8].path) == ("d.org", "") and got[8].verdict == "block"  # it links to a blocked host
    assert got[7].rule is None


def test_op10_sql_with_links(spark, folder, same):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder['odd']}/pages.parquet/*.parquet'")
    same(result(spark, folder, "op10"), c.sql(queries.ORACLES["op10_link_graph"]).df())


def test_op10_scale_free(spark):
    """Who links to a blocked host by way of popular ones stays suspect, however small the
    scores become."""
    rows, links = [("http://bad.net/es/", "")], "bad.net"
    for level in "xyz":
        rows += [(f"http://{level}{i}.org/", f'<a href="http://{links}/">') for i in range(1000)]
        links = f"{level}0.org"
    rows.append(("http://apart.org/", ""))
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    verdicts = {r.page_id: r.verdict for r in link_graph.judge(pages).collect()}
    assert verdicts.pop(len(rows) - 1) == "allow" and set(verdicts.values()) == {"block"}


def test_op10_chain(spark, same, tmp_path):
    """A host twelve links away from a blocked one, and a cycle: the same as by SQL."""
    rows = [("http://h0.net/es/", "")] + [(f"http://h{i}.org/", f'<a href="http://h{i - 1}.{"net" if i == 1 else "org"}/">') for i in range(1, 13)]
    rows += [(f"http://c{i}.org/", f'<a href="http://c{(i + 1) % 3}.org/"> <a href="http://t.com/">') for i in range(3)] + [("http://t.com/", '<a href="http://c0.org/"> <a href="http://h12.org/">'), ("http://h0.net/fr/", None)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op10_link_graph"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(got, c.sql(queries.ORACLES["op10_link_graph"]).df())
    verdicts = {r.host: r.verdict for r in got.collect()}
    # Trust reaches h12 from t.com; the hosts below it are nearer to the blocked one.
    assert verdicts["h1.org"] == verdicts["h6.org"] == "block" and verdicts["c0.org"] == "allow"


def test_op11(spark, folder):
    rows = [(i, np.array([np.nan if x is None else np.float32(x) for x in v or []], float)) for i, v, *_ in odd_vectors()]
    fine = [k for k, (i, v) in enumerate(rows) if i is not None and len(v) and np.isfinite(v).all() and v.any()]
    links, root = Counter(), list(range(len(rows)))
    for a in fine:
        for b in fine:
            x, y = rows[a][1], rows[b][1]
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[a] += 1
    for _ in rows:
        for a in fine:
            for b in fine:
                x, y = rows[a][1], rows[b][1]
                if len(x) == len(y) and root[a] != root[b] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    root[a] = root[b] = min(root[a], root[b], key=lambda k: rows[k][0])
    want = sorted(((i, links[k], rows[root[k]][0], rows[root[k]][0] == i) for k, (i, _) in enumerate(rows)), key=repr)
    assert listed(result(spark, folder, "op11"), *COLUMNS["op11"].split()) == want


TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def naive_ranking(docs, items, best=20):
    terms = lambda t: TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    bags = [(i, terms(t)) for i, t in docs]
    N, L = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            tf, m = Counter(b), 75 + 25 * len(b) * N // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


def test_op12(spark, folder):
    want = naive_ranking([r[:2] for r in odd_rows()], [r[:2] for r in odd_items()])
    assert listed(result(spark, folder, "op12"), *COLUMNS["op12"].split()) == want


@pytest.mark.parametrize("entries", [500_000, 40])
def test_op12_pruning(spark, entries):
    """Many documents, few terms, more ties than places; items in one block and in several."""
    from tessera.llm import lexical

    rng = random.Random(3)
    words = [f"w{int(60 * rng.random() ** 3)}" for _ in range(4000)]
    docs = [(i, " ".join(rng.sample(words, rng.randrange(1, 30)))) for i in range(700)] + [(1000 + i, "w1 w2 w50") for i in range(30)]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 12)))) for i in range(25)] + [(99, "w1 w2 w50")]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), lexical.Ranking(block_entries=entries, cells=2000))
    assert listed(got, *COLUMNS["op12"].split()) == naive_ranking(docs, items)


def naive_tree(leaves, fanout):
    """The root, and for every leaf its levels of (before, after)."""
    H = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, j in enumerate(at):
            run = j // fanout * fanout
            ways[k].append(("".join(nodes[run:j]), "".join(nodes[j + 1 : run + fanout])))
        at = [j // fanout for j in at]
        nodes = [H(nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)]
    return nodes[0], ways


def test_op13(spark, folder):
    H = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, la, s, n: H("".join(map(field, (i, s, la, n, t))))
    groups = defaultdict(list)
    for i, t, la, s, n in odd_rows():
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups[la].append((i is not None, i or 0, leaf(i, t, la, s, n), leaf(i, t, la, s, n + hit if n is not None else None), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: naive_tree([x[2] for x in sorted(groups[g])], 2) for g in order}
    root, crown = naive_tree([trees[g][0] for g in order], 2)
    want = []
    for g, above in zip(order, crown):
        for (_, _, own, claimed, i), way in zip(sorted(groups[g]), trees[g][1]):
            path, fold = way + above, claimed
            for before, after in path:
                fold = H(before + fold + after)
            want.append((i, own, trees[g][0], root, H("".join(b + a for b, a in path)), fold, fold == root))
    assert listed(result(spark, folder, "op13"), *COLUMNS["op13"].split()) == sorted(want, key=repr)


@pytest.mark.parametrize("fanout,depth,n", [(2, 2, 37), (3, 1, 30), (3, 2, 81), (4, 1, 5), (2, 3, 1)])
def test_merkle_shapes(spark, fanout, depth, n):
    """Other fanouts and several tiers of blocks, the last ones not full."""
    from pyspark.sql import functions as F

    from tessera.llm import merkle

    rows = [(f"={g}", k, hashlib.sha256(f"{g}{k}".encode()).hexdigest()) for g, m in (("a", n), ("b", 1), ("c", fanout)) for k in range(m)]
    made = merkle.manifest(spark.createDataFrame(rows, "tree string, k long, leaf string").repartition(5), ["k"], merkle.Shape(fanout, depth), {"k": "bigint"})
    found = merkle.proofs(made).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    trees = {g: naive_tree([x[2] for x in rows if x[0] == g], fanout) for g in ("=a", "=b", "=c")}
    root, crown = naive_tree([t[0] for t in trees.values()], fanout)
    above = dict(zip(trees, crown))
    assert len(found) == len(rows)
    for r in found:
        assert (r.subroot, r.root, r.folded, r.pos) == (trees[r.tree][0], root, root, r.k)
        assert [(x.before, x.after) for x in r.path] == trees[r.tree][1][r.k] + above[r.tree]


def test_registered():
    """All operators and the pipeline are registered beside the other queries."""
    import __spark_entry__ as entry
    from tessera.plans import catalogue

    names = set(entry.queries()) - set(catalogue.QUERIES)
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names - {"pipeline"}} == set(range(1, 14)) and len(names) == 14
