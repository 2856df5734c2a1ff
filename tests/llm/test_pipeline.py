"""The pipeline on odd rows, on empty tables and on planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tests.llm.conftest import SCHEMA, odd_rows, sentence

import corpus_pipeline as pipeline


def test_stages_keep_columns(spark, folder):
    for which in ("odd", "none"):
        docs = spark.read.parquet(f"{folder[which]}/documents.parquet")
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder[which])
            assert docs.columns == columns, name
            path = f"{folder[which]}/stage-{name.replace(' ', '-')}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        packed = pipeline.STAGES[-1][1](spark, docs, folder[which])
        assert (packed.count() > 0) == (which == "odd")


def test_planted(spark, tmp_path):
    rng = random.Random(11)
    passage, insult = sentence(rng, 80), "vilest"
    rows = [(i, sentence(rng, 100), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(200 + i, sentence(rng, 60) + (f" {insult} " + sentence(rng, 9)) * 3, "en", "s0", 1) for i in range(60)]
    rows += [(300, rows[0][1], "en", "s1", 1), (301, rows[1][1].replace(rows[1][1].split()[50], "new", 1), "en", "s1", 1)]
    rows += [(310 + i, sentence(rng, 60) + " " + passage + " " + sentence(rng, 60), "en", "s2", 1) for i in range(3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    clean = {r.doc_id for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert clean == {r[0] for r in rows} - set(range(200, 260))
    single = {r.doc_id for r in stages["near duplicates"](spark, docs, str(tmp_path)).collect()}
    assert single == {r[0] for r in rows} - {300, 301}
    cut = {r.doc_id: r for r in stages["repeated passages"](spark, docs, str(tmp_path)).collect()}
    assert all(passage not in cut[310 + i].text and len(cut[310 + i].text) > 300 for i in range(3))
    assert cut[5].text == rows[5][1] and cut[310].n_chars == len(cut[310].text)


def test_short_words_planted(spark, tmp_path):
    """Passages of 51 words under 400 bytes go from every document, shorter ones and those
    of a single document stay."""
    rng = random.Random(12)
    few = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n))
    passage, shorter, own = few(51), few(50), few(51)
    assert len(passage.encode()) < 400
    texts = {i: f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}" for i in (1, 2)} | {3: f"{sentence(rng, 60)}  {passage.replace(' ', '  ')}\n{sentence(rng, 60)}"}
    texts |= {i: f"{sentence(rng, 60)} {shorter} {sentence(rng, 60)}" for i in (4, 5)} | {6: f"{own} {sentence(rng, 9)} {own}"}
    block = few(30) + " " + passage  # equal surroundings in two documents, others in a third
    texts |= {7: f"{sentence(rng, 40)} {block} {sentence(rng, 40)}", 8: f"{sentence(rng, 40)} {block} {sentence(rng, 40)}"}
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in texts.items()], SCHEMA)
    cut = {r.doc_id: r.text for r in dict(pipeline.STAGES)["repeated passages"](spark, docs, str(tmp_path)).collect()}
    for i in (1, 2, 3, 7, 8):
        assert not set(passage.split()) & set(cut[i].split()) and len(cut[i]) > 300
    assert all(cut[i] == texts[i] for i in (4, 5, 6))
    assert not set(block.split()) & set(cut[7].split())


SPACES = re.compile(rb"[^\x20\x09-\x0D]+")


def naive_kept(rows):
    """How many rows of each text stay: one of every group of linked rows with a doc_id and
    words, and all others."""
    def shingles(t):
        w = SPACES.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                both = len(sets[a] & sets[b])
                if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b], key=lambda k: rows[k][0])
    free = [r for k, r in enumerate(rows) if not sets[k] or r[0] is None]
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        if sets[k] and r[0] is not None:
            groups[root[k]].append(r)
    return free, [(min(r[0] for r in g), {r for r in g}) for g in groups.values()]


def naive_cut(rows):
    """Texts without 400-byte strings that stand twice, and without 51-word windows that stand
    in two documents; characters that are covered in part stay."""
    data = [(t or "").encode() for _, t, *_ in rows]
    often = Counter(b[s : s + 400] for b in data for s in range(len(b) - 399))
    where = defaultdict(set)
    for r, b in zip(rows, data):
        w = SPACES.findall(b)
        for s in range(len(w) - 50):
            where[tuple(w[s : s + 51])].add((r[0], r[1]))
    out = []
    for r, b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 399):
            if often[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        words = list(SPACES.finditer(b))
        for s in range(len(words) - 50):
            if len(where[tuple(w[0] for w in words[s : s + 51])]) > 1:
                gone[words[s].start() : words[s + 50].end()] = True
        at, kept = 0, []
        for c in (r[1] or ""):
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out.append((*r[:1], "".join(kept), *r[2:4]))
    return out


def test_brute_force(spark, tmp_path):
    """Every stage on what its predecessor left, against a plain computation."""
    rng = random.Random(31)
    rows = odd_rows()
    shared = [sentence(rng, 60) for _ in range(3)]
    rows += [(500 + i, f"{sentence(rng, 20 + i)} {shared[i % 3]} {sentence(rng, 25)}", "en", "abc"[i % 3], 7) for i in range(12)]
    rows += [(600 + i, sentence(rng, 30) + " vilest " * 4, "en", "a", 7) for i in range(30)] + [(700 + i, sentence(rng, 30), "en", "b", 7) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(600 + i, 1, 1) for i in range(30)] + [(700 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, docs = dict(pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")

    def after(name, df):
        stages[name](spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        return out, [tuple(r) for r in out.collect()]

    docs, clean = after("toxicity", docs)
    assert Counter(clean) == Counter(r for r in rows if not r[0] or not 600 <= r[0] < 630)
    docs, single = after("near duplicates", docs)
    free, groups = naive_kept(clean)
    left = Counter(single) - Counter(free)
    assert sum(left.values()) == len(groups) == len(single) - len(free)
    for least, members in groups:
        mine = [r for r in left if r in members]
        assert len(mine) == 1 and left[mine[0]] == 1 and mine[0][0] == least
    docs, cut = after("repeated passages", docs)
    assert Counter(r[:4] for r in cut) == Counter(naive_cut(single)) and all(r[4] is None or r[4] == len(r[1]) for r in cut)
    docs, mixed = after("source mixing", docs)
    of, want = Counter(r[3] for r in cut), Counter()
    weight = {s: n**0.5 for s, n in of.items()}
    for r in cut:
        rate = len(cut) * weight[r[3]] / sum(weight.values()) / of[r[3]]
        u = int(hashlib.md5(f"17|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, total, term = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n, term = n + 1, term * rate / (n + 1)
            total += term
        want[r] += n
    assert Counter(mixed) == +want
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        for k, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at : (first if k == 0 else at + 2048)]
            want[r[0], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1].tolist()] and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(r.length for r in packed) // 2048) + 1
