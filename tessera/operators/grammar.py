"""The 35 grammatical features of a tagged transcript, as one projection of higher-order
functions.

Tags come from a strategy. The default is a small rule tagger written as an expression
(closed-class words and endings), so its tags are approximate; the feature definitions
are exact for whatever tags come in. ``tag_by_weights`` tags with an injected table of
weights instead, and ``syllable_counts`` takes an injected table of pronunciations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.session import stored

#: Penn tag sets and word lists of the feature definitions.
FUNCTION_TAGS = ("CC", "DT", "EX", "IN", "LS", "MD", "PDT", "POS", "PRP", "PRP$", "RP", "TO", "UH", "WDT", "WP", "WP$", "WRB")
VERB_TAGS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS", "PRP")
ADJ_TAGS = ("JJ", "JJR", "JJS")
ADV_TAGS = ("RB", "RBR", "RBS")
PRONOUN_TAGS = ("PRP", "PRP$", "WP", "WP$")
DETERMINER_TAGS = ("DT", "PDT", "WDT")
PREP_TAGS = ("IN", "TO")
SUBORDINATING = (
    "because", "although", "though", "since", "when", "while", "if",
    "unless", "before", "after", "until", "whereas", "that", "whether",
)
PERSONAL = (
    "i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "they", "them", "their", "theirs", "themselves",
)

#: The rule tagger: closed-class words, then endings, first match wins.
WORD_TAGS = (
    ("DT", ("the", "a", "an", "this", "these", "those", "every", "each", "some", "any", "no")),
    ("IN", ("of", "in", "on", "at", "by", "for", "with", "from", "as", "that", "if", "because", "while", "since", "after", "before", "until", "though", "although", "unless", "whether", "whereas")),
    ("TO", ("to",)), ("CC", ("and", "or", "but", "nor", "yet")),
    ("PRP", ("i", "me", "we", "us", "you", "he", "him", "she", "her", "it", "they", "them", "myself", "himself", "herself", "themselves", "ourselves", "yourself", "yourselves", "mine", "ours", "yours", "hers", "theirs")),
    ("PRP$", ("my", "our", "your", "his", "its", "their")),
    ("MD", ("can", "could", "will", "would", "shall", "should", "may", "might", "must")),
    ("VBZ", ("is", "has", "does")), ("VBP", ("am", "are", "have", "do")), ("VBD", ("was", "were", "had", "did")), ("VB", ("be", "get", "go", "see")),
    ("WP", ("who", "whom", "what")), ("WDT", ("which",)), ("WRB", ("when", "where", "how", "why")),
    ("RB", ("not", "very", "too", "also", "then", "there", "here", "never", "always")), ("UH", ("uh", "um", "oh", "yes")),
)
ENDING_TAGS = (("VBG", "ing"), ("VBD", "ed"), ("RB", "ly"), ("JJ", "able"), ("JJ", "ous"), ("JJ", "ful"), ("NN", "tion"), ("JJS", "est"), ("JJR", "er"), ("NNS", "s"))


def rule_tag(word: Column) -> Column:
    w = F.lower(word)
    out = F.when(~text.has_alnum(word), ".").when(w.rlike("^[0-9]+$"), "CD")
    for tag, words in WORD_TAGS:
        out = out.when(w.isin(*words), tag)
    for tag, ending in ENDING_TAGS:
        out = out.when(w.endswith(ending), tag)
    return out.otherwise("NN")


def rule_tag_sql(word: str) -> str:
    """The same rules as SQL."""
    w = f"lower({word})"
    out = [f"WHEN NOT regexp_matches({word}, '[\\p{{L}}\\p{{N}}]') THEN '.'", f"WHEN regexp_matches({w}, '^[0-9]+$') THEN 'CD'"]
    out += [f"WHEN {w} IN ({', '.join(repr(x) for x in words)}) THEN '{tag}'" for tag, words in WORD_TAGS]
    out += [f"WHEN ends_with({w}, '{e}') THEN '{tag}'" for tag, e in ENDING_TAGS]
    return f"CASE {' '.join(out)} ELSE 'NN' END"


def recode(tokens: Column, tagger=rule_tag, keep_stop_words: bool = True) -> Column:
    """Every token as its tag; stop words keep their form unless told otherwise."""
    tag = lambda t: F.when(t.isin(*text.STOP_WORDS), t).otherwise(tagger(t)) if keep_stop_words else tagger(t)
    return F.transform(tokens, tag)


def word_tokens(x: Column) -> Column:
    """Words (with inner apostrophes) and single marks."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"), F.lit(0))


def syllables(word: Column) -> Column:
    """Vowel groups, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiouy]+")))


#: Letters by falling sonority; all others but marks and digits count as vowels.
SONORITY = (("lmnrw", 2), ("zvsf", 1), ("bcdgtkpqxhj", 0))


def sonority_syllables(word: Column) -> Column:
    """Syllables of a word by the sonority of its letters. One ends before a letter that is
    less sonorous than both neighbours, and behind one that is as sonorous as the next and no
    more than the last; marks and digits stand alone. Stretches without a vowel belong to a
    neighbour, so those with a vowel count; a word has at least one."""
    letters = F.filter(F.split(F.lower(word), ""), lambda c: c != "")
    rank = lambda c: F.when(c.rlike(r"[0-9\p{Punct}]"), -1).when(c.isin(*SONORITY[0][0]), SONORITY[0][1]).when(c.isin(*SONORITY[1][0]), SONORITY[1][1]).when(c.isin(*SONORITY[2][0]), SONORITY[2][1]).otherwise(3)
    v = F.transform(letters, rank)
    at = lambda i: F.get(v, i)
    inner = lambda i: (i >= 1) & (i <= F.size(v) - 2)
    behind = lambda i: inner(i) & ((at(i) == -1) | ((at(i - 1) >= at(i)) & (at(i) == at(i + 1))))
    before = lambda i: inner(i) & ((at(i) == -1) | ((at(i - 1) > at(i)) & (at(i) < at(i + 1))))
    marked = F.transform(v, lambda x, i: F.struct((x == 3).alias("vowel"), F.coalesce(before(i) | behind(i - 1), F.lit(False)).alias("cut")))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("has"))

    def step(s, x):
        has = s["has"] & ~x["cut"]
        return F.struct((s["n"] + (x["vowel"] & ~has).cast("int")).alias("n"), (has | x["vowel"]).alias("has"))

    return F.greatest(F.lit(1), F.aggregate(marked, start, step, lambda s: s["n"]))


def pronounced(pronunciations: DataFrame) -> DataFrame:
    """(word, n_syllables) of (word, phones): the phones that end in a digit are stressed or
    unstressed vowels; of several pronunciations the longest counts."""
    n = F.size(F.filter("phones", lambda p: p.rlike("[0-9]$")))
    return pronunciations.groupBy(F.lower("word").alias("word")).agg(F.max(n).alias("n_syllables"))


def syllable_counts(words: DataFrame, pronunciations: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with n_syllables: by the dictionary, else by sonority. Only distinct words
    are looked up."""
    known = words.select(F.lower(word).alias("_w")).distinct().join(pronounced(pronunciations).withColumnRenamed("word", "_w"), "_w", "left")
    counted = known.select("_w", F.coalesce("n_syllables", sonority_syllables(F.col("_w"))).alias("n_syllables"))
    return words.withColumn("_w", F.lower(word)).join(counted, "_w", "left").drop("_w")


#: Features of a token that a word near it gives: the word's distance, and their names by
#: what of the word they take.
WORD_FEATURES = (
    (0, ("suffix", "pref1", "word")), (-1, ("word", "suffix")), (-2, ("word",)), (1, ("word", "suffix")), (2, ("word",)),
)


def word_features(word: Column) -> Column:
    """(role, feature) of everything that a word gives the tokens around it; roles are places
    in ``WORD_FEATURES``."""
    take = {"word": word, "suffix": F.substring(word, -3, 3), "pref1": F.substring(word, 1, 1)}
    named = lambda k, what: F.concat(F.lit(f"i{k:+d} {what} " if k else f"i {what} "), take[what])
    return F.array(*(F.struct(F.lit(r).alias("role"), named(k, x).alias("feature")) for r, (k, parts) in enumerate(WORD_FEATURES) for x in parts))


def decode(scores: list[dict], with_word: list[dict], tags: list[str], one: dict, two: dict, both: dict) -> list[str]:
    """The best tag of each token from left to right: its own scores by tag, and weights by
    the last tag, the one before, both of them, and the last tag with the word. Equal
    sums go to the tag that sorts last."""
    out, first, second = [], "-START-", "-START2-"
    for own, word in zip(scores, with_word):
        total = {t: own.get(t, 0.0) for t in tags}
        for weights in (one.get(first), two.get(second), both.get((first, second)), word.get(first)):
            for t, x in (weights or {}).items():
                total[t] = total.get(t, 0.0) + x
        best = max(total, key=lambda t: (total[t], t)) if total else None
        out.append(best)
        first, second = best, first
    return out


#: What tokens stand for before and after a transcript, and bytes of an Arrow batch.
BEFORE, BEHIND, BATCH_BYTES = "-START-", "-END-", 4 << 20


class Tagger:
    """Tags many rows at once, a place of all of them after the other. Sums are those of
    ``decode``; tags go by their number in sorted order."""

    def __init__(self, tags: list[str], links: list[tuple[str, str, float]], bias: np.ndarray, edges: dict):
        self.tags, self.bias, self.edges = np.array(tags, object), bias, edges
        n = len(tags)
        number = {t: k for k, t in enumerate(tags)}
        # Numbers of earlier tags; those of the places before a row come last.
        last, second = number | {BEFORE: n}, number | {"-START2-": n, BEFORE: n + 1}
        self.one, self.two, self.both = np.zeros((n + 1, n)), np.zeros((n + 2, n)), {}
        for feature, tag, weight in links:
            if feature.startswith("i tag+i-2 tag "):
                x, y, *more = [*feature[len("i tag+i-2 tag ") :].split(" "), ""]
                if x in last and y in second and more == [""]:
                    self.both.setdefault(last[x] * (n + 2) + second[y], np.zeros(n))[number[tag]] = weight
                continue
            name = feature[len("i-1 tag ") :]
            if feature.startswith("i-1") and name in last:
                self.one[last[name], number[tag]] = weight
            elif feature.startswith("i-2") and name in second:
                self.two[second[name], number[tag]] = weight
        self.last, self.pairs = last, _Rows(self.both, n)

    def scores(self, at, x) -> np.ndarray:
        """A word's sums by role and tag."""
        out = np.zeros(len(WORD_FEATURES) * len(self.tags))
        np.add.at(out, at, x)
        return out.reshape(len(WORD_FEATURES), -1)

    def batch(self, tokens: list, words: list) -> list:
        n, known, with_last, places = len(self.tags), [], {}, {}
        for role, of in self.edges.items():
            places[role] = len(known)
            known.append(of)
        for row in words:
            for w in row or ():
                if w["word"] not in places:
                    places[w["word"]] = len(known)
                    known.append(self.scores(w["at"], w["x"]) if w["at"] else np.zeros((len(WORD_FEATURES), n)))
                    for e in w["links"] or ():
                        if e["last"] in self.last:
                            with_last.setdefault(places[w["word"]] * (n + 1) + self.last[e["last"]], np.zeros(n))[e["tag"]] = e["weight"]
        known, linked, none = np.stack(known), _Rows(with_last, n), places[None]
        length = np.array([len(t) for t in tokens])
        order = np.argsort(-length, kind="stable")
        # The words' places, with two before and behind every row; missing ones stand as those do.
        code = np.full((len(tokens), int(length.max(initial=0)) + 4), none)
        for k, row in enumerate(order):
            code[k, 2 : 2 + length[row]] = [places.get(w, none) for w in tokens[row]]
        first, second = np.full(len(tokens), n), np.full(len(tokens), n)
        found = np.zeros((len(tokens), code.shape[1]), np.int64)
        for i in range(code.shape[1] - 4):
            live = int(np.searchsorted(-length[order], -i, "left"))
            total = np.tile(self.bias, (live, 1))
            for role, (k, _) in enumerate(WORD_FEATURES):
                of = code[:live, i + 2 + k]
                total += known[np.where(of == none, places[BEFORE] if k < 0 else places[BEHIND], of), role]
            total += self.one[first[:live]] + 0.0
            total += self.two[second[:live]]
            self.pairs.add(total, first[:live] * (n + 2) + second[:live])
            linked.add(total, code[:live, i + 2] * (n + 1) + first[:live])
            # Of equal sums the tag that sorts last.
            best = n - 1 - np.argmax(total[:, ::-1], axis=1)
            found[:live, i] = best
            second[:live] = np.where(first[:live] == n, n + 1, first[:live])
            first[:live] = best
        out: list = [None] * len(tokens)
        for k, row in enumerate(order):
            out[row] = self.tags[found[k, : length[row]]].tolist()
        return out


class _Rows:
    """Few rows of weights by number, added where the numbers occur."""

    def __init__(self, rows: dict, n: int):
        self.keys = np.array(sorted(rows), np.int64)
        self.rows = np.stack([rows[k] for k in self.keys.tolist()]) if rows else np.zeros((0, n))

    def add(self, total: np.ndarray, keys: np.ndarray) -> None:
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            total[hit] += self.rows[at[hit]]


def tag_by_weights(df: DataFrame, keys: list[str], weights: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``keys`` and ``tagged`` (an array of (w, t)) of token arrays, by an injected table of
    weights (feature, tag, weight). Features that words give are joined and added up once per
    distinct word, and a transcript is joined to its distinct words; those of earlier tags
    ("i-1 tag x", "i-2 tag x", "i tag+i-2 tag x y") are as many as tags allow and go along;
    "i-1 tag+i word x w" comes by the word."""
    weights = stored(weights, "tag-weights")
    kind = F.regexp_extract("feature", r"^(i-1 tag|i-2 tag|i tag\+i-2 tag) ", 1)
    # At most a square and a cube of the number of tags.
    links = [(r.feature, r.tag, r.weight) for r in weights.where(kind != "").select("feature", "tag", "weight").collect()]
    tags = sorted(r.tag for r in weights.select("tag").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, tags)).cast("array<string>"), F.col("tag")).cast("int") - 1
    row = stored(df.select(*keys, F.col(tokens).alias("_tokens")).withColumn("_row", F.monotonically_increasing_id()), "tag-rows")
    each = row.select("_row", F.explode(F.array_distinct("_tokens")).alias("_w")).where("_w is not null")
    ends = df.sparkSession.createDataFrame([(BEFORE,), (BEHIND,)], "_w string")
    near = each.select("_w").unionByName(ends).distinct().select("_w", F.explode(word_features(F.col("_w"))).alias("f")).select("_w", "f.role", "f.feature")
    at = (F.col("role") * len(tags) + number).alias("at")
    own = near.join(weights, "feature").groupBy("_w").agg(F.array_sort(F.collect_list(F.struct(at, F.col("weight").alias("x")))).alias("o"))
    pair = weights.where("feature like 'i-1 tag+i word %'").select(F.split(F.substring("feature", 16, 1 << 20), " ", 2).alias("p"), number.alias("tag"), "weight")
    by_word = pair.groupBy(F.col("p")[1].alias("_w")).agg(F.collect_list(F.struct(F.col("p")[0].alias("last"), "tag", "weight")).alias("links"))
    scored = stored(own.join(by_word, "_w", "full").select("_w", F.col("o.at").alias("at"), F.col("o.x").alias("x"), "links"), "tag-words")
    packed = each.join(scored, "_w").groupBy("_row").agg(F.collect_list(F.struct(F.col("_w").alias("word"), "at", "x", "links")).alias("words"))

    bias = np.zeros(len(tags))
    for r in weights.where("feature = 'bias'").select("tag", "weight").collect():
        bias[tags.index(r.tag)] += r.weight
    # The places before and behind a row, and one without a word.
    empty = np.zeros((len(WORD_FEATURES), len(tags)))
    edges = {BEFORE: empty, BEHIND: empty, None: empty}
    tagger = Tagger(tags, links, bias, edges)
    for r in scored.where(F.col("_w").isin(BEFORE, BEHIND) & F.col("at").isNotNull()).collect():
        edges[r["_w"]] = tagger.scores(r["at"], r["x"])

    def work(batches):
        for batch in batches:
            said = batch.column("_tokens").to_pylist()
            if tags:
                found = tagger.batch([t or [] for t in said], batch.column("words").to_pylist())
            else:
                found = [[None] * len(t or []) for t in said]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.list_(pa.string()))], ["_row", "t"])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    joined = row.select("_row", "_tokens").join(packed, "_row", "left")
    found = joined.mapInArrow(work, "_row long, t array<string>")
    out = row.join(found, "_row", "left")
    return out.select(*keys, F.coalesce(F.zip_with("_tokens", "t", lambda w, t: F.struct(w.alias("w"), t.alias("t"))), F.array().cast("array<struct<w:string,t:string>>")).alias("tagged"))


def tagged(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("w"), rule_tag(t).alias("t")))


def _count(a: Column, test) -> Column:
    return F.size(F.filter(a, test)).cast("double")


def features(df: DataFrame, keys: list[str], tags: str = "tagged", window: int = 20) -> DataFrame:
    """keys + 35 columns of rows whose ``tags`` holds (w, t) structs. Rows without a word
    that has a letter or digit are left out."""
    # The arrays that several features share are materialised by their own projection.
    # Behind explode, so that the filter on words below is not pushed down, which would work out
    # the tags twice.
    base = df.select(*keys, F.explode(F.array(tags)).alias("a")).select(
        *keys, "a",
        F.transform("a", lambda x: x["t"]).alias("pos"),
        F.filter(F.transform("a", lambda x: x["w"]), lambda w: text.has_alnum(w)).alias("raw"),
    )
    base = base.select(*keys, "a", "pos", F.transform("raw", lambda w: F.lower(w)).alias("w")).withColumn("n", F.size("w").cast("double")).where("n > 0")
    # The sorted words too: in a lambda they would be sorted again for every word.
    base = base.withColumn("ordered", F.sort_array("w"))
    a, pos, w, n, ordered = F.col("a"), F.col("pos"), F.col("w"), F.col("n"), F.col("ordered")
    size = F.size(w)
    tag = lambda *names: _count(a, lambda x: x["t"].isin(*names))
    near = F.filter(
        F.transform(pos, lambda t, i: t.isin(*VERB_TAGS) & F.exists(F.slice(pos, F.greatest(i - 2, F.lit(1)), F.least(i + 4, F.lit(7))), lambda o: o.isin(*NOUN_TAGS))),
        lambda hit: hit,
    )
    types = F.array_distinct(w)
    # Sorted, a word stands once where both neighbours differ.
    once = F.size(F.filter(F.transform(ordered, lambda t, i: ((i == 0) | (F.get(ordered, i - 1) != t)) & ((i == size - 1) | (F.get(ordered, i + 1) != t))), lambda alone: alone)).cast("double")
    v = F.size(types).cast("double")
    mattr_starts = F.when(size > window, F.sequence(F.lit(1), size - window))
    mattr = F.when(
        size > window,
        # Whole numbers are summed and divided once, so the order of windows does not show.
        F.aggregate(F.transform(mattr_starts, lambda i: F.size(F.array_distinct(F.slice(w, i, window)))), F.lit(0), lambda s, x: s + x) / (float(window) * (size - window)),
    ).otherwise(n / v)
    reps = lambda k: _count(F.transform(w, lambda t, i: F.array_contains(F.slice(w, i + 2, k), t)), lambda hit: hit)
    pairs = F.when(F.size(pos) > 1, F.transform(F.sequence(F.lit(1), F.size(pos) - 1), lambda i: F.array_join(F.slice(pos, i, 2), " "))).otherwise(F.array().cast("array<string>"))
    triples = F.when(F.size(pos) > 2, F.transform(F.sequence(F.lit(1), F.size(pos) - 2), lambda i: F.array_join(F.slice(pos, i, 3), " "))).otherwise(F.array().cast("array<string>"))
    chars = F.aggregate(F.transform(w, lambda t: F.length(t)), F.lit(0), lambda s, x: s + x)
    beats = F.aggregate(F.transform(w, syllables), F.lit(0), lambda s, x: s + x)
    counted = base.select(
        *keys, "n", tag(*NOUN_TAGS).alias("noun"), tag(*VERB_TAGS).alias("verb"), tag(*ADJ_TAGS).alias("adj"), tag(*ADV_TAGS).alias("adv"),
        tag("CC").alias("coord"), _count(a, lambda x: F.lower(x["w"]).isin(*SUBORDINATING)).alias("subord"), tag("VBG", "VBN").alias("reduced"), tag(*FUNCTION_TAGS).alias("func"),
        F.size(near).cast("double").alias("pred"), tag(*PRONOUN_TAGS).alias("pron"),
        _count(a, lambda x: x["t"].isin(*PRONOUN_TAGS) & F.lower(x["w"]).isin(*PERSONAL)).alias("personal"),
        tag(*DETERMINER_TAGS).alias("det"), tag(*PREP_TAGS).alias("prep"), tag("VBG").alias("vbg"), tag("MD").alias("md"), tag("VBZ").alias("vbz"),
        chars.cast("double").alias("chars"), v.alias("v"), once.alias("once"), mattr.alias("mattr"), (beats / n).alias("aws"),
        reps(1).alias("r1"), reps(3).alias("r3"), reps(5).alias("r5"),
        (F.size(F.array_distinct(pairs)) + F.size(F.array_distinct(triples))).cast("double").alias("variety"), (F.size(pairs) + F.size(triples)).alias("patterns"),
    )
    c = F.col
    per = lambda name: c(name) / c("n")
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return counted.select(
        *keys, per("noun").alias("noun_ratio"), per("verb").alias("verb_ratio"), per("adj").alias("adj_ratio"), per("adv").alias("adv_ratio"),
        per("coord").alias("coord_markers"), per("subord").alias("subord_markers"), per("reduced").alias("reduced_verbs"), per("func").alias("function_words"),
        per("pred").alias("num_predicates_approx"), per("pron").alias("pronoun_ratio"), per("personal").alias("personal_pronoun_ratio"), per("det").alias("determiner_ratio"),
        per("prep").alias("preposition_ratio"), per("vbg").alias("verb_present_participle_ratio"), per("md").alias("verb_modal_ratio"), per("vbz").alias("verb_third_person_sing_ratio"),
        per("chars").alias("avg_word_length"), per("v").alias("unique_words"), per("v").alias("type_token_ratio"), c("mattr"),
        F.when(c("once") == c("v"), 100 * F.ln(c("n"))).otherwise(100 * F.ln(c("n")) / (1 - F.try_divide(c("once"), c("v")))).alias("honores_statistic"),
        F.pow(c("n"), F.pow(c("v"), F.lit(-0.165))).alias("brunets_index"), c("n").alias("avg_sentence_length"), c("aws").alias("avg_word_syllables"),
        (0.39 * c("n") + 11.8 * c("aws")).alias("flesch_kincaid_grade_level"), (206.835 - 1.015 * c("n") - 84.6 * c("aws")).alias("flesch_kincaid_reading_ease"),
        c("r1").alias("immediate_reps"), c("r3").alias("nearby_reps_k3"), c("r5").alias("nearby_reps_k5"), c("variety").alias("pos_pattern_variety"),
        ratio(c("variety"), c("patterns")).alias("pos_pattern_density"),
        ((c("verb") + c("adj") + c("adv") + c("prep") + c("coord") + c("subord")) / c("n")).alias("propositional_density"),
        ((c("noun") + c("verb") + c("adj") + c("adv")) / c("n")).alias("content_density"), ratio(c("noun"), c("verb")).alias("noun_verb_ratio"), ratio(c("adj"), c("noun")).alias("adj_noun_ratio"),
    )
