"""Queries over texts: word errors, text rules, language models, grammar, coherence,
synthesis."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numeric import r6, safe_corr
from tessera.operators import alignment, coherence, grammar, language_model, relational, statistics, synthesis, utterances
from tessera.plans import inputs
from tessera.plans.inputs import PAIRS_SQL
from tessera.session import stored, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _wer(spark, sf_dir):
    pairs = inputs.hypotheses(inputs.references(spark, sf_dir))
    d = alignment.encoded_distance(F.col("ref"), F.col("hyp"))
    return pairs.select("srcID", "pID", alignment.wer_from(d, F.size("ref"), F.size("hyp")).alias("wer"))


@query(f"WITH {PAIRS_SQL} SELECT srcID, count(*) AS n, round(avg(wer), 6) + 0 AS mean_wer FROM wer GROUP BY srcID ORDER BY mean_wer, srcID")
def wer_by_source(spark, sf_dir):
    return _wer(spark, sf_dir).groupBy("srcID").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("wer")).alias("mean_wer")).orderBy("mean_wer", "srcID")


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY srcID ORDER BY wer) AS rn, count(*) OVER (PARTITION BY srcID) AS n FROM wer),
t AS (SELECT srcID, avg(wer) AS trimmed FROM r WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) GROUP BY srcID)
SELECT w.srcID, round(avg(wer), 6) + 0 AS mean_wer, round(coalesce(stddev_samp(wer), 0), 6) + 0 AS sd_wer, round(median(wer), 6) + 0 AS median_wer, round(any_value(trimmed), 6) + 0 AS trimmed_wer
FROM wer w JOIN t ON w.srcID = t.srcID GROUP BY w.srcID""")
def wer_summary(spark, sf_dir):
    # The distances are computed once, and only their distinct values are ordered.
    placed = statistics.positions(_wer(spark, sf_dir), ["srcID"], "wer")
    n, x = F.col("n"), F.col("wer")
    mean = F.sum(n * x) / F.sum(n)
    median = statistics.quantiles_of(placed, ["srcID"], "wer", [0.5]).select("srcID", r6(F.col("q")[0]).alias("median_wer"))
    trimmed = statistics.rank_trimmed_of(placed, ["srcID"], "wer", 0.1).select("srcID", r6(F.col("trimmed")).alias("trimmed_wer"))
    means = placed.groupBy("srcID").agg(mean.alias("m"), F.sum(n).alias("rows"))
    spread = placed.join(means, "srcID").groupBy("srcID", "m", "rows").agg(F.sum(n * (x - F.col("m")) * (x - F.col("m"))).alias("s"))
    sd = F.coalesce(F.sqrt(F.try_divide(F.col("s"), F.col("rows") - 1)), F.lit(0.0))
    return spread.select("srcID", r6(F.col("m")).alias("mean_wer"), r6(sd).alias("sd_wer")).join(median, "srcID").join(trimmed, "srcID")


@query(f"WITH {PAIRS_SQL} SELECT srcID, CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS ref_words, CAST(sum(m) AS BIGINT) AS hyp_words FROM errors GROUP BY srcID")
def wer_totals(spark, sf_dir):
    """Errors and words of a source, added up from the aligned counts."""
    inputs.start(spark)
    c = inputs.hypotheses(inputs.references(spark, sf_dir)).select("srcID", alignment.alignment_counts("ref", "hyp").alias("c")).select("srcID", "c.*")
    total = lambda x: F.sum(x).cast("long")
    return c.groupBy("srcID").agg(total(F.expr("subs + dels + ins")).alias("errors"), total(F.expr("hits + subs + dels")).alias("ref_words"), total(F.expr("hits + subs + ins")).alias("hyp_words"))


@query()
def wer_components(spark, sf_dir):
    inputs.start(spark)
    return alignment.wer_components(inputs.hypotheses(inputs.references(spark, sf_dir)))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g')) AS norm,
array_to_string(regexp_extract_all(text, '(?i)[a-z0-9]+(?:''[a-z0-9]+)?'), '|') AS tokens FROM conversations""")
def normalize_tokenize(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize(x).alias("norm"), F.array_join(text.tokenize(x), "|").alias("tokens"))


def _replace_sql(x: str) -> str:
    for old, new in text.SENTENCE_STEPS:
        x = "replace({}, '{}', '{}')".format(x, old.replace("'", "''"), new)
    return x


@query(f"SELECT doc_id, {_replace_sql('text')} AS cleaned FROM documents")
def clean_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_sentences(F.col("text")).alias("cleaned"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$', 0, 's'), lambda s: trim(s)), lambda s: s <> '') AS s FROM documents)
SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_pos FROM s""")
def split_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("sent_pos", "sentence"))
    return d.select("doc_id", "sentence", F.col("sent_pos").cast("long").alias("sent_pos"))


@query(r"""SELECT conv_id, turn, array_to_string(list_transform(string_split(trim(text), ' '), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}_]', '', 'g')), ' ') AS cleaned
FROM conversations WHERE text IS NOT NULL AND len(string_split(trim(text), ' ')) >= 3""")
def clean_utterances(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & (text.word_count(F.trim("text")) >= 3))
    return c.select("conv_id", "turn", text.clean_utterance(F.col("text")).alias("cleaned"))


@query(r"""WITH w AS (SELECT conv_id, unnest(string_split(text, ' ')) AS w FROM conversations)
SELECT regexp_replace(replace(trim(lower(w)), '`', ''''), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS word, count(*) AS n FROM w GROUP BY 1""")
def norm_words(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy(text.norm_word(F.col("w")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda s: trim(s)), lambda s: s <> '') AS l,
list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda s: trim(s)), lambda s: s <> '') AS p FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(len(p) AS INTEGER) AS n_paragraphs FROM s""")
def segment_counts(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.segment(x)).alias("n_lines"), F.size(text.segment(x, "paragraph")).alias("n_paragraphs"))


@query(r"""SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g') AS bare,
CASE WHEN right(trim(regexp_replace(text, '\s+', ' ', 'g')), 1) IN ('.', '?', '!') THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) || '.' END AS closed
FROM benchmark""")
def sentence_forms(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.drop_punctuation(x).alias("bare"), text.close_sentence(x).alias("closed"))


def _contraction_sql(t: str) -> str:
    return "CASE {} {} ELSE {} END".format(t, " ".join("WHEN '{}' THEN '{}'".format(k.replace("'", "''"), v) for k, v in text.CONTRACTIONS.items()), t)


def _plain_sql(x: str) -> str:
    """Only letters whose accents SQL knows are decomposed, which is all these tables have."""
    old, new = (v.replace("'", "''") for v in text.TYPOGRAPHIC)
    x = f"regexp_replace(strip_accents(translate(lower({x}), '{old}', '{new}')), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\\s.?!,;:''\"-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_plain_sql('html')} AS plain, array_to_string(list_transform(string_split(lower(html), ' '), lambda t: {_contraction_sql('t')}), '|') AS tokens FROM pages")
def text_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_text(F.col("html")).alias("plain"), F.array_join(text.expand_contractions(F.split(F.lower("html"), " ")), "|").alias("tokens"))


def _treebank_sql(x: str) -> str:
    """The same rules, where the engine has no look-around."""
    for pattern, to in text.TREEBANK_RULES:
        pattern, to = pattern.replace(r"(?=\s)", r"\s").replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", to).replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


@query(f"""WITH p AS (SELECT conv_id, turn, {_plain_sql('text')} AS x FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, list_transform(string_split(regexp_replace(x, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: ' ' || trim(y) || ' ') AS s FROM p)
SELECT conv_id, turn, array_to_string(list_transform(flatten(list_transform(s, lambda y: list_filter(regexp_split_to_array(trim({_treebank_sql('y')}), '\\s+'), lambda w: w <> ''))), lambda t: {_contraction_sql('t')}), ' ') AS tokens FROM s""")
def treebank_tokens(spark, sf_dir):
    """Cleaned utterances as Treebank words and marks, contractions as full words."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    words = text.expand_contractions(text.treebank_tokens(text.normalize_text(F.col("text"))))
    return c.select("conv_id", "turn", F.array_join(words, " ").alias("tokens"))


def _pronunciations(spark, sf_dir):
    """A dictionary out of the items' words, with two pronunciations of a word: every vowel
    letter as a phone of its own, and every second letter left out."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    phones = lambda xs: F.transform(xs, lambda c: F.when(c.isin(*"aeiou"), F.concat(F.upper(c), F.lit("1"))).otherwise(F.upper(c)))
    both = F.array(phones(letters), phones(F.filter(letters, lambda c, i: i % 2 == 0)))
    return words.select("word", F.explode(both).alias("phones"))


def _talk_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@query(r"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)
SELECT w.word, count(*) AS n, CAST(max(len(regexp_extract_all(w.word, '[aeiou]'))) AS INTEGER) AS n_syllables FROM w JOIN k ON w.word = k.word GROUP BY w.word""")
def dictionary_syllables(spark, sf_dir):
    """Words of the dictionary with their largest number of syllables, and how often they were said."""
    counted = grammar.syllable_counts(_talk_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n")), _pronunciations(spark, sf_dir))
    return counted.join(_pronunciations(spark, sf_dir).select("word").distinct(), "word", "left_semi").select("word", "n", "n_syllables")


@query()
def syllables_per_word(spark, sf_dir):
    """Mean syllables of a conversation's words, by the dictionary or by sonority."""
    counted = grammar.syllable_counts(_talk_words(spark, sf_dir), _pronunciations(spark, sf_dir))
    return counted.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_words"), r6(F.avg("n_syllables")).alias("mean_syllables"))


def _tag_weights(spark, sf_dir):
    """Weights out of how often the rule tagger gives a tag after a tag, for a word and for an
    ending in the documents: logarithms of counts."""
    words = grammar.word_tokens(F.lower("text"))
    d = table(spark, sf_dir, "documents")
    # A word's tag does not depend on its place, so words and endings are tagged once each.
    w = d.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("tag", grammar.rule_tag(F.col("w")))
    follow = d.select(words.alias("w")).select(F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x")).where("x.b is not null")
    links = follow.select(grammar.rule_tag(F.col("x.a")).alias("last"), grammar.rule_tag(F.col("x.b")).alias("tag"), F.lit(1).alias("n"))
    named = lambda name, c: F.concat(F.lit(name + " "), c)
    count = lambda df, feature: df.groupBy(feature.alias("feature"), "tag").agg(F.log1p(F.sum("n")).alias("weight"))
    return count(w, named("i word", F.col("w"))).unionByName(count(w, named("i suffix", F.substring("w", -3, 3)))).unionByName(count(links, named("i-1 tag", F.col("last"))))


@query()
def tags_by_weights(spark, sf_dir):
    """How often each tag follows each other one in the conversations, tagged by weights that
    the documents give."""
    inputs.start(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", grammar.word_tokens(F.lower("text")).alias("tokens"))
    tagged = grammar.tag_by_weights(c, ["conv_id", "turn"], _tag_weights(spark, sf_dir))
    pairs = tagged.select(F.explode(F.zip_with(F.col("tagged.t"), F.slice("tagged.t", F.lit(2), F.size("tagged")), lambda a, b: F.struct(a.alias("tag"), b.alias("next")))).alias("x"))
    return pairs.where("x.next is not null").groupBy("x.tag", "x.next").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT conv_id AS pID, turn AS utt_pos, role, text, lag(role) OVER w AS r, lag(text) OVER w AS t, row_number() OVER w AS rn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT pID, utt_pos, CAST(sum(CASE WHEN rn = 1 OR role IS DISTINCT FROM r OR text IS DISTINCT FROM t THEN 1 ELSE 0 END) OVER (PARTITION BY pID ORDER BY utt_pos) AS BIGINT) AS uttID FROM c""")
def utterance_ids(spark, sf_dir):
    u = inputs.utterances(spark, sf_dir)
    return utterances.number_utterances(u, ["pID"], "utt_pos", ["full_text", "speaker"]).select("pID", "utt_pos", "uttID")


@query("""SELECT conv_id AS pID, role AS speaker, string_agg(text, ' ' ORDER BY turn, text) AS full_text FROM conversations GROUP BY 1, 2""")
def utterance_concat(spark, sf_dir):
    return utterances.join_words(inputs.utterances(spark, sf_dir), ["pID", "speaker"], "utt_pos", "full_text")


@query("""SELECT pID, uttID, utt_pos FROM (SELECT conv_id AS pID, role AS uttID, turn AS utt_pos, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn = 1 AND text IS NOT NULL AND len(string_split(text, ' ')) > 1""")
def last_utterances(spark, sf_dir):
    last = utterances.last_of(inputs.utterances(spark, sf_dir), ["pID", "speaker"], "utt_pos")
    return utterances.keep_long(last, "full_text").select("pID", F.col("speaker").alias("uttID"), "utt_pos")


TIMES_SQL = """
ev AS (SELECT user_id AS pID, event_id AS pos, event_type AS speaker, epoch_us(ts) / 1e6 AS s, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events)
"""


def _intervals(spark, sf_dir):
    from pyspark.sql import Window

    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    nxt = F.lead(sec).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pID"), F.col("event_id").alias("pos"), F.col("event_type").alias("speaker"), sec.alias("s"), nxt.alias("e"))


@query(f"""WITH {TIMES_SQL}, x AS (SELECT pID, speaker, pos, CASE WHEN pos % 3 = 0 THEN s END AS s, CASE WHEN pos % 3 = 1 THEN e END AS e FROM ev),
w AS (SELECT *, row_number() OVER (PARTITION BY pID, speaker ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY pID, speaker) AS n, min(s) OVER (PARTITION BY pID, speaker) AS a, max(e) OVER (PARTITION BY pID, speaker) AS b FROM x)
SELECT pID, speaker, pos, round(CASE WHEN b > a THEN coalesce(s, a + (b - a) / n * i) ELSE s END, 3) AS s, round(CASE WHEN b > a THEN coalesce(e, a + (b - a) / n * (i + 1)) ELSE e END, 3) AS e FROM w""")
def fill_times(spark, sf_dir):
    x = _intervals(spark, sf_dir).select("pID", "speaker", "pos", F.when(F.col("pos") % 3 == 0, F.col("s")).alias("s"), F.when(F.col("pos") % 3 == 1, F.col("e")).alias("e"))
    return utterances.fill_times(x, ["pID", "speaker"], "pos").select("pID", "speaker", "pos", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


@query(f"""WITH {TIMES_SQL}, q AS (SELECT pID, pos AS q, s, e FROM ev WHERE speaker = 'view'), r AS (SELECT * FROM ev WHERE speaker <> 'view' AND s IS NOT NULL AND e IS NOT NULL AND e >= s),
m AS (SELECT q.pID, q.q, r.speaker, r.pos, greatest(0.0, least(q.e, r.e) - greatest(q.s, r.s)) AS o, abs((q.s + q.e) / 2 - (r.s + r.e) / 2) AS d FROM q JOIN r ON q.pID = r.pID WHERE q.e >= q.s),
b AS (SELECT *, row_number() OVER (PARTITION BY pID, q ORDER BY o DESC, CASE WHEN o = 0 THEN d ELSE 0 END, pos) AS rn FROM m)
SELECT q.pID, q.q, b.speaker AS speaker_true FROM q LEFT JOIN b ON q.pID = b.pID AND q.q = b.q AND b.rn = 1""")
def speaker_by_time(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    q = iv.where("speaker = 'view'").select("pID", F.col("pos").alias("q"), "s", "e")
    return utterances.speaker_by_time(q, iv.where("speaker <> 'view'"), ["pID"]).select("pID", "q", "speaker_true")


@query()
def label_speakers(spark, sf_dir):
    inputs.start(spark)
    u = inputs.utterances(spark, sf_dir)
    words = u.select("pID", "speaker", F.posexplode(F.split("full_text", " ")).alias("i", "word"), "utt_pos")
    words = words.select("pID", (F.col("utt_pos") * inputs.TURNS + F.col("i")).alias("pos"), "word", "speaker")
    timed = words.withColumns({"s": F.col("pos").cast("double"), "e": F.col("pos") + 0.9})
    heard = timed.where("pos % 7 <> 3").drop("speaker").withColumn("word", F.when(F.col("pos") % 5 == 1, F.reverse("word")).otherwise(F.col("word")))
    return alignment.label_speakers(timed, heard, ["pID"])


GRAM_SQL = r"""
tok AS (SELECT d.doc_id AS pID, CASE WHEN quality = 1 THEN 'Control' ELSE 'ProbableAD' END AS dx, list_concat(['<START>', '<START>'], regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ['<STOP>', '<STOP>']) AS w
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
flat AS (SELECT pID, dx, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM tok),
lead_ AS (SELECT pID, dx, t, lead(t) OVER v AS t2, lead(t, 2) OVER v AS t3 FROM flat WINDOW v AS (PARTITION BY pID ORDER BY i)),
gram AS (SELECT pID, dx, t || ' ' || t2 AS ctx, t3 AS nxt FROM lead_ WHERE t3 IS NOT NULL)
"""


def _grams(spark, sf_dir, several=False):
    """Rows of n-grams; for ``several`` passes over them the labelled texts are written once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    d = stored(d, "labelled-texts") if several else d
    dx = F.when(F.col("quality") == 1, "Control").otherwise("ProbableAD").alias("dx")
    tokens = d.select(F.col("doc_id").alias("pID"), dx, F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tokens"))
    return language_model.ngram_rows(tokens, ["pID", "dx"])


@query(f"WITH {GRAM_SQL} SELECT dx, ctx, nxt, count(*) AS cnt FROM gram GROUP BY 1, 2, 3")
def ngram_lm(spark, sf_dir):
    return language_model.counts(_grams(spark, sf_dir), ["dx"])[0]


@query(f"WITH {GRAM_SQL} SELECT dx, ctx, count(*) AS total FROM gram GROUP BY 1, 2")
def lm_context_totals(spark, sf_dir):
    return language_model.counts(_grams(spark, sf_dir), ["dx"])[1]


#: Part-of-speech tags and stop words.
VOCABULARY = len(text.PENN_TAGS) + len(text.STOP_WORDS)


def _ppl_sql(loo: bool, gram_sql: str = GRAM_SQL) -> str:
    def one(name: str, dx: str) -> str:
        own = f" - CASE WHEN o.dx = '{dx}' THEN {{}} ELSE 0 END" if loo else ""
        c = "coalesce(m.cnt, 0)" + own.format("o.own")
        t = "coalesce(t.total, 0)" + own.format("o.own_total")
        return f"{name} AS (SELECT o.pID, exp(-sum(ln(({c} + 10.0) / ({t} + {VOCABULARY} * 10.0)) * o.own) / sum(o.own)) AS p FROM o LEFT JOIN m ON m.dx = '{dx}' AND m.ctx = o.ctx AND m.nxt = o.nxt LEFT JOIN t ON t.dx = '{dx}' AND t.ctx = o.ctx GROUP BY o.pID)"

    return f"""WITH {gram_sql}, o1 AS (SELECT pID, dx, ctx, nxt, count(*) AS own FROM gram GROUP BY 1, 2, 3, 4), o AS (SELECT *, sum(own) OVER (PARTITION BY pID, ctx) AS own_total FROM o1),
m AS (SELECT dx, ctx, nxt, sum(own) AS cnt FROM o1 GROUP BY 1, 2, 3), t AS (SELECT dx, ctx, sum(own) AS total FROM o1 GROUP BY 1, 2), {one('a', 'ProbableAD')}, {one('b', 'Control')}
SELECT a.pID, round(a.p, 4) + 0 AS ppl_ad, round(b.p, 4) + 0 AS ppl_cn, round(b.p - a.p, 4) + 0 AS P_diff FROM a JOIN b ON a.pID = b.pID"""


def _ppl(spark, sf_dir, loo, read=_grams):
    p = language_model.perplexity(read(spark, sf_dir, True), ["pID"], None, ("ProbableAD", "Control"), VOCABULARY, leave_one_out=loo)
    r4 = lambda c: F.round(c, 4) + 0.0
    return p.select("pID", r4(F.col("ppl_a")).alias("ppl_ad"), r4(F.col("ppl_b")).alias("ppl_cn"), r4(F.col("P_diff")).alias("P_diff"))


@query(_ppl_sql(False))
def perplexity_diff(spark, sf_dir):
    return _ppl(spark, sf_dir, False)


@query(_ppl_sql(True))
def perplexity_diff_loo(spark, sf_dir):
    return _ppl(spark, sf_dir, True)


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: The same over tags: cleaned user utterances of three words or more, every word but stop
#: words as its tag, padded one by one.
TAG_GRAM_SQL = rf"""
said AS (SELECT conv_id AS pID, turn, CASE WHEN conv_id % 2 = 1 THEN 'ProbableAD' ELSE 'Control' END AS dx,
         list_transform(string_split(trim(text), ' '), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}_]', '', 'g')) AS w
         FROM conversations WHERE lower(role) = 'user' AND text IS NOT NULL AND len(string_split(trim(text), ' ')) >= 3),
word AS (SELECT pID, turn, dx, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM said),
coded AS (SELECT pID, turn, dx, i, n, CASE WHEN w IN ({_quoted(text.STOP_WORDS)}) THEN w ELSE {grammar.rule_tag_sql('w')} END AS t FROM word
          UNION ALL SELECT pID, turn, dx, k, len(w), CASE WHEN k < 1 THEN '<START>' ELSE '<STOP>' END FROM said, unnest([-1, 0, len(w) + 1, len(w) + 2]) AS x(k)),
lead_ AS (SELECT pID, dx, t, lead(t) OVER v AS t2, lead(t, 2) OVER v AS t3 FROM coded WINDOW v AS (PARTITION BY pID, turn ORDER BY i)),
gram AS (SELECT pID, dx, t || ' ' || t2 AS ctx, t3 AS nxt FROM lead_ WHERE t3 IS NOT NULL)
"""


def _tag_grams(spark, sf_dir, several=False):
    u = inputs.utterances(spark, sf_dir).where((F.lower("speaker") == "user") & F.col("full_text").isNotNull() & (text.word_count(F.trim("full_text")) >= 3))
    words = F.split(text.clean_utterance(F.col("full_text")), " ")
    dx = F.when(F.col("pID") % 2 == 1, "ProbableAD").otherwise("Control").alias("dx")
    return language_model.ngram_rows(u.select("pID", dx, grammar.recode(words).alias("tokens")), ["pID", "dx"])


@query(f"WITH {TAG_GRAM_SQL} SELECT dx, ctx, nxt, count(*) AS cnt FROM gram GROUP BY 1, 2, 3")
def ngram_lm_tags(spark, sf_dir):
    return language_model.counts(_tag_grams(spark, sf_dir), ["dx"])[0]


@query(f"WITH {TAG_GRAM_SQL}, n AS (SELECT pID, count(*) AS n FROM gram GROUP BY 1) SELECT count(*) AS units, CAST(sum(n) AS BIGINT) AS ngrams, min(n) AS least, max(n) AS most, round(avg(n), 6) + 0 AS mean FROM n")
def ngram_size_log(spark, sf_dir):
    return language_model.size_log(_tag_grams(spark, sf_dir), "pID").withColumn("mean", r6(F.col("mean")))


@query(_ppl_sql(False, TAG_GRAM_SQL))
def perplexity_diff_tags(spark, sf_dir):
    return _ppl(spark, sf_dir, False, _tag_grams)


@query(_ppl_sql(True, TAG_GRAM_SQL))
def perplexity_diff_tags_loo(spark, sf_dir):
    return _ppl(spark, sf_dir, True, _tag_grams)


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_pos FROM l)
SELECT doc_id, CAST(line_pos AS BIGINT) AS line_pos, CAST(length(trim(regexp_replace(line, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS n_chars FROM x WHERE length(trim(regexp_replace(line, '^\s+|\s+$', '', 'g'))) >= 2""")
def utterance_lines(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_pos", "line")).where(text.long_enough(F.col("line")))
    return x.select("doc_id", F.col("line_pos").cast("long").alias("line_pos"), F.length(F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).cast("long").alias("n_chars"))


@query(f"""WITH u AS (SELECT conv_id AS pID, turn AS utt_pos, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*|[^\\s\\p{{L}}\\p{{N}}]') AS tok FROM conversations WHERE lower(role) = 'user' AND length(trim(text)) > 1),
x AS (SELECT pID, utt_pos, unnest(tok) AS w FROM u), g AS (SELECT pID, utt_pos, lower(w) AS lw, {grammar.rule_tag_sql('w')} AS t, regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AS is_word FROM x)
SELECT pID, utt_pos, round(sum(CASE WHEN t IN {"(" + ", ".join(f"'{t}'" for t in grammar.NOUN_TAGS) + ")"} THEN 1 ELSE 0 END) / sum(is_word::INT)::DOUBLE, 6) + 0 AS noun_ratio,
round(count(DISTINCT CASE WHEN is_word THEN lw END) / sum(is_word::INT)::DOUBLE, 6) + 0 AS unique_words FROM g GROUP BY 1, 2 HAVING sum(is_word::INT) > 0""")
def utterance_features(spark, sf_dir):
    u = inputs.utterances(spark, sf_dir).where((F.lower("speaker") == "user") & (F.length(F.trim("full_text")) > 1))
    f = grammar.features(u.select("pID", "utt_pos", grammar.tagged(grammar.word_tokens(F.col("full_text"))).alias("tagged")), ["pID", "utt_pos"])
    return f.select("pID", "utt_pos", r6(F.col("noun_ratio")).alias("noun_ratio"), r6(F.col("unique_words")).alias("unique_words"))


@query(f"WITH {GRAM_SQL}, k AS (SELECT DISTINCT ctx FROM gram WHERE dx = 'Control') SELECT dx, count(k.ctx) AS seen, count(*) - count(k.ctx) AS unseen FROM gram LEFT JOIN k ON k.ctx = gram.ctx GROUP BY dx")
def seen_contexts(spark, sf_dir):
    all_ = _grams(spark, sf_dir)
    return language_model.seen_contexts(all_, language_model.counts(all_.where("dx = 'Control'"), [])[1], ["dx"])


def _tagged(spark, sf_dir):
    u = inputs.utterances(spark, sf_dir).where("speaker = 'user'")
    return u.select((F.col("pID") * inputs.TURNS + F.col("utt_pos")).alias("pID"), grammar.tagged(grammar.word_tokens(F.col("full_text"))).alias("tagged"))


_IN = lambda tags: "(" + ", ".join(f"'{t}'" for t in tags) + ")"
TAG_SQL = rf"""
u AS (SELECT conv_id * 4294967296 + turn AS pID, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)*|[^\s\p{{L}}\p{{N}}]') AS tok FROM conversations WHERE role = 'user'),
x AS (SELECT pID, unnest(tok) AS w, generate_subscripts(tok, 1) AS i FROM u),
g AS (SELECT pID, i, w, lower(w) AS lw, {grammar.rule_tag_sql('w')} AS t FROM x),
words AS (SELECT pID, lw, row_number() OVER (PARTITION BY pID ORDER BY i) AS i, count(*) OVER (PARTITION BY pID) AS n FROM g WHERE regexp_matches(w, '[\p{{L}}\p{{N}}]')),
size_ AS (SELECT pID, count(*) AS n FROM words GROUP BY pID)
"""


@query(f"""WITH {TAG_SQL}, c AS (SELECT pID, lw, count(*) AS k FROM words GROUP BY 1, 2), v AS (SELECT pID, count(*)::DOUBLE AS v, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END)::DOUBLE AS once FROM c GROUP BY pID),
l AS (SELECT pID, avg(length(lw)) AS len FROM words GROUP BY pID),
win AS (SELECT a.pID, a.i, count(DISTINCT b.lw) AS types FROM words a JOIN words b ON a.pID = b.pID AND b.i BETWEEN a.i AND a.i + 19 WHERE a.n > 20 AND a.i <= a.n - 20 GROUP BY 1, 2),
m AS (SELECT pID, sum(types)::DOUBLE / (20::DOUBLE * count(*)) AS mattr FROM win GROUP BY pID)
SELECT s.pID, round(len, 6) + 0 AS avg_word_length, round(v / n, 6) + 0 AS type_token_ratio, round(coalesce(mattr, n / v), 6) + 0 AS mattr,
round(CASE WHEN once = v THEN 100 * ln(n) ELSE 100 * ln(n) / (1 - once / v) END, 4) + 0 AS honores_statistic, round(pow(n, pow(v, -0.165)), 6) + 0 AS brunets_index
FROM size_ s JOIN v ON s.pID = v.pID JOIN l ON s.pID = l.pID LEFT JOIN m ON s.pID = m.pID""")
def grammar_lexical(spark, sf_dir):
    f = grammar.features(_tagged(spark, sf_dir), ["pID"])
    return f.select("pID", r6(F.col("avg_word_length")).alias("avg_word_length"), r6(F.col("type_token_ratio")).alias("type_token_ratio"), r6(F.col("mattr")).alias("mattr"), (F.round("honores_statistic", 4) + 0.0).alias("honores_statistic"), r6(F.col("brunets_index")).alias("brunets_index"))


@query(f"""WITH {TAG_SQL}, r AS (SELECT a.pID, a.i, min(b.i - a.i) AS d FROM words a JOIN words b ON a.pID = b.pID AND a.lw = b.lw AND b.i > a.i AND b.i <= a.i + 5 GROUP BY 1, 2)
SELECT s.pID, CAST(count(CASE WHEN d <= 1 THEN 1 END) AS DOUBLE) AS immediate_reps, CAST(count(CASE WHEN d <= 3 THEN 1 END) AS DOUBLE) AS nearby_reps_k3, CAST(count(d) AS DOUBLE) AS nearby_reps_k5
FROM size_ s LEFT JOIN r ON s.pID = r.pID GROUP BY s.pID""")
def grammar_reps(spark, sf_dir):
    return grammar.features(_tagged(spark, sf_dir), ["pID"]).select("pID", "immediate_reps", "nearby_reps_k3", "nearby_reps_k5")


def _pos_sql() -> str:
    share = lambda cond, name: f"round(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) / any_value(n)::DOUBLE, 6) + 0 AS {name}"
    verb, noun, adj, adv = (f"t IN {_IN(x)}" for x in (grammar.VERB_TAGS, grammar.NOUN_TAGS, grammar.ADJ_TAGS, grammar.ADV_TAGS))
    sub = f"lw IN {_IN(grammar.SUBORDINATING)}"
    count = lambda cond: f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)::DOUBLE"
    return f"""WITH {TAG_SQL},
near AS (SELECT pID, i, max(CASE WHEN {noun} THEN 1 ELSE 0 END) OVER (PARTITION BY pID ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, lead(t) OVER v AS t2, lead(t, 2) OVER v AS t3 FROM g WINDOW v AS (PARTITION BY pID ORDER BY i)),
j AS (SELECT g.*, near.near, t2, t3, n FROM g JOIN near USING (pID, i) JOIN size_ USING (pID))
SELECT pID, {share(noun, 'noun_ratio')}, {share(verb, 'verb_ratio')}, {share(adj, 'adj_ratio')}, {share(adv, 'adv_ratio')}, {share("t = 'CC'", 'coord_markers')}, {share(sub, 'subord_markers')},
{share("t IN ('VBG', 'VBN')", 'reduced_verbs')}, {share(f't IN {_IN(grammar.FUNCTION_TAGS)}', 'function_words')}, {share(verb + ' AND near = 1', 'num_predicates_approx')},
{share(f't IN {_IN(grammar.PRONOUN_TAGS)}', 'pronoun_ratio')}, {share(f't IN {_IN(grammar.PRONOUN_TAGS)} AND lw IN {_IN(grammar.PERSONAL)}', 'personal_pronoun_ratio')},
{share(f't IN {_IN(grammar.DETERMINER_TAGS)}', 'determiner_ratio')}, {share(f't IN {_IN(grammar.PREP_TAGS)}', 'preposition_ratio')}, {share("t = 'VBG'", 'verb_present_participle_ratio')}, {share("t = 'MD'", 'verb_modal_ratio')}, {share("t = 'VBZ'", 'verb_third_person_sing_ratio')},
CAST(count(DISTINCT CASE WHEN t2 IS NOT NULL THEN t || ' ' || t2 END) + count(DISTINCT CASE WHEN t3 IS NOT NULL THEN t || ' ' || t2 || ' ' || t3 END) AS DOUBLE) AS pos_pattern_variety,
round(coalesce((count(DISTINCT CASE WHEN t2 IS NOT NULL THEN t || ' ' || t2 END) + count(DISTINCT CASE WHEN t3 IS NOT NULL THEN t || ' ' || t2 || ' ' || t3 END)) / nullif(count(t2) + count(t3), 0), 0), 6) + 0 AS pos_pattern_density,
round(({count(verb)} + {count(adj)} + {count(adv)} + {count(f't IN {_IN(grammar.PREP_TAGS)}')} + {count("t = 'CC'")} + {count(sub)}) / any_value(n), 6) + 0 AS propositional_density,
round(({count(noun)} + {count(verb)} + {count(adj)} + {count(adv)}) / any_value(n), 6) + 0 AS content_density,
round(coalesce({count(noun)} / nullif({count(verb)}, 0), 0), 6) + 0 AS noun_verb_ratio, round(coalesce({count(adj)} / nullif({count(noun)}, 0), 0), 6) + 0 AS adj_noun_ratio
FROM j GROUP BY pID"""


POS_COLUMNS = (
    "noun_ratio verb_ratio adj_ratio adv_ratio coord_markers subord_markers reduced_verbs function_words num_predicates_approx pronoun_ratio personal_pronoun_ratio "
    "determiner_ratio preposition_ratio verb_present_participle_ratio verb_modal_ratio verb_third_person_sing_ratio pos_pattern_variety pos_pattern_density "
    "propositional_density content_density noun_verb_ratio adj_noun_ratio"
).split()


@query(_pos_sql())
def grammar_pos(spark, sf_dir):
    f = grammar.features(_tagged(spark, sf_dir), ["pID"])
    return f.select("pID", *(r6(F.col(c)).alias(c) for c in POS_COLUMNS))


@query(f"""WITH {TAG_SQL}, y AS (SELECT pID, sum(greatest(1, len(regexp_extract_all(lw, '[aeiouy]+'))))::DOUBLE AS b FROM words GROUP BY pID)
SELECT s.pID, CAST(n AS DOUBLE) AS avg_sentence_length, round(b / n, 6) + 0 AS avg_word_syllables, round(0.39::DOUBLE * n + 11.8::DOUBLE * b / n, 4) + 0 AS flesch_kincaid_grade_level, round(206.835::DOUBLE - 1.015::DOUBLE * n - 84.6::DOUBLE * b / n, 4) + 0 AS flesch_kincaid_reading_ease
FROM size_ s JOIN y ON s.pID = y.pID""")
def grammar_syllables(spark, sf_dir):
    f = grammar.features(_tagged(spark, sf_dir), ["pID"])
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return f.select("pID", "avg_sentence_length", r6(F.col("avg_word_syllables")).alias("avg_word_syllables"), r4("flesch_kincaid_grade_level"), r4("flesch_kincaid_reading_ease"))


@query(f"SELECT * FROM ({ORACLES['grammar_pos']}) JOIN ({ORACLES['grammar_lexical']}) USING (pID) JOIN ({ORACLES['grammar_reps']}) USING (pID) JOIN ({ORACLES['grammar_syllables']}) USING (pID)")
def grammar_all(spark, sf_dir):
    """The features of every utterance in one row, computed together."""
    f = grammar.features(_tagged(spark, sf_dir), ["pID"])
    fours = {"honores_statistic", "flesch_kincaid_grade_level", "flesch_kincaid_reading_ease"}
    names = [*POS_COLUMNS, "avg_word_length", "type_token_ratio", "mattr", "honores_statistic", "brunets_index", "immediate_reps", "nearby_reps_k3", "nearby_reps_k5", "avg_sentence_length", "avg_word_syllables", "flesch_kincaid_grade_level", "flesch_kincaid_reading_ease"]
    return f.select("pID", *((F.round(c, 4) + 0.0 if c in fours else r6(F.col(c))).alias(c) for c in names))


@query()
def grammar_of_sources(spark, sf_dir):
    """From texts to all features: cleaned, cut into Treebank words, contractions written out,
    tagged, for every utterance of more than one word."""
    u = utterances.keep_long(inputs.utterances(spark, sf_dir), "full_text")
    closed = text.close_sentence(F.col("full_text"))
    words = text.expand_contractions(text.treebank_tokens(text.normalize_text(closed)))
    return grammar.features(u.select("pID", "utt_pos", "speaker", grammar.tagged(words).alias("tagged")), ["pID", "utt_pos", "speaker"])


_STOP_SQL = ", ".join("'{}'".format(w.replace("'", "''")) for w in text.STOP_WORDS)


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_\\s]+', '', 'g')), '\\s+'), lambda x: x <> '') AS t FROM conversations)
SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_filter(t, lambda x: x NOT IN ({_STOP_SQL}))) AS INTEGER) AS n_content FROM t""")
def content_tokens(spark, sf_dir):
    """Tokens of a turn, with and without stop words."""
    stop = F.array(*map(F.lit, text.STOP_WORDS))
    x = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.coherence_tokens(x)).alias("n_tokens"), F.size(text.coherence_tokens(x, stop)).alias("n_content"))


def _r_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT srcID, len(ref)::DOUBLE AS score, len(hyp)::DOUBLE AS n_words, len(array_to_string(hyp, ''))::DOUBLE / nullif(len(hyp), 0) AS word_length, len(list_distinct(hyp))::DOUBLE / nullif(len(hyp), 0) AS types FROM pairs),
l AS (UNPIVOT f ON n_words, word_length, types INTO NAME metric VALUE v),
o AS (SELECT srcID, row_number() OVER (ORDER BY avg(wer), srcID) AS place FROM wer GROUP BY srcID)
SELECT o.place, l.srcID, metric, count(*) AS n, round({_r_sql('v', 'score')}, 6) + 0 AS r FROM l JOIN o ON l.srcID = o.srcID WHERE v IS NOT NULL GROUP BY o.place, l.srcID, metric HAVING count(*) > 2 ORDER BY o.place, metric""")
def heatmap_rows(spark, sf_dir):
    """Signed correlations of every measure with a turn's true length, for sources in the
    order of their word error rate; only measures known for more than two turns."""
    pairs = inputs.hypotheses(inputs.references(spark, sf_dir))
    size = F.size("hyp").cast("double")
    per = lambda x: F.when(size > 0, x.cast("double") / size)
    f = pairs.select("srcID", F.size("ref").cast("double").alias("score"), size.alias("n_words"), per(F.length(F.array_join("hyp", ""))).alias("word_length"), per(F.size(F.array_distinct("hyp"))).alias("types"))
    long = statistics.long_form(f, ["srcID", "score"], ["n_words", "word_length", "types"], "metric", "v").where("v is not null")
    r = long.groupBy("srcID", "metric").agg(F.count(F.lit(1)).alias("n"), r6(safe_corr(F.col("v"), F.col("score"))).alias("r")).where("n > 2")
    order = relational.order_by_mean(_wer(spark, sf_dir), "srcID", "wer").select("srcID", F.col("place").cast("long").alias("place"))
    return order.join(r, "srcID").select("place", "srcID", "metric", "n", "r").orderBy("place", "metric")


@query()
def coherence_scores(spark, sf_dir):
    inputs.start(spark)
    u = inputs.utterances(spark, sf_dir).where("speaker = 'user'")
    tokens = u.select("pID", "utt_pos", F.posexplode(text.coherence_tokens(F.col("full_text"))).alias("i", "token"))
    tokens = tokens.select("pID", (F.col("utt_pos") * inputs.TURNS + F.col("i")).alias("pos"), "token")
    seen = tokens.groupBy("token").agg(F.countDistinct("pID").cast("double").alias("entropy"))
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.max("vec_id").alias("m")).withColumn("k", F.lit(1))
    hashed = seen.withColumn("k", F.lit(1)).join(F.broadcast(n), "k").withColumn("vec_id", F.pmod(F.crc32(F.col("token").cast("binary")), F.col("m") + 1))
    vocab = hashed.join(vectors, "vec_id").select("token", F.xxhash64("token").alias("id"), F.col("embedding").alias("vec"), F.ln("entropy").alias("entropy"))
    return coherence.coherence(tokens, vocab.withColumn("id", F.abs("id")), ["pID"], coherence.Coherence(least_tokens=5, aggregation="trimmed"))


@query()
def error_profile(spark, sf_dir):
    inputs.start(spark)
    t = synthesis.profile_tables(inputs.hypotheses(inputs.references(spark, sf_dir)).where("src_rank > 0"), pairing="all")
    return t["ops"].select(F.lit("op").alias("kind"), F.col("op").alias("a"), F.lit("").alias("b"), "n").unionByName(
        t["subs"].select(F.lit("sub").alias("kind"), F.col("ref").alias("a"), F.col("hyp").alias("b"), "n")
    ).unionByName(t["dels"].select(F.lit("del").alias("kind"), F.col("ref").alias("a"), F.lit("").alias("b"), "n")).unionByName(
        t["ins"].select(F.lit("ins").alias("kind"), F.lit("").alias("a"), F.col("hyp").alias("b"), "n")
    ).unionByName(t["dropout"].select(F.lit("dropout").alias("kind"), F.col("length").cast("string").alias("a"), F.lit("").alias("b"), "n"))


@query()
def synthetic_transcripts(spark, sf_dir):
    inputs.start(spark)
    refs = inputs.references(spark, sf_dir)
    profile = synthesis.profile_tables(inputs.hypotheses(refs).where("src_rank > 0"))
    return synthesis.synthesise(refs.select("pID", F.col("ref").alias("tokens")), profile)


@query()
def synthetic_wer(spark, sf_dir):
    s = synthetic_transcripts(spark, sf_dir)
    placed = statistics.positions(s, ["target"], "wer")
    middle = statistics.quantiles_of(placed, ["target"], "wer", [0.5]).select("target", r6(F.col("q")[0]).alias("median_wer"))
    return placed.groupBy("target").agg(F.sum("n").alias("n"), r6(F.sum(F.col("n") * F.col("wer")) / F.sum("n")).alias("mean_wer")).join(middle, "target")
