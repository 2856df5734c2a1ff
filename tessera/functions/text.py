"""Text rules as Column -> Column expressions, without a Python UDF on any path.

Word classes are written with explicit Unicode categories, since the JVM's ``\\w`` is
ASCII-only.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"

#: What each contraction token stands for.
CONTRACTIONS = {
    "n't": "not", "'re": "are", "'ve": "have", "'s": "is", "'ll": "will",
    "'d": "would", "'m": "am", "wo": "will", "ca": "can", "sha": "shall",
}
#: Literal replacements of sentence cleaning, in order.
SENTENCE_STEPS = (
    ("_", " "), ("-", " "),
    ("….", ". "), ("…", ", "), ("...", ". "), ("..", ". "),
    ("….", ". "), ("…", ", "), ("...", ". "), ("..", ". "),
    ("hafta", "have to"), ("over flowing", "overflowing"), (" ok ", " okay "), (" ok,", " okay,"),
    ("'s", " is"),
)
#: The English stop words that keep their form among part-of-speech tags.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn",
    "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't",
    "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
)
#: The Penn Treebank word tags.
PENN_TAGS = (
    "CC", "CD", "DT", "EX", "FW", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NN", "NNS", "NNP", "NNPS", "PDT", "POS", "PRP", "PRP$", "RB", "RBR", "RBS",
    "RP", "SYM", "TO", "UH", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "WDT", "WP", "WP$", "WRB",
)
#: All that ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: The Penn Treebank's rules for words, in order (pattern, replacement), for a
#: sentence in lower case with a blank on either side.
TREEBANK_RULES = (
    (r"^( *)\"", "$1`` "), (r"([ (\[{<])\"", "$1`` "),
    (r"([:,])([^0-9])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), (r"[;@#$%&]", " $0 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "), (r"[?!]", " $0 "), (r"([^'])' ", "$1 ' "),
    (r"[\]\[(){}<>]", " $0 "), (r"--", " -- "),
    (r"\"", " '' "), (r"(\S)('')", "$1 $2 "), (r"([^' ])('s|'m|'d|') ", "$1 $2 "), (r"([^' ])('ll|'re|'ve|n't) ", "$1 $2 "),
    (r"\b(can)(not)\b", " $1 $2 "), (r"\b(d)('ye)\b", " $1 $2 "), (r"\b(gim)(me)\b", " $1 $2 "), (r"\b(gon)(na)\b", " $1 $2 "),
    (r"\b(got)(ta)\b", " $1 $2 "), (r"\b(lem)(me)\b", " $1 $2 "), (r"\b(more)('n)\b", " $1 $2 "), (r"\b(wan)(na)(?=\s)", " $1 $2 "),
    (r" ('t)(is)\b", " $1 $2 "), (r" ('t)(was)\b", " $1 $2 "),
)
#: Typographic characters and their plain forms.
TYPOGRAPHIC = ("’‘“”–— ", "''\"\"-- ")
def normalize(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9']+", " "))


def tokenize(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?i)[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def segment(x: Column, mode: str = "newline") -> Column:
    """Trimmed non-empty segments; mode newline, paragraph or none."""
    if mode == "none":
        return F.array(x)
    if mode not in ("newline", "paragraph"):
        raise ValueError(f"unknown segment mode: {mode}")
    pieces = F.split(x, LINE_END if mode == "newline" else r"\n\s*\n")
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


@lru_cache
def plain_forms() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition (NFKD) has ASCII characters,
    by the Unicode database: those that have one of them and that one, and the others with
    all of theirs."""
    ones, plain, several = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        kept = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c < "\x80") if not 0xD800 <= code < 0xE000 else ""
        if len(kept) == 1:
            ones.append(chr(code))
            plain.append(kept)
        elif kept:
            several[chr(code)] = kept
    return "".join(ones), "".join(plain), several


def _char_class(chars) -> str:
    """A regular expression class of single characters, as ranges of code points."""
    codes, runs = sorted(map(ord, chars)), []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def ascii_decomposed(x: Column) -> Column:
    """The ASCII characters of a text's compatibility decomposition. Characters that stand
    for several (ligatures, fractions, units) are replaced one kind after the other, only in
    texts that have any."""
    ones, plain, several = plain_forms()
    one = F.translate(x, ones, plain)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several.items()))
    every = F.aggregate(pairs, one, lambda t, p: F.replace(t, p["a"], p["b"]))
    full = F.when(one.rlike(_char_class(several)), every).otherwise(one)
    return F.regexp_replace(full, r"[^\x00-\x7F]", "")


def strip_unsupported(x: Column) -> Column:
    """Typographic characters mapped, all others decomposed and cut to ASCII, what is
    outside the supported set blanked, white space collapsed. Input is expected in lower case."""
    t = ascii_decomposed(F.translate(x, *TYPOGRAPHIC))
    t = F.regexp_replace(t, r"[^a-z0-9\s.?!,;:'\"-]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_text(x: Column) -> Column:
    return strip_unsupported(F.lower(x))


def expand_contractions(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in CONTRACTIONS.items() for v in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def clean_sentences(x: Column) -> Column:
    for old, new in SENTENCE_STEPS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def split_sentences(x: Column) -> Column:
    """Sentences with their closing mark, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def treebank_tokens(x: Column) -> Column:
    """Words and marks of a cleaned lower-case text by the Treebank's rules. A full stop is a
    token where a sentence ends: at the end and before white space."""

    def words(sentence: Column) -> Column:
        t = F.concat(F.lit(" "), F.trim(sentence), F.lit(" "))
        for pattern, to in TREEBANK_RULES:
            t = F.regexp_replace(t, pattern, to)
        return F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")

    sentences = F.split(F.trim(x), r"(?<=[.?!])\s+")
    return F.flatten(F.transform(sentences, words))


def clean_utterance(x: Column) -> Column:
    """Lower-cased words without other characters (may leave empty words)."""
    words = F.split(F.trim(x), " ")
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(F.lower(w), f"[^{WORD}]", "")), " ")


def long_enough(x: Column, least: int = 2) -> Column:
    """Whether a text has so many characters without outer white space."""
    return F.length(F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))) >= least


def word_count(x: Column) -> Column:
    """Pieces between single blanks; the empty string counts one."""
    return F.size(F.split(x, " "))


def drop_punctuation(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), rf"[^{WORD}\s]", "")


def coherence_tokens(x: Column, stop: Column | None = None) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), rf"[^{WORD}\s]+", ""))
    tokens = F.filter(F.split(clean, r"\s+"), lambda t: t != "")
    return tokens if stop is None else F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def norm_word(x: Column) -> Column:
    t = F.replace(F.trim(F.lower(F.coalesce(x, F.lit("")))), F.lit("`"), F.lit("'"))
    return F.regexp_replace(t, rf"^[^{WORD}]+|[^{WORD}]+$", "")


def close_sentence(x: Column) -> Column:
    """White space collapsed, a full stop added where no closing mark stands."""
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.substring(t, -1, 1).isin(".", "?", "!"), t).otherwise(F.concat(t, F.lit(".")))


def has_alnum(x: Column) -> Column:
    return x.rlike(r"[\p{L}\p{N}]")


def pad(tokens: Column, n: int, start: str = "<START>", stop: str = "<STOP>") -> Column:
    return F.concat(F.array_repeat(F.lit(start), n - 1), tokens, F.array_repeat(F.lit(stop), n - 1))


def ngrams(tokens: Column, n: int) -> Column:
    """Array of n-token arrays; empty below n tokens."""
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))
