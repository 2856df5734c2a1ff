"""Unit-cost sequence alignment and word error metrics.

The distance alone needs no UDF: the tokens of a pair are numbered within the pair,
written as one character each, and compared by the built-in ``levenshtein``. Error counts
come from a kernel that carries them along one row of the cost table, for many pairs at
once; operations from one that holds a column of the table in two integers, keeps every
sqrt(m)th column and works out the columns between again on the way back. Ties are broken
as match/substitution, then deletion, then insertion in all of them. Memory is a row a pair
for counts, and 2 sqrt(m) columns of bits for operations.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of tokens start at one block of characters and leave out the surrogates.
FIRST_CODE, SURROGATES, N_SURROGATES = 19968, 55296, 2048


def encoded_distance(ref: Column, hyp: Column) -> Column:
    """Substitutions + deletions + insertions between two token arrays (up to about a
    million distinct tokens a pair)."""
    both = F.array_distinct(F.concat(ref, hyp))

    def code(a: Column) -> Column:
        number = lambda t: F.lit(FIRST_CODE) + F.array_position(both, t).cast("int")
        return F.array_join(F.transform(a, lambda t: F.format_string("%c", F.when(number(t) < SURROGATES, number(t)).otherwise(number(t) + N_SURROGATES))), "")

    return F.levenshtein(code(ref), code(hyp))


def wer_from(errors: Column, ref_size: Column, hyp_size: Column) -> Column:
    """Errors by reference length; an empty reference gives 0 if nothing was inserted
    and 1 otherwise."""
    return F.when(ref_size > 0, errors.cast("double") / ref_size).when(hyp_size == 0, 0.0).otherwise(1.0)


HIT, SUB, DEL, INS = range(4)
OP_NAMES = ("hit", "sub", "del", "ins")


def align_codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Operations and the positions they use (-1: none), in order, of two arrays of token
    numbers; equal numbers match unless they are negative. A column of the cost table is two
    integers of a bit per token of ``a``: where it rises from the cell above, and where it equals
    the cell above and to the left."""
    a, b = a.tolist(), b.tolist()
    n, m = len(a), len(b)
    places: dict = {}
    for i, t in enumerate(a):
        if t >= 0:
            places[t] = places.get(t, 0) | 1 << i
    full, gap = (1 << n) - 1, max(1, isqrt(m))

    def columns(up: int, down: int, start: int, end: int):
        for t in b[start:end]:
            equal = places.get(t, 0)
            level = (((equal & up) + up) ^ up) | equal | down
            more, less = (down | ~(level | up)) & full, up & level
            more, less = more << 1 | 1, less << 1
            up, down = (less | ~(level | more)) & full, more & level & full
            yield up, down, level

    kept = [(full, 0)]
    for j, (up, down, _) in enumerate(columns(full, 0, 0, m), 1):
        if j % gap == 0:
            kept.append((up, down))
    kinds, at_ref, at_hyp = [], [], []
    i, j, low, some = n, m, m + 1, []
    while i or j:
        if j and j <= low:
            # The columns up to here, once more.
            low = (j - 1) // gap * gap
            some = list(columns(*kept[low // gap], low, j))
        up, _, level = some[j - low - 1] if j else (full, 0, full)
        bit = i - 1
        if i and j and (a[bit] == b[j - 1] >= 0 or not level >> bit & 1):
            i, j = bit, j - 1
            kinds.append(HIT if a[i] == b[j] >= 0 else SUB)
            at_ref.append(i)
            at_hyp.append(j)
        elif i and up >> bit & 1:
            i = bit
            kinds.append(DEL)
            at_ref.append(i)
            at_hyp.append(-1)
        else:
            j -= 1
            kinds.append(INS)
            at_ref.append(-1)
            at_hyp.append(j)
    return tuple(np.array(x[::-1], t) for x, t in ((kinds, np.int8), (at_ref, np.int32), (at_hyp, np.int32)))


def _numbered(ref: list, hyp: list, empty_matches: bool) -> tuple[np.ndarray, np.ndarray]:
    codes: dict = {}
    a = np.array([codes.setdefault(t, len(codes)) for t in ref], np.int64)
    b = np.array([codes.setdefault(t, len(codes)) for t in hyp], np.int64)
    if not empty_matches and "" in codes:
        a = np.where(a == codes[""], -1, a)
    return a, b


def align(ref: list, hyp: list, empty_matches: bool = True) -> list[tuple[str, int | None, int | None]]:
    """Operations (hit, sub, del, ins) with the positions they use, in order. With
    ``empty_matches`` off, empty tokens are never equal."""
    found = zip(*(x.tolist() for x in align_codes(*_numbered(ref, hyp, empty_matches))))
    return [(OP_NAMES[k], None if i < 0 else i, None if j < 0 else j) for k, i, j in found]


#: Cells of a row that pairs counted together have.
CELLS = 1 << 20


def error_counts(refs: list[np.ndarray], hyps: list[np.ndarray]) -> np.ndarray:
    """hits, subs, dels, ins of every pair of token numbers (rows), those that ``align_codes``
    finds. Pairs go together in the order of their length, a row of the table each."""
    out = np.zeros((len(refs), 4), np.int64)
    n, m = (np.array([len(x) for x in xs], np.int64) for xs in (refs, hyps))
    order, at = np.lexsort((-m, -n)), 0
    while at < len(order):
        some = order[at : at + max(1, CELLS // (int(m[order[at:]].max(initial=0)) + 1))]
        at += len(some)
        width = int(m[some].max(initial=0))
        a, b = np.full((len(some), int(n[some[0]])), -2, np.int64), np.full((len(some), width), -3, np.int64)
        for k, p in enumerate(some.tolist()):
            a[k, : n[p]], b[k, : m[p]] = refs[p], hyps[p]
        steps = np.arange(width + 1, dtype=np.int32)
        cost, subs = np.tile(steps, (len(some), 1)), np.zeros((len(some), width + 1), np.int32)
        ends = np.stack([m[some], np.zeros(len(some), np.int64)], axis=1)
        live = int((n[some] > 0).sum())
        for i in range(1, a.shape[1] + 1):
            # Shorter references end first; they stand last.
            live = int(np.searchsorted(-n[some], -i, "right"))
            old, wrong = cost[:live], b[:live] != a[:live, i - 1 : i]
            diagonal, above = old[:, :-1] + wrong, old[:, 1:] + 1
            best = np.concatenate([np.full((live, 1), i, np.int32), np.minimum(diagonal, above)], axis=1)
            new = np.minimum.accumulate(best - steps, axis=1) + steps
            straight = new[:, 1:] == diagonal
            from_left = ~straight & (new[:, 1:] != above)
            carried = np.concatenate([subs[:live, :1], np.where(straight, subs[:live, :-1] + wrong, subs[:live, 1:])], axis=1)
            source = np.concatenate([np.zeros((live, 1), np.int64), np.where(from_left, 0, np.arange(1, width + 1))], axis=1)
            subs[:live] = np.take_along_axis(carried, np.maximum.accumulate(source, axis=1), 1)
            cost[:live] = new
            done = np.flatnonzero(n[some[:live]] == i)
            ends[done] = np.stack([new[done, m[some[done]]], subs[done, m[some[done]]]], axis=1)
        # Substitutions + deletions + insertions, and how many of them are substitutions.
        total, swapped = ends.T
        gone = (total - swapped + n[some] - m[some]) // 2
        out[some] = np.stack([n[some] - swapped - gone, swapped, gone, total - swapped - gone], axis=1)
    return out


def distance(ref: list, hyp: list) -> int:
    """Substitutions + deletions + insertions alone, bit-parallel: one step of integer
    arithmetic per token of ``hyp`` over all of ``ref``."""
    if not ref or not hyp:
        return len(ref) + len(hyp)
    places: dict = {}
    for i, t in enumerate(ref):
        places[t] = places.get(t, 0) | 1 << i
    full, top = (1 << len(ref)) - 1, 1 << (len(ref) - 1)
    up, down, score = full, 0, len(ref)
    for t in hyp:
        equal = places.get(t, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        vertical = equal | down
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
    return score


def counts_of(ops: list[tuple]) -> dict[str, int]:
    kinds = [o[0] for o in ops]
    return {"hits": kinds.count("hit"), "subs": kinds.count("sub"), "dels": kinds.count("del"), "ins": kinds.count("ins")}


def _batch_codes(ref: pa.Array, hyp: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """The token numbers of every list of two list arrays, and the number of the empty
    token (-1: there is none)."""
    values = pa.concat_arrays([x.values.slice(x.offsets[0].as_py(), x.offsets[len(x)].as_py() - x.offsets[0].as_py()).cast(pa.string()) for x in (ref, hyp)])
    coded = values.dictionary_encode(null_encoding="encode")
    codes, out, start = coded.indices.to_numpy().astype(np.int64), [], 0
    for x in (ref, hyp):
        offs = x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py() + start
        out.append([codes[i:j] for i, j in zip(offs[:-1], offs[1:])])
        start = int(offs[-1])
    empty = coded.dictionary.index("").as_py()
    return out[0], out[1], empty


def _op_lists(found: list[tuple], fields: dict[str, pa.Array]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _joined(found: list[tuple], k: int, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(f[k] for f in found)])


def _placed(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int32(), mask=x < 0)


def _names(kinds: np.ndarray) -> pa.Array:
    return pa.array(OP_NAMES).take(pa.array(kinds.astype(np.int32)))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@F.arrow_udf(T.ArrayType(_struct(op=T.StringType(), ref_idx=T.IntegerType(), hyp_idx=T.IntegerType())))
def alignment_ops(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The operations of every pair; look tokens up by index."""
    refs, hyps, _ = _batch_codes(ref, hyp)
    found = [align_codes(a, b) for a, b in zip(refs, hyps)]
    return _op_lists(found, {"op": _names(_joined(found, 0, np.int8)), "ref_idx": _placed(_joined(found, 1, np.int32)), "hyp_idx": _placed(_joined(found, 2, np.int32))})


@F.arrow_udf(_struct(hits=T.IntegerType(), subs=T.IntegerType(), dels=T.IntegerType(), ins=T.IntegerType()))
def alignment_counts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The numbers of operations of every pair."""
    refs, hyps, _ = _batch_codes(ref, hyp)
    counts = error_counts(refs, hyps).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(counts[:, k]) for k in range(4)], ["hits", "subs", "dels", "ins"])


@F.arrow_udf(T.ArrayType(_struct(op=T.StringType(), ref_idx=T.IntegerType(), ref_pos=T.LongType(), pos=T.LongType())))
def word_ops(ref: pa.Array, ref_pos: pa.Array, hyp: pa.Array, hyp_pos: pa.Array) -> pa.Array:
    """As above for words, where empty words never match; with the words' positions, for
    all operations that have a word of ``hyp``."""
    refs, hyps, empty = _batch_codes(ref, hyp)
    found, places = [], []
    for k, (a, b) in enumerate(zip(refs, hyps)):
        kinds, i, j = align_codes(np.where(a == empty, -1, a) if empty >= 0 else a, b)
        kept = kinds != DEL
        kinds, i, j = kinds[kept], i[kept], j[kept]
        at, to = (p.values.slice(p.offsets[k].as_py(), p.offsets[k + 1].as_py() - p.offsets[k].as_py()).to_numpy() for p in (ref_pos, hyp_pos))
        found.append((kinds, i, np.where(i < 0, 0, at[i] if len(at) else 0), to[j]))
    i = _joined(found, 1, np.int32)
    return _op_lists(found, {
        "op": _names(_joined(found, 0, np.int8)), "ref_idx": _placed(i), "ref_pos": pa.array(_joined(found, 2, np.int64), pa.int64(), mask=i < 0), "pos": pa.array(_joined(found, 3, np.int64), pa.int64()),
    })


def wer_components(pairs: DataFrame) -> DataFrame:
    """WER, MER, WIL, WIP and the shares of each error for (srcID, pID, ref, hyp)
    token arrays."""
    counted = pairs.select("srcID", "pID", F.size("ref").alias("n"), F.size("hyp").alias("m"), alignment_counts("ref", "hyp").alias("c"))
    c = counted.select("srcID", "pID", "n", "m", "c.*")
    errors = F.col("subs") + F.col("dels") + F.col("ins")
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("n")), F.lit(0.0))
    wip = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n")) * F.try_divide(F.col("hits").cast("double"), F.col("m")), F.lit(0.0))
    return c.select(
        "srcID", "pID", "hits", "subs", "dels", "ins", wer_from(errors, F.col("n"), F.col("m")).alias("WER"),
        F.coalesce(F.try_divide(errors.cast("double"), F.col("hits") + errors), F.lit(0.0)).alias("MER"),
        wip.alias("WIP"), (1 - wip).alias("WIL"), share(F.col("subs")).alias("sub_r"), share(F.col("ins")).alias("ins_r"), share(F.col("dels")).alias("del_r"),
    )


def label_speakers(ref_words: DataFrame, asr_words: DataFrame, key: list[str]) -> DataFrame:
    """Recognised words (key, pos, word, s, e) with speaker_true, align_op, truth_word and
    truth_word_idx from reference words (key, pos, word, s, e, speaker). Both sides are
    packed once per transcript and unpacked with what they were aligned to; words without a
    counterpart take the speaker by time. Only transcripts with reference words are in the result."""
    from tessera.functions.text import norm_word
    from tessera.operators.utterances import speaker_by_time
    from tessera.session import stored

    def packed(df: DataFrame, fields: list[str], out: str) -> DataFrame:
        return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))

    more = [c for c in asr_words.columns if c not in (*key, "pos")]
    both = packed(ref_words, ["pos", "word", "speaker"], "r").join(packed(asr_words, ["pos", *more], "h"), key)
    plain = lambda c: F.transform(f"{c}.word", norm_word)
    places = lambda c: F.transform(f"{c}.pos", lambda x: x.cast("long"))
    ops = both.select(*key, "r", "h", word_ops(plain("r"), places("r"), plain("h"), places("h")).alias("o"))
    # One operation for every recognised word, in their order.
    each = ops.select(*key, "r", F.explode(F.arrays_zip("h", "o")).alias("x"))
    met = each.select(*key, "x.h", "x.o.op", F.col("x.o.ref_idx").alias("truth_word_idx"), F.get("r", F.col("x.o.ref_idx")).alias("t"))
    name = F.when(F.col("op") == "hit", "equal").when(F.col("op").isin("sub", "ins"), F.col("op")).otherwise("unmapped").alias("align_op")
    own = [c if c in key else F.col(f"h.`{c}`") for c in asr_words.columns]
    labelled = stored(met.select(*own, F.col("t.speaker").alias("_said"), name, F.col("t.word").alias("truth_word"), "truth_word_idx"), "speaker-labels")
    # Only words without a counterpart are looked up by time, in the transcripts that have any.
    open_ = stored(labelled.where(F.col("_said").isNull()).withColumn("q", F.col("pos")), "speakers-by-time")
    timed = speaker_by_time(open_, ref_words.join(open_.select(*key).distinct(), key, "left_semi"), key)
    found = labelled.where(F.col("_said").isNotNull()).withColumnRenamed("_said", "speaker_true")
    columns = [*asr_words.columns, "speaker_true", "align_op", "truth_word", "truth_word_idx"]
    return found.select(*columns).unionByName(timed.select(*columns))
