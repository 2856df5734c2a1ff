"""Token ids of whole texts with the ``tokenizers`` library, in Arrow batches.

A byte-level BPE splits a text before its merges run, so a text's ids are the ids of
its units one after the other. Texts whose white space is single spaces and line feeds
between other characters are cut into units (a word with the space before it, a line
feed) by Arrow; the library encodes units a worker doesn't know yet, and the ids of all
units are gathered by position. A worker that knows too many keeps those that more than
one array held. Any other text, and any that holds the string of an added token, is
encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that the unit cut does not cover, and the cut's own separator.
_ODD = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}"
    r"\x{2028}-\x{202f}\x{205f}-\x{2060}\x{3000}\x{feff}]"
)
_CUT = "\x1f"


def _joined(units: pa.Array, n: int = 64) -> list[str]:
    """Every ``n`` units of a large string array as one string."""
    offs = np.frombuffer(units.buffers()[1], np.int64, len(units) + 1, units.offset * 8)
    offs = np.append(offs[:-1:n], offs[-1])
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), units.buffers()[2]]).to_pylist()


class Encoder:
    """Encodes string arrays; keeps the ids of at most ``most_units`` units, or of half
    as many and one array's new ones if those are more."""

    def __init__(self, path: str, most_units: int = 800_000, units: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_units, self.units = most_units, units
        # Strings of added tokens are found in the whole text before it is split.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([_ODD, *added])
        vocab = self.tokenizer.get_vocab()
        self.after_space, self.line_feed = np.zeros(max(vocab.values()) + 1, bool), np.zeros(max(vocab.values()) + 1, bool)
        self.after_space[[v for k, v in vocab.items() if k.startswith("Ġ")]] = True
        self.line_feed[[v for k, v in vocab.items() if k == "Ċ"]] = True
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _forget(self) -> None:
        """Drop the units that only one array held, or all units if that frees less than half."""
        if 2 * self.again.sum() > self.most_units:
            return self._reset()
        lens = np.diff(self.offsets)
        self.ids = self.ids[np.repeat(self.again, lens)]
        self.offsets = np.concatenate([[0], np.cumsum(lens[self.again])])
        self.known = self.known.filter(pa.array(self.again))
        self.again = np.zeros(len(self.known), bool)

    def _learn(self, units: pa.Array) -> None:
        """Encode new units, 64 in a string. One with a space begins at the one id that has a
        space; the others are ended by a line feed, which is cut off as an id of its own."""
        alone = pc.is_in(units, value_set=pa.array(["", "\n"], units.type))
        spaced = pc.starts_with(units, " ")
        fed = pc.invert(pc.or_(alone, spaced))
        for which in (alone, spaced, fed):
            some, cuts = units.filter(which), None
            if which is spaced:
                ids, lens = self._encode(_joined(some))
                cuts = np.flatnonzero(self.after_space[ids])
            elif which is fed:
                ids, lens = self._encode(_joined(pc.binary_join_element_wise(some, *pa.array(["\n", ""], units.type))))
                cuts = np.flatnonzero(self.line_feed[ids])
            if cuts is None or len(cuts) != len(some):
                ids, lens = self._encode(some.to_pylist())
            elif which is spaced:
                lens = np.diff(np.append(cuts, len(ids)))
            else:
                ids, lens = np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1
            self.known = pa.concat_arrays([self.known, some])
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lens)])
            self.again = np.concatenate([self.again, np.zeros(len(some), bool)])

    def _by_units(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(col, " ", _CUT + " "), "\n", _CUT + "\n" + _CUT)
        lists = pc.split_pattern(marked, _CUT)
        offs = lists.offsets.to_numpy()
        coded = lists.values[offs[0] : offs[-1]].dictionary_encode()
        units = coded.dictionary
        at = pc.index_in(units, value_set=self.known)
        if at.null_count:
            self.again[at.drop_null().to_numpy()] = True
            if len(self.known) + at.null_count > self.most_units:
                self._forget()
                at = pc.index_in(units, value_set=self.known)
            self._learn(units.filter(at.is_null()))
            at = pc.index_in(units, value_set=self.known)
        else:
            self.again[at.to_numpy()] = True
        found = pa.LargeListArray.from_arrays(self.offsets, self.ids).take(at.take(coded.indices))
        ends = found.offsets.to_numpy()
        return found.flatten().to_numpy(), np.diff(ends[offs - offs[0]])

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and the number of ids per row. Null: empty."""
        col = col.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        n = len(col)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(col, self.odd).to_numpy(zero_copy_only=False) if self.units else np.ones(n, bool)
        if not odd.any():
            return self._by_units(col)
        lens = np.zeros(n, np.int64)
        odd_ids, lens[odd] = self._encode(col.filter(pa.array(odd)).to_pylist())
        ids, some = self._by_units(col.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        lens[~odd] = some
        is_odd = np.repeat(odd, lens)
        out = np.empty(len(is_odd), np.uint32)
        out[is_odd], out[~is_odd] = odd_ids, ids
        return out, lens


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The end id appended to every row."""
    stops = np.cumsum(lens)
    return np.insert(ids, stops, np.uint32(end_id)), lens + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
