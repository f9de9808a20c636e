"""Whole texts to token ids with a public tokenizer, each distinct piece encoded once.

The tokenizers cut a text into pieces before they merge anything, so a text's
ids are those of its pieces in turn. Pieces repeat, whole texts don't: texts
are cut where both tokenizers surely do, and a worker keeps the ids of the
pieces that it has met, under 128-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .text import CACHES

#: Beyond so many pieces (some 50 bytes each), or so many ids for each, a worker forgets those that it met once.
PIECES, IDS = 1_000_000, 6
#: Two white-space characters in a row, in any script, the mark that cuts pieces, or what begins the strings of
#: added tokens: such texts are encoded whole.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x00|<\|"
#: A mark of punctuation after a letter or digit begins a piece. The letters are those of Latin that stay one letter
#: in lower case and in normal form; others (capital dotted I, and letters that decompose) may end in a mark.
_MARK = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}])([.,;:!?])"
#: Beyond Latin: in texts with such characters, case and normal form may depend on each other.
_FAR = r"[^\x00-\x{17f}]"


class Encoder:
    """`keeps_space`: the tokenizer puts a space with the word after it (byte-level); else it drops white space and case. Strings of added tokens in a text give those tokens."""

    def __init__(self, path: str, keeps_space: bool, end_id: int, pieces: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        strange = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.content.startswith("<|")]
        if strange:
            raise ValueError(f"{path}: added tokens {strange} can stand across pieces")
        self.keeps_space = keeps_space
        self.end_id = end_id
        self.most = PIECES if pieces is None else pieces
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # the first halves of pieces' hashes, sorted
        self.other = np.zeros(0, dtype=np.uint64)  # their second halves
        self.slot_of = np.zeros(0, dtype=np.int32)
        self.again = np.zeros(0, dtype=bool)  # pieces that were met again
        self.flat = np.array([self.end_id], dtype=np.uint32)  # slot 0 is the end id
        self.starts = np.array([0], dtype=np.int64)
        self.lengths = np.array([1], dtype=np.int32)

    def _forget_some(self) -> None:
        """Keeps the pieces that were met again since the last time, or none if those are too many."""
        keep = self.again
        if 2 * keep.sum() > self.most or 2 * int(self.lengths[self.slot_of[keep]].sum()) > IDS * self.most:
            keep = np.zeros(len(self.again), dtype=bool)
        known, other, slots = self.known[keep], self.other[keep], self.slot_of[keep]
        starts, lengths = self.starts[slots], self.lengths[slots]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        self._forget()
        self.known, self.other, self.slot_of, self.again = known, other, np.arange(1, len(known) + 1, dtype=np.int32), np.zeros(len(known), dtype=bool)
        self.flat = np.concatenate((self.flat, flat))
        self.starts = np.concatenate((self.starts, 1 + ends - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        """The slot of each of these distinct pieces; new ones are encoded."""
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join(map(digest, pieces.cast(pa.large_binary()).to_pylist())), dtype=np.uint64).reshape(-1, 2)
        order = np.argsort(both[:, 0])
        first, second = both[order, 0], both[order, 1]
        at = np.searchsorted(self.known, first)
        inside = np.minimum(at, max(0, len(self.known) - 1))
        hit = (self.known[inside] == first) & (self.other[inside] == second) if len(self.known) else np.zeros(len(first), dtype=bool)
        found = np.zeros(len(first), dtype=np.int64)
        found[hit] = self.slot_of[inside[hit]]
        self.again[inside[hit]] = True
        new = np.flatnonzero(~hit)
        if len(new):
            ids = self._encoded(pieces.take(pa.array(order[new])).to_pylist())
            lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
            found[new] = len(self.starts) + np.arange(len(new))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum()))))
            self.lengths = np.concatenate((self.lengths, lengths))
            place = at[new]
            self.known = np.insert(self.known, place, first[new])
            self.other = np.insert(self.other, place, second[new])
            self.slot_of = np.insert(self.slot_of, place, found[new])
            self.again = np.insert(self.again, place, False)
        slots = np.empty(len(first), dtype=np.int64)
        slots[order] = found
        return slots

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of all texts, and where each text's begin."""
        if self.keeps_space:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        else:
            # the tokenizer lowers case itself; where that is the same, lower case first has fewer pieces
            texts = pc.if_else(pc.match_substring_regex(texts, _FAR), texts, pc.ascii_lower(texts))
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\0"), "\n", "\0")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _MARK, "\\1\0\\2"), "\0")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        return lists.flatten(), offsets - offsets[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each with the end id, and where each begins (one more entry than texts)."""
        if len(self.known) > self.most or len(self.flat) > IDS * self.most:
            self._forget_some()
        odd = np.asarray(pc.match_substring_regex(texts, _ODD)) if len(texts) else np.zeros(0, dtype=bool)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        pieces, offsets = self._pieces(plain)
        coded = pieces.dictionary_encode()
        slots = self._slots(coded.dictionary)[np.asarray(coded.indices)] if len(pieces) else np.zeros(0, dtype=np.int64)
        slots = np.insert(slots, offsets[1:], 0)
        offsets = offsets + np.arange(len(offsets))
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths, dtype=np.int64)
        begins = np.concatenate(([0], ends))[offsets]
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[slots] - (ends - lengths), lengths) + np.arange(total)]
        if odd.any():
            at = np.flatnonzero(odd)
            whole = dict(zip(at.tolist(), self._encoded([texts[i].as_py() for i in at.tolist()]), strict=True))
            parts = [np.array([*whole[i], self.end_id], dtype=np.uint32) if i in whole else ids[begins[i] : begins[i + 1]] for i in range(len(texts))]
            begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            ids = np.concatenate(parts)
        return ids, begins


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool, end_id: int, pieces: int | None = None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, keeps_space, end_id, pieces)


CACHES.append(encoder.cache_clear)
