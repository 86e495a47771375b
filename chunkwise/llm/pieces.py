"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The words of a batch that are not yet known are cut into units wherever two
neighbouring characters stand together in no piece (no merge can cross such a
place).  The distinct units that are not yet known are concatenated and indexed
by a suffix array (prefix doubling up to the longest piece).  Every piece is
binary-searched for its range of occurrences; the occurrences are the edges of
a lattice, sorted by position and then relaxed.

Relaxing gives exactly the BPE result: a token sequence is the result of the
merges if and only if each token alone, and each pair of neighbours, is the
result for its own string.  So each position has one last token: the edge
that ends there and fits the last token of the position where it starts.

Defined results: a null or empty text has no tokens; characters without a
piece become byte tokens; runs of spaces, spaces at the ends, control strings
and the space mark in texts are treated as the library does (the mark decodes
as a space); repeated rows are encoded one by one; an empty table gives an
empty table; extra columns are left out.  Whole texts are encoded; a word may
be as long as its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices
from .encoders import model_faults, once

MARK = "▁"
#: What an unknown id decodes to.
UNKNOWN = " ⁇ "
#: Words, and units, that a Python worker remembers, and their greatest length.
REMEMBERED, WORD_CHARS = 300_000, 64
#: Neighbouring token pairs that it remembers.
PAIRS = 400_000
#: Characters that are indexed at once (one word may be longer).
INDEXED = 1 << 20

_WORD = re.compile(rf"{MARK}({MARK}*[^{MARK}]*)")


def words_of(text: str) -> list[str]:
    """Words of a text, each without the space mark that stands before it."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return _WORD.findall(MARK + text.replace(" ", MARK))


class Memory:
    """String -> ids, in two generations of about ``REMEMBERED`` strings; what it forgets is encoded again."""

    def __init__(self, encode: Callable[[list[str]], Iterable[tuple[str, bytes]]]):
        self.encode, self.known, self.older = encode, {}, {}

    def ids(self, lists: Iterable[list[str]]) -> list[list[bytes]]:
        """Ids of every string of every list.  Of the strings only those not yet known are held."""
        get, out, waiting, new = self.known.get, [], [], set()
        for keys in lists:
            found = list(map(get, keys))
            out.append(found)
            if None in found:
                gaps = [k for k, ids in enumerate(found) if ids is None]
                keys = [keys[k] for k in gaps]
                new.update(keys)
                waiting.append((found, gaps, keys))
        if new:
            got = {w: self.older[w] for w in new.intersection(self.older)}
            got.update(self.encode(list(new.difference(got))))
            for found, gaps, keys in waiting:
                for k, w in zip(gaps, keys):
                    found[k] = got[w]
            self.known.update(got if max(map(len, new)) <= WORD_CHARS else {w: i for w, i in got.items() if len(w) <= WORD_CHARS})
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}
        return out


class Model:
    """Pieces of a SentencePiece BPE file and the rules between them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        faults = model_faults(sp)
        if faults:
            raise ValueError(f"not a model that this encoder can stand in for: {', '.join(faults)}")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.bytes_of = {i: b for b, i in self.byte.items()}
        self.text = {i: names[i].replace(MARK, " ") for i in plain}
        self.skip = {i for i in range(n) if sp.is_control(i)}
        if any(MARK in p[1:] for p in self.id if p.strip(MARK)):
            raise ValueError("a piece holds the space mark after its first place")
        # tokens that the merges reach; others never come out
        many = [p for p in self.id if len(p) > 1 and self.merge(p) == [p]]
        self.longest = max(map(len, many), default=1)
        many.sort()
        self.many_codes = [np.array(list(map(ord, p)), np.int64) for p in many]
        # tokens by number: the pieces of several characters, then single characters as they come
        self.tokens = list(many)
        self.sizes = [len(p) for p in many]
        self.token_ids = [self.ids_of(p) for p in many]
        self.chars: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        # neighbouring characters that a piece holds
        self.joined = np.array(sorted({ord(x) << 21 | ord(y) for p in self.id for x, y in zip(p, p[1:])}), np.int64)
        self.words, self.units = Memory(self.encode_words), Memory(self.encode_units)
        # what every id decodes to, as bytes
        self.bytes_by_id = pa.array([bytes([self.bytes_of[i]]) if i in self.bytes_of else b"" if i in self.skip else
                                     self.text.get(i, UNKNOWN).encode() for i in range(n)], pa.binary())
        self.skipped = np.isin(np.arange(n), list(self.skip))

    def merge(self, s: str) -> list[str]:
        """The BPE merges of one short string, best score first, then leftmost."""
        score, parts = self.score, list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        x, y = self.tokens[a], self.tokens[b]
        ok = self.pairs[a << 32 | b] = self.merge(x + y) == [x, y]
        return ok

    def char(self, c: str) -> int:
        """Number of a single character's token."""
        k = self.chars[c] = len(self.tokens)
        self.tokens.append(c)
        self.sizes.append(1)
        self.token_ids.append(self.ids_of(c))
        return k

    def ids_of(self, token: str) -> bytes:
        """Little-endian int32 ids of a token: its piece, else its bytes' pieces."""
        i = self.id.get(token)
        ids = [i] if i is not None else [self.byte[b] for b in token.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]
        return np.array(ids, "<i4").tobytes()

    # -- encoding ---------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of every text."""
        ids, starts = self.encode_flat(texts)
        return np.split(ids, starts[1:-1]) if texts else []

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all texts, and where each text's ids start (at last their number)."""
        own = [b"".join(found) for found in self.words.ids(map(words_of, texts))]
        starts = np.zeros(len(own) + 1, np.int64)
        np.cumsum([len(ids) >> 2 for ids in own], out=starts[1:])
        return np.frombuffer(b"".join(own), "<i4"), starts

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids, which are those of their units one after the other."""
        for part in portions(words):
            text = MARK + MARK.join(part)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            starts = np.zeros(len(part), np.int64)
            np.cumsum([len(w) + 1 for w in part[:-1]], out=starts[1:])
            cut = np.ones(len(codes), bool)
            cut[1:] = ~among(codes[:-1] << 21 | codes[1:], self.joined)
            cut[starts] = True
            begin = np.flatnonzero(cut)
            at = begin.tolist()
            found = self.units.ids([[text[a:b] for a, b in zip(at, at[1:] + [len(text)])]])[0]
            first = np.searchsorted(begin, starts).tolist()
            for w, a, b in zip(part, first, first[1:] + [len(found)]):
                yield w, found[a] if b - a == 1 else b"".join(found[a:b])

    def encode_units(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        for part in portions(sorted(units)):
            yield from zip(part, self.match(part))

    def match(self, words: list[str]) -> list[bytes]:
        """Ids of each word: index, search every piece, sort the edges, relax.  A position's
        last token depends on the word up to there, so sorted words share their beginnings."""
        if not words:
            return []
        text = "\0".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sa = suffix_array(codes, self.longest)
        lo, hi = occurrence_ranges(codes, sa, self.many_codes)
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        start = sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        size = np.array(self.sizes[:len(n)], np.int64)[piece]
        end = start + size
        order = np.argsort(end * (self.longest + 1) - size)
        piece = piece[order].tolist()
        first = np.searchsorted(end[order], np.arange(len(codes) + 2)).tolist()
        sizes, chars, pairs, fits, token_ids = self.sizes, self.chars, self.pairs, self.fits, self.token_ids
        out, base, before = [], 0, ""
        last = [0]  # last[i]: the last token of the first i characters
        for w in words:
            k = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                k += 1
            del last[k + 1:]
            before = w
            for i in range(k + 1, len(w) + 1):
                at = base + i
                for e in range(first[at], first[at + 1]):
                    token = piece[e]
                    j = i - sizes[token]
                    if j == 0:
                        break
                    if j > 0:  # below 0 an edge would cross a separator (a word may hold NUL)
                        key = last[j] << 32 | token
                        ok = pairs.get(key)
                        if ok or ok is None and fits(last[j], token):
                            break
                else:
                    token = chars.get(w[i - 1])
                    if token is None:
                        token = self.char(w[i - 1])
                last.append(token)
            i = len(w)
            found = []
            while i:
                token = last[i]
                found.append(token_ids[token])
                i -= sizes[token]
            found.reverse()
            out.append(b"".join(found))
            base += len(w) + 1
        return out

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        try:
            s = "".join(map(self.text.__getitem__, ids))
        except KeyError:  # bytes, control or unknown ids
            s = self._decode_mixed(ids)
        return s[1:] if s[:1] == " " else s

    def decode_flat(self, ids: pa.Array, starts: np.ndarray) -> pa.Array:
        """Texts of the ids between each start and the next: all tokens' bytes one after the other.  Rows with control or
        foreign ids, or whose bytes are no UTF-8, are decoded one by one, with all others of this call."""
        texts = None
        if pa.types.is_integer(ids.type) and not ids.null_count:
            of = ids.to_numpy()
            if len(of) and 0 <= of.min() and of.max() < len(self.skipped) and not self.skipped[of].any():
                texts = self._joined(ids, starts)
        if texts is None:
            of, at = ids.to_pylist(), starts.tolist()
            texts = pa.array([self.decode(of[a:b]) for a, b in zip(at, at[1:])], pa.string())
        return texts

    def _joined(self, ids: pa.Array, starts: np.ndarray) -> pa.Array | None:
        tokens = self.bytes_by_id.take(ids)
        until = np.frombuffer(tokens.buffers()[1], np.int32)[starts]
        data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[:until[-1]]
        # the space before a text's first word is left out
        own = until[:-1][until[1:] > until[:-1]]
        spaces = own[data[own] == 32]
        until = (until - np.searchsorted(spaces, until)).astype(np.int32)
        data = np.delete(data, spaces)
        texts = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(until), pa.py_buffer(data)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return None
        return texts

    def _decode_mixed(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.text:
                out.append(self.text[i])
            elif i not in self.skip:
                out.append(UNKNOWN)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))


def among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each key is one of the sorted ``values``."""
    if not len(values):
        return np.zeros(len(keys), bool)
    return values[np.minimum(np.searchsorted(values, keys), len(values) - 1)] == keys


def portions(words: list[str]) -> Iterator[list[str]]:
    """Words in lists of about ``INDEXED`` characters."""
    own, size = [], 0
    for w in words:
        if own and size + len(w) > INDEXED:
            yield own
            own, size = [], 0
        own.append(w)
        size += len(w) + 1
    if own:
        yield own


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` codes at least (prefix doubling, from as many
    codes as a long holds)."""
    rank = np.cumsum(np.bincount(codes) > 0)[codes]
    bits = int(rank.max()).bit_length()
    size = min(63 // bits, depth, len(rank))
    key = np.zeros(len(rank), np.int64)
    for k in range(size):
        key <<= bits
        key[:len(rank) - k] |= rank[k:]
    order = np.argsort(key)
    while size < min(depth, len(rank)):
        new = np.ones(len(key), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (len(rank) + 2)
        key[:-size] += rank[size:]
        order = np.argsort(key)
        size *= 2
    return order


def occurrence_ranges(codes: np.ndarray, sa: np.ndarray, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of ``sa`` whose suffixes start with it: binary search,
    one character of all pieces at a time."""
    n = len(sa)
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    size = np.array([len(p) for p in pieces], np.int64)
    padded = np.append(codes, -1)
    width = int(size.max()) if len(size) else 0
    grid = np.full((len(pieces), width), -1, np.int64)
    for k, p in enumerate(pieces):
        grid[k, :len(p)] = p

    def bound(a: np.ndarray, b: np.ndarray, want: np.ndarray, d: int) -> np.ndarray:
        """First place in [a, b) whose code at depth d is at least ``want``."""
        a, b = a.copy(), b.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            c = padded[np.minimum(sa[np.minimum(mid, n - 1)] + d, n)]
            left = open_ & (c < want)
            a = np.where(left, mid + 1, a)
            b = np.where(open_ & ~left, mid, b)

    for d in range(width):
        own = np.flatnonzero((size > d) & (lo < hi))
        want = grid[own, d]
        low = bound(lo[own], hi[own], want, d)
        hi[own] = bound(low, hi[own], want + 1, d)
        lo[own] = low
    return lo, np.maximum(lo, hi)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(Model, path)
        for b in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(*model.encode_flat(b.column(1).to_pylist()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for every row of token ids (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(Model, path)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                own = b.slice(k, 1024)
                starts = np.zeros(own.num_rows + 1, np.int64)
                np.cumsum(pc.list_value_length(own.column(1)).fill_null(0), out=starts[1:])
                yield pa.RecordBatch.from_arrays([own.column(0), model.decode_flat(own.column(1).flatten(), starts)], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and whether they decode to the text (the space mark read as a space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(Model, path)
        for b in slices(batches, "text", 4 << 20):
            ids, starts = model.encode_flat(b.column(1).to_pylist())
            same = pc.equal(model.decode_flat(pa.array(ids), starts), pc.replace_substring(b.column(1).cast(pa.string()), MARK, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids, starts), same], names=["doc_id", "ids", "decoded_equal"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded_equal boolean")
