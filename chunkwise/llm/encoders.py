"""Encoders for whole texts: byte-level BPE ids and SentencePiece counts.

Each is built once per Python worker (:func:`once`) from a vocabulary file
whose path is a parameter.
"""

from __future__ import annotations

import json
import sys
import types
from array import array
from collections.abc import Callable, Iterator

#: Longer units are not remembered.
MAX_UNIT = 64


def once(kind, path: str):
    """The encoder ``kind(path)`` of this Python worker.  This package is pickled
    by value, so each task has its own module globals; a module entry outlives them."""
    built = sys.modules.setdefault("_chunkwise_encoders", types.ModuleType("_chunkwise_encoders")).__dict__
    if (kind.__name__, path) not in built:
        built[kind.__name__, path] = kind(path)
    return built[kind.__name__, path]


class Units(dict):
    """unit -> value; a missing unit is encoded on the way (``encode(unit)``)."""

    def __init__(self, encode: Callable[[str], object], limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.encode(unit)
        if len(unit) <= MAX_UNIT:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = value
        return value


#: How byte-level BPE files write the 256 bytes as characters, and how they split text.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file by bytes, if its ids are its merge
    ranks (then the merges of tiktoken and tokenizers are the same); else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in pairs]
    if ids != sorted(set(ids)) or model.get("dropout") or model.get("ignore_merges"):
        return None
    others = [b for b in range(256) if b not in set(_PLAIN)]
    byte = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}


class ByteBpe:
    """Ids (little-endian uint32 bytes) of whole texts as tokenizers gives them
    for a byte-level BPE file, special strings in texts included.  Where the
    file's ids are its merge ranks, tiktoken runs the same merges several times
    faster; texts with a special string always go through tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + n]
            at += n


def model_faults(sp) -> list[str]:
    """Why the words of texts cannot be encoded one by one, by byte pair merges, with a SentencePiece model: its
    type and its normaliser, which must leave texts as they are but for the mark put before them."""
    trainer, normalizer = {}, {}
    for number, value in _fields(sp.serialized_model_proto()):
        if number in (2, 3):  # fixed values: the messages of the trainer and of the normaliser, and their fields
            (trainer if number == 2 else normalizer).update(_fields(value))
    faults = []
    if trainer.get(3, 1) != 2:
        faults.append("it is no BPE model")
    if trainer.get(24, 0):
        faults.append("it marks the ends of words")
    if normalizer.get(2) or normalizer.get(6):
        faults.append("it replaces characters")
    if not normalizer.get(3, 1):
        faults.append("it puts no mark before a text")
    if normalizer.get(4, 1):
        faults.append("it removes spaces")
    if not normalizer.get(5, 1):
        faults.append("it does not mark spaces")
    return faults


class SentencePieceCounts:
    """Token counts of whole texts by a SentencePiece file.

    If no piece of the file crosses a space and it leaves texts as they are (both checked; else texts are encoded whole), a
    text's count is the sum over its space-delimited units, each encoded once
    and remembered in a cache of two generations of ``limit`` entries; what it
    forgets is encoded again.  Texts with runs of spaces, spaces at the ends or
    the space mark itself are encoded whole."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: No piece but runs of the space mark holds one after its first place.
        self.by_unit = not model_faults(self.sp) and all(not p.strip("▁") or "▁" not in p[1:] for p in pieces)
        self.cache = Units(self._whole, limit)

    def _whole(self, text: str) -> int:
        return len(self.sp.encode(text))

    def count(self, text: str) -> int:
        if not self.by_unit or "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return self._whole(text)
        return sum(map(self.cache.__getitem__, text.split(" ")))
