"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary of ranks (one base64 token and its rank a line) becomes a ``tokenizers`` BPE model: bytes map to the
printable characters of the byte-level alphabet, and each way to split a token into two known tokens becomes a merge
with that token's rank. Texts are cut before single spaces, where the pattern always starts a new piece, and a worker encodes
each distinct cut once; a text with runs of white space that this rule doesn't cover is encoded whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, text_column

#: Fixed value: the split pattern for which the cut before single spaces holds.
SPACE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space inside a longer run of white space isn't always the start of a piece.
_INNER_SPACE = re.compile(r"\s (?=\s|\Z)")
#: What an ASCII text must hold for that.
_ASCII_SPACES = tuple(c + " " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
#: Characters over which the pattern needs no Unicode tables, and the pattern over them.
_PLAIN = re.compile("[ -~\t\n\r\u00a1-\u024f]*")
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", " \t\n\r"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Signs that may follow a word; no rule of the pattern joins them with letters.
_SIGNS = ".,;:!?*#$%&)"
#: Keys of a generation of a worker's caches of cuts and of pieces, and characters of a key; only speed and memory depend on
#: them. A key and its ids take less than 500 bytes, so that both generations of all caches stay below 500 MB at the very worst.
CACHE_CUTS, CACHE_PIECES, CACHE_CHARS = 350_000, 60_000, 40


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_LETTERS = dict(enumerate(byte_alphabet()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def rank_tokenizer(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    letters = byte_alphabet()
    shown = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    out = Tokenizer(BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def inner_space(text: str) -> bool:
    if text.isascii() and not any(map(text.__contains__, _ASCII_SPACES)):
        return False
    return _INNER_SPACE.search(text) is not None


class _Recent(dict):
    """A cache of what ``make`` gives for a key. When it is full, its entries become the old generation, of which those that are
    met again come back, so that frequent keys stay and memory holds two generations. Long keys aren't kept."""

    def __init__(self, make, size: int) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) > CACHE_CHARS:
            return out
        if len(self) >= self.size:
            self.old = self.copy()
            self.clear()
        self[key] = out
        return out


class CutEncoder:
    """Token ids of whole texts as little-endian 32-bit integers, by way of their distinct cuts.

    A cut of ASCII or Latin letters is split here, by the same pattern over those characters alone, and its distinct pieces go
    to the tokenizer's model; any other cut takes the whole tokenizer, and so does a text that holds a token which the
    tokenizer looks for before it splits.
    """

    def __init__(self, tokenizer, cuts: bool = True, size: int = CACHE_CUTS) -> None:
        self.tokenizer, self.model, self.cuts = tokenizer, tokenizer.model, cuts
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content and not (t.special and tokenizer.encode_special_tokens)]
        self.first, self.pieces = _Recent(self._first, CACHE_PIECES), _Recent(self._piece, CACHE_PIECES)
        self.later = _Recent(self._maker(), size)

    def _first(self, cut: str) -> bytes:
        word = cut.rstrip(_SIGNS)
        if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
            return self.pieces[word] + self.pieces[cut[len(word) :]] if len(word) < len(cut) else self.pieces[word]
        return self._cut("", cut)

    def _maker(self):
        """Ids of a cut with the space before it. Most cuts are a word, or a word and signs after it, which need no pattern."""
        tokenize, pieces, space, pack = self.model.tokenize, self.pieces, _LETTERS[32], struct.Struct

        packers = [pack(f"<{n}I").pack for n in range(64)]

        def make(cut: str) -> bytes:
            word = cut.rstrip(_SIGNS)
            if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
                if len(word) < len(cut):
                    return self.later[word] + pieces[cut[len(word) :]]
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
                ids = [t.id for t in tokenize(space + shown)]
                return packers[len(ids)](*ids) if len(ids) < 64 else array("I", ids).tobytes()
            # a single line break between words is a piece of its own
            before, line, after = cut.partition("\n")
            if line and before and after and not before[-1].isspace() and not after[0].isspace():
                return self.later[before] + pieces["\n"] + self.first[after]
            return self._cut(" ", cut)

        return make

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _cut(self, lead: str, cut: str) -> bytes:
        text = lead + cut
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out, first, later = [], self.first.__getitem__, self.later.__getitem__
        for text in texts:
            if not self.cuts or inner_space(text) or (self.added and any(t in text for t in self.added)):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                head, *tail = text.split(" ")
                out.append(first(head) + b"".join(map(later, tail)))
        return out


class Decoder:
    """Reverses the byte table: ids to bytes, and bytes to text where a character may be split between tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def text_of(self, ids: list[int]) -> Iterator[str]:
        """The characters that each token completes; bytes of an unfinished character wait for the next token."""
        waiting = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield waiting.decode(self.table[i])
        yield waiting.decode(b"", True)

    def offsets(self, ids: list[int]) -> list[int]:
        """The character in which each token starts: a token that begins inside a character has that character's offset."""
        out, at = [], 0
        for i in ids:
            piece = self.table[i]
            inside = bool(piece) and 0x80 <= piece[0] < 0xC0
            out.append(at - inside)
            at += sum((b & 0xC0) != 0x80 for b in piece)
        return out


_loaded: dict[tuple, tuple] = {}


def _codec(ranks_path: str, pattern: str) -> tuple[CutEncoder, Decoder]:
    key = (ranks_path, pattern)
    if key not in _loaded:
        ranks = read_ranks(ranks_path)
        _loaded[key] = CutEncoder(rank_tokenizer(ranks, pattern), pattern == SPACE_PATTERN, CACHE_CUTS // 3), Decoder(ranks)
    return _loaded[key]


def list_of(values: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), "<i4")))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Token ids of each whole text and what they decode to.

    Returns doc_id, ids array<int>, decoded binary and, where ``offsets`` is set, starts array<int>: the character of the
    text in which each token starts. A null text is an empty one, which has no ids. Other columns of ``docs`` don't
    matter and aren't returned; repeated rows stay; an empty table gives an empty one. ``ranks_path`` must be readable
    on every executor. A map over Arrow batches: nothing is shuffled, and memory follows one batch and one cache.
    """
    prepare(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary" + ", starts array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(ranks_path, pattern)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
            columns = [batch.column(0), list_of(ids), pa.array([decoder.bytes_of(x) for x in lists], pa.binary())]
            if offsets:
                columns.append(pa.array([decoder.offsets(x) for x in lists], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", "starts"][: len(columns)])

    return docs.select("doc_id", text_column().alias("text")).mapInArrow(run, schema)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
