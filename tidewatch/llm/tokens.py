"""Exact tokenization through a table of distinct chunks.

A chunk is a stretch of text that the tokenizer's own rules never cross, so its
ids do not depend on what surrounds it. Each Python worker keeps a bounded table
from chunk to ids, asks the library only for chunks that are not in it, and joins
the ids back by position. The results equal those of encoding whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from operator import itemgetter

import numpy as np

#: Chunks in each of a table's two generations; bounds memory, not results.
TABLE_CHUNKS = 500_000


class ChunkTable(dict):
    """Chunk -> little-endian unsigned 32-bit ids. When full, the entries become the old generation, of which only those used again are kept."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = TABLE_CHUNKS):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self.put(chunk, ids)
        return ids

    def put(self, chunk: str, ids: bytes) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids

    def ids(self, chunks: list[str]) -> bytes:
        """The ids of consecutive chunks, joined by position."""
        return b"".join(itemgetter(*chunks)(self)) if len(chunks) > 1 else self[chunks[0]] if chunks else b""


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    return out.tobytes() if out.itemsize == 4 and np.little_endian else np.array(ids, "<u4").tobytes()


_ready: dict[tuple[type, str], object] = {}


def encoder(kind: type, path: str):
    """The worker's encoder of this kind; its table serves all tasks that the worker runs."""
    if (kind, path) not in _ready:
        _ready[kind, path] = kind(path)
    return _ready[kind, path]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Bpe:
    """A `tokenizers` file. Pre-tokens of common letters go straight to its model; any other text through the whole of it."""

    _letters = _byte_letters()
    #: Letters whose classes no version of Unicode changes, so that this side may split them.
    _common = re.compile("[\x21-\x7e \n¡-ɏ]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
        self.model = self.tok.model
        self.pre = ChunkTable(self.word, 200_000)

    def word(self, pre: str) -> bytes:
        """Ids of one pre-token."""
        return packed([t.id for t in self.model.tokenize(pre.encode().decode("latin-1").translate(self._letters))])

    def whole(self, text: str) -> bytes:
        return packed(self.tok.encode(text, add_special_tokens=False).ids)


#: Marks that often end a word and are pre-tokens of their own there.
_MARKS = (",", ".", ";", ":", "!", "?")


class SpaceLedEncoder(_Bpe):
    """Byte-level BPE whose pre-tokens may begin with one space: a boundary lies before each space that precedes a non-space."""

    _cut = re.compile(r" (?=\S)")
    #: White space that is not one space or line break between two other characters.
    _odd = re.compile(r"[ \n](?=\s|$)|\s\n")
    #: What ASCII texts with such white space hold, or one of the rarer kinds; faster to look for than the pattern.
    _signs = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        super().__init__(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.table = ChunkTable(self._chunk)  # without the space that leads a chunk
        self.heads = ChunkTable(self._head, 100_000)
        #: Whether the pattern leaves plain words whole, cuts a mark off their end and a line break out, so that most chunks need no pattern.
        self.plain = self.split.findall(" aB ZéX, c.\nd\nE") == [" aB", " ZéX", ",", " c", ".", "\n", "d", "\n", "E"]
        self.line = self._piece("\n")

    def _piece(self, text: str) -> bytes:
        return self.pre.ids(self.split.findall(text)) if self._common.fullmatch(text) else self.whole(text)

    def _head(self, text: str) -> bytes:
        return self.word(text) if self.plain and text.isalpha() and self._common.fullmatch(text) else self._piece(text)

    def _chunk(self, text: str) -> bytes:
        if self.plain and self._common.fullmatch(text):
            if text.isalpha():
                return self.word(" " + text)
            if text[-1:] in _MARKS and text[:-1].isalpha():
                return self.table[text[:-1]] + self.pre[text[-1]]
        return self._piece(" " + text)

    def _line(self, text: str) -> bytes:
        parts = text.split(" ")
        return self.heads[parts[0]] + self.table.ids(parts[1:])

    def __call__(self, text: str) -> bytes:
        odd = text.endswith((" ", "\n")) or any(x in text for x in self._signs) if text.isascii() else self._odd.search(text)
        if odd or not self.plain:
            parts = self._cut.split(text)
            return self.heads[parts[0]] + self.table.ids(parts[1:])
        return self.line.join(map(self._line, text.split("\n")))


class WhitespaceFreeEncoder(_Bpe):
    """BPE with word ends that drops white space and lowers case: any space or line break is a boundary."""

    def __init__(self, path: str):
        import regex

        super().__init__(path)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.table = ChunkTable(self._chunk)

    def _chunk(self, text: str) -> bytes:
        if not text:
            return b""
        if text.isascii():
            if text.isalpha():
                return self.word(text.lower())
            if text[-1] in _MARKS and text[:-1].isalpha():
                return self.table[text[:-1]] + self.pre[text[-1]]
        if not self._common.fullmatch(text):
            return self.whole(text)
        return self.pre.ids(self.split.findall(text.lower() if text.isascii() else self.tok.normalizer.normalize_str(text)))

    def __call__(self, text: str) -> bytes:
        return self.table.ids(text.replace("\n", " ").split(" "))


class MarkedWordEncoder:
    """SentencePiece model whose pieces never hold a marker after another character: each marked word stands alone."""

    _word = re.compile("▁+[^▁]*")
    _odd = re.compile("▁|  |^ | $")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        #: Whole texts are segmented at once if some piece crosses a marker, so that ids stay exact.
        self.whole = any(re.search("[^▁]▁", p) for p in pieces) or self.model.encode("  a ") != self.model.encode("▁▁a▁")
        # The model puts one marker before what it encodes, so words go in without their first.
        lone = packed([self.model.piece_to_id("▁")])
        self.table = ChunkTable(lambda w: packed(self.model.encode(w)) if w else lone)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole:
            return packed(self.model.encode(text))
        if self._odd.search(text):
            return self.table.ids([w[1:] for w in self._word.findall("▁" + text.replace(" ", "▁"))])
        return self.table.ids(text.split(" "))
