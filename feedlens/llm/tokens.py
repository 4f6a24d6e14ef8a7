"""Token ids of whole texts by a public tokenizer, inside Spark tasks.

A text is cut at white space, where the pre-tokenizers of the supported files always cut as well, and each
distinct piece is encoded once by the `tokenizers` library. Texts with rarer white space or with the text of
a special token go through the library whole. The result equals encoding each text on its own.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib

import numpy as np

#: Distinct pieces of a generation of the memo, some 200 bytes each; a worker remembers two generations.
MEMO_PIECES = 250_000
#: Longer pieces, in characters, are encoded on their own.
LONG_CHARS = 64
#: New pieces that go to the library in one string.
JOINED = 256

#: A piece ends before white space, and between a letter and one of these marks, where the tokenizers cut as well.
_WORD = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af]++(?![^ \t\n\r,.;:!?#$%&*|()\"])"
_SPACED = re.compile(rf"[ ]?(?:{_WORD}|[^ \t\n\r]+)|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+(?=[ ][^ \t\n\r])|[\t\n\r]")
_BARE = re.compile(rf"{_WORD}|[^ \t\n\r]+")
_RARE_ASCII = re.compile("[\x0b\x0c\x1c-\x1f]")
#: The superscripts, fractions and other numerals are those of the blocks named here; combining marks and the
#: two capitals whose lower case depends on more than themselves are among them too.
_RARE_WIDE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0130\u0300-\u036f\u03a3\u0900-\u1fff\u2000-\u2bff\u2c00-\u2dff\u3000-\u3007\u3021-\u303f\u3190-\u33ff\ua000-\uabff\uf900-\uffff\U00010000-\U0010ffff]")


def _rare(text: str) -> bool:
    """Whether a text may cut elsewhere than the piece patterns say."""
    if text.isascii():
        return bool(_RARE_ASCII.search(text))
    return bool(_RARE_WIDE.search(text))


class _Memo(dict):
    """Piece to number; a piece that it lacks gets the next number and is noted in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Ids of texts by one tokenizer file; keeps a bounded memo of pieces between batches."""

    def __init__(self, path: str, memo_pieces: int | None = None):
        self.memo_pieces = memo_pieces or MEMO_PIECES
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.drops_space = '"Removed"' in json.dumps(spec.get("pre_tokenizer") or {})
        self.lowers = '"Lowercase"' in json.dumps(spec.get("normalizer") or {})
        self.pattern = _BARE if self.drops_space else _SPACED
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        #: Ids that close a word (file without spaces) or open a piece with a space (the other kind).
        self.edge = np.zeros(self.vocabulary, dtype=bool)
        for text, i in self.tokenizer.get_vocab().items():
            self.edge[i] = text.endswith("</w>") if self.drops_space else text.startswith("\u0120")
        self._fresh()
        self.old = (_Memo(), self.flat, self.first, self.size)

    def _fresh(self) -> None:
        self.memo = _Memo()
        self.flat, self.end = np.zeros(1 << 16, dtype=self.dtype), 0
        self.first, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _remember(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.end : self.end + len(ids)] = ids
        self.first[numbers] = self.end + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.end += len(ids)

    def _learn(self) -> None:
        """Take new pieces over from the old generation; encode the others, many to a call."""
        new, memo = self.memo.new, self.memo
        self.memo.new = []
        while len(memo) > len(self.first):
            self.first, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size))
        past, flat, first, size = self.old
        at = len(memo) - len(new)
        plain, other, known = [], [], []
        for number, p in enumerate(new, at):
            if p in past:
                known.append(number)
            elif len(p) > LONG_CHARS:
                other.append(p)
            elif self.drops_space:
                (plain if p.isalpha() else other).append(p)
            else:
                (plain if p[0] == " " and p[1:].isalpha() else other).append(p)
        if known:
            of = np.array([past[new[k - at]] for k in known], dtype=np.int64)
            self._remember(known, _ragged(flat, first[of], size[of]), size[of])
        glue = " " if self.drops_space else ""
        groups = [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)]
        for part, got in zip(groups, self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype=self.dtype)
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):  # a piece has an edge inside
                other.extend(part)
                continue
            bounds = np.concatenate(([0], edges + 1)) if self.drops_space else np.append(edges, len(ids))
            self._remember([memo[p] for p in part], ids, np.diff(bounds))
        for a in range(0, len(other), 4096):
            part = other[a : a + 4096]
            each = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._remember([memo[p] for p in part], np.fromiter(itertools.chain.from_iterable(each), dtype=self.dtype), np.fromiter(map(len, each), dtype=np.int64))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start; null counts as empty."""
        if len(self.memo) > self.memo_pieces:
            self.old = (self.memo, self.flat, self.first, self.size)
            self._fresh()
        whole: dict[int, np.ndarray] = {}
        pieces: list[str] = []
        of_text = [0]
        for i, text in enumerate(texts):
            if text and (_rare(text) or any(s in text for s in self.specials)):
                whole[i] = self._whole(text)
            elif text:
                pieces += self.pattern.findall(text.lower() if self.lowers else text)
            of_text.append(len(pieces))
        at = np.fromiter(map(self.memo.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if self.memo.new:
            self._learn()
        size = self.size[at]
        flat = _ragged(self.flat, self.first[at], size)
        bounds = np.concatenate(([0], np.cumsum(size)))[of_text]
        if not whole:
            return flat, bounds
        parts, sizes = [], np.diff(bounds)
        for i in range(len(texts)):
            own = whole.get(i)
            parts.append(flat[bounds[i] : bounds[i + 1]] if own is None else own)
            sizes[i] = len(parts[-1])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


def _ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[first : first + size], one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - size), size) + np.arange(total)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, memo_pieces: int | None = None) -> Encoder:
    """The encoder of a file, kept by the Python worker between tasks."""
    return Encoder(path, memo_pieces)


def tokenizer(name: str) -> str:
    """The path of one of the public vocabulary files on this machine; every executor has it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def text_slices(batch, column: str = "text", size: int = 1 << 20):
    """(first row, texts) of slices of a batch of about `size` bytes each; bounds what a task holds at once."""
    from feedlens.llm.shared import buffers, tiles

    values = batch.column(column)
    _, offsets = buffers(values)
    for i, j in tiles(offsets, size):
        yield i, values.slice(i, j - i).to_pylist()


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8))
