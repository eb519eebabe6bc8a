"""Byte-level BPE through the ``tokenizers`` library, with a memo of the pieces between spaces.

A space or line feed that stands between two characters that are not white space always
opens a token of the byte-level pattern, and so does a stop or comma after a letter or
digit. The text can be cut there and each piece encoded alone: the ids are those of the
whole text. Prose repeats its words, hence a memo: of pieces seen again, and of new ones.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.llm.common import MEMOS

_CUT = re.compile(r"(?<=\S) (?=\S)")
_OFTEN, _ONCE = 300_000, 200_000
#: Where a letter or digit meets a stop or comma: also a cut of the pattern.
_MARK = "\0"
_CLOSE = r"([A-Za-z0-9À-ÖØ-öø-ɏ])([.,])"
_PIECE_CHARS = 4_000_000
_MEMO_CHARS = 48
#: Pieces that the library gets as one text.
_TOGETHER = 256


def _odd(piece: str) -> bool:
    """Whether a piece is not what stands between two lone spaces (or a line feed or mark and a space)."""
    body = piece[1:] if piece[:1] in ("\n", _MARK) else piece
    return not body or body[0].isspace() or body[-1].isspace()


class Bpe:
    """Encodes texts to arrays of little-endian ids, ``width`` bytes an id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        pre = self.tokenizer.pre_tokenizer
        self.cuts = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.feed = self._whole(["\n"])[0] if self.cuts else None
        self.cuts = self.cuts and len(self.feed) == self.width
        self.memo: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4096):  # the library's results are large
            for encoding in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
                ids = array("H" if self.width == 2 else "I", encoding.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                out.append(ids.tobytes())
        return out

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without line feeds, many in a text: a line feed between two of them is a token of its own."""
        out: list[bytes] = []
        for first in range(0, len(pieces), 16 * _TOGETHER):
            groups = [pieces[at : at + _TOGETHER] for at in range(first, min(first + 16 * _TOGETHER, len(pieces)), _TOGETHER)]
            for group, ids in zip(groups, self._whole(["\n".join(g) for g in groups])):
                feeds = np.flatnonzero(np.frombuffer(ids, self.dtype) == np.frombuffer(self.feed, self.dtype)[0])
                if len(feeds) != len(group) - 1:
                    out += self._whole(group)
                    continue
                ends = (feeds * self.width).tolist()
                out += [ids[a:b] for a, b in zip([0, *(e + self.width for e in ends)], [*ends, len(ids)])]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, without special tokens."""
        return self.encode_column(pa.array([text]))[0]

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text of a string column; null is the empty text."""
        column = pc.fill_null(column, "")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        out: list[np.ndarray] = []
        while len(out) < len(sizes):
            at = len(out)
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE_CHARS)))
            some = column.slice(at, stop - at)
            out += self._some(some) if self.cuts else [np.frombuffer(x, self.dtype) for x in self._whole(some.to_pylist())]
        return out

    def _apart(self, text: str) -> np.ndarray:
        """A text with white space in unusual places: cut at fewer spaces."""
        parts = _CUT.split(text)
        return np.frombuffer(b"".join(self._whole([parts[0], *(" " + p for p in parts[1:])])) if text else b"", self.dtype)

    def _some(self, column: pa.Array) -> list[np.ndarray]:
        # the older half goes; frequent pieces come back at once
        if len(self.memo) > _OFTEN:
            self.memo = dict(islice(self.memo.items(), _OFTEN // 2, None))
        if len(self.once) > _ONCE:
            self.once = dict(islice(self.once.items(), _ONCE // 2, None))
        # a line feed before each text makes its head a piece like others; its id is dropped below
        fed = pc.binary_join_element_wise(pa.scalar("\n", column.type), column, pa.scalar("", column.type))
        fed = pc.replace_substring_regex(pc.replace_substring(fed, "\n", " \n"), _CLOSE, rf"\1 {_MARK}\2")
        lists = pc.split_pattern(fed, " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        index = coded.indices.to_numpy()
        pieces = coded.dictionary.to_pylist()
        ids = list(map(self.memo.get, pieces))
        new = [i for i, x in enumerate(ids) if x is None]
        odd = []
        rest = []
        for i in new:
            piece = pieces[i]
            if x := self.once.pop(piece, None):
                self.memo[piece] = ids[i] = x
            elif not piece.isalpha() and _odd(piece):
                odd.append(i)
                ids[i] = b""
            else:
                rest.append(i)
        fresh = [[], []]
        for i in rest:
            fresh[pieces[i][0] == "\n"].append(i)
        coded_now = chain(self._joined([pieces[i][1:] if pieces[i][0] == _MARK else " " + pieces[i] for i in fresh[0]]), self._whole([pieces[i] for i in fresh[1]]))
        for i, x in zip(chain(*fresh), coded_now):
            ids[i] = x
            if len(pieces[i]) <= _MEMO_CHARS:
                self.once[pieces[i]] = x
        strange = np.zeros(len(pieces), bool)
        strange[odd] = True
        # the empty piece before each text's line feed is the only one that belongs there
        apart = np.flatnonzero((np.add.reduceat(strange[index], offsets[:-1]) > 1) | pc.match_substring(column, _MARK).to_numpy(zero_copy_only=False))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.dtype)
        each = lengths[index]
        ends = np.cumsum(each)
        shift = (np.cumsum(lengths) - lengths)[index] - (ends - each)
        joined = flat[np.repeat(shift, each) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        out = [joined[a + 1 : b] for a, b in zip(bounds, bounds[1:])]
        for i in apart.tolist():
            out[i] = self._apart(column[i].as_py())
        return out


_LOADED: set[str] = set()


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One encoder for each file and Python worker."""
    _LOADED.add(path)
    return Bpe(path)


def _forget() -> None:
    for path in _LOADED:
        load(path).memo, load(path).once = {}, {}


MEMOS["bpe"] = _forget


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
