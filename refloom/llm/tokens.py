"""Token ids of whole texts from the public tokenizer files, word by word.

The tokenizers library splits a text before it merges, and no piece of either file
reaches across the start of a space that follows another character. So a text is cut
at its spaces, equal words are encoded once, and a text's ids are its words' ids, as
bytes, joined. Words of letters up to U+024F and ASCII are split here by the file's own
pattern and merged by the library's model; every other word, and every text with two
spaces in a row or with the mark that begins a special token, is encoded by the library
as a whole. Ids are those of encode(text, add_special_tokens=False), so the string of a
special token in a text becomes its id; tests compare with the plain call.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C
from .kernels import slices

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
KNOWN = 700_000
SPECIAL = "<|"
SIMPLE = " -~\n¡-¬®-įı-ɏ"
LOWERED = f"^[{SIMPLE}]*$"


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of single pieces, found when first asked for."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.table = tokenize, _byte_chars()

    def __missing__(self, piece: str) -> bytes:
        text = piece
        if not text.isascii() or "\n" in text:
            text = text.encode().decode("latin-1").translate(self.table)
        elif text[0] == " ":
            text = "\u0120" + text[1:].replace(" ", "\u0120")
        ids = self[piece] = array("I", [t.id for t in self.tokenize(text)]).tobytes()
        return ids


class _Words(dict):
    """Ids of words, found when first asked for; lead is put before each."""

    def __init__(self, lead: str, pieces: _Pieces, lower: bool, simple, split, whole):
        super().__init__()
        self.lead, self.pieces, self.lower = lead, pieces, lower
        self.simple, self.split, self.whole = simple, split, whole

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(",.")
        if core.isalpha() and (core.isascii() or self.simple(core)):
            ids = self.pieces[core.lower() if self.lower else self.lead + core]
            if len(core) < len(word):
                ids += self.pieces[word[len(core) :]]
        else:
            text = self.lead + word
            if not self.simple(text):
                ids = self.whole(text)
            else:
                ids = b"".join([self.pieces[p] for p in self.split(text.lower() if self.lower else text)])
        self[word] = ids
        return ids


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, folder: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(C.tokenizer_path(name, folder))
        self.words = name == WORD_BPE
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+" if self.words else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # characters on which this pattern and the library's agree and which no normaliser but lower case changes
        simple = re.compile(f"[{SIMPLE}]*").fullmatch
        self.pieces = _Pieces(self.tok.model.tokenize)
        rest = (self.pieces, self.words, simple, regex.compile(pattern).findall, self._whole)
        self.first, self.later = _Words("", *rest), _Words("" if self.words else " ", *rest)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def column(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array, one text after the other, and where
        each begins (n + 1 places); null is empty. Arrow splits the texts and numbers
        their words, so that only distinct words become Python strings."""
        arr = arr.fill_null("") if arr.null_count else arr
        odd = pc.match_substring(arr, SPECIAL)
        if not self.words:
            odd = pc.or_(odd, pc.match_substring(arr, "  "))
        whole: dict[int, bytes] = {}
        if pc.any(odd).as_py():
            whole = {i: self._whole(arr[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
            arr = pc.if_else(odd, "", arr)
        if self.words:  # white space is dropped, and splits as a space does
            arr = pc.replace_substring(arr, "\n", " ")
            arr = pc.if_else(pc.match_substring_regex(arr, LOWERED), pc.utf8_lower(arr), arr)
        parts = pc.split_pattern(arr, " ")
        numbered = parts.flatten().dictionary_encode()
        codes = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        off = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))].astype(np.int64)
        words = numbered.dictionary.to_pylist()
        ids = list(map(self.later.__getitem__, words))
        if not self.words:
            heads, place = np.unique(codes[off[:-1]], return_inverse=True)
            codes[off[:-1]] = len(ids) + place
            ids += [self.first[words[c]] for c in heads.tolist()]
        for i, own in whole.items():
            codes[off[i]] = len(ids)
            ids.append(own)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.r_[0, np.cumsum(size)]
        pool = np.frombuffer(b"".join(ids), "<u4")
        n = size[codes]
        ends = np.cumsum(n)
        flat = pool[np.repeat(start[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        for known in (self.first, self.later, self.pieces):
            if len(known) > KNOWN:
                known.clear()
        return flat, np.r_[0, ends][off]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        if not texts:
            return []
        flat, at = self.column(pa.array(texts, pa.string()))
        return [flat[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def encode_column(encoder: Encoder, arr: pa.Array, limit: int = 1 << 22):
    """Ids of each text of a string array, taken about `limit` bytes at a time."""
    for i, j in slices(arr, limit):
        flat, at = encoder.column(arr.slice(i, j - i))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            yield flat[x:y].tobytes()
