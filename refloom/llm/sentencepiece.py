"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked as the library does (a space becomes U+2581, one is put in front)
and cut into words at its marks, which no piece of the vocabulary reaches across. The
distinct words of a run of texts are sorted, so that they are a trie in depth-first
order: the forward pass over a word starts where it leaves the word before it and
reuses the states of their common prefix. Back pointers give the pieces. Where many words
are new, the same trie is passed over level by level, all prefixes of a length at once;
long words, of which few share a level, are left to the pass word by word.

* The Viterbi state of a prefix is the score of its best segmentation. For a unigram
  model its pieces are the ids.
* The public vocabulary is a byte-pair model, whose ids are not the best sum of its
  scores, so that plain Viterbi gives wrong ids. There the state of a prefix is also the
  last piece of its byte-pair encoding: the one piece that ends there, joins a prefix
  whose own last piece is known, and stays apart from that piece in merging. The same
  pass over the trie finds both; this state gives exactly the library's ids, and the
  Viterbi segmentation those of the same vocabulary read as a unigram model.

Characters that are no piece become byte pieces (or the unknown piece). Null and empty
texts have no ids. Decoding joins pieces and bytes; invalid bytes become U+FFFD. A
U+2581 in a text is decoded as a space, as by the library: such texts alone don't
come back as they were. Of equal sums the longest last piece counts, as in the library.
Repeated rows have equal results, very long texts are encoded whole, an empty table gives
no rows, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import random
import re
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .kernels import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES = "piece_bpe_32k.model"
KNOWN = 400_000
UNK = -1
#: At least so many new words, none longer than so many characters, are passed over by level.
MANY, LONG = 256, 32


def _fields(data: bytes):
    """Field number and value of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            value = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    byte_fallback: bool
    dummy_prefix: bool


def load(path: str) -> Model:
    """A model file whose normaliser changes nothing but spaces."""
    with open(path, "rb") as f:
        data = f.read()
    m = Model([], [], [], False, False, True)
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(piece.get(2, 0.0))
            m.kinds.append(piece.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
            kind = trainer.get(3, 1)
            if kind not in (1, 2):
                raise ValueError("only unigram and byte-pair models are read")
            m.bpe, m.byte_fallback = kind == 2, bool(trainer.get(35, 0))
        elif field == 3:
            norm = dict(_fields(value))
            if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                raise ValueError("only the identity normaliser with escaped, unreduced spaces is read")
            m.dummy_prefix = bool(norm.get(3, 1))
    if USER in m.kinds or UNUSED in m.kinds:
        raise ValueError("user-defined and unused pieces aren't read")
    return m


def merged(text: str, rank: dict[str, int]) -> list[str]:
    """Byte-pair encoding by the merges themselves: the pair of best rank first, the
    leftmost of several."""
    parts = list(text)
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Pairs:
    """Numbers of pairs (row, column), looked up in bulk: the rows of a sparse table,
    laid over one another so that no two numbers meet. What isn't there is -1."""

    def __init__(self, pairs: dict[tuple[int, int], int], rows: int, width: int):
        by_row: dict[int, list[int]] = {}
        for a, b in pairs:
            by_row.setdefault(a, []).append(b)
        self.at = np.zeros(rows, np.int64)
        room, draw = 8 * len(pairs) + 1, random.Random(0)
        taken = np.zeros(room + width, bool)
        for a, columns in sorted(((a, c) for a, c in by_row.items() if len(c) > 1), key=lambda x: -len(x[1])):
            c = np.array(columns)
            at, tries = draw.randrange(room), 0
            while taken[c + at].any():
                at, tries = draw.randrange(room), tries + 1
                if tries % 64 == 0:
                    taken, room = np.concatenate([taken, np.zeros(room, bool)]), 2 * room
            taken[c + at] = True
            self.at[a] = at
        lone = [(a, c[0]) for a, c in by_row.items() if len(c) == 1]
        free = np.flatnonzero(~taken[width:])[: len(lone)] + width  # enough: there are eight places for each pair
        for (a, b), place in zip(lone, free.tolist()):
            self.at[a] = place - b
        size = int(self.at.max(initial=0)) + width
        self.row, self.value = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        a, b = np.array(list(pairs), np.int64).reshape(-1, 2).T
        self.row[self.at[a] + b] = a
        self.value[self.at[a] + b] = list(pairs.values())

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = self.at[a] + b
        return np.where(self.row[place] == a, self.value[place], -1)


class Levels:
    """The forward pass over many words at once, level by level of their trie."""

    def __init__(self, encoder: Encoder):
        m = encoder.model
        self.bpe, self.byte_fallback, self.low = m.bpe, m.byte_fallback, encoder.low
        often: dict[str, int] = {}
        nodes, pairs, seen = [encoder.back], [], 0
        while seen < len(nodes):  # numbers the nodes of the pieces read backwards
            for ch, node in nodes[seen].items():
                if ch is not None:
                    pairs.append((seen, ch, len(nodes)))
                    often[ch] = often.get(ch, 0) + 1
                    nodes.append(node)
            seen += 1
        kind = {ch: i for i, ch in enumerate(sorted(often, key=lambda ch: -often[ch]), 1)}
        self.kind = np.zeros(0x110000, np.uint16 if len(kind) < 1 << 16 else np.int32)  # 0: in no piece
        for ch, i in kind.items():
            self.kind[ord(ch)] = i
        self.child = Pairs({(a, kind[ch]): b for a, ch, b in pairs}, len(nodes), len(kind) + 1)
        found = [node.get(None, (UNK, 0.0, -1)) for node in nodes]
        self.piece, self.score, self.number = (np.array(x, t) for x, t in zip(zip(*found), (np.int32, np.float64, np.int32)))
        if m.bpe:
            size = max(encoder.split, default=-1) + 1
            self.chars = sum(n == a for n, (a, _) in encoder.split.items())
            self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
            for n, (a, b) in encoder.split.items():
                self.left[n], self.right[n] = a, b
            self.joined = Pairs(encoder.joined, size, size)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Encoder._apart of each pair."""
        out, of = np.zeros(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), 1 << 60)
        while len(of):
            made = self.joined.get(x, y)
            go = (made < 0) | (made >= limit)
            single = np.maximum(x, y) < self.chars
            out[of[go & single]] = True
            go &= ~single
            of, x, y = of[go], x[go], y[go]
            later = x > y  # undo the later of the two merges
            limit = np.where(later, x, y + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return out

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the sorted, distinct words, none empty: pieces (or UNK) and their starts, one
        word's behind the other's; where each word's end; and how many ids each word's best
        segmentation has."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[code]
        first = np.cumsum(size) - size  # character of each word
        base = first + np.arange(n)  # and place of its empty prefix
        node = np.zeros(len(code) + n, np.int32)  # of each prefix of each word; 0 is the empty one
        # by node, as in Encoder._forward
        number, score = np.full(len(code) + 1, -1, np.int32), np.zeros(len(code) + 1)
        last, where = np.full(len(code) + 1, UNK, np.int32), np.zeros(len(code) + 1, np.int32)
        count, unknown = np.zeros(len(code) + 1, np.int32), np.zeros(len(code) + 1, bool)  # of the best segmentation: its ids, and whether it ends in none
        made, alive = 1, np.arange(n)
        for end in range(1, int(size.max(initial=0)) + 1):
            alive = alive[size[alive] >= end]
            before, ch = node[base[alive] + end - 1], code[first[alive] + end - 1]
            new = np.ones(len(alive), bool)
            new[1:] = (before[1:] != before[:-1]) | (ch[1:] != ch[:-1])
            node[base[alive] + end] = np.cumsum(new) + (made - 1)
            own, w, before, ch = slice(made, made + int(new.sum())), alive[new], before[new], ch[new]
            made = own.stop
            number_, last_, where_ = number[own], last[own], where[own]  # views
            where_[:] = end - 1
            top, from_, known = score[before] + self.low, before.copy(), np.zeros(len(w), bool)
            tried = []  # of byte-pair encoding: nodes, pieces and the ancestors and starts they join
            of, at = np.arange(len(w)), np.zeros(len(w), np.int64)
            chars, prefixes = first[w], base[w]
            for i in range(end - 1, -1, -1):
                at = self.child.get(at, kind[chars[of] + i])
                there = at >= 0
                of, at = of[there], at[there]
                if not len(of):
                    break
                ends = self.piece[at] >= 0
                to, p = of[ends], at[ends]
                ancestor = node[prefixes[to] + i]
                s = score[ancestor] + self.score[p]
                better = s >= top[to]
                b = to[better]
                top[b], from_[b], known[b] = s[better], ancestor[better], True
                if self.bpe:
                    merged_ = self.number[p] >= 0
                    tried.append((to[merged_], p[merged_], ancestor[merged_], np.full(np.count_nonzero(merged_), i)))
                else:
                    last_[b], where_[b] = self.piece[p[better]], i
            if tried:
                to, p, ancestor, start = map(np.concatenate, zip(*tried[::-1]))  # of several, the shortest counts: it is written last
                q, m = number[ancestor], self.number[p]
                fits = q < 0
                fits[~fits] = self.apart(q[~fits], m[~fits])
                to = to[fits]
                last_[to], where_[to], number_[to] = self.piece[p[fits]], start[fits], m[fits]
            score[own], unknown[own] = top, ~known
            spelled = 1 + (ch >= 0x80) + (ch >= 0x800) + (ch >= 0x10000) if self.byte_fallback else 1 - unknown[before]
            count[own] = count[from_] + np.where(known, 1, spelled)
        steps, of, to = [], np.arange(n), size.copy()
        while len(of):
            at = node[base[of] + to[of]]
            steps.append((of, last[at], where[at]))
            to[of] = where[at]
            of = of[to[of] > 0]
        ends = np.cumsum(np.bincount(np.concatenate([x[0] for x in steps]), minlength=n)) if steps else np.zeros(0, np.int64)
        pieces, starts = np.zeros(int(ends[-1]) if n else 0, np.int32), np.zeros(int(ends[-1]) if n else 0, np.int32)
        for k, (of, p, i) in enumerate(steps, 1):
            pieces[ends[of] - k], starts[ends[of] - k] = p, i
        return pieces, starts, ends, count[node[base + size]]


class Encoder:
    def __init__(self, model: Model):
        self.model = m = model
        normal = [i for i, k in enumerate(m.kinds) if k == NORMAL and m.pieces[i]]
        self.whole = any(MARK in m.pieces[i].lstrip(MARK) for i in normal)  # then texts aren't cut
        self.byte = {}
        for i, k in enumerate(m.kinds):
            if k == BYTE:
                self.byte[int(m.pieces[i][3:5], 16)] = i
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
        if m.bpe:
            self._rank(normal)
        self.low = min((m.scores[i] for i in normal), default=0.0) - 10.0
        self.back: dict = {}  # pieces by their characters from the last to the first; None: the piece, its score and number
        for i in normal:
            node = self.back
            for ch in reversed(m.pieces[i]):
                node = node.setdefault(ch, {})
            node[None] = (i, m.scores[i], self.number.get(i, -1) if m.bpe else -1)
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.best: dict[str, int] = {}  # ids of the Viterbi segmentation
        self.levels: Levels | None = None  # made when first needed

    def _rank(self, normal: list[int]) -> None:
        """Numbers pieces in the order in which merges make them, and finds for each
        the two that its last merge joins. Pieces that merging never makes are left."""
        m = self.model
        rank = {m.pieces[i]: r for r, i in enumerate(sorted((i for i in normal if len(m.pieces[i]) > 1), key=lambda i: (-m.scores[i], i)))}
        chars = [i for i in normal if len(m.pieces[i]) == 1]
        self.number, self.split, self.joined = {}, {}, {}
        by_text = {}
        for r, i in enumerate(chars):
            self.number[i] = by_text[m.pieces[i]] = r
            self.split[r] = (r, r)
        single = set(by_text)
        ids = {m.pieces[i]: i for i in normal}
        for text, r in rank.items():
            if not set(text) <= single:
                continue
            parts = _last_two(text, rank)
            if parts is None or parts[0] not in by_text or parts[1] not in by_text:
                continue
            n = len(chars) + r
            a, b = by_text[parts[0]], by_text[parts[1]]
            by_text[text] = self.number[ids[text]] = n
            self.split[n] = (a, b)
            self.joined[a, b] = n

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces numbered a and b leaves these two."""
        key = a << 32 | b
        got = self.apart.get(key)
        if got is None:
            x, y, limit = a, b, 1 << 60
            while True:
                made = self.joined.get((x, y))
                if made is not None and made < limit:
                    got = False
                    break
                if x > y:  # undo the later of the two merges
                    limit, x = x, self.split[x][1]
                    if x == limit:
                        limit, y = y + 1, self.split[y][0]
                        if y + 1 == limit:
                            got = True
                            break
                else:
                    limit, y = y + 1, self.split[y][0]
                    if y + 1 == limit:
                        limit, x = x, self.split[x][1]
                        if x == limit:
                            got = True
                            break
            self.apart[key] = got
        return got

    def words(self, text: str) -> list[str]:
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return [marked] if self.whole else re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)

    def _forward(self, words: list[str]):
        """(word, pieces, best pieces) of each of the sorted words: those of the ids and
        those of the Viterbi segmentation, as (piece or UNK, start, end)."""
        back, low, apart, bpe = self.back, self.low, self.apart, self.model.bpe
        number, score = [-1], [0.0]  # by place: of the last piece of the prefix that ends there, and of its best segmentation
        pointers = [(UNK, 0, UNK, 0)]  # last piece and its start, of the ids and of the best segmentation
        before = ""
        for word in words:
            n = len(word)
            at, most = 0, min(n, len(before))
            while at < most and word[at] == before[at]:
                at += 1
            at += 1
            del number[at:], score[at:], pointers[at:]
            for end in range(at, n + 1):
                node, i, open_ = back, end, bpe
                last, where, k = UNK, end - 1, -1
                best, from_, top = UNK, end - 1, score[end - 1] + low  # below any piece of one character
                while i:
                    i -= 1
                    node = node.get(word[i])
                    if node is None:
                        break
                    found = node.get(None)
                    if found is not None:
                        p, s, m = found
                        s += score[i]
                        if s >= top:
                            best, from_, top = p, i, s
                        if open_ and m >= 0:
                            q = number[i]
                            if q >= 0:
                                fits = apart.get(q << 32 | m)
                                if fits is None:
                                    fits = self._apart(q, m)
                            if q < 0 or fits:
                                last, where, k, open_ = p, i, m, False
                score.append(top)
                number.append(k)
                pointers.append((last, where, best, from_))
            before = word
            out, i = [], n
            while bpe and i:
                p, j, _, _ = pointers[i]
                out.append((p, j, i))
                i = j
            best_out, i = [], n
            while i:
                _, _, p, j = pointers[i]
                best_out.append((p, j, i))
                i = j
            best_out.reverse()
            out.reverse()
            yield word, out if bpe else best_out, best_out

    def learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self.known))
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            self.best.clear()
            new = sorted(words)
        short = [w for w in new if 0 < len(w) <= LONG]
        if len(short) >= MANY:
            self._learn_levels(short)
            new = [w for w in new if not 0 < len(w) <= LONG]
        for word, parts, best in self._forward(new):
            ids = [p for p, _, _ in parts]
            self.known[word] = array("I", self._ids(word, parts) if UNK in ids else ids).tobytes()
            self.best[word] = len(self._ids(word, best) if UNK in [p for p, _, _ in best] else best)

    def _learn_levels(self, words: list[str]) -> None:
        self.levels = self.levels or Levels(self)
        pieces, starts, ends, best = self.levels(words)
        raw, to = pieces.tobytes(), ends.tolist()
        cuts = list(zip([0, *to[:-1]], to))
        self.known.update(zip(words, [raw[4 * i : 4 * j] for i, j in cuts]))
        self.best.update(zip(words, best.tolist()))
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(pieces == UNK), side="right")).tolist():
            (i, j), word = cuts[k], words[k]
            at = starts[i:j].tolist()
            self.known[word] = array("I", self._ids(word, list(zip(pieces[i:j].tolist(), at, [*at[1:], len(word)])))).tobytes()

    def _ids(self, word: str, parts: list[tuple[int, int, int]]) -> list[int]:
        ids: list[int] = []
        run = False
        for p, i, j in parts:
            if p != UNK:
                ids.append(p)
            elif self.model.byte_fallback:
                ids += [self.byte[b] for b in word[i:j].encode()]
            elif not run:
                ids.append(self.unknown)
            run = p == UNK
        return ids

    def forget(self) -> None:
        """Drops words and what they needed; tables stay."""
        self.known.clear()
        self.best.clear()
        self.apart.clear()

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation by the sum of scores."""
        words = self.words(text) if text else []
        best = {w: self._ids(w, b) for w, _, b in self._forward(sorted(set(words)))}
        return [i for w in words for i in best[w]]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        return [ids for ids, _ in self.both(texts)]

    def both(self, texts: list[str | None]) -> list[tuple[bytes, int]]:
        """Ids of each text, and the number of those of its best segmentation."""
        parts = []
        for t in texts:
            if not t:
                parts.append([])
            elif self.whole or "  " in t or t[-1] == " " or not self.model.dummy_prefix or MARK in t:
                parts.append(self.words(t))
            elif t[0] == " ":
                w = (MARK + t.replace(" ", " " + MARK)).split(" ")
                parts.append([w[0] + w[1], *w[2:]])
            else:
                parts.append((MARK + t.replace(" ", " " + MARK)).split(" "))
        self.learn(set().union(*parts) if parts else set())
        known, best = self.known.__getitem__, self.best.__getitem__
        out = [(b"".join(map(known, p)), sum(map(best, p))) for p in parts]
        if len(self.known) > KNOWN:
            self.known.clear()
            self.best.clear()
        return out


def _last_two(text: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The pair that the last merge of a piece joins, or None if merging ends in other
    pieces."""
    parts = list(text)
    while len(parts) > 2:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@functools.lru_cache(maxsize=1)
def _coders(path: str, changed: tuple[int, int]) -> tuple[Encoder, Decoder]:
    """Made once in a worker, which serves many tasks."""
    model = load(path)
    return Encoder(model), Decoder(model)


class Decoder:
    def __init__(self, model: Model):
        self.dummy_prefix = model.dummy_prefix
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds)]

    def __call__(self, ids: bytes) -> str:
        a = array("I")
        a.frombytes(ids)
        text = b"".join(map(self.raw.__getitem__, a)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def encode(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and either the ids or, for ids=False, a digest: ids_crc32 (of
    little-endian unsigned 32-bit ids), decoded_sha256, lossless (the decoded ids are
    the text) and n_viterbi (ids of the best segmentation by scores)."""
    path = path or C.tokenizer_path(PIECES)

    def run(batches):
        file = os.stat(path)
        encoder, decoder = _coders(path, (file.st_mtime_ns, file.st_size))
        encoder.forget()
        for b in batches:
            for i, j in slices(b.column(1), 1 << 22):
                texts = b.column(1).slice(i, j - i).to_pylist()
                got, best = map(list, zip(*encoder.both(texts)))
                n = pa.array([len(g) // 4 for g in got], pa.int64())
                own = b.column(0).slice(i, j - i)
                if ids:
                    yield pa.RecordBatch.from_arrays([own, n, pa.array([array("I", g).tolist() for g in got], pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
                else:
                    back = [decoder(g) for g in got]
                    yield pa.RecordBatch.from_arrays([own, n, pa.array([zlib.crc32(g) for g in got], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([t == (x or "") for t, x in zip(back, texts)], pa.bool_()), pa.array(best, pa.int64())], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless", "n_viterbi"])

        encoder.forget()

    return C.doc_columns(docs, "doc_id", "text").mapInArrow(C.lean(run), "doc_id bigint, n_tokens bigint, " + ("ids array<int>" if ids else "ids_crc32 bigint, decoded_sha256 string, lossless boolean, n_viterbi bigint"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids). Null ids give null."""
    path = path or C.tokenizer_path(PIECES)

    def run(batches):
        decoder = Decoder(load(path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decoder(array("I", x).tobytes()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(C.lean(run), "doc_id bigint, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents"), ids=False)
