"""Quality rules with suffix-array repetition.

A text's suffix array and longest common prefixes give its maximal repeated
substrings of at least `min_bytes` UTF-8 bytes. The union of their spans may cover
at most `max_covered` of the text and none may be longer than `max_longest`. Texts
without any repeated window of min_bytes have no such substring and get no suffix
array: one vectorised pass over a batch finds the others.

The base rules see repeated words; suffix arrays also see what repeats without white
space (encoded data, scripts that don't part words), where no five words do.

Nulls and empty texts have no words and fail the base rules. Very long texts are measured
whole, as a batch of their own; repeated rows have equal results, an empty table none.
Columns other than doc_id and text are not read by `quality_rules`; `keep_good` carries
them along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import kernels as K

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CHUNK = 1 << 19


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    min_bytes: int = 48
    max_covered: float = 0.3
    max_longest: int = 2000


def suffix_array(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of b, and the common prefix of each suffix with the one before
    it in that order (the first has 0). Prefix doubling from eight bytes on."""
    n = len(b)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # nine bits a symbol, so that the end of the text (0) sorts before byte 0
    sym = np.zeros(n + 8, np.uint64)
    sym[:n] = b.astype(np.uint64) + np.uint64(1)
    key = sym[:n].copy()
    for i in range(1, 7):
        key = (key << np.uint64(9)) | sym[i : n + i]
    levels, width = [], 7
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[0] = 1
        np.cumsum(s[1:] != s[:-1], out=new[1:])
        new[1:] += 1
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append((width, rank.astype(np.int32) if n < 1 << 31 else rank))
        if new[-1] == n or width >= n:
            break
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        key = rank * np.int64(n + 1) + after
        width *= 2
    a, c = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for width, rank in reversed(levels):
        rank = np.append(rank, [-1])
        pa_, pc = np.minimum(a + lcp, n), np.minimum(c + lcp, n)
        lcp += np.where((rank[pa_] == rank[pc]) & (pa_ != pc), width, 0)
    sym = sym.astype(np.int64)
    for _ in range(6):
        pa_, pc = np.minimum(a + lcp, n), np.minimum(c + lcp, n)
        lcp += (sym[pa_] == sym[pc]) & (sym[pa_] > 0)
    return order, np.r_[0, lcp]


def repeats(b: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Mask of the bytes in repeated substrings of `least` bytes or more, and the
    longest one's length: from the intervals of the common prefixes."""
    order, lcp = suffix_array(b)
    longest = np.maximum(lcp, np.r_[lcp[1:], 0])
    at = longest >= least
    if not at.any():
        return np.zeros(len(b), bool), 0
    return K.union_mask(order[at], order[at] + longest[at], len(b)), int(longest.max())


def measure(arr: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The measures of each text of a string array."""
    b, off = K.utf8(arr)
    n = len(off) - 1
    lens = np.diff(off)
    space = SPACE[b]
    salt = K.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    is_start = np.zeros(len(b) + 1, bool)
    is_start[off[:-1][lens > 0]] = True
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1] | is_start[1:-1]
    ws = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= space[1:] | is_start[1:-1]
    we = np.flatnonzero(last) + 1
    out = {
        "n_words": K.sums(first, off),
        "word_chars": K.sums(word & ((b & 0xC0) != 0x80), off),
        "n_symbols": K.sums(SYMBOL[b], off),
    }
    doc = np.repeat(np.arange(n), out["n_words"])

    line_break = b == 10
    ends = np.flatnonzero(line_break | np.r_[is_start[1:-1], np.ones(min(1, len(b)), bool)])
    # a line ends before its \n, or after the last byte of the text
    le = np.where(line_break[ends], ends, ends + 1)
    ls = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    words_before = np.r_[0, np.cumsum(first)]
    some = words_before[le] > words_before[ls]
    ls, le = ls[some], le[some]
    ldoc = np.searchsorted(off, ls, side="right") - 1
    lkey = K.span_hash(b, ls, le) ^ salt[ldoc]
    earlier = np.ones(len(ls), bool)
    earlier[np.unique(lkey, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(ldoc[earlier], minlength=n).astype(np.int64)

    w, m = rules.window, len(ws)
    covered = np.zeros(m, bool)
    if m >= w:
        h = K.span_hash(b, ws, we)
        key = h[: m - w + 1].copy()
        for i in range(1, w):
            key = K.join_hash(key, h[i : m - w + 1 + i], 0)
        own = np.flatnonzero(doc[: m - w + 1] == doc[w - 1 :])
        again = own[K.repeated(key[own] ^ salt[doc[own]])]
        covered = K.union_mask(again, again + w, m)
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n).astype(np.int64)

    out["repeat_bytes"], out["longest_repeat"] = np.zeros(n, np.int64), np.zeros(n, np.int64)
    h = K.window_hash(b, rules.min_bytes)
    inside = np.repeat(np.arange(n), lens)[: len(h)]
    whole = np.arange(len(h)) + rules.min_bytes <= off[1:][inside]
    at = np.flatnonzero(whole)
    again = at[K.repeated(h[at] ^ salt[inside[at]])]
    for d in np.unique(inside[again]).tolist():
        mask, longest = repeats(b[off[d] : off[d + 1]], rules.min_bytes)
        out["repeat_bytes"][d], out["longest_repeat"][d] = int(mask.sum()), longest
    out["n_bytes"] = lens
    bad = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    out["base_failed"] = bad
    out["kept"] = ~bad & (out["repeat_bytes"] <= rules.max_covered * lens) & (out["longest_repeat"] <= rules.max_longest)
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bytes", "repeat_bytes", "longest_repeat"]
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_bytes bigint, repeat_bytes bigint, longest_repeat bigint"


def _all(arr: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    parts = [measure(arr.slice(i, j - i), rules) for i, j in K.slices(arr, CHUNK)]
    return {c: np.concatenate([p[c] for p in parts]) for c in COLUMNS} if parts else {}


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of docs (doc_id, text): measures and verdict. A document
    without words, null included, has zeros, base_failed and not kept; equal rows
    get equal results; an empty table gives an empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        got = _all(batch.column(1), rules)
        if not got:
            return None
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[c]) for c in COLUMNS]], names=["doc_id", *COLUMNS])

    return C.arrow_map(C.doc_columns(docs, "doc_id", "text"), run, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        got = _all(batch.column(at), rules)
        return batch.filter(pa.array(got["kept"])) if got else None

    return C.arrow_map(docs, run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents")).drop("longest_repeat")


#: The query's rows for DuckDB. A substring of 48 bytes or more repeats where a window of
#: 48 bytes does, and one of over 2000 bytes where a window of 2001 does; windows are cut
#: from hexadecimal bytes and compared by MD5.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, '')))::BIGINT n FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) > 1 again FROM (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') k FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) p FROM d))),
gr AS (SELECT doc_id, sum(least(5, coalesce(nxt - p, 5)))::BIGINT covered FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) nxt FROM g WHERE again) GROUP BY 1),
b AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) > 1 again FROM (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 96)) k FROM (SELECT doc_id, h, unnest(range(n - 47)) p FROM d))),
br AS (SELECT doc_id, sum(least(48, coalesce(nxt - p, 48)))::BIGINT covered FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) nxt FROM b WHERE again) GROUP BY 1),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(substr(h, 2 * p + 1, 4002)) k FROM (SELECT doc_id, h, unnest(range(n - 2000)) p FROM d SEMI JOIN (SELECT doc_id FROM br WHERE covered > 2000) USING (doc_id))) GROUP BY doc_id, k HAVING count(*) > 1),
m AS (SELECT d.doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, coalesce(gr.covered, 0) n_repeat_words, n n_bytes, coalesce(br.covered, 0) repeat_bytes, long.doc_id IS NOT NULL is_long FROM d LEFT JOIN gr USING (doc_id) LEFT JOIN br USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND repeat_bytes <= 0.3 * n_bytes AND NOT is_long AS kept, n_bytes, repeat_bytes FROM m
"""
