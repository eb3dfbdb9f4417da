"""Benchmark decontamination by pigeonhole edit matching with Myers' bit-parallel distance."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, with_place, written

#: Edits allowed, as a share of an item's normalized length.
BUDGET = 0.08
#: Normalized items shorter than this are found as whole words without any edit.
LEAST_CHARS = 24
#: Characters of items per automaton, so that its size is bounded whatever the size of the test set.
BLOCK_CHARS = 2_000_000
MATCHES = "item_id long, edits int, item_chars int, start int, end int"

_WORD = re.compile(r"[^\W_]+")


def normalized(text: str) -> str:
    """Lower-cased words joined by single blanks."""
    return " ".join(_WORD.findall(text)).lower()


def places(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Where each word begins in ``normalized(text)``, and its span in ``text``."""
    begins, spans, at = [], [], 0
    for m in _WORD.finditer(text):
        begins.append(at)
        spans.append(m.span())
        at += len(m.group().lower()) + 1
    return begins, spans


def pieces(item: str, budget: float = BUDGET) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k and the k + 1 pieces (offset, text): with k edits at most, one piece stays whole."""
    k = int(len(item) * budget)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int, start_free: bool = True) -> tuple[int, int] | None:
    """(edits, end) of the best match of all of ``pattern`` that ends in ``text``, or None if it needs over ``k`` edits.

    Bit-parallel over the pattern in whole-number arithmetic. ``start_free``: the match may begin anywhere, else at 0.
    Of equally good ends the first counts.
    """
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    if m <= k:
        best = (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = (ph << 1) & full
        if not start_free:
            ph |= 1
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def grams(text: str) -> Counter:
    """Runs of three characters with their counts."""
    return Counter(zip(text, text[1:], text[2:]))


class Finder:
    """All matches of a list of items (id, text) in a text; each item counts by itself, whatever its id."""

    def __init__(self, items: list[tuple[int | None, str | None]], budget: float = BUDGET, least_chars: int = LEAST_CHARS):
        self.items, where = [], defaultdict(list)
        for key, text in items:
            text = normalized(text or "")
            if not text:
                continue
            k, parts = pieces(text, budget) if len(text) >= least_chars else (0, [(0, text)])
            for at, p in parts:
                where[p].append((len(self.items), at))
            self.items.append((key, text, k, len(text) < least_chars, grams(text)))
        self.auto = ahocorasick.Automaton()
        for p, at in where.items():
            self.auto.add_word(p, (len(p), at))
        if where:
            self.auto.make_automaton()

    def find(self, raw: str | None) -> Iterator[tuple[int | None, int, int, int, int]]:
        """(item, edits, item length, start, end), start and end in ``raw``; overlapping matches of an item count once."""
        if not raw or not self.items:
            return
        text, words = normalized(raw), None
        if not text:
            return
        hits = defaultdict(set)
        for end, (n, at) in self.auto.iter(text):
            for i, offset in at:
                hits[i].add(end + 1 - n - offset)
        for i, diagonals in hits.items():
            key, item, k, whole, _ = self.items[i]
            if whole:
                found = [(d, d + len(item), 0) for d in diagonals if (not d or text[d - 1] == " ") and text[d + len(item) : d + len(item) + 1] in ("", " ")]
            else:
                found = self._verified(i, text, sorted(diagonals))
            last, kept = None, []
            for begin, end, edits in sorted(found):
                if last and begin < last[1]:
                    if edits < last[2]:
                        kept[-1] = last = (begin, end, edits)
                    continue
                last = (begin, end, edits)
                kept.append(last)
            for begin, end, edits in kept:
                begins, spans = words = words or places(raw)
                a, b = bisect_right(begins, begin) - 1, bisect_right(begins, max(begin, end - 1)) - 1
                yield key, edits, len(item), spans[a][0], spans[b][1]

    def _verified(self, i: int, text: str, diagonals: list[int]) -> list[tuple[int, int, int]]:
        """(begin, end, edits) of the best match around each run of diagonals."""
        _, item, k, _, own = self.items[i]
        # k edits change 3k runs of three at most, so a match shares the others with its surroundings
        least, found, group = len(item) - 2 - 3 * k, [], []
        for d in [*diagonals, None]:
            if group and (d is None or d - group[0] > k):
                lo, hi = max(0, group[0] - k), min(len(text), group[-1] + len(item) + k)
                window = text[lo:hi]
                if (least <= 0 or (own & grams(window)).total() >= least) and (got := myers(item, window, k)):
                    edits, end = got
                    # the start: the same match read backwards from its end
                    back = text[max(lo, lo + end - len(item) - k) : lo + end][::-1]
                    begin = lo + end - myers(item[::-1], back, k, start_free=False)[1]
                    found.append((begin, lo + end, edits))
                group = []
            if d is not None:
                group.append(d)
        return found


_made: dict = {}
_KINDS = [pa.int64(), *[pa.int32()] * 4]


def _matches(items, budget: float, least_chars: int):
    """Matches of the last column's texts, each with the row's other columns before it."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = items.value[0]
        if mark not in _made:
            _made.clear()
            _made[mark] = Finder(items.value[1], budget, least_chars)
        finder = _made[mark]
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for hit in finder.find(text.as_py()):
                    row.append(i)
                    out.append(hit)
            cols = list(zip(*out)) if out else [[]] * 5
            own = [batch.column(c).take(pa.array(row, pa.int32())) for c in range(batch.num_columns - 1)]
            yield pa.record_batch([*own, *(pa.array(c, t) for c, t in zip(cols, _KINDS))], [*batch.schema.names[:-1], "item_id", "edits", "item_chars", "start", "end"])

    return match


def _found(rows: DataFrame, benchmark: DataFrame, budget: float, item_col: str, item_text_col: str, block_chars: int, least_chars: int) -> DataFrame:
    """The matches in ``rows``, whose last column is the text; the other columns stay."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-total // block_chars)), None
    own = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    for b in range(blocks):
        of = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow().to_pylist()
        held = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item_id"], r["text"]) for r in of]))
        part = rows.mapInArrow(_matches(held, budget, least_chars), f"{own}, {MATCHES}")
        out = part if out is None else out.unionByName(part)
    return out


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    budget: float = BUDGET,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """(doc_id, item_id, edits, item_chars, start, end): each passage of a document that is a benchmark item but for
    ``budget`` of its length in edits; start and end are character offsets in the document's text.

    Texts and items are compared as lower-cased words joined by single blanks. An item with an error budget of k is
    split into k + 1 pieces, of which one at least is found whole in any match; an automaton finds all pieces of all
    items in one pass over the whole text, however long, and each hit's surroundings are verified with Myers'
    algorithm. An item of fewer than ``least_chars`` characters is found as whole words without edits. Items are
    the stated query set: they go to the executors in blocks of ``block_chars`` characters, one pass each, so that an
    automaton's size is bounded; documents are never shuffled.

    Null and empty texts and items, and those without letters or digits, match nothing. Null ids of either kind are
    reported as null. Every row is judged by itself: repeated rows, and items that share an id, are reported each.
    Of matches of an item that overlap the one with the fewest edits counts, of equal ones the first. Empty tables give
    an empty result; columns of other names are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _found(base, benchmark, budget, item_col, item_text_col, block_chars, least_chars)


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    budget: float = BUDGET,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Each row is judged by its own text, whatever its id: rows
    are told apart by their place in the files of ``docs`` (a table that is not read from files is written first)."""
    placed = with_place(docs, "documents")
    found = _found(placed.select("__file", "__at", F.col(text_col).alias("__text")), benchmark, budget, item_col, item_text_col, block_chars, least_chars)
    found = written(found.select("__file", "__at").distinct(), "leaks")
    return placed.join(small_side(found), ["__file", "__at"], "left_anti").select(*docs.columns)


def op3_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; see ``leaks`` for nulls, empty and very long texts, ties, repeated rows,
    empty tables and other columns."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
