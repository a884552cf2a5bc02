"""Source divergence audit: how the words of each source differ from the other sources of its language.

A term is a run of ASCII letters and characters beyond ASCII, A to Z in lower case, taken as UTF-8 bytes.  Each language keeps
the terms that ``LEAST`` or more of its documents hold.  They are found by iceberg prefix refinement: a level counts, for the
prefixes of one length, the documents that hold them; prefixes below ``LEAST`` are discarded with all that begins with them;
the next, longer level counts only what begins with a prefix that is left.  Terms no longer than a level's prefixes are counted
whole, and kept or not, there.  Lengths grow by ``GROWTH`` from ``FIRST``, so the passes grow with the logarithm of the longest
prefix that enough documents share.

A pass reads the documents and adds up prefixes within each task before any row leaves it; the tables that meet in the shuffle
hold one row per task and prefix.  The prefixes that are left travel to the next pass as a bit table of fixed size (``BITS``): it may
let through a prefix that was discarded, whose terms are then counted and fail by their own count, so results are exact.

Counts, probabilities and scores are integers: p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) for a term in a group of N kept
occurrences and V kept terms of the language, and f = floor((p - q)^2 / (p + q)) between two such.

Pairs of sources are compared by blocks of terms: each task has all sources of a language and some of its terms, and emits one
partial sum per pair; a language's blocks follow from its cells, so none outgrows a task.

Defined cases: null texts, languages and sources are empty ones; each row is a document, repeated rows too; languages without a
kept term have pairs of value 0 and no terms; a source alone in its language has no pairs; ties go to the smaller item by
UTF-8; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of
from tidewatch.session import materialize

LEAST = 10
TOP = 10
SCALE = 1_000_000_000
FIRST, GROWTH = 8, 3
#: 2^25 bits are 4 MiB, however many prefixes are left.
BITS = 1 << 25
#: Keys that a task holds before it hands its sums on, words that it holds before it adds them up, and cells (sources times terms) of a block.
_HELD = 400_000
_WORDS = 1 << 21
_LOW, _WHOLE = (1 << 32) - 1, 1 << 62
_CELLS = 1 << 19
#: Letters keep their place in lower case, bytes beyond ASCII stay, all else parts terms.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_COUNTS = "lang string, term binary, whole boolean, n bigint"
_CELL = "lang string, term binary, sources array<string>, counts array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _longer(before: int):
    """Function from a text to its terms of more than ``before`` bytes."""
    if not before:
        return terms_of
    find = re.compile(rb"[a-z\x80-\xff]{%d,}" % (before + 1)).findall
    return lambda text: find(text.translate(_LETTERS))


def _place(lang: str, prefix: bytes) -> int:
    return zlib.crc32(prefix, zlib.crc32(lang.encode())) % BITS


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            yield lang, source, text.as_buffer().to_pybytes()


def _left(bits: np.ndarray, lang: str, prefix: bytes) -> bool:
    place = _place(lang, prefix)
    return bool(bits[place >> 3] >> (place & 7) & 1)


def _fresh() -> defaultdict:
    """Numbers words as they are first asked for."""
    return defaultdict(count().__next__)


def _numbered(words, numbers: defaultdict) -> np.ndarray:
    found = itemgetter(*words)(numbers) if len(words) > 1 else [numbers[w] for w in words]
    return np.fromiter(found, dtype=np.int64, count=len(words))


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often each occurs."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.array([], dtype=np.int64)
    return codes[starts], np.diff(np.append(starts, len(codes)))


class _Keys:
    """What the terms of a task count as at a level: prefixes of ``length`` bytes, whole terms, or nothing where the level before has
    discarded how they begin."""

    def __init__(self, length: int, before: int, bits: np.ndarray | None):
        self.length, self.before, self.bits = length, before, bits
        self.known: dict[tuple[str, bytes], int] = {}

    def __len__(self):
        return len(self.known)

    def of(self, lang: str, terms) -> np.ndarray:
        """Number of each term's key, -1 for none."""
        out, known, open_ = np.empty(len(terms), dtype=np.int64), self.known, {}
        length, before, bits = self.length, self.before, self.bits
        for i, term in enumerate(terms):
            if bits is not None:
                start = term[:before]
                left = open_.get(start)
                if left is None:
                    left = open_[start] = _left(bits, lang, start)
                if not left:
                    out[i] = -1
                    continue
            # A blank, which no term has, marks a whole term.
            out[i] = known.setdefault((lang, term[:length] if len(term) > length else term + b" "), len(known))
        return out

    def columns(self) -> list[pa.Array]:
        """lang, term and whole of all keys by number."""
        return [pa.array([k[0] for k in self.known], pa.string()), pa.array([k[1].rstrip(b" ") for k in self.known], pa.binary()), pa.array([k[1][-1:] == b" " for k in self.known], pa.bool_())]


_NONE = np.array([], dtype=np.int64)


def _counter(length: int, before: int, left):
    """Documents per prefix of ``length`` bytes, and per whole term longer than ``before`` and no longer than that."""

    def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _longer(before)
        keys, counts = _Keys(length, before, left.value if left is not None else None), _NONE
        numbers: dict[str, defaultdict] = {}
        found: dict[str, list[np.ndarray]] = {}
        held = 0

        def add_up() -> np.ndarray:
            """Each document counts once for each of its keys."""
            total = counts
            for lang, codes in found.items():
                key = keys.of(lang, numbers[lang])
                codes = np.concatenate(codes)
                at = key[codes & _LOW]
                once, _ = _runs((codes & ~_LOW | at)[at >= 0])
                more = np.bincount(once & _LOW, minlength=len(keys))
                more[: len(total)] += total
                total = more
            return total

        for document, (lang, _, text) in enumerate(_rows(batches)):
            words = set(terms(text))
            own = numbers.setdefault(lang, _fresh()) if lang not in numbers else numbers[lang]
            found.setdefault(lang, []).append(_numbered(words, own) + (document << 32))
            held += len(words)
            if held > _WORDS or len(own) > _HELD:
                counts = add_up()
                numbers, found, held = {}, {}, 0
                if len(keys) > _HELD:
                    yield pa.RecordBatch.from_arrays([*keys.columns(), pa.array(counts, pa.int64())], names=["lang", "term", "whole", "n"])
                    keys, counts = _Keys(length, before, keys.bits), _NONE
        counts = add_up()
        yield pa.RecordBatch.from_arrays([*keys.columns(), pa.array(counts, pa.int64())], names=["lang", "term", "whole", "n"])

    return count_documents


def _bit_table(left: DataFrame) -> np.ndarray:
    """Bits of the (lang, term) rows, as BITS / 8 bytes.  At most BITS / 64 rows reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_place(lang, term) for lang, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True)]
            at = np.asarray(found, dtype=np.int64)
            bits = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int64()), pa.array(bits, pa.int64())], names=["word", "bits"])

    words = left.select("lang", "term").mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint8)


def kept_terms(docs: DataFrame, least: int = LEAST, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(lang, term, n_docs) of the terms that ``least`` documents of the language hold; ``docs`` has lang, source and text, none null."""
    spark = docs.sparkSession
    length, before, left, kept = first, 0, None, []
    while True:
        counted = docs.mapInArrow(_counter(length, before, left), _COUNTS).groupBy("lang", "term", "whole").agg(F.sum("n").alias("n_docs"))
        level = materialize(counted.where(F.col("n_docs") >= least), "prefixes")
        if left is not None:
            left.unpersist()
        kept.append(level.where("whole").select("lang", "term", "n_docs"))
        unfinished = level.where("NOT whole")
        if unfinished.isEmpty():
            break
        left = spark.sparkContext.broadcast(_bit_table(unfinished))
        length, before = length * growth, length
    every = kept[0]
    for more in kept[1:]:
        every = every.union(more)
    return every


def _cells(left):
    """Occurrences per language and term, with the sources side by side; a bit table says which terms may be kept ones."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(_WHOLE, _WHOLE, left.value)
        numbers: dict[str, defaultdict] = {}
        found: dict[str, list[np.ndarray]] = {}
        groups: dict[str, int] = {}
        codes, counts, held = _NONE, _NONE, 0

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            """Sorted codes of (key, source), and how often each occurs."""
            every, weights = [codes], [counts]
            for lang, fresh in found.items():
                key = keys.of(lang, numbers[lang])
                words = np.concatenate(fresh)
                at = key[words & _LOW]
                different, times = _runs((at << 32 | words >> 32)[at >= 0])
                every.append(different)
                weights.append(times)
            every, weights = np.concatenate(every), np.concatenate(weights)
            order = np.argsort(every, kind="stable")
            every, weights = every[order], weights[order]
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else _NONE
            return every[starts], np.add.reduceat(weights, starts) if len(starts) else weights

        def batch_of(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes >> 32, minlength=len(keys)))]), pa.int32())
            sources = pa.array(list(groups), pa.string()).take(pa.array(codes & _LOW))
            return pa.RecordBatch.from_arrays([*keys.columns()[:2], pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=["lang", "term", "sources", "counts"])

        for lang, source, text in _rows(batches):
            words = terms_of(text)
            own = numbers.setdefault(lang, _fresh()) if lang not in numbers else numbers[lang]
            found.setdefault(lang, []).append(_numbered(words, own) + (groups.setdefault(source, len(groups)) << 32))
            held += len(words)
            if held > _WORDS or len(own) > _HELD or len(groups) > _HELD:
                codes, counts = add_up()
                numbers, found, held = {}, {}, 0
                if len(keys) > _HELD or len(groups) > _HELD or len(codes) > _WORDS:
                    yield batch_of(codes, counts)
                    keys, groups, codes, counts = _Keys(_WHOLE, _WHOLE, keys.bits), {}, _NONE, _NONE
        yield batch_of(*add_up())

    return count_words


def cells(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): how often each group has each kept term, where it has it."""
    left = docs.sparkSession.sparkContext.broadcast(_bit_table(kept))
    parts = docs.mapInArrow(_cells(left), _CELL).repartition("lang", "term")
    # The sum keeps this placement; so does the join with the kept terms.
    each = parts.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    counted = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return counted.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")


def _p(count: str, total: str, terms: str):
    """Exact beyond 64 bits."""
    big = "decimal(38, 0)"
    return F.expr(f"1 + (cast({SCALE} as {big}) * ({count} + 2)) div (cast({total} as {big}) + 2 * {terms})").cast("bigint")


def _f(p, q):
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})").cast("bigint")


def groups_of(docs: DataFrame, counted: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms): every group that occurs, its kept occurrences and the kept terms of its language."""
    total = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    every = docs.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(terms, "lang", "left")
    return every.select("lang", "source", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"), F.coalesce("terms", F.lit(0).cast("bigint")).alias("terms"))


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of f over the terms of one block, for each two sources (a before b)."""
    sources, names = np.unique(np.asarray(table.column("source").to_pylist(), dtype=object), return_inverse=True)
    at = table.column("place").to_numpy()
    p = table.column("p").to_numpy()
    base, cell = at < 0, at >= 0
    grid = np.zeros((len(sources), 1), dtype=np.int64)
    grid[names[base], 0] = p[base]
    columns, where = np.unique(at[cell], return_inverse=True)
    grid = np.repeat(grid, len(columns), axis=1)
    grid[names[cell], where] = p[cell]
    left, right, value = [], [], []
    for a in range(len(sources) - 1):
        d = grid[a + 1 :] - grid[a]
        left += [sources[a]] * len(d)
        right += sources[a + 1 :].tolist()
        value.append((d * d // (grid[a + 1 :] + grid[a])).sum(axis=1))
    sums = np.concatenate(value) if value else np.array([], dtype=np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "value": pa.array(sums, pa.int64())})


def pair_values(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways.

    Of a pair's terms those that neither source has are compared too: each block has every source's p of a missing term.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) * F.max("terms") / _CELLS).cast("int").alias("blocks"))
    hashed = F.xxhash64("term")
    placed = scored.join(blocks, "lang").select("lang", "source", "term", "p", F.pmod(hashed, "blocks").cast("int").alias("block"))
    numbers = scored.join(blocks, "lang").select("lang", "term", F.pmod(hashed, "blocks").cast("int").alias("block")).distinct()
    order = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")).cast("bigint").alias("place")
    numbers = numbers.select("lang", "term", order)
    of_cells = placed.join(numbers, ["lang", "term"]).select("lang", "block", "source", "place", "p")
    base = groups.where("terms > 0").join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    base = base.select("lang", "block", "source", F.lit(-1).cast("bigint").alias("place"), _p("0", "total", "terms").alias("p"))
    sums = of_cells.union(base).groupBy("lang", "block").applyInArrow(_compare, "lang string, a string, b string, value bigint")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    found = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    # Languages without kept terms.
    none = groups.where("terms = 0").select("lang", "source")
    blank = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    return found.union(blank)


def term_values(scored: DataFrame, counted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has oftener than its language."""
    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("terms").alias("lang_terms"))
    q = of_lang.join(totals, "lang").select("lang", "term", _p("of_lang", "lang_total", "lang_terms").alias("q"))
    return scored.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _f("p", "q").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and each group's ``top`` terms."""
    docs = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    kept = materialize(kept_terms(docs, least), "kept-terms")
    counted = materialize(cells(docs, kept), "cells")
    groups = materialize(groups_of(docs, counted, kept), "groups")
    scored = counted.join(groups, ["lang", "source"]).select("lang", "source", "term", _p("n", "total", "terms").alias("p"))
    parts = []
    for part, found in (("pair", pair_values(scored, groups)), ("term", term_values(scored, counted, groups))):
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
        ranked = found.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
        parts.append(ranked.where(F.col("rank") <= top) if part == "term" else ranked)
    return parts[0].union(parts[1])
