"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers (digits or spelled out), units after a number (also stuck to it) and runs of names
(capitalised words, wherever they stand) turn into typed placeholders, all others into their lower-case letters and digits.
Windows of ``WIDTH`` template tokens of the documents are hash-joined with those of the benchmark items.  Windows poor in
ordinary words (fewer than ``LITERALS``) keep their slot values, the values behind the placeholders, inside the hash, so they
meet verbatim copies only.  A second, literal form of items and documents, lower case and without placeholders, meets copies in
another case.  A window that an item repeats counts at its first place; items shorter than ``WIDTH`` are windows of their own
length.

Matches of a document and an item on one diagonal (document position less item position), or in a band of neighbouring
diagonals (a quarter of the item wide, two overlapping series, so that inserted and deleted words do not part a copy), form an
alignment.  Its slots must map consistently: one item value to one document value; two may share theirs.  A consistent
alignment is a trace of the item where it covers ``COVERAGE`` of the item's windows, or of its words (``LEAST_WORDS`` at least;
so a changed word costs one word), or where ``RUN`` words stand in a row on one diagonal, whatever their share.

Most documents share next to nothing with any item.  ``suspects`` finds those that may hold a trace by patterns over whole texts:
the same windows as plain text, without slots and places in the item, of which a trace needs a known least number.  It loses
none; only what it finds is cut into tokens with slots and aligned.

Document windows carry only (position, hash, slot values) through the join.  The benchmark side is counted first and
broadcast up to ``BROADCAST_WINDOWS``; beyond that the same join shuffles.

Defined cases: null and blank texts and items match nothing; equal items are compared once and all reported; repeated rows
are reported once per id; empty tables give no rows; extra columns are ignored by ``traces`` and pass through ``clean``, also
where they are named like the keys in here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import let, row_key, text_of, words_of
from tidewatch.session import materialize

WIDTH = 5
COVERAGE = 0.8
LITERALS = 2
#: 24 bytes each in the hash table, so about 50 MB at most.
BROADCAST_WINDOWS = 2_000_000
#: Words in a row that make a trace whatever the item's length, and words that make a trace by their share of the item.
RUN = 20
LEAST_WORDS = 10
#: Units that count as such after a number.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "t", "l", "ml", "s", "min", "h", "ms", "kmh", "mph", "ft", "in", "lb", "oz", "usd", "eur", "percent", "degrees",
         "meters", "metres", "kilometers", "kilometres", "grams", "kilograms", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
         "dollars", "euros", "cents", "miles", "feet", "inches", "pounds", "ounces")
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
_MARK = "\x01"
#: Stands behind a word that ends a sentence.  A text's own use of the characters that are marks in here counts as blank.
_STOP = "\x02"
_BLANK = r"\x20\x09-\x0D"
#: Numbers in words, up to ninety-nine and the round ones.
_ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SPELLED = ("zero", *_ONES, "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", *_TENS,
           *[t + o for t in _TENS for o in _ONES], "hundred", "thousand", "million", "billion")
#: Joins the names of a run.
_JOINT = "\x03"
#: Placeholders of ``typed_text``: number, unit, name.
_HOLDERS = "\x04\x05\x06"


def _free(text: Column) -> Column:
    """Blanks in place of the characters that are marks in here."""
    marks = f"{_MARK}{_STOP}{_JOINT}{_HOLDERS}"
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])
    return F.when(marked, F.translate(text, marks, " " * len(marks))).otherwise(text)


def tokens(text: Column) -> Column:
    """Array of (template token, slot text) of the words that have a letter or a digit; the slot text of a literal is empty.

    Marks are dealt with on the whole text: words that end a sentence get one stop mark, which parts runs of names and goes later;
    all other marks go.  What is left of a word tells its kind by its first character in nearly all cases.
    """
    joined = F.regexp_replace(bare_text(text), rf"{_START}(\p{{Lu}}[^{_BLANK}{_STOP}]*)[{_BLANK}]+(?=\p{{Lu}})", f"$1{_JOINT}")

    def digits(word: Column) -> Column:
        return F.ascii(word).between(48, 57) & F.regexp_like(word, F.lit(rf"^[0-9]+{_STOP}*\z"))

    def spelled(word: Column) -> Column:
        return F.lower(F.replace(word, F.lit(_STOP), F.lit(""))).isin(*SPELLED)

    def typed(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.get(words, i - 1)
            plain = F.replace(w, F.lit(_STOP), F.lit(""))
            lower_case = F.ascii(w).between(97, 122)
            name = ~lower_case & F.regexp_like(w, F.lit(r"^\p{Lu}"))
            counted = digits(before) | spelled(before)
            kind = F.when((~lower_case & digits(w)) | spelled(w), NUMBER).when(name, NAME).when(F.lower(plain).isin(*UNITS) & (i > 0) & counted, UNIT)
            literal = F.struct(F.lower(plain).alias("token"), F.lit("").alias("slot"))
            return let(kind, lambda k: F.when(k.isNull(), literal).otherwise(F.struct(k.alias("token"), F.concat(plain, F.lit(_MARK)).alias("slot"))))

        return F.filter(F.transform(words, one), lambda t: F.length(t["token"]) > 0)

    return let(words_of(joined), typed)


def literal_tokens(text: Column) -> Column:
    """As ``tokens``, all literals, whatever the case."""
    bare = F.lower(F.regexp_replace(_free(text), rf"[^\p{{L}}\p{{N}}{_BLANK}]+", ""))
    return F.transform(words_of(bare), lambda w: F.struct(w.alias("token"), F.lit("").alias("slot")))


def literal_windows(toks: Column, width: int = WIDTH) -> Column:
    """Windows of ``literal_tokens``, hashed apart from those of ``tokens``."""
    return F.transform(windows(toks, width, width), lambda w: F.struct(w["at"].alias("at"), F.xxhash64(F.lit("="), w["hash"]).alias("hash"), w["slots"].alias("slots")))


def windows(toks: Column, width: int = WIDTH, literals: int = LITERALS) -> Column:
    """Array of (at, hash, slots) of the windows of ``width`` tokens; those with fewer literals are hashed with their slots."""
    most = width - min(literals, width)

    def of(t: Column) -> Column:
        places = F.when(F.size(t) >= width, F.sequence(F.lit(0), F.size(t) - width)).otherwise(F.array().cast("array<int>"))

        def hashed(n: Column, i: Column) -> Column:
            return F.xxhash64(F.slice(n, i + 1, width)).alias("hash")

        def eligible(w: Column) -> Column:
            return F.length(w["slots"]) - F.length(F.translate(w["slots"], _MARK, "")) <= most

        def with_slots(n: Column) -> Column:
            cut = let(F.transform(t, lambda x: x["slot"]), lambda s: F.transform(
                places, lambda i: F.struct(i.alias("at"), hashed(n, i), F.array_join(F.slice(s, i + 1, width), "").alias("slots"))))
            return F.transform(cut, lambda w: F.struct(
                w["at"].alias("at"), F.when(eligible(w), w["hash"]).otherwise(F.xxhash64(w["hash"], w["slots"])).alias("hash"), w["slots"].alias("slots")))

        def without(n: Column) -> Column:
            return F.transform(places, lambda i: F.struct(i.alias("at"), hashed(n, i), F.lit("").alias("slots")))

        any_slot = F.exists(t, lambda x: F.length(x["slot"]) > 0)
        return let(F.transform(t, lambda x: x["token"]), lambda n: F.when(any_slot, with_slots(n)).otherwise(without(n)))

    return let(toks, of)


def item_windows(items: DataFrame, id_col: str, text: str, width: int, literals: int) -> tuple[DataFrame, DataFrame]:
    """Windows (item, width, hash, place, item_slots, length, windows) of both forms of each different item, and (item, item ids)."""
    named = items.select(F.col(id_col).alias("item_id"), text_of(text).alias("t")).withColumn("item", F.xxhash64("t"))
    members = named.groupBy("item").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.first("t").alias("t"))
    # The literal form is an item of its own.
    apart = members.withColumn("item", F.xxhash64(F.lit("="), "item"))
    cuts = []
    for rows, toks, cut in ((members, tokens, lambda t, n: windows(t, n, min(literals, n))), (apart, literal_tokens, literal_windows)):
        cut_up = rows.select("item", toks(F.col("t")).alias("toks")).where(F.size("toks") > 0)
        sizes = F.least(F.size("toks"), F.lit(width))
        per_width = [F.when(sizes == n, cut(F.col("toks"), n)) for n in range(1, width + 1)]
        cuts.append(cut_up.select("item", sizes.alias("width"), F.size("toks").alias("length"), F.explode(F.coalesce(*per_width)).alias("w")))
    first = cuts[0].union(cuts[1]).groupBy("item", "width", "length", F.col("w.hash").alias("hash")).agg(F.min(F.struct(F.col("w.at").alias("place"), F.col("w.slots").alias("item_slots"))).alias("f"))
    whole = F.count(F.lit(1)).over(Window.partitionBy("item"))
    return first.select("item", "width", "hash", "f.place", "f.item_slots", "length", whole.alias("windows")), members.union(apart).select("item", "item_ids")


def _meetings(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str, width: int, coverage: float, literals: int, run: int,
              broadcast_windows: int) -> tuple[DataFrame, DataFrame]:
    """Windows of the suspects joined with the item windows of the same hash, and (item, item ids)."""
    grams, members = item_windows(items, item_id, item_text, width, literals)
    grams = materialize(grams, "benchmark-windows")
    sizes = grams.groupBy("width").count().collect()  # ``width`` rows at most
    small = sum(r["count"] for r in sizes) <= broadcast_windows
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text), text_of(text).alias("t"))
    held = materialize(suspects(rows, grams, items, item_text, width, coverage, literals, run, broadcast_windows), "suspects")
    toks = rows.join(held, ["__k0", "__k1"], "left_semi").select("id", "__k0", "__k1", tokens(F.col("t")).alias("toks"), literal_tokens(F.col("t")).alias("plain"))

    def cut(n: int) -> DataFrame:
        both = F.concat(windows(F.col("toks"), n, min(literals, n)), literal_windows(F.col("plain"), n))
        return toks.select("id", "__k0", "__k1", F.lit(n).alias("width"), F.explode(both).alias("w"))

    cuts = [cut(n) for n in sorted(r["width"] for r in sizes)] or [cut(width).where(F.lit(False))]
    spread = reduce(DataFrame.union, cuts)
    spread = spread.select("id", "__k0", "__k1", "width", F.col("w.hash").alias("hash"), F.col("w.at").alias("at"), F.col("w.slots").alias("slots"))
    # One long key; the width, which is nearly always the same, is compared after it.
    grams = grams.withColumnsRenamed({"width": "__width", "hash": "__hash"})
    return spread.join(F.broadcast(grams) if small else grams, (F.col("hash") == F.col("__hash")) & (F.col("width") == F.col("__width"))), members


def _pairs() -> Column:
    return F.arrays_zip(F.split("item_slots", _MARK).alias("mine"), F.split("slots", _MARK).alias("theirs"))


def _distinct(pairs: Column, name: str) -> Column:
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p[name])))


def _same(pairs: Column) -> Column:
    return ~F.exists(pairs, lambda p: p["mine"] != p["theirs"])


def _report(leaked: DataFrame, members: DataFrame) -> DataFrame:
    named = leaked.join(members, "item").select("id", "__k0", "__k1", "share", "same", F.explode("item_ids").alias("item_id"))
    return named.groupBy("id", "__k0", "__k1").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count_distinct("item_id").alias("n_items"), F.max("share").alias("coverage"), F.max("same").alias("verbatim"))


def _either(words: tuple[str, ...]) -> str:
    """Pattern of the words, letter by letter as in a trie, so that a text leaves it at its first wrong letter; longer words first."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for head, rests in heads.items():
        more = _either(tuple(r for r in rests if r))
        parts.append(head + (f"(?:{more}){'?' if '' in rests else ''}" if more else ""))
    return "|".join(parts)


_START, _END = rf"(?<![^{_BLANK}])", rf"(?=[{_BLANK}]|\z)"


def bare_text(text: Column) -> Column:
    """Letters, digits, blanks and stop marks of a text, units parted from numbers.  What comes first in a pattern is a test of one character, which nearly all places fail."""
    ended = F.regexp_replace(_free(text), rf"[.!?:][^\p{{L}}\p{{N}}{_BLANK}]*{_END}", _STOP)
    bare = F.regexp_replace(ended, rf"[^\p{{L}}\p{{N}}{_STOP}{_BLANK}]+", "")
    return F.regexp_replace(bare, rf"(?=[0-9]){_START}([0-9]+)(?=(?i:{_either(UNITS)}){_STOP}*(?:[{_BLANK}]|\z))", "$1 ")


def typed_text(bare: Column) -> Column:
    """The template tokens of ``tokens`` of a ``bare_text``, parted by single blanks; placeholders are one character each."""
    number, unit, name = _HOLDERS
    joined = F.regexp_replace(bare, rf"(?=\p{{Lu}}){_START}(\p{{Lu}}[^{_BLANK}{_STOP}]*)[{_BLANK}]+(?=\p{{Lu}})", f"$1{_JOINT}")
    numbers = F.regexp_replace(joined, rf"(?=[0-9a-zA-Z]){_START}(?:[0-9]+|(?i:{_either(SPELLED)}))({_STOP}*){_END}", f"{number}$1")
    names = F.regexp_replace(numbers, rf"(?=\p{{Lu}}){_START}\p{{Lu}}[^{_BLANK}]*", name)
    units = F.regexp_replace(names, rf"{number}({_STOP}*[{_BLANK}]+)(?i:{_either(UNITS)})({_STOP}*){_END}", f"{number}$1{unit}$2")
    return _single(units)


def _single(text: Column) -> Column:
    """Lower case, words parted by single blanks, no stop marks."""
    return F.trim(F.lower(F.regexp_replace(text, rf"[{_STOP}{_BLANK}]+", " ")))


def text_windows(text: Column, width: int) -> Column:
    """Every ``width`` neighbouring words of a text parted by single blanks, as text: an array per first word (modulo ``width``) of windows that follow each other.

    A pattern runs over the text once per array, each match where the last one ended.
    """
    def following(skip: int) -> Column:
        return F.regexp_extract_all(text, F.lit(rf"(?:^(?:[^ ]++ ){{{skip}}}|(?!^)\G )([^ ]++(?: [^ ]++){{{width - 1}}})"), F.lit(1))

    return F.array(*[following(k) for k in range(width)])


def _spread_texts(rows: DataFrame, keep: list[str], width: int, literals: int) -> DataFrame:
    """(keep, form, at, hash) of the windows of ``width`` in both forms; typed ones need their literals."""
    bare = rows.select(*keep, bare_text(F.col("t")).alias("bare"))
    both = bare.select(*keep, F.explode(F.array(F.struct(F.lit(0).alias("form"), typed_text(F.col("bare")).alias("x")), F.struct(F.lit(1).alias("form"), _single(F.col("bare")).alias("x")))).alias("f"))
    phases = both.select(*keep, "f.form", F.posexplode(text_windows(F.col("f.x"), width)).alias("phase", "ws"))
    cut = phases.select(*keep, "form", "phase", F.posexplode("ws").alias("i", "w")).select(*keep, "form", (F.col("i") * width + F.col("phase")).alias("at"), "w")
    held = F.length("w") - F.length(F.translate("w", _HOLDERS, ""))
    enough = (F.col("form") == 1) | (held <= width - min(literals, width))
    return cut.where(enough).select(*keep, "form", "at", F.xxhash64("form", "w").alias("hash"))


def suspects(rows: DataFrame, grams: DataFrame, items: DataFrame, item_text: str, width: int, coverage: float, literals: int, run: int, broadcast_windows: int) -> DataFrame:
    """Keys of the rows (__k0, __k1, t) that share enough windows with an item for a trace; the others cannot hold one.

    A trace matches item windows at different places, each at a place of its own in the document.  Windows with literals are
    windows of ``typed_text``, and one without begins where a window of the plain words does that matches too.  So a trace shows at
    as many places here as it needs windows there, and fewer than ``need`` rule it out.  All of it are patterns over
    whole texts and one join, without a step per word.
    """
    need = F.least(F.ceil(coverage * F.col("windows")), F.ceil(F.greatest(F.lit(LEAST_WORDS), coverage * F.col("length")) / F.col("width")), F.greatest(F.lit(1), run - F.col("width") + 1))
    per_form = grams.groupBy("item").agg(F.min(F.greatest(F.lit(1), need)).alias("need"))
    sizes = sorted(r[0] for r in grams.select("width").distinct().collect())  # ``width`` rows at most
    texts = items.select(text_of(item_text).alias("t")).distinct()
    forms = F.explode(F.array(F.xxhash64("t"), F.xxhash64(F.lit("="), F.xxhash64("t")))).alias("item")
    needed = texts.select("t", forms).join(per_form, "item").groupBy("t").agg(F.min("need").alias("need"))
    found = None
    for n in sizes or [width]:
        own = _spread_texts(needed, ["t", "need"], n, literals).select(F.xxhash64("t").alias("item"), "need", F.col("hash").alias("__hash")).distinct()
        own = materialize(own, "item-windows")
        own = F.broadcast(own) if own.count() <= broadcast_windows else own
        met = _spread_texts(rows, ["__k0", "__k1"], n, literals).join(own, F.col("hash") == F.col("__hash")).select("__k0", "__k1", "item", "need", F.lit(n).alias("width"), "form", "at")
        found = met if found is None else found.union(met)
    # Repeated rows share their keys and their places.
    places = found.groupBy("__k0", "__k1", "item", "need").agg(F.count_distinct("width", "form", "at").alias("places"))
    return places.where("places >= need").select("__k0", "__k1").distinct()


def _covered(places: Column, width: Column) -> Column:
    """Words under the windows at sorted places."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct((p + width).alias("end"), (s["n"] + p + width - F.greatest(p, s["end"])).alias("n"))
    return F.aggregate(places, start, step, lambda s: s["n"])


def _longest(places: Column, width: Column) -> Column:
    """Words under the longest run of neighbouring windows at sorted places."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, p: Column) -> Column:
        run = F.when(p == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(places, start, step, lambda s: s["best"]) + width - 1


def traces(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           width: int = WIDTH, coverage: float = COVERAGE, literals: int = LITERALS, run: int = RUN, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document with a trace: id, row keys, item_ids, n_items, coverage (the best share of windows or words), verbatim (any item is)."""
    met, members = _meetings(docs, items, id_col, text, item_id, item_text, width, coverage, literals, run, broadcast_windows)
    key = ["id", "__k0", "__k1", "item"]
    lines = met.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set(_pairs()))).alias("pairs"),
        *[F.first(c).alias(c) for c in ("windows", "length", "width")])
    stride = F.greatest(F.lit(1), F.floor(F.col("length") / 4))
    band = F.floor(F.col("diagonal") / stride)
    # The diagonal itself has no band: null.
    spread = lines.withColumn("band", F.explode(F.array(F.lit(None).cast("bigint"), band, band - 1)))
    alone = F.when(F.col("band").isNull(), F.col("diagonal"))
    joined = spread.groupBy(*key, "band", alone.alias("diagonal")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        *[F.first(c).alias(c) for c in ("windows", "length", "width")])
    covered = joined.withColumn("words", _covered(F.col("places"), F.col("width")))
    pairs = F.col("pairs")
    by_windows, by_words = F.size("places") / F.col("windows"), F.col("words") / F.col("length")
    in_a_row = F.col("band").isNull() & (_longest(F.col("places"), F.col("width")) >= run)
    enough = (by_windows >= coverage) | ((by_words >= coverage) & (F.col("words") >= LEAST_WORDS)) | in_a_row
    leaked = covered.where((_distinct(pairs, "mine") == F.size(pairs)) & enough).select(*key, F.greatest(by_windows, by_words).alias("share"), _same(pairs).alias("same"))
    return _report(leaked, members)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a trace of an item, with all their columns."""
    found = materialize(traces(docs, items, id_col, text, **options).select("__k0", "__k1"), "leaks")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *row_key(id_col, text))
    return kept.join(found, ["__k0", "__k1"], "left_anti").select("__row.*")
