import random

import brute_force as brute
from pyspark.sql import functions as F

from tidewatch.llm import decontamination as d

ROOT = "/root/testdata/sf0.001"


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id bigint, text string, item string, hash bigint")


def check(docs, items):
    got = {r.id: list(r.item_ids) for r in d.traces(docs, items).collect()}
    want = brute.traces([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], d.UNITS, d.SPELLED)
    assert got == want
    return got


def test_traces_match_every_document_against_every_item(spark):
    docs, items = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/benchmark.parquet")
    got = check(docs, items)
    planted = {x.doc_id for x in docs.collect() for i in items.collect() if i.text in x.text}
    assert planted and planted <= set(got)
    assert {r.id for r in d.traces(docs, items, broadcast_windows=0).collect()} == set(got)


QUESTION = "On some day Tom walked 12 km to the old market with Anna and Tom bought 3 apples for 7 dollars before they went home again"


def test_edited_copies(spark):
    """Copies that are cut, joined, shortened, lengthened, re-cased and re-parameterised at random, beside texts of the same words."""
    rnd = random.Random(11)
    items = [QUESTION, "3 4 5 6 7 8", "Anna Bert", "x", "5km 6km 7km 8km 9km", " ".join(f"w{i}" for i in range(60)), "seven of the ten men went to Rome in May. Paris is 4 h away"]
    texts = []
    for _ in range(160):
        words = rnd.choice(items).split(" ")
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(words))
            kind = rnd.randrange(6)
            if kind == 0:
                words.insert(at, rnd.choice(["very", "Max", "9", "km", "old."]))
            elif kind == 1 and len(words) > 1:
                del words[at]
            elif kind == 2:
                words[at] = rnd.choice(["Max", "seventeen", "11", "new", words[at].upper()])
            elif kind == 3:
                words = [w.replace("Tom", "Mary Ann").replace("12", "forty") for w in words]
            elif kind == 4:
                rnd.shuffle(words)
            else:
                words = " ".join(words).lower().split(" ")
        texts.append(rnd.choice(["", "Some words first. ", "(", "x\x02y "]) + " ".join(words) + rnd.choice(["", ".", "\n and more"]))
    docs = brute.dirty(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = check(docs, items_of(spark, list(enumerate(items))))
    assert 40 < len(got) < 160


def test_text_patterns_yield_the_tokens(spark):
    """The whole-text form has the same tokens, so it loses no window."""
    rows = [t.text for t in spark.read.parquet(f"{ROOT}/documents.parquet").select("text").collect()]
    rows += [QUESTION, "5km 6 KM 7 kM. Five km, Five Apples... km 5 ... km", "A B. C\x02D e\x03f 1a 12 2nd 9.5 m-h", "twenty one TWENTYONE twentyone. h", " . ! ?", "", "\u0130x \u01c5y \u00df"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    marks = F.create_map(*[F.lit(x) for x in (d.NUMBER, d._HOLDERS[0], d.UNIT, d._HOLDERS[1], d.NAME, d._HOLDERS[2])])
    tokens = F.array_join(F.transform(d.tokens(F.col("t")), lambda x: F.coalesce(F.try_element_at(marks, x["token"]), x["token"])), " ")
    both = docs.select("i", tokens.alias("a"), d.typed_text(d.bare_text(F.col("t"))).alias("b")).where("a <> b").collect()
    assert not both


def test_reparameterised_questions_need_consistent_slots(spark):
    texts = [
        QUESTION,
        QUESTION.replace("Tom", "Peter").replace("Anna", "Maria").replace("12 km", "45 miles").replace("3", "8"),
        QUESTION.replace("Tom walked", "Peter walked").replace("Tom bought", "Karl bought").replace("12 km", "45 miles").replace("Anna", "Maria").replace("3", "8"),  # one name, two values
        QUESTION.replace("Tom", "Anna"),  # two names, one value
        "Some words come first. " + QUESTION.lower() + " and some come after",
        QUESTION.replace("old market with", "new shop beside"),
        "they walked to the market",
    ]
    docs = brute.dirty(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = check(docs, items_of(spark, [(7, QUESTION), (9, QUESTION), (11, None), (12, ""), (13, "walked to the market"), (14, "1 2 3 4 5 6 7 8 9")]))
    assert all(got[i] == [7, 9] for i in (0, 1, 3, 4)) and 2 not in got and got[6] == [13]
    rows = {r.id: r.verbatim for r in d.traces(docs, items_of(spark, [(7, QUESTION)])).collect()}
    assert rows[0] and rows[4] and not rows[1]


def test_odd_rows(spark):
    items = items_of(spark, [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "x y z x y z x y z"), (None, "no id here at all"), (4, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8")])
    docs = brute.dirty(spark).selectExpr("*", "1 AS __k0", "2 AS __k1", "3 AS t", "4 AS at", "5 AS form")
    rows = d.traces(docs, items).collect()
    assert {r.id for r in rows if r.item_ids == [1]} == {1, 2} and {r.id for r in rows if r.item_ids == [2]} == {12}
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 12)").count() == 0 and kept.where("doc_id = 6").count() == 3
    assert d.traces(brute.empty(spark), items).count() == 0
    assert d.traces(docs, items_of(spark, [])).count() == 0 and d.clean(docs, items_of(spark, [])).count() == docs.count()
