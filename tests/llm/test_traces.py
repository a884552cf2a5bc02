import brute_force as brute

from tidewatch.llm import decontamination

ITEM = "item_id bigint, text string"
WORDS = ("the quiet baker carried seven heavy baskets over a narrow bridge while many small children watched from both muddy banks and "
         "nobody asked why he never stopped to rest before evening came down upon these old grey roofs again").split()
LONG = " ".join(WORDS)
NAMED = "In that town Tom walked to the old market with Anna and later Tom bought apples for his friend Anna before they went home again"


def found(spark, texts, items):
    docs = brute.dirty(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    rows = decontamination.traces(docs, spark.createDataFrame(list(enumerate(items)), ITEM)).collect()
    kept = {r.doc_id for r in decontamination.clean(docs, spark.createDataFrame(list(enumerate(items)), ITEM)).collect()}
    assert kept == set(range(len(texts))) - {r.id for r in rows}
    return {r.id: list(r.item_ids) for r in rows}


def test_changed_words_and_parts_do_not_hide_a_copy(spark):
    half = len(WORDS) // 2
    texts = [
        " ".join([*WORDS[:half], "very", *WORDS[half:]]),
        " ".join([*WORDS[:half], *WORDS[half + 1 :]]),
        " ".join([*WORDS[:9], "strangely", *WORDS[10:20]]),  # of the short item
        "Somebody wrote this once: " + " ".join(WORDS[8:30]) + " as far as anyone can tell",
        " ".join(WORDS[:6]) + " and other words that do not come from there, however long the text may go on after it",
        " ".join(reversed(WORDS)),
    ]
    assert found(spark, texts, [LONG, " ".join(WORDS[:20])]) == {0: [0, 1], 1: [0, 1], 2: [1], 3: [0]}


def test_names_of_other_length_and_shared_values(spark):
    texts = [
        NAMED.replace("Tom", "Mary Ann"),
        NAMED.replace("Tom", "Anna"),  # two names, one value
        NAMED.replace("Tom walked", "Mary Ann walked").replace("Tom bought", "Karl bought").replace("with Anna", "with Eva"),  # one name, two values
    ]
    assert found(spark, texts, [NAMED]) == {0: [0], 1: [0]}


def test_case_position_and_spelling_of_copies(spark):
    sums = "Natalia sold three clips to her friends in the spring. Natalia sold 5 km of old rope after that and then went away."
    texts = [
        "some words come first. " + NAMED.lower() + " and some come after",
        NAMED.upper(),
        sums.replace("Natalia", "Weng"),
        sums.replace("three", "forty-one").replace("5 km", "7km"),
    ]
    assert found(spark, texts, [NAMED, sums]) == {0: [0], 1: [0], 2: [1], 3: [1]}


def test_items_poor_in_literals_match_verbatim_copies(spark):
    items = ["12 + 34 + 56 = 102", "Anna Bert Carla Dora Emil", "WHICH OF THESE TOWNS IS THE OLDEST", "Xylophone", "2 3 5 7 11 13 17 19 23"]
    texts = [
        "it is said that 12 + 34 + 56 = 102 holds",
        "it is said that 12 + 34 + 57 = 103 holds",
        "there are Anna, Bert, Carla, Dora, Emil and nobody else",
        "there are Fritz, Gerd, Hanna, Ida, Jan and nobody else",
        "He asked me: WHICH OF THESE TOWNS IS THE OLDEST? and went",
        "a xylophone stood there",
        "primes such as 2 3 5 7 11 13 17 19 23 and so on",
        "primes such as 2 3 5 7 12 14 18 20 24 and so on",
    ]
    assert found(spark, texts, items) == {0: [0], 2: [1], 4: [2], 5: [3], 6: [4]}
