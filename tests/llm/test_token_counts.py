import brute_force as brute
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import token_counts
from tidewatch.llm.token_counts import Automaton

ROOT = "/root/testdata/sf0.001"
LETTERS = st.text("abc▁é", max_size=7)


@settings(max_examples=400, deadline=None)
@given(st.lists(LETTERS, max_size=14), st.text("abcx▁é\U0001f600", max_size=25))
def test_counts_match_piece_by_piece(pieces, word):
    want = brute.pieces(word.replace(" ", ""), [p for p in pieces if p], mark="")
    assert Automaton(pieces).count(word) == want


def test_documents_match_piece_by_piece(spark):
    vocabulary = token_counts.load_pieces()
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(60)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.with_counts(docs).collect()}
    assert got == {r.doc_id: (len(brute.words(r.text)), brute.pieces(r.text, vocabulary)) for r in docs.collect()}


def test_odd_rows(spark):
    docs = brute.dirty(spark)
    vocabulary = ["▁a", "lpha", "▁w", "x", "1"]
    got = token_counts.with_counts(docs, pieces=vocabulary)
    assert sorted(repr((r.doc_id, r.n_words, r.n_tokens)) for r in got.collect()) == sorted(repr((r.doc_id, len(brute.words(r.text)), brute.pieces(r.text, vocabulary))) for r in docs.collect())
    assert token_counts.with_counts(brute.empty(spark)).count() == 0 and got.columns.count("n_words") == 1
    assert token_counts.with_counts(docs, pieces=[]).count() == docs.count()


def test_a_full_cache_starts_over(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 2)
    docs = brute.dirty(spark, [(1, "a b c d a b c d e f", "en", "s")])
    assert token_counts.with_counts(docs, pieces=["▁a", "▁", "b"]).first().n_tokens == brute.pieces("a b c d a b c d e f", ["▁a", "▁", "b"])
