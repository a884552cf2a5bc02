"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match-first splits a word into the longest vocabulary piece, then the longest of the rest, and so on.  The
automaton walks a trie of the vocabulary once over the characters: where no edge fits, a failure link goes to the state of
what is left after the pieces that are certain by then, and a number precomputed per state says how many pieces those are.  So a
text's length in pieces is a sum, without any piece being built.

Words carry the vocabulary's word-start mark in front.  A character that is no piece of its own counts as its UTF-8 bytes, as
with byte-fallback vocabularies.

Defined cases: null and blank texts have no pieces; repeated rows are counted each; an empty table gives no rows; extra
columns with the names of the results are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of

MARK = "▁"
#: Different words whose counts a worker keeps at most before it starts over; bounds memory, not results.
CACHE_WORDS = 500_000
#: Longer words are counted each time, so the words kept have 32 MB at most.
CACHE_BYTES = 64
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Ordinary pieces of a sentencepiece model, read on the driver; a vocabulary is a fixed small file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """Trie states are numbers; 0 is the root.  ``link`` is -1 where nothing is certain yet."""

    def __init__(self, pieces: list[str]):
        self.goto: list[dict[str, int]] = [{}]
        worth: dict[int, int] = {}
        for piece in pieces:
            if piece:
                worth[self._add(piece)] = 1
        # Every character of the vocabulary is a piece of its own, worth its bytes unless the vocabulary lists it.
        for c in {c for edges in list(self.goto) for c in edges}:
            worth.setdefault(self._add(c), len(c.encode()))
        size = len(self.goto)
        self.link, self.popped = [-1] * size, [0] * size
        layer = [(0, c, v) for c, v in self.goto[0].items()]
        while layer:  # by depth, as links lead to shorter strings
            deeper = []
            for parent, c, v in layer:
                if v in worth:
                    self.link[v], self.popped[v] = 0, worth[v]
                else:
                    count, z = self.popped[parent], self.link[parent]
                    while z >= 0 and c not in self.goto[z]:
                        count, z = count + self.popped[z], self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.goto[z][c], count
                deeper += [(v, d, w) for d, w in self.goto[v].items()]
            layer = deeper

    def _add(self, piece: str) -> int:
        state = 0
        for c in piece:
            edges = self.goto[state]
            if c not in edges:
                edges[c] = len(self.goto)
                self.goto.append({})
            state = edges[c]
        return state

    def count(self, word: str) -> int:
        goto, link, popped = self.goto, self.link, self.popped
        total = state = 0
        for c in word:
            while c not in goto[state]:
                if not state:
                    break
                total += popped[state]
                state = link[state]
            if c in goto[state]:
                state = goto[state][c]
            else:  # unknown to the vocabulary
                total += len(c.encode())
        while state:
            total += popped[state]
            state = link[state]
        return total


_built: dict[int, tuple[Automaton, dict[bytes, int]]] = {}


def _automaton(pieces) -> tuple[Automaton, dict[bytes, int]]:
    """One automaton per worker process and vocabulary."""
    if pieces.id not in _built:
        _built[pieces.id] = (Automaton(pieces.value), {})
    return _built[pieces.id]


class _Shared:
    """A broadcast vocabulary with a name that workers agree on."""

    def __init__(self, spark, pieces: list[str]):
        self.id, self.box = hash(tuple(pieces)), spark.sparkContext.broadcast(pieces)

    @property
    def value(self) -> list[str]:
        return self.box.value


def with_counts(docs: DataFrame, text: str = "text", pieces: list[str] | None = None, path: str = VOCABULARY, mark: str = MARK) -> DataFrame:
    """All columns plus n_words and n_tokens."""
    shared = _Shared(docs.sparkSession, pieces if pieces is not None else load_pieces(path))

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint>")
    def counted(texts: pa.Array) -> pa.Array:
        machine, known = _automaton(shared)
        words, totals = [], []
        for t in texts:
            split = t.as_buffer().to_pybytes().split()
            total = 0
            for w in split:
                n = known.get(w)
                if n is None:
                    n = machine.count(mark + w.decode("utf-8", "replace"))
                    if len(w) <= CACHE_BYTES:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[w] = n
                total += n
            words.append(len(split))
            totals.append(total)
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(totals, pa.int64())], names=["n_words", "n_tokens"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"n_words", "n_tokens"}]
    return docs.select(*kept, counted(text_of(text)).alias("__c")).select(*kept, "__c.n_words", "__c.n_tokens")
