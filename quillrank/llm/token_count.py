"""Count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's matches in a word; dynamic programming carries the best score and its
number of pieces.  Ties go as in the tokenizer: of equal scores at a position, the path whose last piece starts first."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: White space as the tokenizer has it: Unicode's White_Space.  str.split() also splits at four separators that are none.
_OTHER = re.compile("[\x1c-\x1f]")
_WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character scores this much below the lowest piece.
PENALTY = 10.0
#: Words that a worker remembers.
CACHE = 400_000
_counters: dict = {}


def split_words(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(text) if _OTHER.search(text) else text.split()


def vocabulary(name: str = MODEL) -> list[tuple[str, float]]:
    """(piece, log score) of a public sentencepiece model; its merge ranks r become Zipf scores -log(r + 2)."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    return [(p, -math.log(r + 2)) for r, p in enumerate(pieces)]


class Counter:
    """Pieces of a word under the best segmentation; unknown characters that follow one another are one piece."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        ending: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        best, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # open_: the path ends with an unknown piece
        for end in range(1, n + 1):
            found = sorted(ending[end - 1], reverse=True)  # the longest starts first
            top = None
            for length, score in found:
                at = end - length
                if top is None or best[at] + score > top:
                    top, pieces, unknown = best[at] + score, count[at] + 1, False
            if not found or found[-1][0] > 1:  # no piece of this one character: an unknown one competes, last
                if top is None or best[end - 1] + self.unknown > top:
                    top, pieces, unknown = best[end - 1] + self.unknown, count[end - 1] + (not open_[end - 1]), True
            best[end], count[end], open_[end] = top, pieces, unknown
        return count[n]

    def text(self, text: str | None) -> int:
        """Each white-space-delimited word is led by the space mark and counted by itself."""
        total, known = 0, self.words
        for word in split_words(text):
            got = known.get(word)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                known[word] = got = self.word(SPACE + word)
            total += got
        return total


def _count(name: str, pieces: list[tuple[str, float]] | None):
    token = hashlib.md5(repr(pieces).encode()).hexdigest() if pieces else name

    def run(batches):
        if token not in _counters:
            _counters.clear()
            _counters[token] = Counter(pieces or vocabulary(name))
        counter = _counters[token]
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(split_words(t)) for t in texts], pa.int64()), pa.array([counter.text(t) for t in texts], pa.int64())], ["id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = MODEL, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """One row for each row of docs: key, n_words, n_tokens, over the whole text.

    pieces: (piece, log score) of a unigram model; without them the public model `name` with Zipf scores.  Null and
    empty texts have no tokens.  Repeated rows each keep a row; an empty table gives none; other columns are not read."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(_count(name, pieces), f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_tokens long").withColumnRenamed("id", key)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
