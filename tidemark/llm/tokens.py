"""Token counts under a unigram model, by dynamic programming shared along a trie of distinct pre-tokens.

The vocabulary file of a public tokenizer gives the pieces in rank order; a piece's unigram score is its Zipf log
probability, -ln(rank + 1) less the normaliser. A character outside the vocabulary falls back to its UTF-8 bytes. The
segmentation of a pre-token (a white-space word with the word-start mark before it) is the one of greatest summed score,
of fewest tokens among equals.

Forward scores depend on a prefix alone. The distinct pre-tokens of a batch are laid into a trie by sorting: walking
them in order, the stack of forward states up to the common prefix with the word before is kept, so each trie node is
computed once, and a word's last state is its terminal count. Counts of words seen are kept between batches up to a
bound on memory; beyond it they are computed again.

Defined results: a null, empty or blank text has 0 tokens; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose counts a worker keeps: about 120 bytes each.
KEPT_WORDS = 1_000_000


def load_pieces(path: str) -> dict[str, float]:
    """piece -> score, for the pieces that are neither control, unknown nor byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    normal = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - normal for r, p in enumerate(pieces)}


class Segmenter:
    def __init__(self, pieces: dict[str, float]):
        self.get = pieces.get
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - 10.0

    def _next(self, word: str, end: int, score: list[float], count: list[int]) -> None:
        """Append the forward state of word[:end], from the states of the shorter prefixes."""
        get, best, least = self.get, -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            s = get(word[start:end])
            if s is not None:
                s += score[start]
                if s > best or s == best and count[start] + 1 < least:
                    best, least = s, count[start] + 1
        if get(word[end - 1]) is None:
            n = len(word[end - 1].encode())
            s = score[end - 1] + n * self.byte
            if s > best:
                best, least = s, count[end - 1] + n
        score.append(best)
        count.append(least)

    def counts(self, distinct: list[str]) -> dict[str, int]:
        """Terminal counts of distinct words, each with the mark before it; states are shared along common prefixes."""
        out: dict[str, int] = {}
        score, count, before = [0.0], [0], ""
        for word in sorted(distinct):
            marked, shared = MARK + word, 0
            most = min(len(marked), len(before))
            while shared < most and marked[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                self._next(marked, end, score, count)
            out[word], before = count[len(marked)], marked
        return out


def _count_batches(batches: Iterator[pa.RecordBatch], pieces: dict[str, float], kept_words: int) -> Iterator[pa.RecordBatch]:
    segmenter = Segmenter(pieces)
    known: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            split = [(t or "").split() for t in part.column(1).to_pylist()]
            fresh = set().union(*split).difference(known)
            known.update(segmenter.counts(list(fresh)))
            totals = [sum(map(known.__getitem__, ws)) for ws in split]
            if len(known) > kept_words:
                known.clear()
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(list(map(len, split)), pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, kept_words: int = KEPT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_pretokens of every document. The vocabulary (tens of thousands of pieces, fixed) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _count_batches(it, shared.value, kept_words), "doc_id long, n_tokens long, n_pretokens long"
    )
