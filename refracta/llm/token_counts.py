"""Token counts under a unigram vocabulary, with one forward pass per shared prefix.

The distinct pre-tokens of a batch are put in a trie, by sorting them: neighbours share their
longest common prefix. The best score and the token count of every prefix are computed once,
on the path from the root, and the counts of the ends are stored. Texts are then sums of
stored counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for the white space before a word
#: Stored counts per Python worker, some 200 MB; then the store starts anew.
STORED = 1_000_000


def vocabulary(model: str = MODEL) -> dict[str, float]:
    """Pieces of a tokenizer file with log-probabilities from their rank, by Zipf's law.

    The file is read, never trained. Control and single-byte pieces are left out: bytes are
    what characters outside of all pieces fall back to.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [
        i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))
    ]
    total = log(sum(1.0 / (rank + 2) for rank in range(len(plain))))
    return {p.id_to_piece(i): -log(rank + 2) - total for rank, i in enumerate(plain)}


class Counts:
    """Token counts of pre-tokens, computed over a trie and kept."""

    def __init__(self, pieces: Mapping[str, float]):
        self.pieces = dict(pieces)
        # A byte scores below every piece, so it is used where no piece fits.
        self.byte = min(self.pieces.values(), default=0.0) - 10.0
        by_last: dict[str, set[int]] = {}
        for piece in self.pieces:
            by_last.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: tuple(sorted(n)) for c, n in by_last.items()}
        self.stored: dict[str, int] = {}

    def add(self, words: Iterator[str] | Sequence[str] | set[str]) -> None:
        """Store the counts of ``words``."""
        pieces, lengths, byte = self.pieces, self.lengths, self.byte
        best, used, before = [0.0], [0], ""
        for word in sorted(words):
            path = MARK + word
            # The scores of the prefix shared with the word before stay as they are.
            shared, most = 0, min(len(path), len(before))
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(path) + 1):
                char = path[end - 1]
                n_bytes = len(char.encode("utf-8", "surrogatepass"))
                score, tokens = best[end - 1] + byte * n_bytes, used[end - 1] + n_bytes
                for n in lengths.get(char, ()):
                    if n > end:
                        break
                    piece = pieces.get(path[end - n : end])
                    if piece is not None and best[end - n] + piece > score:
                        score, tokens = best[end - n] + piece, used[end - n] + 1
                best.append(score)
                used.append(tokens)
            self.stored[word] = used[len(path)]
            before = path

    def of(self, words: list[str]) -> int:
        """Tokens of a text's words; all must be stored."""
        return sum(map(self.stored.__getitem__, words))




def _count(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(broadcast.value)
        for batch in batches:
            n_words, n_tokens = [], []
            texts = [(t or "").split() for t in batch.column("text").to_pylist()]
            if len(counts.stored) > STORED:
                counts.stored.clear()
            counts.add(set().union(*texts) - counts.stored.keys())
            for words in texts:
                n_words.append(len(words))
                n_tokens.append(counts.of(words))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, pieces: Mapping[str, float]) -> DataFrame:
    """(doc_id, n_words, n_tokens), one row per row of ``docs`` (doc_id, text).

    A pre-token is a maximal run without white space, with a mark before it. Its tokens are
    those of the segmentation into ``pieces`` with the highest sum of scores; of equal sums
    the one with the shorter last piece. A character that no piece covers counts one token
    per UTF-8 byte. NULL and blank texts have 0 words and tokens; repeated rows are counted
    each. Other columns are ignored, whatever their names. An empty table gives an empty one.
    ``pieces`` (a tokenizer's vocabulary, some 10,000 to 1,000,000 entries) is broadcast.
    """
    if len(pieces) > 5_000_000:
        raise ValueError("a vocabulary of this size is not broadcast")
    broadcast = docs.sparkSession.sparkContext.broadcast(dict(pieces))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _count(broadcast), f"doc_id {kind}, n_words bigint, n_tokens bigint"
    )
