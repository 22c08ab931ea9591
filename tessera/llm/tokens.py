"""Token counts of whole texts, with a shortcut for pre-tokens that are one vocabulary string.

Offline proof, made once for a model file: (1) no vocabulary string has a word mark after anything but a word mark, and there are no
user-defined strings, so no merge crosses from a word into the next mark and the pieces between such places (runs of marks with the
word after them) are encoded independently of each other; (2) a vocabulary string that, encoded alone, gives exactly its
own id is one token wherever it stands as a pre-token. Matching pre-tokens are then counted by look-up, the rest are merged by the library and
remembered in a bounded memo. A model for which (1) fails is encoded text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_TOKENS = 4096
#: Entries of the memo of merged pre-tokens, per worker.
MEMO = 600_000
#: Characters whose pre-tokens are looked up together.
SLICE = 1_000_000


class Counts(dict):
    """Pre-token without its first mark -> number of tokens. Proven strings stay; merged ones are dropped together when full."""

    def __init__(self, model_file: str, memo: int = MEMO):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=model_file)
        self.memo = memo
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        crossing = re.compile(f"[^{MARK}]{MARK}")
        # a mark before the text, and spaces kept as they are, are settings of the model: asked of it, not assumed
        alone = self.sp.encode("a  a ") == [*self.sp.encode("a"), *self.sp.encode(" a"), self.sp.piece_to_id(MARK)]
        self.separable = alone and not any(crossing.search(pieces[i]) for i in plain)
        self.proven: dict[str, int] = {}
        if self.separable:
            own = [i for i in plain if pieces[i].startswith(MARK) and len(pieces[i]) > 1]
            for i, ids in zip(own, self.sp.encode([pieces[i][1:].replace(MARK, " ") for i in own], num_threads=1), strict=True):
                if ids == [i]:
                    self.proven[pieces[i][1:]] = 1
        self.update(self.proven)

    def learn(self, words: set[str]) -> None:
        """Merge the pre-tokens that are not known yet, in one call of the library."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) >= self.memo + len(self.proven):
            self.clear()
            self.update(self.proven)
            new = [w for w in words if w not in self]
        for w, ids in zip(new, self.sp.encode([w.replace(MARK, " ") for w in new], num_threads=1), strict=True):
            self[w] = len(ids)
        self[""] = 1  # a mark alone

    def of(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        found = [pre_tokens(t) for t in texts]
        self.learn(set().union(*found))
        return [sum(map(self.__getitem__, x)) for x in found]


def pre_tokens(text: str) -> list[str]:
    """Runs of marks with the word after them, without the first mark of each."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", (" " + text).replace(" ", MARK))]


@lru_cache(1)
def counts(model_file: str) -> Counts:
    """One to a worker process, which tasks share one after another."""
    return Counts(model_file)


def slices(texts: list[str], size: int = SLICE) -> Iterator[list[str]]:
    """Consecutive texts of together about size characters: the words of a slice are in memory at once."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def count_tokens(docs: DataFrame, model_file: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text; more columns are ignored).

    A null text counts as empty: no bytes and no tokens. Repeated rows are counted each; an empty table gives no rows. Nothing is
    shuffled. No text is cut, whatever its length.
    """
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts(model_file).of
        for b in batches:
            n = [x for texts in slices(b.column(2).to_pylist()) for x in of(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of_batches, f"doc_id {doc_id}, n_bytes bigint, n_tokens bigint, over_limit boolean")
