"""Benchmark decontamination: every passage of every text queries a BM25 index of the benchmark items.

A text's tokens (lower-cased runs of letters and digits) are read as passages of twice the length of the longest item, each starting half a
passage after the last, so that every stretch as long as an item lies whole in some passage. The index holds, for each token, its items in ascending order with the
BM25 weight of the token in the item as a share of the item's own full score; lists are cut into blocks that know their largest
share. A passage retrieves all items whose shares add up to MIN_SCORE or more, by block-max WAND. Passages that cannot reach it for any item are
skipped before: the longest lists are set aside as long as no item has more than half of MIN_SCORE in them, and what an item still needs must come from
the others, which are short. A retrieved item counts as leaked if the
passage also holds enough of the word triples of its question and of its answer.

Items of more than ITEM_WORDS tokens are cut into pieces that are items of their own with the same id, so that one long item does not lengthen all passages. The index is dealt into parts of a
bounded number of pieces by hash. Tasks build them, with document frequencies and mean length of the whole benchmark, and write them to the shared folder; neither items nor index
pass through the driver. A task holds one part at a time, and further parts take further passes over the texts.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize, unused

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
MIN_SCORE = 0.6
#: Shares of the word triples of question and answer that the passage must hold.
MIN_QUESTION, MIN_ANSWER = 0.7, 0.5
#: Where an item has no answer of its own, its last words, this share of them, stand for it.
ANSWER_SHARE = 0.25
#: Postings in a block; tokens in half a passage at least; tokens of an item (of a piece of it) at most; pieces in a part of the index at most, about.
BLOCK, HALF, ITEM_WORDS, PART_ITEMS = 64, 64, 256, 50_000

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def triples(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Item:
    item_id: int | None
    words: list[str]
    question: list[str]
    answer: list[str]


def pieces(item_id: int | None, words: list[str]) -> list[Item]:
    """The item, or pieces of about equal length of a long one, each with the last ANSWER_SHARE of its words as its answer."""
    n = -(-len(words) // ITEM_WORDS)
    out = []
    for i in range(n):
        own = words[len(words) * i // n : len(words) * (i + 1) // n]
        cut = len(own) - max(1, round(ANSWER_SHARE * len(own)))
        out.append(Item(item_id, own, own[:cut] or own, own[cut:]))
    return out


def make_item(item_id: int | None, text: str | None) -> Item:
    """The only piece of a text that is not long."""
    words = tokens(text)
    cut = len(words) - max(1, round(ANSWER_SHARE * len(words)))
    return Item(item_id, words, words[:cut] or words, words[cut:])


class Index:
    """Tokens -> items, ascending, with shares, and the largest share of each block and list."""

    def __init__(self, items: list[Item], held: dict[str, int] | None = None, total: int = 0, mean: float = 0.0):
        """items: those of this part. held, total and mean: items with each token, items and their mean length in the whole benchmark (by default that of the part)."""
        self.items = items
        if held is None:
            held, total, mean = Counter(t for x in items for t in set(x.words)), len(items), sum(len(x.words) for x in items) / max(1, len(items))
        idf = {t: math.log(1 + (total - n + 0.5) / (n + 0.5)) for t, n in held.items()}
        lists: dict[str, list[tuple[int, float]]] = {}
        for i, x in enumerate(items):
            weight = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x.words) / mean)) for t, n in Counter(x.words).items()}
            own = sum(weight.values())
            for t, w in weight.items():
                lists.setdefault(t, []).append((i, w / own))
        self.ids = {t: k for k, t in enumerate(lists)}
        self.places = [[i for i, _ in x] for x in lists.values()]
        self.shares = [[w for _, w in x] for x in lists.values()]
        self.block_most = [[max(x[j : j + BLOCK]) for j in range(0, len(x), BLOCK)] for x in self.shares]
        self.most = np.array([max(x) for x in self.shares] + [0.0])  # the last stands for tokens of no item
        self.question = [triples(x.question) for x in items]
        self.answer = [triples(x.answer) for x in items]
        self.half = max([HALF, *(len(x.words) for x in items)])
        aside = np.zeros(len(items))
        short = []
        for t in sorted(range(len(self.places)), key=lambda t: (-len(self.places[t]), t)):
            more = np.array(self.shares[t])
            if (aside[self.places[t]] + more <= MIN_SCORE / 2).all():
                aside[self.places[t]] += more
            else:
                short.append(t)
        short.sort()
        self.needed = MIN_SCORE - aside
        self.size = np.zeros(len(self.places) + 1, np.int64)  # of the lists that count; none for the last
        self.size[short] = [len(self.places[t]) for t in short]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.flat_places = np.array([i for t in short for i in self.places[t]], np.int64)
        self.flat_shares = np.array([w for t in short for w in self.shares[t]])

    def search(self, terms: list[int], least: float = MIN_SCORE) -> list[tuple[int, float]]:
        """All items whose shares over the distinct terms add up to least or more: block-max WAND."""
        end = len(self.items)
        at = [[self.places[t][0], 0, t] for t in terms]  # item under the cursor, cursor, term
        found = []
        while True:
            at = sorted(c for c in at if c[0] < end)
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(at):
                bound += self.most[t]
                if bound >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            shallow, next_ = 0.0, end  # the blocks that would hold the item, and where the first of them ends
            for _, j, t in at[: pivot + 1]:
                places = self.places[t]
                k = bisect_left(places, item, j)
                if k < len(places):
                    block = k // BLOCK
                    shallow += self.block_most[t][block]
                    next_ = min(next_, places[min(len(places), (block + 1) * BLOCK) - 1] + 1)
            if shallow < least - 1e-9:
                to = max(item + 1, min(next_, at[pivot + 1][0] if pivot + 1 < len(at) else end))
                moved = at[: pivot + 1]
            elif at[0][0] == item:
                score = sum(self.shares[t][j] for p, j, t in at[: pivot + 1])
                if score >= least - 1e-9:
                    found.append((item, score))
                to, moved = item + 1, at[: pivot + 1]
            else:
                to, moved = item, [c for c in at[:pivot] if c[0] < item]
            for c in moved:
                c[1] = bisect_left(self.places[c[2]], to, c[1])
                c[0] = self.places[c[2]][c[1]] if c[1] < len(self.places[c[2]]) else end

    def passages(self, ids: np.ndarray, half: np.ndarray, n_halves: int) -> np.ndarray:
        """Of the passage that starts at each half: whether some item may get from it what it needs of the short lists."""
        size = self.size[ids]
        seen = np.flatnonzero(size)
        size = size[seen]
        at = np.repeat(self.first[ids[seen]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        keys = np.repeat(half[seen], size) * len(self.items) + self.flat_places[at]
        out = np.zeros(n_halves + 1, bool)
        if not len(keys):
            return out[:-1]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(self.flat_shares[at][order], first)
        keys = keys[first]
        needed = self.needed[keys % len(self.items)] - 1e-9
        next_ = np.minimum(np.searchsorted(keys, keys + len(self.items)), len(keys) - 1)
        both = sums + np.where(keys[next_] == keys + len(self.items), sums[next_], 0.0)
        out[keys[both >= needed] // len(self.items)] = True
        out[keys[sums >= needed] // len(self.items) - 1] = True  # a half that is enough is in the passage before it, too
        return out[:-1]

    def leaks(self, texts: list[str | None]) -> list[dict[int, float]]:
        """Leaked items of each text with their best score."""
        words = [tokens(t) for t in texts]
        none = len(self.ids)
        n = np.array([len(x) for x in words], np.int64)
        ids = np.fromiter(map(self.ids.get, chain.from_iterable(words), repeat(none)), np.int64, int(n.sum()))
        begins = np.concatenate([[0], np.cumsum(n)])
        halves = -(-n // self.half)
        first = np.concatenate([[0], np.cumsum(halves)])
        half = np.repeat(first[:-1], n) + (np.arange(len(ids)) - np.repeat(begins[:-1], n)) // self.half
        may = self.passages(ids, half, int(first[-1]))
        found: list[dict[int, float]] = [{} for _ in texts]
        for d in np.unique(np.searchsorted(first, np.flatnonzero(may), "right") - 1):
            own = may[first[d] : first[d + 1]]
            for k in range(max(1, len(own) - 1)):
                if own[k] or len(own) == 1:
                    lo, hi = k * self.half, min((k + 2) * self.half, int(n[d]))
                    self._passage(words[d][lo:hi], np.unique(ids[begins[d] + lo : begins[d] + hi]), found[d])
        return found

    def _passage(self, words: list[str], terms: np.ndarray, found: dict[int, float]) -> None:
        have = None
        for item, score in self.search([int(t) for t in terms if t < len(self.ids)]):
            have = have or triples(words)
            if overlap(self.question[item], have, words) >= MIN_QUESTION and overlap(self.answer[item], have, words) >= MIN_ANSWER:
                found[item] = max(score, found.get(item, 0.0))


def slices(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str | None]]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def overlap(wanted: set[tuple[str, ...]], have: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of the wanted runs of words that the passage has; runs shorter than triples are looked for in its words."""
    if not wanted:
        return 0.0
    n = len(next(iter(wanted)))
    if n < 3:
        have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(wanted & have) / len(wanted)


def build_index(benchmark: DataFrame, part_items: int = PART_ITEMS) -> list[str]:
    """Paths of the index parts in the shared folder; none where no item has a token."""
    spark = benchmark.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [x for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in pieces(i, tokens(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x.item_id for x in own], pa.int64()), pa.array([x.words for x in own], pa.list_(pa.string()))], ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "item_id bigint, words array<string>")
    rows = materialize(rows, "benchmark-pieces")
    total, mean = rows.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    if not total:
        return []
    n = -(-total // part_items)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(n)).cast("int"))
    held = rows.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    of_part = rows.select("part", F.explode(F.array_distinct("words")).alias("token")).distinct().join(held, "token")
    facts = rows.select("part", F.lit(0).alias("kind"), "item_id", "words", F.lit(0).cast("long").alias("held"))
    facts = facts.unionByName(of_part.select("part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("item_id"), F.array("token").alias("words"), "held"))
    folder = fresh(spark, "benchmark-index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        at, items, held = None, [], {}

        def written() -> pa.RecordBatch:
            items.sort(key=lambda x: (x.item_id is None, x.item_id or 0, x.words))
            fs.create_dir(root, recursive=True)
            name = f"part-{at}-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pickle.dumps(Index(items, held, total, mean), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([f"{folder}/{name}"], pa.string())], ["part", "path"])

        for b in batches:
            for part, kind, item_id, words, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at and at is not None:
                    yield written()
                    items, held = [], {}
                at = part
                if kind == 0:
                    items += pieces(item_id, words)
                else:
                    held[words[0]] = n
        if at is not None:
            yield written()

    parts = facts.repartition(max(1, min(n, 10_000)), "part").sortWithinPartitions("part").mapInArrow(build, "part int, path string")
    # only the paths that the finished tasks return count, so that a lost attempt leaves nothing that is read
    return [r["path"] for r in materialize(parts, "benchmark-parts").orderBy("part").collect()]


@lru_cache(1)
def _loaded(path: str) -> Index:
    """A part of the index; a worker keeps the last one."""
    fs, name = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as f:
        return pickle.loads(f.read())


def _pass(docs: DataFrame, path: str, items_column: str, score_column: str) -> DataFrame:
    """docs (with both columns) after one part of the index: its items and best score added to those that are there."""
    place, own, best = (docs.columns.index(c) for c in ("text", items_column, score_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _loaded(path)
        for b in batches:
            found = (f for texts in slices(b.column(place).to_pylist()) for f in index.leaks(texts))
            ids, scores = [], []
            for have, score, f in zip(b.column(own).to_pylist(), b.column(best).to_pylist(), found, strict=True):
                ids.append(sorted({*have, *(index.items[i].item_id for i in f if index.items[i].item_id is not None)}))
                scores.append(max([score, *f.values()]))
            columns = list(b.columns)
            columns[own], columns[best] = pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _searched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str, str]:
    """docs (any columns, text among them) with two more, whose names are returned: leaked item_ids, ascending, and the best score, or 0."""
    items, score = unused(docs.columns, "__t_items"), unused(docs.columns, "__t_score")
    text = docs.withColumn("text", F.col("text").cast("string"))
    out = text.withColumns({items: F.array().cast("array<bigint>"), score: F.lit(0.0)})
    for i, path in enumerate(build_index(benchmark)):
        out = _pass(materialize(out, "benchmark-pass") if i else out, path, items, score)
    return out, items, score


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, score for every row of docs (doc_id, text; other columns are ignored).

    A text that is null or has no token, and any text when the benchmark has no items, is clean, with score 0. Items with a
    null id count but are not named; equal items are each named. Rows are judged one by one, so repeated rows give repeated results.
    An empty table gives no rows.
    """
    found, items, score = _searched(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.col(score) > 0).alias("contaminated"), F.col(items).alias("item_ids"), F.col(score).alias("score"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leaked item, with the columns of docs, whatever their names. Nulls, empty texts, repeated rows and empty tables as in decontaminate: clean, clean,
    judged each, and no rows; a very long text is searched whole, passage by passage."""
    found, _, score = _searched(docs, benchmark)
    return found.filter(F.col(score) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
