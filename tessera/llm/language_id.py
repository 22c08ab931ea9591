"""Language identification by one interpolated Kneser-Ney character model per language.

Texts become runs of 16-bit units: lower case, everything that is no letter one space, characters beyond the basic plane
one unit. A gram of ORDER units is a 64-bit number. Counts of grams by language are summed over all training texts (each task
sends its distinct grams once), lower orders are continuation counts derived from the distinct grams, and the models of all languages are
folded into sorted hash arrays: for each order the sorted hashes of all grams and, in step, the log probability under every language. Scoring looks
each place of a text up once; a gram unknown to all languages backs off with the weight of its context.

The prediction is the language of the lowest cross-entropy per unit. It is accepted unless that is above a limit of
the language, calibrated on all its training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

ORDER = 4
#: Languages at most; more is an error, not a silent cut.
MAX_LANGUAGES = 200
#: Quantile of the cross-entropies of a language's training texts, and slack of its limit.
QUANTILE, SLACK = 0.995, 1.25
#: How sharply differences of cross-entropy (nats per unit) turn into the score.
SHARPNESS = 12.0
UNDETERMINED = "und"
SPACE, START = 32, 1
#: Distinct grams of a language that a counting task holds; bytes of texts that are Python objects at a time; characters that are scored at a time.
HELD, PART_BYTES, SCORED = 400_000, 4_000_000, 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    table = np.zeros(65536, np.uint16)
    for i in range(65536):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            table[i] = i
    table[table == 0] = SPACE
    table[0], table[START], table[0xFFFF] = 0, START, 0xFFFF
    return table


_TABLE: list[np.ndarray] = []


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of units, each opened by two START units and a space; and where each begins (one more at the end)."""
    if not _TABLE:
        _TABLE.append(_letters())
    clean = [t.replace("\0", " ").replace("\x01", " ") if "\0" in t or "\x01" in t else t for t in texts]
    wide = np.frombuffer(("\0".join(["", *clean, ""])).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    u = _TABLE[0][np.where(wide > 0xFFFE, 0xFFFF, wide)]
    # a separator stands before each text; the space that opens a text swallows the spaces that follow
    blank = (u == SPACE) | (u == 0)
    keep = ~((u == SPACE) & np.concatenate([[False], blank[:-1]]))
    u = u[keep]
    at = np.flatnonzero(u == 0)
    out = np.insert(u, np.repeat(at[:-1] + 1, 2), np.tile(np.array([START, SPACE], np.uint16), len(at) - 1)) if len(at) > 1 else u
    out[out == 0] = START
    begins = at + 2 * np.arange(len(at))
    return out[: begins[-1]], begins


def grams(u: np.ndarray) -> np.ndarray:
    """The gram that ends at each place from ORDER - 1 on."""
    w = u.astype(np.uint64)
    return (w[:-3] << np.uint64(48)) | (w[1:-2] << np.uint64(32)) | (w[2:-1] << np.uint64(16)) | w[3:]


def inside(begins: np.ndarray, n: int) -> np.ndarray:
    """False for grams that reach over the start of a text."""
    ok = np.ones(max(0, n), bool)
    for back in (1, 2, 3):
        hit = begins[1:-1] - back
        ok[hit[(hit >= 0) & (hit < n)]] = False
    return ok


def has_letter(texts: list[str]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in texts], bool)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def slices(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """batch in parts of about PART_BYTES of its text column."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + PART_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def gram_counts(train: DataFrame) -> DataFrame:
    """lang, gram, n over all texts of train (text, lang). A task holds its distinct grams, and passes them on when they are many."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        def out(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
        for b in (x for whole in batches for x in parts(whole, 0)):
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, part in by.items():
                for _, texts in slices(part):
                    u, begins = units(texts)
                    g = grams(u) if len(u) >= ORDER else np.zeros(0, np.uint64)
                    keys, n = np.unique(g[inside(begins, len(g))], return_counts=True)
                    have = held.pop(lang, None)
                    if have:
                        keys, n = _summed(np.concatenate([have[0], keys]), np.concatenate([have[1], n]))
                    if len(keys) > HELD:
                        yield out(lang, keys, n)
                    else:
                        held[lang] = [keys, n]
        for lang, (keys, n) in held.items():
            yield out(lang, keys, n)

    counted = train.mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Order:
    """Sorted hashes with the values of all languages in step; the upper bits of a hash say where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys * MIX
        order = np.argsort(h)
        self.h, self.values = h[order], np.ascontiguousarray(values[order], np.float32)
        self.bits = max(1, int(len(keys)).bit_length())
        bucket = (self.h >> np.uint64(64 - self.bits)).astype(np.int64)
        size = np.bincount(bucket, minlength=1 << self.bits)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        self.longest = int(size.max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.h):
            return np.full(len(keys), -1, np.int32)
        h = keys * MIX
        b = (h >> np.uint64(64 - self.bits)).astype(np.int32)
        at, last = self.start[b], len(self.h) - 1
        at = np.minimum(at, last)
        found = np.where(self.h[at] == h, at, -1)
        open_ = np.flatnonzero(found < 0)
        end = self.start[b[open_] + 1]
        p = at[open_]
        for _ in range(1, self.longest):
            p = p + 1
            more = p < end
            open_, p, end = open_[more], p[more], end[more]
            if not len(open_):
                break
            hit = self.h[p] == h[open_]
            found[open_[hit]] = p[hit]
        return found


class Models:
    """The models of all languages over common sorted hash arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        low = [np.uint64((1 << 16 * k) - 1) for k in range(5)]
        by = []  # for each language: keys and counts of each order from 1 to ORDER
        for lang in self.langs:
            keys, n = counts[lang]
            levels = {ORDER: (keys, n.astype(np.float64))}
            for k in range(ORDER - 1, 0, -1):
                keys, n = np.unique(levels[k + 1][0] & low[k], return_counts=True)
                levels[k] = (keys, n.astype(np.float64))
            by.append(levels)
        vocabulary = len(np.unique(np.concatenate([x[1][0] for x in by]))) + 1 if n_langs else 1
        self.unknown = np.full((1, n_langs), -np.log(vocabulary), np.float32)
        self.orders: dict[int, Order] = {}
        self.backoffs: dict[int, Order] = {}
        if not n_langs:
            return
        lower = lambda keys: np.repeat(self.unknown.astype(np.float64), len(keys), 0)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([x[k][0] for x in by]))
            contexts = np.unique(keys >> np.uint64(16)) if k > 1 else np.zeros(1, np.uint64)
            p, gamma = np.zeros((len(keys), n_langs)), np.ones((len(contexts), n_langs))
            for j, x in enumerate(by):
                own, n = x[k]
                n1, n2 = (n == 1).sum(), (n == 2).sum()
                d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
                at = np.searchsorted(contexts, own >> np.uint64(16)) if k > 1 else np.zeros(len(own), int)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                gamma[:, j] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                p[np.searchsorted(keys, own), j] = (n - d) / total[at]
            at = np.searchsorted(contexts, keys >> np.uint64(16)) if k > 1 else np.zeros(len(keys), int)
            logs = np.log(p + gamma[at] * np.exp(lower(keys)))
            self.orders[k], self.backoffs[k] = Order(keys, logs), Order(contexts, np.log(gamma))
            lower = lambda g, k=k: self.log_p(g & low[k], k).astype(np.float64)

    def log_p(self, g: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log probability of the last unit of each k-gram after the others, a column for each language."""
        if k == 0:
            return np.repeat(self.unknown, len(g), 0)
        at = self.orders[k].find(g)
        out = self.orders[k].values[at] if len(self.orders[k].h) else np.zeros((len(g), len(self.langs)), np.float32)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            shorter = g[rest]
            below = self.log_p(shorter & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
            seen = self.backoffs[k].find(shorter >> np.uint64(16) if k > 1 else np.zeros(len(rest), np.uint64))
            out[rest] = below + np.where((seen >= 0)[:, None], self.backoffs[k].values[np.maximum(seen, 0)], 0)
        return out

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per unit of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for start, part in slices(texts, SCORED):
            u, begins = units(part)
            g = grams(u)
            logs = self.log_p(g)
            logs[~inside(begins, len(g))] = 0
            n = np.diff(begins) - (ORDER - 1)
            out[start : start + len(part)] = -np.add.reduceat(logs, begins[:-1], axis=0, dtype=np.float64) / n[:, None]
        return out


def train(training: DataFrame) -> Models:
    """Models of all languages in training (text and lang, neither null). The whole table of counts comes to the driver as
    Arrow columns: discounts, context totals and continuation counts are those of every gram, and none is left out."""
    counts = materialize(gram_counts(training.select(F.col("text").cast("string").alias("text"), "lang")), "language-grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = {}
    for lang in langs:
        own = counts.filter(F.col("lang") == lang).select("gram", "n").toArrow()
        found[lang] = _summed(own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy())
    return Models(found)


def _scored(docs: DataFrame, models: Models, limits: dict[str, float]) -> DataFrame:
    """docs (any columns, text among them) with __t_lang, __t_score, __t_entropy and __t_accepted, in Arrow batches. Columns of docs must not have these names (see keep_identified)."""
    shared = docs.sparkSession.sparkContext.broadcast((models, limits))
    place = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limits = shared.value
        for b in (x for whole in batches for x in parts(whole, place)):
            texts = [t or "" for t in b.column(place).to_pylist()]
            ok = has_letter(texts)
            lang, value, entropy = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if models.langs and ok.any():
                rows = np.flatnonzero(ok)
                h = models.cross_entropies([texts[i] for i in rows])
                best = h.argmin(1)
                least = h[np.arange(len(rows)), best]
                value[rows] = 1 / np.exp(-SHARPNESS * (h - least[:, None])).sum(1)
                entropy[rows] = least
                for i, j in zip(rows, best, strict=True):
                    lang[i] = models.langs[j]
            accepted = [x in limits and e <= limits[x] for x, e in zip(lang, entropy, strict=True)]
            new = [pa.array(lang, pa.string()), pa.array(value), pa.array(entropy), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "__t_lang", "__t_score", "__t_entropy", "__t_accepted"])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__t_lang string", "__t_score double", "__t_entropy double", "__t_accepted boolean"])
    return docs.mapInArrow(score, out)


def calibrate(scored: DataFrame, models: Models, quantile: float = QUANTILE, slack: float = SLACK) -> dict[str, float]:
    """The limit of each language: slack times the quantile of the cross-entropy of all its training texts that are identified as of it
    (scored: lang, __t_lang and __t_entropy). A language without any takes the largest limit of the others."""
    own = scored.filter(F.col("lang") == F.col("__t_lang"))
    found = own.groupBy("lang").agg(F.percentile_approx("__t_entropy", quantile, 10_000).alias("q")).toPandas()
    limits = {lang: slack * q for lang, q in zip(found["lang"], found["q"], strict=True)}
    return {lang: limits.get(lang, max(limits.values(), default=float("inf"))) for lang in models.langs}


def in_training():
    return ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()


def fit(docs: DataFrame) -> tuple[Models, dict[str, float]]:
    training = docs.filter(in_training()).select("doc_id", "text", "lang")
    models = train(training)
    return models, calibrate(_scored(training, models, {}), models)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, cross_entropy for every row of docs (doc_id, text, lang).

    Learns from rows that are not held out and have a text and a language. A text that is null or has no letter is `und` with score 0, as is every
    text when there is nothing to learn from; ties go to the first language by name. A row with a null doc_id is held out. Repeated rows are
    predicted each; other columns are ignored; an empty table gives no rows.
    """
    models = train(docs.filter(in_training()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", F.when(in_training(), F.col("lang")).alias("lang"))
    # each text is scored once: the limits come from the same scores, without the texts
    scored = materialize(_scored(rows, models, {}).select("doc_id", "lang", "__t_lang", "__t_score", "__t_entropy"), "language-scores")
    limit = F.lit(None).cast("double")
    for lang, value in calibrate(scored, models).items():
        limit = F.when(F.col("__t_lang") == lang, F.lit(value)).otherwise(limit)
    accepted = F.coalesce(F.col("__t_entropy") <= limit, F.lit(False))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__t_lang").alias("lang_pred"), F.col("__t_score").alias("score"), accepted.alias("accepted"), F.col("__t_entropy").alias("cross_entropy"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is determined and accepted, with the columns of docs, whatever their names. Texts that are null or have no letter go; repeated rows
    are judged alike; a very long text is scored whole; where there is nothing to learn from nothing is kept; an empty table gives no rows."""
    models, limits = fit(docs)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return _scored(row, models, limits).filter("__t_accepted").select(*[F.col(f"row.`{c}`") for c in docs.columns])
