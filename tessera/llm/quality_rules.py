"""Quality rules: base counts, and the distance of a text's histograms from those of its language.

A text is described by two histograms: code points by character class, and words by the commonest words of its
language, which are learned from all texts: the N_COMMON words that the most texts of the language have REPEATS times or more. Jensen-Shannon distances to the
language's reference (medians over all texts of that language that are long
enough) decide, unless the text is too short for its histogram to mean anything. Everything is a DataFrame
expression. A text is exploded into its repeated words only, and nothing else is shuffled but one row of sketches for each language and task.

Nulls and ties: a null text counts as empty (and so fails the base rule); a null language, or one of which no text repeats a word, is compared with the
medians over all languages, by classes only. Words that equally many texts have go by their hash. Rows are judged one by one, so repeated rows are judged alike, and
columns of any other name pass through. A very long text is judged whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import NOT_WS, WS, materialize

#: Commonest words of a language that are looked for, and how often a text has to have a word to count for it.
N_COMMON, REPEATS = 50, 3
#: Parts in which a language's words are ranked.
PARTS = 64
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ("lower", "upper", "digit", "space", "stop", "other")
#: Words from which the histograms are judged; texts below this are judged by the base rule alone.
MIN_WORDS = 60
#: Words from which the histogram of common words is judged, too: with fewer, its distance is mostly that of a small sample.
MIN_COMMON_WORDS = 200
#: Largest distances (square roots of the divergence to base 2, so 0 to 1) of a kept text, from the distances of labelled texts (sf0.1): 99.9 % of the good
#: ones have at most 0.205, and of those long enough 0.281; of the others 95 % have more than 0.207, and of those long enough 0.294.
MAX_CLASS, MAX_COMMON = 0.21, 0.29
#: Rows of references that are broadcast.
MAX_LANGUAGES = 10_000
#: The base rule.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur at least twice, from the words' hashes.

    Each window is a 64-bit hash. Sorting longs made of the upper 40 bits of the hash and the window's place (24 bits)
    brings equal windows together; neighbours are confirmed on the whole hash. The result is the size of the union of
    [p, p + 2] over the confirmed places p. Places of texts of 2^24 words or more do not fit, so these are sorted as pairs of hash and place.
    """
    low = (1 << 24) - 1

    def union(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def repeated(near: Column, same, place) -> Column:
        equal = lambda x, y: F.coalesce(same(x, y), F.lit(False))
        return F.sort_array(F.transform(F.filter(near, lambda x, j: equal(x, F.get(near, j - 1)) | equal(x, F.get(near, j + 1))), place))

    def packed(h: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        same = lambda x, y: (F.shiftright(x, 24) == F.shiftright(y, 24)) & (F.get(h, place(x)) == F.get(h, place(y)))
        return let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))), lambda s: let(repeated(s, same, place), union))

    def wide(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(repeated(s, lambda x, y: x["h"] == y["h"], lambda x: x["i"]), union))

    def of(one: Column) -> Column:
        windows = F.transform(F.slice(one, 1, F.size(one) - 2), lambda x, i: F.xxhash64(x, F.get(one, i + 1), F.get(one, i + 2)))
        found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).when(F.size(h) > low, wide(h)).otherwise(packed(h)))
        return F.when(F.size(one) < 3, F.lit(0)).otherwise(found)

    return let(hashes, of).cast("long")


def then(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, each computed exactly once: a generator of one row stands between them and what uses them, as
    projections would be merged and a value that is used often computed as often."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(f"__t_{k}") for k, v in columns.items()]))))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def common_words(docs: DataFrame) -> DataFrame:
    """(__t_lang, __t_top): for each language of docs (text, lang) the hashes of its N_COMMON commonest words, one row a language."""
    last = lambda s: lambda w, i: (w == F.get(s, i + (REPEATS - 1))) & ~F.coalesce(w == F.get(s, i - 1), F.lit(False))
    rows = docs.where("lang is not null and text is not null")
    often = let(F.sort_array(word_hashes(split_words(F.col("text")))), lambda s: F.filter(s, last(s)))
    seen = rows.select("lang", F.explode(often).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # the best of each of many parts of a language's words, and then the best of these
    best = materialize(seen, "repeated-words").withColumn("part", F.pmod("word", F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        first = Window.partitionBy(*keys).orderBy(F.desc("n"), "word")
        best = best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= N_COMMON).drop("place")
    top = best.groupBy(F.col("lang").alias("__t_lang")).agg(F.sort_array(F.collect_list("word")).alias("__t_top"))
    return materialize(top, "common-words")


def _few(table: DataFrame) -> DataFrame:
    """One row a language: broadcast while there are at most MAX_LANGUAGES of them (counted), and left to the optimizer beyond."""
    return F.broadcast(table) if table.count() <= MAX_LANGUAGES else table


def with_histograms(docs: DataFrame, top: DataFrame) -> DataFrame:
    """Add __t_top, __t_words, __t_hashes, __t_n_words, __t_word_chars, __t_n_symbols and __t_classes. Each class of characters is taken out of the text before the next is counted."""
    docs = docs.join(_few(top), F.col("lang") == F.col("__t_lang"), "left").drop("__t_lang")
    d = then(docs, text=F.coalesce(F.col("text"), F.lit("")))
    d = then(d, a=F.regexp_replace("__t_text", "[a-z]+", ""), words=split_words(F.col("__t_text")))
    d = then(d, b=F.regexp_replace("__t_a", WS + "+", ""), n_words=F.size("__t_words").cast("long"), hashes=word_hashes(F.col("__t_words")))
    d = then(d, c=F.regexp_replace("__t_b", r"\p{Ll}+", ""))
    d = then(d, d=F.regexp_replace("__t_c", r"\p{Lu}+", ""))
    d = then(d, e=F.regexp_replace("__t_d", r"\p{Nd}+", ""), n_symbols=F.length("__t_d").cast("long") - F.length(F.regexp_replace("__t_d", SYMBOLS, "")))
    d = then(d, f=F.regexp_replace("__t_e", "[.,]+", ""), **{f"n_{c}": F.length(f"__t_{c}").cast("long") for c in ("text", "a", "b", "c", "d", "e")})
    n = {c: F.col(f"__t_n_{c}") for c in ("text", "a", "b", "c", "d", "e")}
    by = {"lower": n["text"] - n["a"] + n["b"] - n["c"], "space": n["a"] - n["b"], "upper": n["c"] - n["d"], "digit": n["d"] - n["e"], "stop": n["e"] - F.length("__t_f"), "other": F.length("__t_f").cast("long")}
    return then(d, word_chars=n["text"] - by["space"], classes=F.array(*[by[c] for c in CLASSES]))


def common_counts(hashes: Column, top: Column) -> Column:
    """How often each of the hashes of top (ascending) is among hashes; 0 for those that a short list lacks, null for a null list.

    All are sorted together, with two low bits that put a word between a lower and an upper mark of each common word: the distance of the two marks, less one, is the count. So the cost grows with the
    length of the text, and not with the number of common words.
    """
    marked = lambda a, low: F.transform(a, lambda h: h.bitwiseAND(F.lit(~3)).bitwiseOR(F.lit(low).cast("long")))
    all_ = F.sort_array(F.concat(marked(hashes, 1), marked(top, 0), marked(top, 2)))
    places = F.filter(F.transform(all_, lambda x, i: F.when(x.bitwiseAND(F.lit(3).cast("long")) == 1, F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    return let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(N_COMMON - 1)), lambda k: F.coalesce((F.get(p, 2 * k + 1) - F.get(p, 2 * k) - 1).cast("long"), F.lit(0).cast("long"))))


def references(counted: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a language (lang; null: all languages together): the median share of each class and common word over
    its long enough texts. Medians keep the junk in a corpus from shifting the reference."""
    counted = counted.filter(F.col("__t_n_words") >= min_words)
    n_chars = F.aggregate("__t_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = counted.select("lang", *[(F.get("__t_classes", F.lit(i)) / n_chars).alias(f"c{i}") for i in range(len(CLASSES))], *[(F.get("__t_common", F.lit(i)) / F.col("__t_n_words")).alias(f"w{i}") for i in range(N_COMMON)])
    names = shares.columns[1:]
    medians = [F.percentile_approx(c, 0.5, 2000).alias(c) for c in names]
    by_lang = shares.filter(F.col("lang").isNotNull()).groupBy("lang").agg(*medians)
    together = shares.agg(*medians).select(F.lit(None).cast("string").alias("lang"), *names)
    return materialize(by_lang.unionByName(together), "quality-references").select(
        F.col("lang").alias("__t_lang"), F.array(*names[: len(CLASSES)]).alias("__t_ref_classes"),
        F.array(*names[len(CLASSES) :], F.lit(1.0) - sum(F.col(c) for c in names[len(CLASSES) :])).alias("__t_ref_common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of counts; null if either has no mass."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def shares(a: Column) -> Column:
        return let(F.transform(a, lambda x: F.coalesce(x, F.lit(0)).cast("double")), lambda d: let(F.aggregate(d, F.lit(0.0), lambda s, x: s + x), lambda s: F.when(s > 0, F.transform(d, lambda x: x / s))))

    parts = F.zip_with(shares(p), shares(q), lambda x, y: part(x, y) + part(y, x))
    whole = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.when(whole < 0, F.lit(0.0)).otherwise(whole))


def with_reference(d: DataFrame, refs: DataFrame) -> DataFrame:
    """Add the reference of each row's language, or that of all languages."""
    own = refs.filter(F.col("__t_lang").isNotNull())
    every = refs.filter(F.col("__t_lang").isNull()).select(F.col("__t_ref_classes").alias("__t_all_classes"))
    d = d.join(_few(own), F.col("lang") == F.col("__t_lang"), "left").join(F.broadcast(every), F.lit(True), "left")
    return d.withColumn("__t_known", F.col("__t_lang")).withColumn("__t_ref_classes", F.coalesce("__t_ref_classes", "__t_all_classes"))


def measured(docs: DataFrame, top: DataFrame) -> DataFrame:
    """docs with everything that is counted in a text."""
    lines = F.filter(F.split("__t_text", "\n"), lambda x: x.rlike(NOT_WS))
    d = then(with_histograms(docs, top), n_repeat_words=repeat_words(F.col("__t_hashes")), n_dup_lines=let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    d = d.drop("text", *[f"__t_{c}" for c in ("text", "words", "a", "b", "c", "d", "e", "f")])
    return d.withColumn("__t_common", F.when(F.col("__t_top").isNotNull(), common_counts(F.col("__t_hashes"), F.col("__t_top"))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON, keep: Column | None = None) -> DataFrame:
    """keep (by default the whole row as a struct, as __t_row), lang, and the columns of COUNTS and RESULT with the prefix __t_. The texts are read twice, once for the common words
    and once for the counts, which are written to the shared folder with keep; references and verdicts come from there."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep is None else keep
    rows = docs.select(row.alias("__t_row"), F.col("text").cast("string").alias("text"), "lang")
    counted = materialize(measured(rows, common_words(rows.select("text", "lang"))).select("__t_row", "lang", *[f"__t_{c}" for c in COUNTS]), "quality-counts")
    return _verdict(with_reference(counted, references(counted, min_words)), min_words, max_class, max_common)


def _verdict(d: DataFrame, min_words: int, max_class: float, max_common: float) -> DataFrame:
    rest = F.greatest(F.lit(0), F.col("__t_n_words") - F.aggregate("__t_common", F.lit(0).cast("long"), lambda a, x: a + x))
    d = then(d, all_common=F.concat("__t_common", F.array(rest)))
    d = then(
        d,
        class_distance=js_distance(F.col("__t_classes"), F.col("__t_ref_classes")),
        common_distance=F.when(F.col("__t_known").isNotNull() & F.col("__t_common").isNotNull(), js_distance(F.col("__t_all_common"), F.col("__t_ref_common"))),
    )
    d = d.withColumn("__t_base_failed", (F.col("__t_n_words") < BASE_MIN_WORDS) | (100 * F.col("__t_n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("__t_n_words")))
    odd = (F.coalesce(F.col("__t_class_distance"), F.lit(0.0)) > max_class) | ((F.col("__t_n_words") >= max(min_words, MIN_COMMON_WORDS)) & (F.coalesce(F.col("__t_common_distance"), F.lit(0.0)) > max_common))
    return d.withColumn("__t_kept", ~F.col("__t_base_failed") & ~((F.col("__t_n_words") >= min_words) & odd))


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance")


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON) -> DataFrame:
    """doc_id and the columns of RESULT for every row of docs."""
    judged = judge(docs, min_words, max_class, max_common, F.struct("doc_id"))
    return judged.select("__t_row.doc_id", *[F.col(f"__t_{c}").alias(c) for c in RESULT])


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever their names."""
    return judge(docs, **limits).filter("__t_kept").select(*[F.col(f"__t_row.`{c}`") for c in docs.columns])
