"""Each operator against a brute-force version, and on the hard cases: nulls in any column, empty and very long texts, ties and repeated rows,
empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import chat_format, decontamination, language_id, mixing, near_dedup, perplexity, quality_rules, tokens, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, lang="en"):
    common = {"en": "the of and to in a is that", "fr": "de la le et les des en un"}[lang].split()
    rare = ["ba", "lo", "mi", "ter", "ven", "ski", "dro", "pel"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(rare) for _ in range(3)) for _ in range(n))


def hard_documents():
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [base, near, base, base.upper(), None, "", " \n\t", "one two", "one two", "a b c d e", "A B C D E", "...", "word " * 3000, prose(rng, 4000)]
    texts += [prose(rng, 80, lang) for lang in ("en", "fr") for _ in range(30)]
    rows = [(i, t, None if i == 5 else "fr" if i >= 44 else "en", None if i % 7 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return [*rows, (None, base, "en", "s0", 1), (None, None, None, None, None), rows[0], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(hard_documents(), SCHEMA)
    return df.withColumnsRenamed({"n_chars": "n"}).withColumn("score", df["doc_id"]).withColumn("node", df["source"]).withColumn("size", df["doc_id"]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(docs, empty):
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.quality(docs).drop("kept", "class_distance", "common_distance").collect())
    want = collections.Counter()
    for doc_id, text, *_ in hard_documents():
        w = WORD.findall(text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        want[(doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert got == want
    assert quality_rules.quality(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.keep_good(empty).count() == 0


def test_quality_drops_fragments_and_texts_without_common_words(spark):
    rng = random.Random(5)
    rare = ["ba", "lo", "mi", "ter", "ven", "ski", "dro", "pel"]
    word = lambda common: rng.choice("the of and to in a is that".split()) if rng.random() < common else "".join(rng.choice(rare) for _ in range(2))
    text = lambda common, n=400: " ".join(word(common) + (". And" if i % 10 == 9 else "") for i in range(n))
    fragments = [" | ".join(" ".join(word(0.05) for _ in range(rng.choice((1, 2)))) for _ in range(150)) for _ in range(3)]
    texts = [text(0.2) for _ in range(60)] + fragments + [" ".join(word(0) for _ in range(400)) for _ in range(3)]
    rows = quality_rules.quality(spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(60))


def test_mixing_meets_targets(spark, docs, empty):
    rows = mixing.mix(docs, bucket_rows=5).collect()
    assert len(rows) == docs.count()
    assert sorted(r.size for r in rows) == sorted(len(WORD.findall(t or "")) for _, t, *_ in hard_documents())
    by = collections.defaultdict(list)
    source = {d: s for d, _, _, s, _ in hard_documents()}
    for r in rows:
        if r.doc_id is not None:
            by[source[r.doc_id]].append(r)
    for rs in by.values():
        assert len({(r.source_size, r.target) for r in rs}) == 1
        assert all(0 <= r.taken <= 3 * r.size for r in rs)
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= 4
    again = sorted(map(tuple, mixing.mix(docs.repartition(3), bucket_rows=5).collect()), key=repr)
    assert again == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(empty).count() == 0


def test_targets_reshare(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 10), ("d", 5), (None, 975)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size bigint, source_rows bigint")).collect()}
    weight, size = dict(zip([s for s, _ in sizes], (1, 2, 3, 1, 2))), dict(sizes)
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in weight if x not in capped) for s in weight if s not in capped}
        more = {s for s in share if share[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in weight:
        assert got[s] == pytest.approx(3 * size[s] if s in capped else share[s])


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def test_near_duplicates_against_all_pairs(spark, docs, empty):
    rng = random.Random(7)
    extra = []
    for g in range(12):  # groups whose members are similar to a greater or lesser degree
        words = prose(rng, 150).split()
        for _ in range(8):
            w = list(words)
            for _ in range(rng.choice([0, 1, 3, 6, 9])):
                w[rng.randrange(150)] = "x" + str(rng.random())
            extra.append((1000 + len(extra), " ".join(w), None, None, None))
    rows = hard_documents() + extra
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "first")).collect()
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()} - {None})


def test_decontamination(spark, docs, empty):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(3, 60))) for i in range(150)] + [(150, None), (151, ""), (None, prose(rng, 30)), (0, "one repeated item that stands twice here")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    leak = prose(rng, 200) + "\n" + items[7][1].upper().replace(" ", " , ") + " " + prose(rng, 300) + " " + items[8][1]
    question_only = prose(rng, 90) + " " + " ".join(items[9][1].split()[: len(items[9][1].split()) // 2]) + " " + prose(rng, 90)
    rows = [(0, leak, None, None, None), (1, question_only, None, None, None), (2, None, None, None, None), (3, "", None, None, None), (4, prose(rng, 20000), None, None, None)]
    got = {r.doc_id: r for r in decontamination.decontaminate(spark.createDataFrame(rows, SCHEMA), benchmark).collect()}
    assert {7, 8} <= set(got[0].item_ids) and got[0].contaminated
    assert 9 not in got[1].item_ids
    assert not got[2].contaminated and not got[3].contaminated
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, benchmark.limit(0)).collect())
    kept = decontamination.keep_clean(docs.withColumn("__t_items", docs["doc_id"]), benchmark)
    assert kept.columns == [*docs.columns, "__t_items"] and kept.count() == docs.count()
    # parts of the index give what one index gives, and a long item is found by any of its pieces
    paths = decontamination.build_index(benchmark, 40)
    assert len(paths) == 4 and sum(len(decontamination._loaded(p).items) for p in paths) == 152
    long = prose(rng, 2000)
    own = spark.createDataFrame([(5, long)], "item_id bigint, text string")
    piece = " ".join(long.split()[700:1300])
    got = decontamination.decontaminate(spark.createDataFrame([(1, prose(rng, 100) + " " + piece), (2, prose(rng, 600))], "doc_id bigint, text string"), own).collect()
    assert {(r.doc_id, tuple(r.item_ids)) for r in got} == {(1, (5,)), (2, ())}


def test_decontamination_against_brute_force(spark):
    """Every passage against every item: BM25 share, then the triples of question and answer."""
    rng = random.Random(17)
    items = [(i, prose(rng, rng.randint(5, 40))) for i in range(60)]
    rows = []
    for i in range(60):
        words = prose(rng, rng.randint(0, 400)).split()
        if i % 2:
            w = rng.choice(items)[1].split()
            w = [x if rng.random() > (i % 5) * 0.08 else "changed" for x in w]
            at = rng.randint(0, len(words))
            words[at:at] = w
        rows.append((i, " ".join(words)))
    index = decontamination.Index([decontamination.make_item(*x) for x in items])
    want = {}
    for i, text in rows:
        w, hits = decontamination.tokens(text), set()
        for lo in range(0, max(1, len(w) - index.half), index.half):
            part = w[lo : lo + 2 * index.half]
            have = set(zip(part, part[1:], part[2:]))
            for k, x in enumerate(index.items):
                share = sum(index.shares[t][index.places[t].index(k)] for t in {index.ids[a] for a in set(part) & set(x.words)})
                enough = lambda run: len(set(zip(run, run[1:], run[2:])) & have) / max(1, len(set(zip(run, run[1:], run[2:]))))
                short = lambda run: len({tuple(run)} & {tuple(part[j : j + len(run)]) for j in range(len(part))}) if len(run) < 3 else enough(run)
                if share >= decontamination.MIN_SCORE - 1e-9 and short(x.question) >= decontamination.MIN_QUESTION and short(x.answer) >= decontamination.MIN_ANSWER:
                    hits.add(x.item_id)
        want[i] = sorted(hits)
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: r.item_ids for r in got} == want and any(want.values())
    assert all(r.contaminated == bool(want[r.doc_id]) for r in got)


def test_search_finds_all_above_the_threshold():
    rng = random.Random(11)
    index = decontamination.Index([decontamination.make_item(i, prose(rng, rng.randint(3, 60))) for i in range(400)])
    for _ in range(300):
        terms = sorted(rng.sample(range(len(index.ids)), rng.choice([3, 10, 40, 100])))
        least = rng.choice([0.05, 0.1, 0.3])
        score = collections.Counter()
        for t in terms:
            for place, share in zip(index.places[t], index.shares[t]):
                score[place] += share
        found = dict(index.search(terms, least))
        assert set(found) == {p for p, s in score.items() if s >= least - 1e-9}
        assert all(found[p] == pytest.approx(score[p]) for p in found)


def test_passages_skip_nothing():
    rng = random.Random(13)
    items = [decontamination.make_item(i, prose(rng, rng.randint(3, 60))) for i in range(60)]
    index = decontamination.Index(items)
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 150))] + [" ".join(rng.choice(items).words) + " " + prose(rng, rng.randint(0, 150)) for _ in range(2)]
        words = decontamination.tokens(" ".join(parts))
        want = {}
        for lo in range(0, max(1, len(words) - index.half), index.half):
            index._passage(words[lo : lo + 2 * index.half], [index.ids[w] for w in sorted(set(words[lo : lo + 2 * index.half]) & set(index.ids), key=index.ids.get)], want)
        assert index.leaks([None, " ".join(parts), ""])[1].keys() == want.keys()


def test_language(spark, docs, empty):
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    texts = dict((d, (t, lang)) for d, t, lang, *_ in hard_documents())
    for r in rows:
        text = texts[r.doc_id][0] if r.doc_id is not None else "a"
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.doc_id is not None and (text is None or not any(map(str.isalpha, text))):
            assert r.lang_pred == "und"
        elif r.doc_id is not None and r.doc_id >= 14:
            assert r.lang_pred == texts[r.doc_id][1]
    assert language_id.identify(empty).count() == 0
    none = language_id.identify(docs.withColumn("lang", docs["lang"].isNull().cast("string").substr(9, 9)).replace("", None, "lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_language_models_are_distributions():
    rng = random.Random(2)
    train = {lang: [prose(rng, 60, lang) for _ in range(10)] for lang in ("en", "fr")}
    import numpy as np

    counts = {}
    for lang, texts in train.items():
        u, begins = language_id.units(texts)
        g = language_id.grams(u)
        counts[lang] = np.unique(g[language_id.inside(begins, len(g))], return_counts=True)
    models = language_id.Models(counts)
    seen = np.unique(np.concatenate([k for k, _ in counts.values()]) & np.uint64(0xFFFF))
    for context in ("the", " of", "zzz", "\x01 t"):
        base = np.uint64(sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context)))
        total = np.exp(models.log_p(np.array([base | w for w in seen], np.uint64)).astype(float)).sum(0)
        unknown = np.exp(models.log_p(np.array([base | np.uint64(0x4E00)], np.uint64)).astype(float))[0]
        assert total + unknown == pytest.approx(1, abs=1e-3)


def test_language_model_keeps_every_gram(spark):
    """Rare grams of a language with many distinct ones, and the counts from which discounts come."""
    import numpy as np

    rng = random.Random(8)
    texts = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(1000)) for _ in range(210)] + ["一丁丂七一丁丂七"] * 5
    models = language_id.train(spark.createDataFrame([(t, "zh") for t in texts] + [(prose(rng, 50), "en")], "text string, lang string"))
    u, begins = language_id.units(texts)
    g = language_id.grams(u)
    g = np.unique(g[language_id.inside(begins, len(g))])
    assert len(g) > 200_000
    assert (models.orders[language_id.ORDER].find(g) >= 0).all()


def test_limits_come_from_all_training_texts(spark):
    rng = random.Random(6)
    some = [prose(rng, 12) for _ in range(50)]
    rows = [(i, some[i % 50], "en") for i in range(60_000)] + [(60_000 + i, prose(rng, 12, "fr"), "fr") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models, limits = language_id.fit(docs)
    for lang in ("en", "fr"):
        seen = sorted(models.cross_entropies([t for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 3 != 1])[:, models.langs.index(lang)])
        assert limits[lang] == pytest.approx(language_id.SLACK * seen[-(-len(seen) * 995 // 1000) - 1], rel=1e-3)
    rows = language_id.identify(docs).where("lang_pred = 'fr' or doc_id < 100").collect()
    assert rows and all(r.accepted == (r.cross_entropy <= limits[r.lang_pred]) for r in rows)


def test_units_do_not_join_texts():
    alone = [language_id.units([t])[0].tolist() for t in ("Ab  c", "", "x1y", "\0\x01z", "日 😀")]
    joined, begins = language_id.units(["Ab  c", "", "x1y", "\0\x01z", "日 😀"])
    assert [joined[i:j].tolist() for i, j in zip(begins, begins[1:])] == alone


def test_tokens(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    model = public.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=model)
    got = collections.Counter(tuple(r) for r in tokens.count_tokens(docs, model).collect())
    want = collections.Counter((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t, *_ in hard_documents())
    assert got == want
    assert tokens.count_tokens(empty, model).count() == 0
    rng = random.Random(1)
    parts = [" ", "  ", "a", "the", "\n", "▁", "<s>", "</s>", "\t", "é", "日本", "😀", "<0x0A>", "   ", " x", "\x00", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    assert tokens.Counts(model, memo=50).of(texts) == [len(x) for x in sp.encode(texts)]


def test_perplexity(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(14, 74)] + [(3, 0, 0), (None, 1, 0), (12, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = perplexity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[4].perplexity is None and not by[4].kept and not by[5].kept
    assert by[12].perplexity > max(by[i].perplexity for i in range(14, 74))
    assert perplexity.classify(empty, labels).count() == 0
    assert all(r.kept for r in perplexity.classify(docs, labels.limit(0)).where("perplexity is not null").collect())


def kneser_ney(texts):
    """Perplexity of a text under the same model on plain dictionaries."""
    import math

    run = lambda t: ["<", "<", *WORD.findall(t or ""), "<"] if WORD.search(t or "") else []
    tri = collections.Counter(x for t in texts for r in [run(t)] for x in zip(r, r[1:], r[2:]))
    bi = collections.Counter(x[1:] for x in tri)
    uni = collections.Counter((x[1],) for x in bi)

    def order(counts):
        of = collections.Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        plain = (1 - 2 * y * of[2] / of[1] if of[1] else 0.5, 2 - 3 * y * of[3] / of[2] if of[2] else 1.0, 3 - 4 * y * of[4] / of[3] if of[3] else 1.4)
        d = [min(max(v, 0.1), top) for v, top in zip(plain, (0.95, 1.95, 2.95))]
        total, left = collections.Counter(), collections.Counter()
        for x, n in counts.items():
            total[x[:-1]] += n
            left[x[:-1]] += d[min(n, 3) - 1]
        return lambda x, lower: lower if not total[x[:-1]] else (max(0, counts[x] - d[min(counts[x], 3) - 1]) if counts[x] else 0) / total[x[:-1]] + left[x[:-1]] / total[x[:-1]] * lower

    p1, p2, p3 = order(uni), order(bi), order(tri)
    prob = lambda x: p3(x, p2(x[1:], p1(x[2:], 1 / (len(uni) + 1))))

    def perplexity_of(t):
        r = run(t)
        return (len(r) - 2, math.exp(-sum(math.log(prob(x)) for x in zip(r, r[1:], r[2:])) / (len(r) - 2))) if r else (0, None)

    return perplexity_of


@pytest.mark.parametrize("small", [False, True])
def test_perplexity_is_that_of_the_model(spark, monkeypatch, small):
    """The sharded joins against the formula on plain dictionaries; with many shards, no cache and a filter that is full."""
    if small:
        for name, value in (("SHARD_KEYS", 300), ("CACHE", 5), ("FILTER_BYTES", 64), ("COPY_BYTES", 200)):
            monkeypatch.setattr(perplexity, name, value)
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(60)] + ["!!", None, "", "the", "the the the of the the of", "unknown words only"]
    rows = [(str(i), t) for i, t in enumerate(texts)] + [(None, texts[0]), ("0", texts[0])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    brute = kneser_ney(texts[:50])
    found = perplexity.perplexities(docs, spark.createDataFrame([(t,) for t in texts[:50]], "text string"))
    got = docs.select("doc_id", "text", perplexity.row_key().alias("key")).distinct().join(found, "key").collect()
    assert len(got) == len(texts) + 1 and sum(r.rows for r in got) == len(rows)
    import math

    for r in got:
        n, value = brute(r.text)
        assert r.n == n * r.rows
        assert value is None or math.exp(-r.log_p / r.n) == pytest.approx(value, rel=1e-6)


def test_perplexity_in_passes_leaves_only_the_model(spark, monkeypatch):
    """Many passes give the values of the formula, and no shuffle file or table of the training stays on disk."""
    import glob
    import math
    import os

    monkeypatch.setattr(perplexity, "PASS_ROWS", 300)
    rng = random.Random(10)
    texts = [prose(rng, 40, lang) for lang in ("en", "fr") for _ in range(40)]
    brute = kneser_ney(texts[:60])
    shared = perplexity.materialize(spark.range(1), "here").inputFiles()[0].removeprefix("file://").rpartition("/here-")[0]
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    shuffles = lambda: {x for x in glob.glob(f"{local}/**/shuffle_*", recursive=True) if os.path.getsize(x)}
    tables, files = set(os.listdir(shared)), shuffles()
    model, unknown = perplexity.train(spark.createDataFrame([(t,) for t in texts[:60]], "text string"))
    assert {x.partition("-")[0] for x in set(os.listdir(shared)) - tables} == {"model"}
    assert not shuffles() - files
    value = {r.key: r.value for r in model.collect()}
    assert len(value) == model.count()
    for t in texts:
        tokens, own = perplexity.runs([t], perplexity.Words())
        log_p = unknown * (len(tokens) - 2) + sum(value.get(k, 0.0) for ks, _ in perplexity.keys(tokens, own) for k in ks.view("int64").tolist())
        assert math.exp(-log_p / (len(tokens) - 2)) == pytest.approx(brute(t)[1], rel=1e-6)


def test_perplexity_limits(spark):
    """kept against the formula: quantiles of held-out trusted texts by language, or of all together."""
    rng = random.Random(19)
    rows = [(i, prose(rng, 30, lang), lang) for i, lang in enumerate(["en"] * 400 + ["fr"] * 30)] + [(1000 + i, "odd " + " ".join(str(rng.random()) for _ in range(20)), lang) for i, lang in enumerate(["en", "fr", None] * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(430)], "doc_id bigint, quality int, toxic int")
    held = {r.doc_id for r in docs.where(perplexity.F.expr(f"pmod(xxhash64('held out', cast(doc_id as string)), {perplexity.HELD_OUT}) = 0")).collect() if r.doc_id < 430}
    brute = kneser_ney([t for i, t, _ in rows if i < 430 and i not in held])
    value = {i: brute(t)[1] for i, t, _ in rows}
    limit = lambda ids: sorted(value[i] for i in ids)[-(-len(ids) * 995 // 1000) - 1] * perplexity.SLACK
    en = limit([i for i in held if i < 400]) if sum(i < 400 for i in held) >= perplexity.MIN_TRUSTED else limit(held)
    for r in perplexity.classify(docs, labels).collect():
        want = value[r.doc_id] <= (en if r.doc_id < 400 or (r.doc_id >= 1000 and rows[430 + r.doc_id - 1000][2] == "en") else limit(held))
        assert r.perplexity == pytest.approx(value[r.doc_id]) and r.kept == want


def test_urls(spark):
    urls = ["http://A.net/x?y", "https://www.example.net/en/1", "https://xexample.net/en/1", "http://example.com/de/#z", "http://a.org/fr/", "http://org", None, "no scheme", "a://b://c/d", "://", "http://h.com", "x\n://q.com/p\nq?r", "http://net", "http://a.net"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame([("h.com",), ("gone",)], "k string")).collect() if r.page_id is not None}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("www.example.net", "/en/1", "example.net/en/", "allow"), 2: ("xexample.net", "/en/1", "net/", "block"), 3: ("example.com", "/de/", "example.com/de/", "block"),
        4: ("a.org", "/fr/", "org/fr/", "allow"), 5: ("org", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("b:", "//c/d", None, "allow"), 9: ("", "", None, "allow"),
        10: ("h.com", "", None, "block"), 11: ("q.com", "/p\nq", None, "allow"), 12: ("net", "", None, "allow"), 13: ("a.net", "", None, "allow"),
    }
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("shard_keys", "broadcast_bytes"), [(1 << 20, 1 << 20), (100, 1 << 20), (100, 0)])
def test_cascade_is_exact(spark, shard_keys, broadcast_bytes):
    universe = spark.range(3000).selectExpr("concat('h', id) as k")
    listed = universe.where("hash(k) % 5 = 0").union(spark.sql("select 'elsewhere' as k"))
    cascade = url_filter.Cascade(listed, universe, shard_keys, broadcast_bytes)
    assert cascade.levels > 2 and cascade.shards == -(-3000 // shard_keys)
    assert cascade.with_listed(universe.withColumnRenamed("k", "key"), "key", "out").where("out <> (hash(key) % 5 = 0)").count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = [(1, "http://a/ %\n", "<p>é</p>"), (2, None, None), (3, "u", big), (4, "u", big), (5, "u", big), (None, "u", "n"), (6, "u", "small"), (7, "u", "small"), (7, "u", "small"), (8, "u", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08 " + "".join(chr(i) for i in range(1, 3000)) * 30)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("size", pytest.importorskip("pyspark").sql.functions.lit(1))
    manifest = warc.write_archives(df, f"file://{tmp_path}/w")
    for step in (1 << 22, 997):
        read = warc.read_archives(manifest, range_bytes=step).collect()
        want = collections.Counter()
        for i, u, h in pages:
            p = (h or "").encode()
            revisit = h == big and i != 5
            want[(i, u, "revisit" if revisit else "response", 5 if revisit else None, len(p), hashlib.sha1(p).hexdigest(), None if revisit else p)] += 1
        assert collections.Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in read) == want
    assert warc.round_trip(df.limit(0), spark).count() == 0


def test_warc_records_that_are_odd(tmp_path):
    import gzip

    made = lambda head, body: gzip.compress(b"WARC/1.1\r\n" + head + b"\r\n\r\n" + body)
    whole = made(b"WARC-Type: response\r\nContent-Length: 9", b"H\r\n\r\nabcd\r\n\r\n")
    data = made(b"WARC-Type: warcinfo\r\nContent-Length: 3", b"a: 1\r\n\r\n") + made(b"WARC-Type: response", b"H\r\n\r\nxyz\r\n\r\n") + made(b"WARC-Type: revisit\r\nContent-Length: x", b"H") + b"junk\x1f\x8b\x08" + whole + whole[:-12]
    (tmp_path / "odd").write_bytes(data)
    import pyarrow.fs

    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "odd")) as f:
        rows = list(warc.records_of_range(f, len(data), 0, len(data)))
    assert [(r[2], r[-1]) for r in rows[:4]] == [("warcinfo", b"a: "), ("response", b"xyz"), ("revisit", None), ("response", b"abcd")]
    assert [r[2] for r in rows[4:]] in ([], ["truncated"])


def test_warc_header_of_any_length(spark, tmp_path):
    url = "data:," + random.Random(4).randbytes(1_500_000).hex()
    df = spark.createDataFrame([(1, url, "a"), (2, "u", "b")], "page_id bigint, url string, html string")
    read = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/w")).collect()
    assert {(r.page_id, r.url) for r in read} == {(1, url), (2, "u")}


def test_chat(spark):
    rows = [(1, 2, "assistant", "b\\|<|im_end|>"), (1, 1, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (3, 5, "od\nd\\_<|r", "\\\\<\\|\n<|im_start|>user\n"), (None, 1, "assistant", ""), (4, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    d = chat_format.parsed(chat_format.formatted(chat_format.canonical(df))).collect()
    for r in d:
        assert [tuple(t) for t in r.read] == [tuple(t) for t in r.turns]
        at, under = 0, []
        for m in r.loss_mask:
            if m.loss:
                under.append(r.formatted[at + m.head : at + m.head + m.length])
            at += m.head + m.length + len(chat_format.END) + 1
        assert at == len(r.formatted)
        assert "".join(x.replace("<\\|", "<|").replace("\\\\", "\\") if "\\\\" not in x else re.sub(r"\\([\\|])", r"\1", x) for x in under) == r.loss
    got = {r.conv_id: r for r in chat_format.digests(df.withColumn("read", df["turn"])).collect()}
    said = "user\n" + chat_format.PROBE + "\nassistant\n" + chat_format.PROBE + "\n"
    assert got[-1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].n_turns == 2
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[1].loss_chars == len(rows[0][3])
    assert [r.conv_id for r in chat_format.digests(df.limit(0)).collect()] == [-1]


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', '{"prompt":"a","response":"b"}', '{"output":"b","instruction":"a","input":""}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"other":1}', "no json", None,
    ]
    got = {r.conv_id: r for r in chat_format.canonical_json(spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string")).collect()}
    for i in range(4):
        assert [tuple(t) for t in got[i].turns] == [("user", "a"), ("assistant", "b")], i
    assert all(got[i].turns is None and got[i].layout is None for i in (4, 5, 6))
    df = spark.createDataFrame([(1, "a", "b")], "conv_id bigint, prompt string, completion string")
    assert [tuple(t) for t in chat_format.canonical(df).first().turns] == [("user", "a"), ("assistant", "b")]
    assert [tuple(r) for r in chat_format.canonical(df.withColumnRenamed("prompt", "unknown")).collect()] == [(1, None)]
    # the probe's id in the table is a conversation of its own, and the loss text is what the mask cuts out
    own = spark.createDataFrame([(-1, 0, "user", "q"), (-1, 1, "assistant", "a\\<|b")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.loss_sha256 for r in chat_format.digests(own).collect()}
    assert got == {hashlib.sha256(x.encode()).hexdigest() for x in ("a\\<|b", chat_format.PROBE)}
    chats = chat_format.formatted(chat_format.canonical(own))
    moved = chats.withColumn("loss_mask", chat_format.F.transform("loss_mask", lambda m: m.withField("head", m["head"] + 1)))
    assert chat_format.parsed(moved).first().loss != chat_format.parsed(chats).first().loss
