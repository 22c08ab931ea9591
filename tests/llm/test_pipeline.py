"""The pipeline, stage by stage and as a whole, and the verdicts of quality rules and language identification, against brute-force versions."""

import collections
import math
import random
import re
import unicodedata

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import decontamination, language_id, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COMMON = {"en": "the of and to in a is that for it".split(), "fr": "de la le et les des en un que qui".split()}
PARTS = {"en": ["ing", "th", "er", "wh", "ly", "ough", "sh", "ed"], "fr": ["eau", "tion", "oi", "é", "ê", "ch", "eux", "an"]}


def prose(rng, n, lang="en"):
    words = [rng.choice(COMMON[lang]) if rng.random() < 0.45 else "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w for i, w in enumerate(words))


def items():
    rng = random.Random(23)
    return [(i, prose(rng, rng.randint(12, 40))) for i in range(40)]


def corpus():
    rng = random.Random(29)
    texts = [(prose(rng, rng.randint(60, 400), lang), lang) for lang in ("en", "en", "fr") for _ in range(60)]
    texts += [(" | ".join(prose(rng, 2) for _ in range(60)), "en") for _ in range(4)] + [("short text", "en"), (None, "en"), ("", None), ("word " * 300, "fr"), (prose(rng, 20000), "en")]
    texts += [("".join(chr(0x4E00 + rng.randrange(3000)) + (" " if i % 5 == 4 else "") for i in range(400)), "en")]
    base = prose(rng, 200).split()
    for k in range(5):  # near copies
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{k}"
        texts.append((" ".join(w), "en"))
    texts += [(prose(rng, 80) + " " + items()[7][1] + " " + prose(rng, 80), "en"), (items()[3][1] + " " + prose(rng, 120, "fr"), "fr")]
    rows = [(i, t, lang, None if i % 11 == 0 else f"s{i % 4}", None) for i, (t, lang) in enumerate(texts)]
    return [*rows, rows[3], (None, prose(rng, 90), "en", "s0", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumnsRenamed({"n_chars": "__t_lang"}).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items(), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


# --- brute-force versions


def classes(text):
    n = collections.Counter()
    for c in text:
        kind = unicodedata.category(c)
        n["space" if c in " \t\n\x0b\x0c\r" else "lower" if kind == "Ll" else "upper" if kind == "Lu" else "digit" if kind == "Nd" else "stop" if c in ".," else "other"] += 1
    return [n[k] for k in quality_rules.CLASSES]


def repeated(w):
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    return len({j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})


def js(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    half = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y) if a > 0)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def quality(rows):
    """(class distance, common distance, kept) of each row."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    top = {}
    for lang in {r[2] for r in rows if r[2]}:
        seen = collections.Counter(signed(xxhash.xxh64_intdigest(w.encode(), 42)) for r in rows if r[2] == lang and r[1] for w, n in collections.Counter(WORD.findall(r[1])).items() if n >= quality_rules.REPEATS)
        if seen:
            top[lang] = [h for h, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.N_COMMON]]
    facts = []
    for _, text, lang, *_ in rows:
        w = WORD.findall(text or "")
        own = collections.Counter(signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w)
        facts.append((lang, len(w), classes(text or ""), [own[h] for h in sorted(top[lang])] if lang in top else None, repeated(w)))
    middle = lambda x: sorted(x)[-(-len(x) // 2) - 1]

    def reference(some):
        long = [f for f in some if f[1] >= quality_rules.MIN_WORDS]
        if not long:
            return None
        share = [middle([f[2][i] / sum(f[2]) for f in long]) for i in range(len(quality_rules.CLASSES))]
        known = [f for f in long if f[3] is not None]
        words = [middle([f[3][i] / f[1] for f in known]) for i in range(len(known[0][3]))] if known else []
        return share, [*words, 1 - sum(words)]

    every, own = reference(facts), {lang: reference([f for f in facts if f[0] == lang]) for lang in top}
    out = []
    for lang, n, cls, common, again in facts:
        ref = own.get(lang) or every
        cd = js(cls, ref[0]) if sum(cls) and ref else None
        wd = js([*common, max(0, n - sum(common))], own[lang][1]) if common is not None and n and own.get(lang) else None
        base = n < 50 or 100 * again > 50 * n
        odd = (cd or 0) > quality_rules.MAX_CLASS or (n >= quality_rules.MIN_COMMON_WORDS and (wd or 0) > quality_rules.MAX_COMMON)
        out.append((cd, wd, not base and not (n >= quality_rules.MIN_WORDS and odd)))
    return out


def language_models(train):
    """lang -> function from a text to its cross-entropy, on plain dictionaries."""
    runs = lambda t: language_id.units([t])[0].tolist()
    tables = {}
    for lang, texts in train.items():
        level = collections.Counter(tuple(u[i : i + 4]) for t in texts for u in [runs(t)] for i in range(len(u) - 3))
        orders = {4: level}
        for k in (3, 2, 1):
            level = collections.Counter(g[1:] for g in level)
            orders[k] = level
        tables[lang] = orders
    vocabulary = len({g for o in tables.values() for g in o[1]}) + 1

    def of(orders):
        total, kinds, d = {}, {}, {}
        for k, counts in orders.items():
            n1, n2 = (sum(n == i for n in counts.values()) for i in (1, 2))
            d[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            for g, n in counts.items():
                total[k, g[:-1]] = total.get((k, g[:-1]), 0) + n
                kinds[k, g[:-1]] = kinds.get((k, g[:-1]), 0) + 1

        def p(g):
            k = len(g)
            if not k:
                return 1 / vocabulary
            t = total.get((k, g[:-1]))
            lower = p(g[1:])
            return lower if t is None else max(orders[k].get(g, 0) - d[k], 0) / t + d[k] * kinds[k, g[:-1]] / t * lower

        def entropy(t):
            u = runs(t)
            return -sum(math.log(p(tuple(u[i : i + 4]))) for i in range(len(u) - 3)) / (len(u) - 3)

        return entropy

    return {lang: of(o) for lang, o in tables.items()}


# --- tests


def key(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def test_quality_verdicts(spark, docs):
    want = quality(corpus())
    got = collections.defaultdict(list)
    for r in quality_rules.quality(docs).collect():
        got[r.doc_id].append(r)
    for (doc_id, *_), (cd, wd, kept) in zip(corpus(), want):
        if doc_id is None:
            continue
        for r in got[doc_id]:
            assert r.class_distance == (None if cd is None else pytest.approx(cd, abs=1e-6)), doc_id
            assert r.common_distance == (None if wd is None else pytest.approx(wd, abs=1e-6)), doc_id
            assert r.kept == kept
    stage = corpus_pipeline.quality(spark, docs, "").collect()
    assert key(stage) == key(r for r, w in zip(corpus(), want) if w[2]) and 0 < len(stage) < len(want)


def test_language_against_brute_force(spark, docs):
    import zlib

    rows = [r for r in corpus() if r[0] is not None and r[0] < 200]
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train = collections.defaultdict(list)
    for i, t, lang, *_ in rows:
        if not out(i) and t is not None and lang:
            train[lang].append(t)
    df = spark.createDataFrame(rows, SCHEMA)
    models = language_models(train)
    some = [r for r in rows if r[1] and any(map(str.isalpha, r[1])) and len(r[1]) < 3000]
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    for i, t, _, *_ in some[::5]:
        h = {lang: m(t) for lang, m in models.items()}
        best = min(sorted(h), key=h.get)
        assert got[i].lang_pred == best and got[i].cross_entropy == pytest.approx(h[best], rel=1e-4)
        assert got[i].score == pytest.approx(1 / sum(math.exp(-language_id.SHARPNESS * (x - h[best])) for x in h.values()), rel=1e-2)


def test_language_stage(spark, docs):
    got = language_id.identify(docs).collect()
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in got if r.accepted)
    assert collections.Counter(r.doc_id for r in kept.collect()) == ids and 0 < sum(ids.values()) < len(got)


def test_stages_return_the_columns_of_documents(spark, docs, sf_dir):
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, empty, sf_dir).count() == 0, name
    assert corpus_pipeline.mix(spark, empty, sf_dir).count() == 0


def test_pipeline(spark, sf_dir):
    """run() against the stages' brute-force versions, one after another."""
    rows = [r for r, w in zip(corpus(), quality(corpus())) if w[2]]
    # language: the accepted ones, by the operator that is compared with brute force above
    accepted = language_id.keep_identified(spark.createDataFrame(rows, SCHEMA)).collect()
    # near duplicates: components by all pairs; the smallest id of each stays, one row an id, and rows without one
    sets = {}
    for r in accepted:
        w = [x.lower() for x in WORD.findall(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    single = {r.doc_id: r for r in accepted if r.doc_id is not None and find(r.doc_id) == r.doc_id}
    rest = [*single.values(), *(r for r in accepted if r.doc_id is None)]
    assert any(find(i) != i for i in ids)
    index = decontamination.Index([decontamination.make_item(*x) for x in items()])
    clean = [r for r in rest if not index.leaks([r.text])[0]]
    assert 0 < len(clean) < len(rest)
    want = {(r.doc_id, len(WORD.findall(r.text)), r.source) for r in clean}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.size) for r in got} == {(i, n) for i, n, _ in want} and len(got) == len(clean)
    sizes = collections.Counter()
    for _, n, source in want:
        sizes[source] += n
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (mixing.WEIGHTS * 9)))
    capped = set()
    while True:  # targets: what exceeds three times a source's size is shared again
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[x] for x in weights if x not in capped) for s in weights if s not in capped}
        more = {s for s in share if share[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else share[s] for s in sizes}
    source_of = {i: s for i, _, s in want}
    taken = collections.Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
