"""Language identification, whitening and ranked search: against brute force, and the cases of each."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from test_llm_cases import LONG, docs, empty, kept_columns  # noqa: F401

from tidebook.llm import langid, lexical, whitening

# language identification

TABLES = langid._tables(langid.letter_runs())
WORDS = {
    "aa": ["kala", "maka", "lamaka", "kamala", "akala"],
    "bb": ["trind", "strond", "grend", "drist", "strind"],
    "cc": ["ouille", "eille", "uelle", "ieu", "oieu"],
}


def sentences(lang, n, seed):
    random.seed(seed)
    return [" ".join(random.choices(WORDS[lang], k=random.randint(3, 60))).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, t, lang) for lang in WORDS for i, t in enumerate(sentences(lang, 60, lang))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def speaker(spoken):
    return langid.train(spoken)


def plain_features(text):
    """Counts of the n-grams, as strings with '_' at edges."""
    out = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{word}_"
        for n in langid.ORDERS:
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if "_" not in gram[1:-1] and gram.strip("_") and (n > 1 or gram != "_"):
                    out[gram] += 1
    return out


def test_features_are_the_ngrams_inside_words():
    texts = ["The quick, brown fox", "", None, "a", "12 ?!", "Ünder étoile 東京都 x y", LONG[:3000]]
    found = {}
    for a, _, text, feature, count, letters in langid._counted(texts, TABLES):
        for t, f, c in zip(text.tolist(), feature.tolist(), count.tolist()):
            found.setdefault(a + t, {})[f] = c
        for i, n in enumerate(letters):
            assert n == sum(c.isalpha() for c in texts[a + i] or "")
    number = {}
    for t in texts:
        for gram in plain_features(t or ""):
            symbols = np.array([0 if c == "_" else ord(c) for c in gram], np.uint32)
            inner = langid._ngrams(symbols, symbols, len(symbols) - 1)[0]
            number[gram] = int(inner[-1])
    for i, t in enumerate(texts):
        want = collections.Counter()
        for gram, n in plain_features(t or "").items():
            want[number[gram]] += n
        assert found.get(i, {}) == want


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(sentences("aa", 40, 1) + sentences("cc", 40, 2))
    (whole,) = [x[2:] for x in langid._counted([text, None], TABLES)]
    monkeypatch.setattr(langid, "BLOCK_CHARS", 97)
    (pieces,) = [x[2:] for x in langid._counted([text], TABLES)]
    assert all((a[: len(b)] == b).all() for a, b in zip(whole, pieces))


def test_languages_of_new_texts(spark, speaker):
    rows = [(i, t, lang) for lang in WORDS for i, t in enumerate(sentences(lang, 30, lang + "new"))]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, truth string"), speaker).collect()
    assert all(r.nearest == r.truth and 0 < r.score <= 1 for r in found)
    assert sum(r.rejected for r in found) <= 0.1 * len(found)
    (far,) = langid.identify(spark.createDataFrame([("Zyxwv pqjzx qqzyx wvxzq jzzxq pyqzx",)], "text string"), speaker).collect()
    assert far.rejected and far.lang_pred == "und" and far.nearest in WORDS


def test_nearest_centroid_against_brute_force(spoken, speaker):
    table = {}
    for r in speaker.centroids.collect():
        table.setdefault(r.lang, []).append(dict(zip(r.features, r.weights)))
    for r in langid.identify(spoken.where("doc_id < 15"), speaker).collect():
        ((_, _, _, feature, count, _),) = langid._counted([r.text], TABLES)
        v = {f: (1 + math.log(c)) * speaker.idf[f] for f, c in zip(feature.tolist(), count.tolist())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        best = max((sum(x * c.get(f, 0) for f, x in v.items()) / norm, lang) for lang, own in table.items() for c in own)
        assert r.nearest == best[1] and abs(r.score - best[0]) < 1e-5


def test_slices_of_languages_find_what_one_pass_finds(spoken, speaker, monkeypatch):
    one = langid.identify(spoken, speaker).select("doc_id", "nearest", "rejected").collect()
    many = langid.Model(speaker.idf, speaker.centroids, [[x] for x in sorted(WORDS)])
    assert sorted(one) == sorted(langid.identify(spoken, many).select("doc_id", "nearest", "rejected").collect())


def test_sample_is_bounded_and_whole_languages_are_seen(rows):
    data = [("hot", f"text number {i % 500}") for i in range(3000)] + [("rare", "only one")] * 5
    picked = langid._sampled(rows("lang string, t string", data), 40).collect()
    assert collections.Counter(r.lang for r in picked) == {"hot": 40, "rare": 1}
    assert len(set(picked)) == 41


def test_language_cases(docs, empty, rows, speaker):  # noqa: F811
    found = langid.identify(docs, speaker)
    kept_columns(found, docs, "lang_pred", "nearest", "score", "rejected")
    by = {(r.doc_id, (r.text or "")[:4]): r for r in found.select("doc_id", "text", "nearest", "lang_pred", "score", "rejected").collect()}
    for key in [(2, ""), (3, ""), (6, "!!! "), (8, "")]:
        assert by[key][2:] == ("und", "und", 0.0, True)
    assert by[5, "word"].nearest in WORDS and found.count() == docs.count()
    assert langid.identify(empty, speaker).count() == 0
    nothing = langid.train(empty)
    assert {r.nearest for r in langid.identify(docs, nothing).collect()} == {"und"}
    one = langid.train(rows("text string, lang string", [("a single text", "xx"), (None, "yy"), ("no language", None), ("!!", "zz")]))
    assert {r.nearest for r in langid.identify(docs, one).collect()} == {"und", "xx"}


# whitening


def brute_whitening(vectors, k):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    covariance = centred.T @ centred / n
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return deviation, centred @ q / np.sqrt(e), e / np.trace(covariance)


@pytest.mark.parametrize("n,dimension,scale", [(40, 3, 1.0), (300, 24, 5.0), (60, 9, 1e6)])
def test_whitening_against_brute_force(rows, n, dimension, scale):
    random.seed(dimension)
    vectors = [[random.gauss(0, scale / (j + 1)) for j in range(dimension)] for _ in range(n)]
    df = rows("vec_id long, embedding array<double>", list(enumerate(vectors)))
    model = whitening.fit(df)
    deviation, white, explained = brute_whitening(vectors, 8)
    found = sorted(whitening.whiten(df, model).collect())
    assert [int(r.deviation) for r in found] == deviation
    got = np.array([r.whitened for r in found])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8
    assert np.allclose(model.explained, explained, rtol=1e-9)
    assert whitening.identity_error(df, model) < 1e-8


@pytest.mark.parametrize("kind", ["plain", "twins", "one large", "low rank", "same", "cluster"])
def test_spectral_components(kind):
    random = np.random.default_rng(3)
    n = 40
    q = np.linalg.qr(random.standard_normal((n, n)))[0]
    e = {
        "plain": np.arange(1.0, n + 1),
        "twins": np.repeat(np.arange(1.0, n / 4 + 1), 4),
        "one large": np.append(np.ones(n - 1) + 1e-3 * np.arange(n - 1), 1e6),
        "low rank": np.append(np.zeros(n - 3), [1.0, 2.0, 3.0]),
        "same": np.full(n, 2.0),
        "cluster": np.append(1 + 1e-13 * np.arange(n // 2), np.arange(2.0, 2 + n // 2)),
    }[kind]
    a = q @ np.diag(e) @ q.T
    for wanted in (1, 8, n):
        values, vectors = whitening.spectral_components((a + a.T) / 2, wanted)
        assert np.abs(values - np.sort(e)[::-1][:wanted]).max() <= 1e-13 * e.max()
        assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * e.max()


def test_exact_products_of_large_numbers():
    y = np.array([[3, -(10**9)], [10**9 + 1, 7]])
    z = y.astype(object)
    assert (whitening._products(y) == z.T @ z).all()


def test_whitening_cases(rows):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [1.5, 2.0], [4.0, -1.0], [0.0, 0.0]]
    data = [(i, v, i, 0.5) for i, v in enumerate(good)] + [(None, [2.0, 3.0], 7, 0.5), (0, [1.0, 2.0], None, None)]
    bad = [(10, None, 1, 0.0), (11, [1.0, None], 1, 0.0), (12, [nan, 1.0], 1, 0.0), (13, [inf, 1.0], 1, 0.0), (14, [1.0], 1, 0.0), (15, [], 1, 0.0)]
    schema = "vec_id long, embedding array<float>, n int, deviation double"
    df = rows(schema, data + bad)
    model = whitening.fit(df)
    assert model.n == 6 and len(model.values) == 2
    found = whitening.whiten(df, model)
    kept_columns(found, df, "whitened", "deviation")
    deviation, white, _ = brute_whitening([d[1] for d in data], 2)
    assert sorted(int(r.deviation) for r in found.collect()) == sorted(deviation)
    assert collections.Counter(r.vec_id for r in found.collect()) == {0: 2, 1: 1, 2: 1, 3: 1, None: 1}
    for nothing in (rows(schema, []), rows(schema, bad[:4])):
        none = whitening.fit(nothing)
        assert none.n == 0 and whitening.whiten(nothing, none).count() == 0 and whitening.identity_error(nothing, none) == 0
    same = rows(schema, [(i, [1.0, 2.0], 0, 0.0) for i in range(3)])
    assert [r.whitened for r in whitening.whiten(same, whitening.fit(same)).collect()] == [[], [], []]


# ranked search


def plain_scores(docs, items):  # noqa: F811
    """{item id: [(score, place of the document)]} by the formula, all documents."""
    words = [re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n, total = sum(map(bool, words)), sum(map(len, words))
    counts = [collections.Counter(w) for w in words]
    df = collections.Counter(itertools.chain.from_iterable(counts))
    out = {}
    for name, text in items:
        out.setdefault(name, set()).update(re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    for name, terms in out.items():
        scores = []
        for i, c in enumerate(counts):
            m = 100 - 90 + 90 * len(words[i]) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((s, i))
        out[name] = scores
    return out


def brute_search(docs, items, k):  # noqa: F811
    out = []
    for name, scores in plain_scores(docs, items).items():
        best = sorted((-s, docs[i][0] is None, docs[i][0] or 0) for s, i in scores)[:k]
        out += [(name, r, None if no else d, -s) for r, (s, no, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


def collection(n, seed, ties=False):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(random.choices(vocabulary, weights, k=random.choice([3, 8, 20, 60]))) for _ in range(n)]
    if ties:
        texts = [random.choice(texts[:7]) for _ in texts]
    return list(enumerate(texts)), [(i, " ".join(random.choices(vocabulary, weights, k=random.randint(1, 9)))) for i in range(12)]


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("block", [20, 500_000])
def test_search_against_brute_force(rows, monkeypatch, ties, block):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    documents, items = collection(150, 7, ties)
    for k, group_bytes in ((1, 1 << 20), (10, 1 << 20), (4, 100)):
        found = lexical.search(rows("doc_id long, text string", documents).repartition(3), rows("item_id long, text string", items), k=k, group_bytes=group_bytes)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_search(documents, items, k)


def _block(lengths, lists, known):
    terms = np.array([t for own in lists for t, _ in own])
    return lexical.Block(np.array(lengths), terms, np.array([c for own in lists for _, c in own]), np.cumsum([len(own) for own in lists]), known)


def test_best_positions_stop_early_and_lose_nothing():
    random.seed(5)
    known = lexical.Statistics(4000, 400_000, np.array([900, 800, 700, 300, 0]))
    lists = [[(t, random.randint(1, 3)) for t in range(5) if random.random() < (0.3 if t < 3 else 0.9)] for _ in range(4000)]
    lists[17] = [(t, 9) for t in range(4)]  # one document at the top of all lists
    block = _block([100] * 4000, lists, known)
    all_scores = np.zeros(4000, int)
    doc = np.repeat(np.arange(4000), [len(x) for x in lists])
    np.add.at(all_scores, doc, block.impacts)
    for k in (1, 5, 50):
        docs_, scores, met = block.best(np.arange(4), k)
        order = np.lexsort((np.arange(4000), -all_scores))[:k] if k else []
        assert scores.tolist() == all_scores[order].tolist()
        ties = np.flatnonzero(np.isin(all_scores, scores))
        assert len(ties) < k or docs_.tolist() == order.tolist()
        assert met < 4000
    assert block.best(np.arange(4), 1)[2] <= 64
    assert len(block.best(np.array([4]), 5)[0]) == 0  # a term without weight
    floor = int(np.sort(all_scores)[-3])
    docs_, scores, met = block.best(np.arange(4), 50, floor)
    assert sorted(s for s in scores.tolist() if s >= floor) == sorted(s for s in all_scores.tolist() if s >= floor) and met < block.best(np.arange(4), 50)[2]


def test_search_cases(docs, empty, rows):  # noqa: F811
    items = [(1, "The lazy FOX and the river"), (2, None), (3, ""), (None, "text without a key"), (4, "word7 word59999"), (1, "bank today"), (1, "bank today"), (5, "nowhere found")]
    df = rows("item_id long, text string, score int", [(i, t, 0) for i, t in items])
    documents = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = lexical.search(docs, df)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_search(documents, items, 10)
    assert lexical.search(empty, df).count() == lexical.search(docs, df.limit(0)).count() == lexical.search(docs.where("text = ''"), df).count() == 0
    named = rows("name string, body string", [("b", "a river"), ("a", "a river"), (None, "a river")])
    got = lexical.search(named, rows("q string, text string", [("x", "river")]), key="name", text="body", item_id="q").collect()
    assert [(r.q, r["rank"], r.name) for r in got] == [("x", 1, "a"), ("x", 2, "b"), ("x", 3, None)]
