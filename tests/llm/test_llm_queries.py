"""The registered queries over whole tables, against SQL where there is some, else against brute force."""

import base64
import collections
import hashlib
import re
import sys
import zlib

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module
from tidebook.llm import catalog
from tidebook.llm.textblocks import folded_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def result(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


def shingle_counts(text):
    words = folded_words(text.encode())
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else collections.Counter()


def shingle_set(text):
    return frozenset(shingle_counts(text))


def likeness(x, y):
    """Probability Jaccard similarity of two counters: of each shared shingle, what x has from its ratio on and y before it."""
    shared = sorted(x.keys() & y.keys(), key=lambda k: x[k] / y[k])
    before = y.total() - sum(y[k] for k in shared)
    after = x.total()
    out = 0.0
    for k in shared:
        out += 1 / (after / x[k] + before / y[k])
        after -= x[k]
        before += y[k]
    return out


def test_registered():
    names = [n for n in entry_module.queries() if re.match(r"op\d", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_module.queries()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


def test_mix_comes_near_its_targets(spark, con):
    rows = result(spark, "op3_mix")
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    rows["source"] = rows.doc_id.map(source)
    assert (rows.taken <= 3 * rows["size"]).all()
    by = rows.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first", "size": "sum"})
    assert (by.source_size == by["size"]).all()
    assert abs(by.target.sum() - rows["size"].sum()) < 1e-6 * rows["size"].sum()
    assert (by.target <= 3 * by.source_size).all()
    assert ((by.taken - by.target).abs() <= 0.01 * by.target).all()


def test_token_counts(spark, texts):
    from tidebook.llm.token_counts import RANKS, encoding

    encode = encoding(open(RANKS, "rb").read()).encode_ordinary
    lengths = [len(encode(t)) for t in texts.values()]
    rows = result(spark, "op2_token_counts").set_index("length")
    counts = collections.Counter(lengths)
    assert dict(rows.n_docs) == dict(counts)
    for limit in counts:
        row = rows.loc[limit]
        longer = [n for n in lengths if n >= limit]
        assert (row.docs_from, row.tokens_from) == (len(longer), sum(longer))
        assert row.truncated == sum(min(n, limit) for n in lengths)
        assert row.docs_upto == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))


def test_shards_have_near_equal_bytes_and_keep_equal_texts_together(spark, texts):
    rows = result(spark, "op5_shard")
    assert sorted(rows.doc_id) == sorted(texts)
    for r in rows.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    size = rows.groupby("shard")["size"].sum()
    assert list(size.index) == list(range(8))
    assert size.max() / size.mean() < 1.05 and size.min() / size.mean() > 0.95
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert (rows.groupby(rows.doc_id.map(texts)).shard.nunique() == 1).all()


def test_toxicity_on_rows_no_label_of_which_was_seen(spark, con):
    rows = result(spark, "op6_toxicity")
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.itertuples())
    labels = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    known = rows[rows.doc_id.isin(labels)]
    toxic = known.doc_id.map(labels) == 1
    assert known.score[toxic].mean() > known.score[~toxic].mean() + 0.2
    assert (known.predicted[~toxic] == 0).mean() > 0.95


def base_spans(text):
    """The contract's patterns, run over the whole text."""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def fits(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            odd, even = digits[-1::-2], digits[-2::-2]
            return 12 <= len(digits) <= 19 and (sum(odd) + sum(d * 2 - 9 * (d > 4) for d in even)) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    out = [(m.start(), k, m.end()) for k, (kind, rule) in enumerate(rules) for m in re.finditer(rule, text) if fits(kind, m.group())]
    return [(rules[k][0], s, e) for s, k, e in sorted(out)]


def test_personal_data(spark, texts):
    rows = result(spark, "op7_pii")
    assert sorted(rows.doc_id) == sorted(texts)
    for r in rows.itertuples():
        spans = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        own = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert set(filter(None, own.split(","))) <= set(r.spans.split(","))


def test_fingerprints(spark, texts):
    rows = result(spark, "op8_fingerprint").set_index("doc_id")
    ids = sorted(texts, reverse=True)
    assert sorted(rows.index, reverse=True) == ids
    for at, i in enumerate(ids):
        text, following, row = texts[i], texts[ids[(at + 1) % len(ids)]], rows.loc[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(base64.b64decode(row.fingerprint)) == 8 * min(128, len(shingle_set(text)))
        for near, other in ((row.near_edited, edited), (row.near_next, following)):
            a, b = shingle_set(text), shingle_set(other)
            assert abs(near - len(a & b) / len(a | b)) < 0.2
    same = collections.defaultdict(set)
    for i in ids:
        same[texts[i]].add(rows.fingerprint[i])
    assert all(len(f) == 1 for f in same.values())


def near_enough(a, b, n, m):
    """What two counters share of their weight is at least their likeness."""
    return sum(min(a[k] / n, b[k] / m) for k in a.keys() & b.keys()) >= 0.79


def near_classes(texts):
    """Components of all pairs with a probability Jaccard similarity of 0.8 or more: doc_id to the least id."""
    sets = {i: shingle_counts(t) for i, t in texts.items()}
    total = {i: c.total() for i, c in sets.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and (a == b or not a.keys().isdisjoint(b) and near_enough(a, b, total[i], total[j]) and likeness(a, b) >= 0.8)):
                lo, hi = sorted((top(i), top(j)))
                parent[hi] = lo
    return {i: top(i) for i in ids}


def test_near_duplicates(spark, texts):
    rows = result(spark, "op9_near_duplicates")
    assert dict(zip(rows.doc_id, rows.class_id)) == near_classes(texts)
    sizes = collections.Counter(rows.class_id)
    assert all(sizes[r.class_id] == r.class_size for r in rows.itertuples())


def test_quality_keeps_trusted_documents(spark, con):
    rows = result(spark, "op10_quality")
    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    known = rows[rows.doc_id.isin(quality)]
    good = known.doc_id.map(quality) == 1
    assert known.keep[good].mean() > 0.95
    assert known.perplexity[~good].median() > known.perplexity[good].median()
    assert (rows.keep == (rows.perplexity <= rows.threshold)).all()


def test_pipeline(spark, con, texts):
    """Each stage against what it was given."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    benchmark = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        after = docs.toPandas()
        if name == "toxicity":
            predicted = dict(result(spark, "op6_toxicity")[["doc_id", "predicted"]].values)
            assert sorted(after.doc_id) == sorted(i for i in before.doc_id if not predicted[i])
        elif name == "minhash near-dedup":
            assert sorted(after.doc_id) == sorted(set(near_classes(dict(zip(before.doc_id, before.text))).values()))
        elif name == "benchmark decontamination":
            assert set(after.doc_id) <= set(before.doc_id)
            windows = collections.defaultdict(set)
            for _, t in benchmark:
                words = folded_words(t.encode())
                for k in range(max(1, len(words) - 9)):
                    windows[len(words[k : k + 10])].add(tuple(words[k : k + 10]))
            was = dict(zip(before.doc_id, before.text))

            def hit(text):
                words = folded_words(text.encode())
                return any(tuple(words[k : k + n]) in own for n, own in windows.items() for k in range(len(words) - n + 1))

            clean = {i for i, t in was.items() if not hit(t)}
            assert clean <= set(after.doc_id)
            for r in after.itertuples():
                assert r.text == was[r.doc_id] if r.doc_id in clean else not hit(r.text) and len(r.text) < len(was[r.doc_id])
                assert r.n_chars == len(r.text)
        elif name == "mixing to target weights":
            size = after.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
            assert set(after.doc_id) <= set(before.doc_id) and after.groupby("doc_id").size().max() <= 3
            assert size.sum() == pytest.approx(sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in before.text), rel=0.01)
        else:
            assert len(after) == len(before) and set(after.shard) == set(range(8))
        assert docs.columns[: len(columns)] == columns
    assert docs.columns == [*columns, "shard", "slot"]


def test_llm_is_not_needed(tmp_path):
    """Without the package and the pipeline the other queries still load."""
    import subprocess

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('tidebook.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=entry_module.__file__.rsplit("/", 1)[0], check=True)
