"""The pipeline's stages on a small corpus, each against a plain version of what it should keep."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_corpus import removed_words

from rowloom.llm import minhash, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    speak = {"en": "the of and that this with have from they which their would there what about other".split(), "de": "der die das und nicht eine auch sich werden haben durch mehr über können".split()}
    say = lambda lang, n: " ".join(rng.choice(speak[lang]) for _ in range(n))
    texts = [(say(lang, 120), lang) for lang in ["en", "de"] * 40]
    toxic = set(range(0, 80, 8))
    texts = [(t + " idiot worthless scum" * 4, lang) if i in toxic else (t, lang) for i, (t, lang) in enumerate(texts)]
    passage = say("en", 60)
    texts += [(texts[1][0], "de"), (texts[3][0] + " ", "de"), (say("en", 30) + " " + passage, "en"), (passage + " " + say("en", 30), "en"), ("", "en"), (None, None), ("!!! 123", "en")]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, toxic


def test_stages(spark, corpus):
    folder, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        seen[name] = {r.doc_id: r for r in out.collect()}
        docs = spark.createDataFrame(list(seen[name].values()), SCHEMA)
    assert set(range(80)) | {80, 81, 82, 83} == set(seen["language_id"])
    assert not toxic & set(seen["toxicity"])
    assert len(seen["toxicity"]) >= 0.9 * (84 - len(toxic))
    classes = {}
    for i, r in seen["toxicity"].items():
        classes.setdefault(simhash.fingerprint(r.text.encode()), []).append(i)
    for members in classes.values():
        assert {min(members)} >= set(members) & set(seen["simhash_near_dedup"])
    before = [(i, r.text) for i, r in sorted(seen["simhash_near_dedup"].items())]
    for (i, text), (_, _, gone, kept) in zip(before, removed_words(before, 20), strict=True):
        assert seen["substring_dedup"][i].text == (kept.decode() if gone else text)
        assert seen["substring_dedup"][i].n_chars == len(seen["substring_dedup"][i].text)
    assert len(seen["substring_dedup"][83].text.split()) == 30
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packed.select("doc_id").distinct().count() == len(seen["substring_dedup"])


def test_run(spark, corpus):
    found = corpus_pipeline.run(spark, corpus[0])
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() >= 60


def test_stages_take_empty_tables(spark, corpus):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus[0]).count() == 0


def test_rows_without_ids_or_texts(spark, corpus):
    docs = spark.createDataFrame([(None, "a b c d", "en", "s", 7), (None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0)], SCHEMA)
    assert corpus_pipeline.near_dedup(spark, docs, corpus[0]).count() == 3
    assert corpus_pipeline.substring_dedup(spark, docs, corpus[0]).count() == 4


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_near_dedup_takes_edited_copies(spark, corpus):
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [say(rng.choice((6, 40, 200))) for _ in range(40)]
    for base in [say(200) for _ in range(20)]:  # each copy of the copy before it, so that some classes hold by a chain alone
        texts.append(base)
        for edits in (1, 3, 4, 5):
            base = [*base]
            for at in rng.sample(range(len(base)), edits):
                base[at] = f"edit{rng.randrange(10**6)}"
            texts.append(base)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    docs += [(500, None), (501, " "), (502, "Short text"), (503, "short  TEXT"), (None, "short text"), (None, docs[0][1])]
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if alike(sets[i], sets[j])]
    far = [(simhash.fingerprint(docs[i][1].encode()) ^ simhash.fingerprint(docs[j][1].encode())) % 2**64 for i, j in pairs if docs[i][1] and docs[j][1]]
    assert sum(x.bit_count() > 3 for x in far) >= 20  # what 3 bits of SimHash leave
    for i, j in pairs:
        group = [group[j] if g == group[i] else g for g in group]
    wanted = {min(docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None) for g in set(group)}
    found = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA), corpus[0]).collect()]
    assert sorted(i for i in found if i is not None) == sorted(wanted)
    assert found.count(None) == 2


def test_minhash_forest_is_exact():
    ints = lambda *spans: np.array([x for a, b in spans for x in range(a, b)], np.uint64)
    sets = [ints((0, 9)), ints((1, 10)), ints((0, 9), (20, 21)), ints((0, 8), (30, 31)), ints((100, 109)), ints((100, 107), (120, 122))]
    assert {frozenset(x) for x in minhash.forest(sets, (4, 5))} == {frozenset(x) for x in [(0, 1), (0, 2), (0, 3)]}


def test_near_dedup_tells_rows_of_one_id_apart(spark, corpus):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(1, a), (2, b), (2, a), (2, c), (3, c), (3, "own words here")]
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA), corpus[0]).collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted([(1, a), (2, b), (2, c), (3, "own words here")])


def test_substring_dedup_keeps_each_row_with_its_own_text(spark, corpus):
    schema = SCHEMA + ", _k int, _null string, carried0 double"
    long = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, "hello world", "de", "s", 11, 1, "x", 0.5), (1, None, "en", "s", None, 2, None, None), (2, "b a", "aa", "x", 3, 3, "y", 1.5), (2, "a b", "zz", "y", 3, 4, "z", 2.5),
        (3, long, "en", "s", 0, 5, "u", 3.5), (None, "own " + long, "en", "s", 0, 6, "v", 4.5), (None, "", "fr", None, 0, 7, "w", None), (2, "a b", "zz", "y", 3, 4, "z", 2.5),
    ]
    docs = spark.createDataFrame(rows, schema)
    found = corpus_pipeline.substring_dedup(spark, docs, corpus[0])
    assert found.columns == docs.columns
    assert found.dtypes == docs.dtypes
    wanted = [(i, "own" if t and t.startswith("own") else t, lang, source, None if t is None else 3 if t.startswith("own") else len(t), *rest) for i, t, lang, source, _, *rest in rows]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_wide_simhash_finds_pairs_of_the_least_similarity():
    rng = np.random.default_rng(5)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for n in (1000, 300_000):
        wide = simhash.Wide.of((4, 5), n)
        common = [some(80) for _ in range(300)]
        left, right = (np.array([wide.fingerprint(np.concatenate([c, some(10)])) for c in common]) for _ in range(2))  # 80 of 100 in both
        shared = wide.keys(left) == wide.keys(right)
        assert shared.any(1).all()
        assert 0.5 < shared.mean() / 0.848**wide.bits < 2  # equal segments, and no others, have equal distances
        assert (wide.keys(left) == wide.keys(left[::-1])).mean() < 2 * 0.5**wide.bits
        labels = wide.labels(np.concatenate([left, right])[:, :3])
        assert (labels[:300] == labels[300:]).all()
        assert len(set(labels.tolist())) == 300


def test_near_dedup_looks_up_simhash_pivot_tables(spark):
    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    wide = simhash.Wide.of((4, 5), 10**6)
    common = [some(160) for _ in range(200)]
    prints = [(2 * i + k, wide.fingerprint(np.concatenate([c, some(20)])).tobytes()) for i, c in enumerate(common) for k in (0, 1)]
    found = wide.near(spark.createDataFrame(prints, "node long, print binary").repartition(3)).collect()
    groups = {}
    for bucket, node in found:
        groups.setdefault(bucket, set()).add(node)
    assert {frozenset(g) for g in groups.values()} == {frozenset((2 * i, 2 * i + 1)) for i in range(200)}
