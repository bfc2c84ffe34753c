import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.llm import embeddings, grams, language_id, samples, toxicity

EDGE = [(None, "no id"), (90_001, None), (90_002, ""), (90_003, "word " * 60_000), (90_004, "12 ## 7"), (5, "repeated id"), (5, "repeated id")]


def prose(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """600 texts of two made-up languages; a third of the first are toxic, a
    quarter are shouted."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        lang = "aa" if i % 2 else "bb"
        text = prose(rng, ["ka", "lo", "mi", "ten"] if i % 2 else ["zu", "ery", "op", "gri"], rng.randint(20, 60))
        toxic, good = int(i % 3 == 0), int(i % 4 != 0)
        if toxic:
            text += " vileword" + rng.choice(["", "s", "ish"]) + " " + text[:20]
        rows.append((i, text if good else text.upper() + " $$$", lang, 1.5))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame(rows + [(*e, None, None) for e in EDGE], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs.repartition(4).cache(), known


def check(scored, labels, column, least):
    got = scored.join(labels.where(F.col(column).isNotNull()), "doc_id").where(samples.fold("doc_id", 3) == 1).collect()
    right = np.mean([(r.score >= 0.5) == bool(r[column]) for r in got])
    assert len(got) > 100 and right >= least, right


@pytest.mark.parametrize("module,column,least", [(embeddings, "quality", 0.97), (toxicity, "toxic", 0.97)])
def test_learns_from_the_other_rows(corpus, module, column, least):
    docs, labels = corpus
    model = module.fit(docs, labels, column, samples.fold("doc_id", 3) != 1)
    scored = module.score(docs, model)
    check(scored, labels, column, least)
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (90_001, 90_002)}) == 1
    again = module.fit(docs.repartition(3), labels, column, samples.fold("doc_id", 3) != 1)
    assert np.allclose(again[0], model[0]) and np.allclose(again[1], model[1])
    assert module.score(docs.where("false"), model).count() == 0


def test_nothing_to_learn(corpus):
    docs, labels = corpus
    none = labels.where("false")
    assert {r.score for r in embeddings.score(docs, embeddings.fit(docs, none, "quality", F.lit(True))).collect()} == {0.5}
    assert all(r.score < 1e-9 for r in toxicity.score(docs, toxicity.fit(docs, none, "toxic", F.lit(True))).collect())
    filters = language_id.fit(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, filters).collect()} == {("und", 0.0)}


def test_risk_is_corrected_by_the_prior():
    """Unlabelled rows hold positives; a plain classifier against them would
    score positives near a half, the corrected one near one."""
    rng = np.random.default_rng(0)
    base = lambda: rng.choice(1000, 30, replace=False)
    toxic = lambda: np.append(base(), 2000 + rng.integers(0, 5))
    w, b = toxicity.train([toxic() for _ in range(200)], [toxic() for _ in range(200)] + [base() for _ in range(800)], 0.2)
    assert min(toxicity._sigmoid(toxicity._margin(w, b, [toxic() for _ in range(100)]))) > 0.7
    assert max(toxicity._sigmoid(toxicity._margin(w, b, [base() for _ in range(100)]))) < 0.1


def test_cutoff_keeps_rows_whole(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    kept = toxicity.score(docs, model, 0.7)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score(docs, model).where("score < 0.7").count()


def test_languages(corpus):
    docs, _ = corpus
    filters = language_id.fit(docs, samples.fold("doc_id", 4) != 2)
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, filters).collect()}
    want = {r.doc_id: r.lang for r in docs.collect() if r.lang}
    assert all(lang == want[i] and score > 0.5 for i, lang, score in got if i in want and i != 5)
    assert {(i, lang) for i, lang, _ in got if i in (90_001, 90_002, 90_004)} == {(90_001, "und"), (90_002, "und"), (90_004, "und")}


def test_bloom_slices_have_no_false_negatives():
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 1 << 64, 4000, dtype=np.uint64) for _ in range(70)]
    filters = language_id.build([f"l{i:02d}" for i in range(70)], members, 14)
    for i in (0, 8, 63, 64, 69):
        mask = np.bitwise_and.reduce([filters.slots[i // 64][s] for s in language_id._slots_of(members[i], 14)])
        assert ((mask >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    mask = np.bitwise_and.reduce([filters.slots[0][s] for s in language_id._slots_of(other, 14)])
    assert abs((mask & np.uint64(1)).mean() - filters.chance[0]) < 0.02


@pytest.mark.parametrize("texts", [["", ""], ["a"], ["", "ab c", "", "Straße Ñandú 🙂", "x"]])
def test_grams_do_not_cross_texts(texts):
    def one(part):
        _, _, d, o = next(iter(grams.chunks(pa.array(part))))
        return [(set(b.tolist()), round(float(w.sum()), 9)) for b, w in embeddings.shares(d, o, grams.Powers())], language_id.text_grams(d, o, grams.Powers())

    together, alone = one(texts), [one([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    for i, a in enumerate(alone):
        mine = sorted(int(x) for h, t in together[1][0] for x in h[t == i])
        assert mine == sorted(int(x) for h, _ in a[1][0] for x in h) and together[1][1][i] == a[1][1][0]
