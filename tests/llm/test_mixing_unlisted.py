from collections import defaultdict

import corpus_pipeline
from rostrum.llm import mixing, queries

LANGS = ["en", "de", "fr", "es", "it", None]


def test_unlisted_languages_are_not_dropped(spark, tmp_path):
    """The listed lang shares add up to 1; other and null values stay as they come."""
    rows = [(i, "word " * 100 + str(i), LANGS[i % 6], f"src{i // 6 % 3}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_mixing(spark, str(tmp_path)).collect()
    by_lang = defaultdict(list)
    for r in got:
        by_lang[r.lang].append(r)
    for lang in ("it", None):
        assert min(r.probability for r in by_lang[lang]) > 0 and any(r.sampled for r in by_lang[lang])
    kept = {r.lang for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()}
    assert kept == set(LANGS)
    raked = mixing.rake(mixing.cells_of(docs), queries.MIX, keep_unlisted=True).toPandas().groupby("lang")["weight"].sum()
    share = raked / raked.sum()
    for lang, want in {"it": 1 / 6, "(none)": 1 / 6, "en": 0.5 * 4 / 6, "de": 0.2 * 4 / 6, "fr": 0.1, "es": 0.1}.items():
        assert abs(share[lang] - want) < 1e-4
    # A listed 0 still drops.
    assert {r.probability for r in mixing.sample(docs, {"lang": {"it": 0.0, "en": 1.0}}, 0.5, keep_unlisted=True).where("lang = 'it'").collect()} == {0.0}
