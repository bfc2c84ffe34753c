import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rostrum.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello, WORLD's don't we'll ''s 's'' 'some they're I'd 12345 x²½", "a\x1cb\x85c d e", "<|endoftext|> and <|startoftext|>x<|end", "İstanbul ß ÀÉ ǅ ŉ",
         "café 日本語 🙂 ελληνικός", "it's " * 5000, "x" * 100_000, "tab\tand\nnewline!!!???###", "'", "''", "a'", "'re've'll", "'r 'l", " "]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_same_as_library(spark, tok):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, TEXTS[3], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for entries in (1, 64):
        got = token_counts.count_tokens(docs, PATH, entries=entries).collect()
        want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs.where("false"), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'stmdrevl <|>\n"), st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4))
def test_pieces_of_any_low_text(tok, texts):
    import numpy as np
    import pyarrow as pa

    from rostrum.llm import grams
    pieces = token_counts.Pieces.get(open(PATH).read())
    none = (np.zeros(2, np.uint64), np.zeros(2, np.uint16))
    got = []
    for lo, hi, data, offsets in grams.chunks(pa.array(texts)):
        h, start, stop, text, chars, odd = pieces.split(data, offsets)
        n = np.bincount(text, pieces.lengths(h, start, stop, chars, none), minlength=hi - lo)
        got += [pieces.slowly(texts[lo + i]) if odd[i] else int(n[i]) for i in range(hi - lo)]
    assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
