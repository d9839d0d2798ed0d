"""What a Python worker holds while documents are tokenised."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quillspark.llm import packing  # noqa: E402
from quillspark.llm.queries import tokenizer_path  # noqa: E402

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_pieces_do_not_depend_on_the_words_kept(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k % 50} again" for k in range(200))) for i in range(20)], "doc_id long, text string")
    path = tokenizer_path("word_bpe_49k.json")
    few, many = (sorted(map(tuple, packing.pieces(docs, path, cache_words=n).collect())) for n in (7, packing.CACHE_WORDS))
    assert few == many and len(few) == 20


def test_the_pipeline_keeps_fewer_words_and_sends_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    seen, pieces = [], packing.pieces
    monkeypatch.setattr(packing, "pieces", lambda *a, **k: seen.append(k["cache_words"]) or pieces(*a, **k))
    spread = packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name, rows: seen.append(rows) or spread(df, name, rows))
    before = spark.conf.get(BATCH)
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 1
    assert seen == [corpus_pipeline.CACHE_WORDS, packing.BATCH_ROWS] and corpus_pipeline.CACHE_WORDS < packing.CACHE_WORDS
    assert spark.conf.get(BATCH) == before


def test_missing_words_are_encoded_many_at_once_and_cut_right():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = "Don't I'll x's' foo'' naïve' Été. ÀÖØ!! ß ÿ× ÷ İstanbul été Ab3c 42! (a) <|endoftext|> x<|endoftext|>. a b it's. ''s #$% 中文, a\x1fb µ ª"
    texts = [" ".join(f"wo{chr(97 + k % 26)}rd{chr(97 + k // 26)}{'.!?,'[k % 4] * (k % 3)}" for k in range(600)), odd, odd.upper(), f"{odd} {odd}", "x" * 90, ""]
    for most in (4, 50, packing.CACHE_WORDS):
        words, calls = packing._Words(path), []
        words.most, one = most, words.encode
        words.encode = lambda text, one=one, calls=calls: calls.append(text) or one(text)
        for text in texts * 2:
            got = np.frombuffer(words.ids(text.encode().split()), "<u4").tolist()
            assert got == whole.encode(text, add_special_tokens=False).ids
            assert len(words.now) <= max(1, most // 2) and len(words.before) <= max(1, most // 2)
        if most == packing.CACHE_WORDS:
            assert len(calls) < 100
