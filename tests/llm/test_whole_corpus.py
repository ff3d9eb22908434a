"""Special tokens in texts, and documents with reused or no ids in the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from tonearm.llm import mixing, packing, queries, wavelet
from tonearm.llm.tokens import BatchEncoder

TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b\nc", "plain words <|endoftext", "x y", "<|endoftext|> <|endoftext|>"]


def default_ids(texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    return [Tokenizer.from_file(queries.tokenizer_path()).encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_in_texts_as_the_library_does(spark):
    small, ids = BatchEncoder(queries.tokenizer_path(), kept=2), default_ids(TEXTS)
    assert small.by_word and len(ids[0]) == 4 and 50256 in ids[0]
    want = [np.array(i, "<u4").tobytes() for i in ids]
    assert small.encode(TEXTS) == want and [x for t in TEXTS for x in small.encode([t])] == want
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    shards = wavelet.read_documents(wavelet.write_shards(frame, queries.tokenizer_path(), 2)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in shards} == {d: (len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, i in enumerate(ids)}
    packed: dict[int, list[int]] = {}
    for r in sorted(packing.pack(frame, queries.tokenizer_path()).collect(), key=lambda r: r.start):
        packed.setdefault(r.doc_id, []).extend(r.ids)
    assert packed == {d: [*i, 1] for d, i in enumerate(ids)}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicate_stage_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(60))
    near = b + " more"
    texts = [(0, near), (1, a), (1, b), (2, a), (3, "one two"), (3, "three four"), (3, "One two"), (4, None), (4, None), (None, b), (None, "lone words"), (None, "other words"), (None, "lone words"), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts], SCHEMA)
    for parts in (1, 5):
        got = Counter((r.doc_id, r.text and r.text.lower()) for r in corpus_pipeline.near_duplicate_stage(spark, docs.repartition(parts), SCHEMA).collect())
        assert got == Counter([(0, near), (1, a), (3, "one two"), (3, "three four"), (4, None), (None, "lone words"), (None, "other words"), (None, None), (None, None)])


def test_mixing_stage_keeps_texts_of_one_id_and_size_apart(spark):
    import corpus_pipeline

    texts = [(d, f"{w} {w}", s) for d, w, s in [(1, "a", "x"), (1, "b", "x"), (None, "c", "x"), (None, "d", "x"), (None, "e", None), (2, "f", None)]]
    docs = spark.createDataFrame([(d, t, "en", s, 3) for d, t, s in texts], SCHEMA)
    mixed = mixing.mix(docs).collect()
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect())
    assert set(got) <= set(texts) and len(got) == len([1 for r in mixed if r.copies])
    for k in {(r.doc_id, r.source) for r in mixed}:
        assert sorted(r.copies for r in mixed if (r.doc_id, r.source) == k and r.copies) == sorted(n for (d, _, s), n in got.items() if (d, s) == k)


def test_mixing_stage_takes_what_the_mix_takes_of_many_rows_without_id(spark):
    import corpus_pipeline

    rows = [(None, f"w{i % 7} " * 3, "s" if i % 3 else None) for i in range(120)] + [(None, None, "s"), (None, "", "t"), (1, "x y", "t"), (1, "x y", "t")] + [(i, "p q r", "t") for i in range(30)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)
    for parts in (1, 4):
        shuffled = docs.repartition(parts)
        want = Counter()
        for r in mixing.mix(shuffled).collect():
            want[r.doc_id, r.source, r.size, r.text_key] += r.copies
        out = corpus_pipeline.mixing_stage(spark, shuffled, "")
        assert out.columns == list(corpus_pipeline.COLUMNS)
        keyed = out.selectExpr("doc_id", "source", "text", "xxhash64(text) AS text_key").collect()
        got = Counter((r.doc_id, r.source, len((r.text or "").split()), r.text_key) for r in keyed)
        assert got == +want
    assert corpus_pipeline.mixing_stage(spark, docs.limit(0), "").count() == 0
