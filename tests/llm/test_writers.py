"""Files, packing, mixing and the pipeline: exact round trips and plain versions."""

from __future__ import annotations

import gzip
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import mixing, packing, queries, warc, wavelet
from tonearm.llm.common import join_counted
from tonearm.llm.tokens import BatchEncoder, encoder

SF = "/root/testdata/sf0.001"
ODD = ["", "  a b", " x", "tab\there", "a\n\nb", "é b c", "don't stop\n12,3 <|endoftext|> x", "a ", "\n", "\x1c b c", "日本 語", "plain words here\nand here.", "a\tb  c d"]


def plain_ids(texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    small = BatchEncoder(queries.tokenizer_path(), kept=50)  # forgets words all the time
    assert small.by_word
    want = [np.array(i, "<u4").tobytes() for i in plain_ids(texts)]
    assert encoder(queries.tokenizer_path()).encode(texts) == want
    assert [x for a in range(0, len(texts), 7) for x in small.encode(texts[a : a + 7])] == want


def test_wavelet_matrix():
    rng = np.random.Generator(np.random.PCG64(0))
    for ids in (rng.integers(0, 50257, 3000), rng.integers(0, 3, 1025), np.zeros(5, int), np.array([7])):
        m = wavelet.WaveletMatrix.of(ids)
        assert (m.decode() == ids).all()
        assert [m.access(i) for i in range(0, len(ids), 97)] == ids[::97].tolist()
        for t in {*ids[:4].tolist(), 2, 60000}:
            at = np.flatnonzero(ids == t)
            assert m.count(t) == len(at) and m.count(t, 3, 900) == (ids[3:900] == t).sum()
            assert [m.locate(t, k) for k in range(len(at))][:50] == at[:50].tolist() and m.locate(t, len(at)) == -1
    assert wavelet.WaveletMatrix.of(np.zeros(0, int)).decode().tolist() == []


def test_lookups_in_a_shard_file(tmp_path):
    """access, count and locate on a file read back, against the plain ids; a lookup inflates a few blocks only."""
    rng = np.random.Generator(np.random.PCG64(1))
    ids = np.minimum(rng.zipf(1.3, 900_000), 50_256).astype(np.uint32)
    path = tmp_path / "x.wm"
    path.write_bytes(wavelet.shard_bytes([None, 4], np.array([400_000, 500_000]), ids))
    with open(path, "rb") as f:
        shard = wavelet.Shard(f)
        assert shard.doc_ids == [None, 4] and shard.lengths.tolist() == [400_000, 500_000] and shard.matrix.n == len(ids)
        assert shard.matrix.access(777_777) == ids[777_777] and 0 < shard.read_blocks <= 2 * shard.matrix.levels < len(shard.sizes) - 3 - shard.matrix.levels
        for i in rng.integers(0, len(ids), 200).tolist() + [0, len(ids) - 1]:
            assert shard.matrix.access(i) == ids[i]
        for t in (1, 2, 17, 4000, 50_256, 60_000, 1 << 20):
            at = np.flatnonzero(ids == t)
            assert shard.matrix.count(t) == len(at) and shard.matrix.count(t, 123_456, 654_321) == (ids[123_456:654_321] == t).sum()
            for k in {0, len(at) // 3, len(at) - 1} - {-1}:
                assert shard.matrix.locate(t, k) == (at[k] if len(at) else -1)
            assert shard.matrix.locate(t, len(at)) == -1
        assert (shard.matrix.decode() == ids).all()
    with open(path, "rb") as f, pytest.raises(IndexError):
        wavelet.Shard(f, kept=0).matrix.access(len(ids))


def test_count_of_a_token_over_shards(spark):
    frame = spark.createDataFrame([(i, "a b " * i) for i in range(40)], "doc_id long, text string")
    manifest = wavelet.write_shards(frame, queries.tokenizer_path(), 2, shard_ids=100)
    assert wavelet.count_token(manifest, 2).agg(F.sum("occurrences")).first()[0] == 40 and manifest.count() > 4


def test_token_shards(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(-5, None), (None, "null id"), (6, "again"), (7, "long text " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(3)
    manifest = wavelet.write_shards(frame, queries.tokenizer_path(), 2, shard_ids=40)
    got = sorted(wavelet.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start, want = 0, defaultdict(list)
    for (d, _), ids in zip(rows, plain_ids([t or "" for _, t in rows]), strict=True):
        want[d].append((len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    assert manifest.count() > 4
    none = wavelet.write_shards(frame.limit(0), queries.tokenizer_path(), 2)
    assert wavelet.read_documents(none).count() == 0


def test_packing(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10_000, None), (10_001, ""), (None, "no id"), (3, "repeated"), (3, "repeated")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash"))
    got = packing.pack(frame, queries.tokenizer_path()).collect()
    ids = Counter((d, tuple([*i, 1])) for (d, _), i in zip(rows, plain_ids([t or "" for _, t in rows]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d in {d for d, _ in rows} - {3}:
        parts = sorted(by_doc[d], key=lambda r: r.start)
        whole = tuple(x for r in parts for x in r.ids)
        assert ids[d, whole] == 1 and [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        assert {r.doc_tokens for r in parts} == {len(whole)}
    assert sum(r.length for r in by_doc[3]) == sum(len(i) * n for (d, i), n in ids.items() if d == 3)
    sizes = []
    for parts in by_sequence.values():
        parts = sorted(parts, key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        sizes.append(sum(r.length for r in parts))
    assert max(sizes) <= 2048 and all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack(frame.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_ranges_hold_equal_ids(spark):
    """Very long texts and a third of copies: ranges are even by ids, and every id comes back."""
    rows = [(i, "same text of ten words or so in a row " * 3) for i in range(200)] + [(1000 + i, f"w{i} v{i * 7} u " * (5 if i % 20 else 2000)) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path(), keep_ids=False).collect()
    by = defaultdict(int)
    for r in got:
        by[r.sequence_id >> 40] += r.length
    assert len(by) == 4 and max(by.values()) < 1.5 * sum(by.values()) / 4
    assert sum(by.values()) == sum(len(i) + 1 for i in plain_ids([t for _, t in rows]))


def test_power_pieces():
    assert [packing.power_pieces(n) for n in (0, 1, 6, 2047)] == [[], [1], [4, 2], [1 << b for b in range(10, -1, -1)]]


def water(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Targets by sharing the excess again and again."""
    share, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_ and left > 1e-9:
        heavy = sum(weights[i] for i in open_)
        give = {i: left * weights[i] / heavy for i in open_}
        left = 0.0
        for i, g in give.items():
            share[i] += g
            if share[i] >= most * sizes[i]:
                left += share[i] - most * sizes[i]
                share[i] = most * sizes[i]
                open_.discard(i)
    return share


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])) + rng.choice(["", " x", "\t\n y"]), rng.choice(["a", "a", "a", "b", "c", "é", "Z", None])) for i in range(600)]
    rows += [(600, None, "b"), (601, "", "empty"), (3, "w w w", "a"), (3, "w w w", "a"), (None, "w", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit("clash"))
    got = mixing.mix(frame, buckets=8)
    again = mixing.mix(frame.repartition(7), buckets=8)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, again.collect()), key=key)
    by = defaultdict(list)
    for r in got.collect():
        by[r.source].append(r)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got.collect()) == Counter((d, size(t)) for d, t, _ in rows)
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    totals = [sum(r.size for r in by[s]) for s in names]
    targets = water(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for s, total, target in zip(names, totals, targets, strict=True):
        largest = max(r.size for r in by[s])
        assert {r.source_size for r in by[s]} == {total} and all(abs(r.target - target) < 1e-6 for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= largest and all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in by[s])
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mixing_inclusion(spark):
    """Forty sources of the same sizes are forty draws: documents are taken once more about as often as their odds say."""
    sizes = [1, 4, 16, 64, 256]
    rows = [(s * 1000 + i, " ".join(["w"] * n), f"s{s:02}") for s in range(40) for i, n in enumerate(sizes * 40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total, heavy = 40 * 40 * sum(sizes), 14 * 5 + 13 * 2 + 13
    taken, odds = defaultdict(list), {}
    for r in got:
        weight = (5, 2, 1)[int(r.source[1:]) % 3]
        assert abs(r.target - total * weight / heavy) < 1e-6
        taken[weight, r.size].append(r.copies - int(r.target // r.source_size))
        odds.setdefault((weight, r.size), r.odds)
        assert odds[weight, r.size] == r.odds and r.copies - int(r.target // r.source_size) in (0, 1)
    for k, times in taken.items():
        assert len(times) >= 13 * 40 and abs(sum(times) / len(times) - odds[k]) < 0.06
    for weight in (5, 2, 1):
        of = [odds[weight, n] for n in sizes]
        assert of == sorted(of, reverse=True) and of[0] == 1.0 and of[-1] < 0.9
    for s in {r.source for r in got}:
        assert abs(sum(r.taken - r.target / 200 for r in got if r.source == s)) <= 128
    other = mixing.mix(spark.createDataFrame(rows[:400], "doc_id long, text string, source string"), seed=6).collect()
    same = mixing.mix(spark.createDataFrame(rows[:400], "doc_id long, text string, source string"), seed=7).collect()
    assert {(r.doc_id, r.copies) for r in other} != {(r.doc_id, r.copies) for r in same}


def test_warc(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(40)] + [(40, None, None), (41, "u\r\nX: y", ""), (None, "n", "<p>1</p>"), (12, "http://dup", "<p>5</p>"), (39, "again", "<p>4</p>"), (42, "é", "ü" * 400_000), (42, "é", "ü" * 400_000)]
    rows += [(None, "m", "only without ids"), (None, "n", "only without ids"), (None, "n", "<p>1</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    manifest = warc.write_archives(frame, file_bytes=600)
    got = warc.read_archives(manifest).collect()
    last: dict[bytes, int] = {}
    for p, _, h in rows:
        if p is not None:
            last[(h or "").encode()] = max(p, last.get((h or "").encode(), p))
    want, first = Counter(), set()
    for p, _, h in rows:
        data = (h or "").encode()
        to = last.get(data) if p != last.get(data) or data in first else None
        if p == last.get(data):
            first.add(data)
        want[p, len(data), warc.base32_sha1(data), "revisit" if to is not None else "response", to] += 1
    assert Counter(map(tuple, got)) == want
    assert manifest.count() > 4
    few = warc.read_archives(warc.write_archives(frame, least_bytes=100)).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in few] == [(42, 42)]
    assert warc.read_archives(warc.write_archives(frame.limit(0))).count() == 0


def test_warc_files_repeat(spark):
    """The same names and bytes from any layout of the rows; every record id once; nothing under a temporary name."""
    rows = [(i, "u", "x" * (i % 30)) for i in range(200)] + [(5, "u", "xxxxx"), (5, "v", "xxxxx"), (None, "n", "x"), (None, "n", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")

    def files(df):
        found = warc.write_archives(df, file_bytes=1500).collect()
        folder = found[0].path.rpartition("/")[0].removeprefix("file://")
        assert sorted(os.listdir(folder)) == sorted(r.path.rpartition("/")[2] for r in found)
        return {r.path.rpartition("/")[2]: open(r.path.removeprefix("file://"), "rb").read() for r in found}

    one, other = files(frame.repartition(2)), files(frame.orderBy(F.desc("page_id")).repartition(7))
    assert one == other and len(one) > 4
    ids = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(gzip.decompress(b) for b in one.values()))
    assert len(ids) == len(rows) == len(set(ids))


def test_join_of_hot_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(100)], "k long, v long")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = join_counted(rows, per, "k", "n", most=10).select("v", "top").collect()
    assert sorted((r.v, r.top) for r in got) == [(i, 87 + i % 3 if i < 90 else i) for i in range(100)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = sorted(docs.columns)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert sorted(after.columns) == columns, name
        assert {(r.doc_id, r.text) for r in after.collect()} <= {(r.doc_id, r.text) for r in before.collect()}, name
        before = after.persist()
    assert 0 < before.count()
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.where("length > 2048").count() == 0 and pieces.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (900, "", None, None, 0, 1), (901, "word", "en", "s", 4, 1)], docs.schema.simpleString()[7:-1].replace(":", " ") + ", copies int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0, name


def test_pipeline_mixing_of_repeated_rows(spark):
    import corpus_pipeline

    rows = [(i, "w " * (i % 5), "en", "abc"[i % 3], 9) for i in range(30)] + [(3, "w w w ", "en", "a", 9), (None, "w", "en", "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len((r.text or "").split())) for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect())
    assert got == Counter({k: n for k, n in taken.items() if n})
