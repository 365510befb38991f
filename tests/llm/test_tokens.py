"""Token counts, token files and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugeline.llm import packing, token_files, unit_tokens
from gaugeline.llm.bytewords import text_bytes
from gaugeline.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, n_tokens string, start int"
ODD = [
    "", "  ", " a", "a ", "\n", " \n a\n\nb  c\t d ", "it's we're 'tis ''re x'sy can't.", "éa ≮ b", "<|endoftext|>hi <|startoftext|> THE end", "<|ENDOFTEXT|> a",
    "x y   z", "日本語 テキスト。ok", "1234 5a6 b7.8,9", "<s> </s> <unk>", "\x00a\x01 b\x1c c", "🙂🙂 a🙂b", "a\r\nb;\r c", "×à÷ü Ñ",
]


def odd_texts():
    rng = random.Random(4)
    parts = ["a", "B", "é", "×", " ", "  ", "\n", "\r", "'", "s", "re", "1", ".", ";", "<|endoftext|>", "<|", " ", "́", "—", "_", "\t", "日"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["word " * 5000]


def rows(texts):
    return [(i, t, "clash", 7) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_library_ids(name):
    texts = odd_texts()
    ids, at = unit_tokens.FileEncoder(P.path(name))(*text_bytes(pa.array(texts)))
    want = Tokenizer.from_file(P.path(name)).encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [w.ids for w in want]


def test_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(unit_tokens, "CACHE_UNITS", 50)
    encoder, tokenizer = unit_tokens.FileEncoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for first in range(0, 400, 40):
        texts = odd_texts()[first : first + 40]
        ids, at = encoder(*text_bytes(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]


def test_counts_equal_the_library(spark):
    texts = [*odd_texts(), None]
    got = token_counts(spark.createDataFrame(rows(texts), SCHEMA), P.path("piece_bpe_32k.model"), limit=20).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 20) and r["start"] == 7 for r in got)


def test_counts_of_nothing(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), P.path("piece_bpe_32k.model")).count() == 0


def test_files_round_trip(spark, tmp_path):
    texts = [*odd_texts()[:300], None]
    data = [(i * 3 - 50, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1)]
    manifest = token_files.write_token_files(spark.createDataFrame(data, SCHEMA).repartition(5), str(tmp_path / "out"), P.path("byte_bpe_50k.json"), end_id=0, length=32)
    got = {r["doc_id"]: r for r in token_files.read_token_files(manifest).collect()}
    tokenizer, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for key, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for row in manifest.collect():
        file = token_files.SequenceFile(row["path"] + ".arrow")
        stream = np.concatenate(list(file.stream()))
        assert len(stream) == row["n_tokens"] and file.length == 32
        ids, mask = file.sequence(row["n_tokens"] // 32 - 1 if row["n_tokens"] >= 32 else 0)
        assert len(ids) == len(mask) == 32


def test_files_of_nothing(spark, tmp_path):
    manifest = token_files.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), P.path("byte_bpe_50k.json"), end_id=0)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


def test_rows_of_equal_ids_keep_their_order(spark, tmp_path):
    rows = [(k, f"text {k} {j}") for k in (None, 1, 2) for j in range(9)]

    def starts(name, data):
        docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
        got = token_files.read_token_files(token_files.write_token_files(docs, str(tmp_path / name), P.path("byte_bpe_50k.json"), end_id=0))
        return sorted(map(tuple, got.collect()), key=str)

    first = starts("a", rows)
    assert len(first) == 27 and first == starts("b", rows[::-1])


def test_folder_of_another_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://localhost:1")
    try:
        assert token_files.qualified(spark, "/out/ids") == "hdfs://localhost:1/out/ids"
        assert token_files.qualified(spark, "file:/out/ids") == "file:/out/ids"
    finally:
        conf.set("fs.defaultFS", before)
    assert token_files.qualified(spark, "/out/ids") == "/out/ids"


def check_packing(pieces, capacity):
    fill = {}
    for r in pieces:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


def test_packing_places_every_piece(spark):
    texts = [*odd_texts()[:400], "to be " * 700, "to be " * 700, None]
    got = packing.pack_documents(spark.createDataFrame(rows(texts) + rows(texts)[:50], SCHEMA).repartition(6), P.path("word_bpe_49k.json"), capacity=256).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in rows(texts) + rows(texts)[:50]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, k * 256, len(ids[k * 256 :][:256]), zlib.crc32(ids[k * 256 :][:256].tobytes())) for k in range(-(-len(ids) // 256))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    used = check_packing(got, 256)
    assert used <= 1.1 * sum(r["length"] for r in got) / 256 + 2


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_a_packing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 400))
    sizes = np.clip(rng.lognormal(np.log(capacity) - rng.uniform(0.2, 2), 0.9, int(rng.integers(1, 800))).astype(int), 1, capacity)
    counts = np.bincount(sizes, minlength=capacity + 1)
    plan = packing.make_plan(counts, capacity, groups=12)
    ranks, pieces = {}, []
    for size, rank, bins, first, offset, copies in plan.rows:
        ranks.setdefault(size, []).extend(range(rank, rank + bins * copies))
        pieces += [{"sequence_id": first + k, "offset": offset + c * size, "length": size} for k in range(bins) for c in range(copies)]
    assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items()) and sum(map(len, ranks.values())) == len(sizes)
    assert check_packing(pieces, capacity) == plan.bins
    assert plan.bins <= 1.35 * sizes.sum() / capacity + 3
