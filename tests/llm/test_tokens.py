import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidewake.llm import packing, token_files
from tidewake.llm.tokens import ChunkEncoder, with_end

PATHS = {n: public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def reference(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[name])
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", PATHS)
def test_chunks_give_the_ids_of_whole_texts(name):
    ids_of, encoder = reference(name), ChunkEncoder(PATHS[name], most=300)
    rng = random.Random(3)
    alphabet = list(" \n\t\r\x0b\x1c\x85\xa0'sStredDONm.,!?1²éÜ日本Σς\u200b\u0301") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "  ", "'re", " word", "İ"]
    texts = ["", None, " ", "\n\n x"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        ids, offsets = encoder.encode(part)
        for t, a, b in zip(part, offsets[:-1], offsets[1:], strict=True):
            assert ids[a:b].tolist() == ids_of(t), repr(t)


def test_end_ids():
    ids, offsets = with_end(np.array([5, 6, 7], np.uint32), np.array([0, 0, 2, 3]), 9)
    assert ids.tolist() == [9, 5, 6, 9, 7, 9] and offsets.tolist() == [0, 1, 4, 6]


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 513, 5000])
def test_codes_round_trip(size):
    rng = np.random.default_rng(size)
    ids = (rng.integers(0, 1 << 32, size, dtype=np.uint64) >> rng.integers(0, 32, size, dtype=np.uint64)).astype(np.uint32)
    codes = token_files.Codes(token_files.pack(ids))
    assert len(codes) == size and codes.read(0, size).tolist() == ids.tolist()
    for i in rng.integers(0, max(size, 1), min(size, 60)):
        assert codes[int(i)] == ids[i]
    for _ in range(20 if size else 0):
        a, b = sorted(rng.integers(0, size + 1, 2).tolist())
        assert codes.read(a, b).tolist() == ids[a:b].tolist()


ROWS = [(3, "third text"), (None, "no id"), (1, ""), (2, None), (2, "again two"), (7, "word " * 4000), (-4, "Ünïcode 日本 <|endoftext|>"), (3, "third text")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, payload string, part int")


def test_token_table(spark, tmp_path):
    ids_of = reference("word_bpe_49k.json")
    token_files.write_tokens(frame(spark, ROWS).repartition(3), str(tmp_path / "t"), PATHS["word_bpe_49k.json"], 2, partitions=3, block_tokens=50)
    got = [tuple(r) for r in token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "t"))).orderBy("start").collect()]
    at, expected = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(t), 2]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    # Equal ids come in the order of their texts or hashes; their starts follow from the file.
    assert sorted((g[0] is not None, g[0] or 0, g[2], g[3]) for g in got) == sorted((e[0] is not None, e[0] or 0, e[2], e[3]) for e in expected)
    assert [g[0] for g in got] == [e[0] for e in expected] and [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got[:-1])]).tolist()


def test_single_tokens_by_small_reads(spark, tmp_path):
    path, ids_of = str(tmp_path / "t"), reference("word_bpe_49k.json")
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice(["the", "naïve", "quixotic", "x", "1", "日本"]) for _ in range(rng.randint(0, 60)))) for d in rng.sample(range(10_000), 300)] + [(None, "none"), (20_000, "long " * 30_000)]
    token_files.write_tokens(frame(spark, rows).repartition(3), path, PATHS["word_bpe_49k.json"], 2, partitions=3, block_tokens=500, file_blocks=4)
    ids = [i for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*ids_of(t), 2]]
    files = [str(x) for x in (tmp_path / "t").glob("part-*") if x.stat().st_size]
    read = []

    def read_at(file, place, n):
        with open(file, "rb") as f:
            f.seek(place, 0 if place >= 0 else 2)
            data = f.read(n)
        read.append(len(data))
        return data

    table = token_files.Table(files, read_at)
    assert len(files) > 3 and len(table) == len(ids)
    for i in [0, len(ids) - 1, *rng.sample(range(len(ids)), 300)]:
        read.clear()
        assert table.token_at(i) == ids[i]
        assert sum(read) <= 8 + 2 * (4 + 1 + token_files.STRETCH // 8 + 4) and len(read) <= 10
    with pytest.raises(IndexError):
        table.token_at(len(ids))
    assert [token_files.open_table(spark, path).token_at(i) for i in (0, 77, len(ids) - 1)] == [ids[0], ids[77], ids[-1]]
    got = token_files.token_digests(token_files.read_tokens(spark, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0)) and sum(r["n_tokens"] for r in got) == len(ids)


def test_empty_tables(spark, tmp_path):
    token_files.write_tokens(frame(spark, []), str(tmp_path / "t"), PATHS["word_bpe_49k.json"], 2)
    assert token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "t"))).count() == 0
    assert packing.pack(frame(spark, []), PATHS["byte_bpe_50k.json"]).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_brackets_give_each_gap_the_longest_free_piece(seed):
    rng = np.random.default_rng(seed)
    rows = sorted((int(n), bool(g)) for n, g in zip(rng.integers(1, 30, 60), rng.random(60) < rng.random(), strict=True))
    mate, _ = packing.brackets(np.array([g for _, g in rows]))
    free, expected = [], [-1] * len(rows)
    for k, (_, is_gap) in enumerate(rows):
        if not is_gap:
            free.append(k)
        elif free:
            expected[k] = free.pop()
            expected[expected[k]] = k
    assert mate.tolist() == expected and all(rows[k][0] <= rows[m][0] for k, m in enumerate(expected) if m >= 0 and rows[m][1])


def packed(spark, lengths, capacity):
    pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long").repartition(3)
    rows = packing.places_of(pieces, capacity).collect()
    assert sorted(r["pid"] for r in rows) == list(range(len(lengths)))
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["pid"]]))
    for placed in held.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("task_rows", [packing.TASK_ROWS, 40])
def test_rounds_are_near_best_fit_decreasing(spark, monkeypatch, task_rows):
    """Over one range and over many, where what is open in one meets what is open in another."""
    monkeypatch.setattr(packing, "TASK_ROWS", task_rows)
    rng = random.Random(task_rows)
    capacity = 30
    for lengths in ([min(capacity, 1 + int(rng.paretovariate(0.5))) for _ in range(300)], [3] * 100 + [15] * 30 + [16] * 20):
        assert packed(spark, lengths, capacity) <= best_fit_decreasing(lengths, capacity) + 2


def test_one_round_over_many_ranges_is_the_sweep_over_one(spark, monkeypatch):
    rng = random.Random(3)
    sizes = [rng.randint(1, 40) for _ in range(300)], [rng.randint(1, 40) for _ in range(200)]
    pieces, gaps = (spark.createDataFrame(list(enumerate(x)), "id long, size long") for x in sizes)
    found = []
    for task_rows in (1000, 25):
        monkeypatch.setattr(packing, "TASK_ROWS", task_rows)
        rows = packing.one_round(pieces, gaps, 1, 41, 1, 500, 100).collect()
        found.append(sorted((r["kind"], r["id"], r["size"], -1 if r["sid"] is None else r["sid"]) for r in rows))
    assert found[0] == found[1] and sum(r[0] == 2 for r in found[0]) > 100


def test_packing_of_few_or_equal_pieces(spark):
    assert packed(spark, [1] * 80, 8) == 10
    assert packed(spark, [10] * 5 + [6] * 4 + [4] * 4, 10) == 9
    assert packed(spark, [3], 8) == packed(spark, [3, 5], 8) == 1
    assert packed(spark, [1, 1, 1], 1) == 3


def test_packing(spark):
    ids_of = reference("byte_bpe_50k.json")
    rows = packing.pack(frame(spark, ROWS).repartition(4), PATHS["byte_bpe_50k.json"], 0, 2048).collect()
    got, expected = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for d, t in ROWS:
        ids = [*ids_of(t), 0]
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            expected.setdefault(d, []).append((k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in expected.items()}
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *(n for _, n in x[:-1])]).tolist() and sum(n for _, n in x) <= 2048
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut(5, 2048) == [(0, 5)]
