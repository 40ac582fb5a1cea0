"""Packing along the Hilbert curve: ids against the tokenizer library, whole sequences, and the curve's own properties."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    model = Tokenizer.from_file(PATH)
    return [model.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check_pieces(pieces, docs, size=4096):
    """Every id of every document in one piece, sequences gapless, all of ``size`` but for powers of two."""
    left = {}
    for i, t in docs:
        left.setdefault(i, []).append(library_ids([t])[0])
    for i, mine in itertools.groupby(sorted(pieces, key=lambda p: (repr(p["doc_id"]), p["doc_tokens"], p["start"], p["sequence_id"])), key=lambda p: p["doc_id"]):
        mine = list(mine)
        assert sum(p["length"] for p in mine) == sum(map(len, left[i]))
        if len(left[i]) == 1:
            assert [p["start"] for p in mine] == [0, *itertools.accumulate(p["length"] for p in mine)][:-1]
            assert b"".join(p["ids"] for p in mine) == np.array(left[i][0], "<u4").tobytes()
            assert {p["doc_tokens"] for p in mine} == {len(left[i][0])}
    assert {p["doc_id"] for p in pieces} == set(left)
    lengths = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == lengths.get(p["sequence_id"], 0) and p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
        lengths[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(lengths) == list(range(len(lengths)))
    assert all(n == size or n < size and n & (n - 1) == 0 for n in lengths.values())


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbouring cell


def test_cuts():
    for total in (0, 1, 5, 16, 17, 31, 47, 64):
        whole, tail = packing.cuts(total, 16)
        ends = [*tail[1:], total] if tail else []
        assert whole == total // 16 * 16 and sum(e - b for b, e in zip(tail, ends, strict=True)) == total - whole
        pieces = packing.pieces_of(0, total, total, 16)
        assert sum(p[1] for p in pieces) == total and [p[2] for p in pieces] == list(range(len(pieces)))


def test_ids_equal_the_library():
    rnd = random.Random(2)
    letters = ["a", "B", "é", "é", "́", "İ", "Σ", "ß", "'s", "'", "’", "1", "٣", "中", "。", "🙂", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "\x00", "<|endoftext|>", "<|startoftext|>", "don't", "WE'LL", "x" * 50, "ﬁ", "각", "각"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(600)] + ["", " ", "\n\n"]
    texts += ["中文没有空格。但是有句号，还有１２３和abc。" * 1500, "9a" * 20_000]
    words = packing._words(PATH)
    expected = library_ids(texts)
    for step in (50, 7):  # the second time with what is kept
        got = [raw for at in range(0, len(texts), step) for raw in packing.token_ids(texts[at : at + step], words)]
        for raw, ids in zip(got, expected, strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == ids[:-1]


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = packing.packed(spark.read.parquet(f"{SF}/documents.parquet"), PATH)
    pieces = found.collect()
    check_pieces(pieces, docs)
    total = sum(p["length"] for p in pieces)
    joined = packing.sequences(found).collect()
    assert sum(r["n_ids"] for r in joined) == total and all(r["padding"] == 0 and len(r["ids"]) == 4 * r["n_ids"] for r in joined)
    rows = queries.op12_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows) == sorted((p["doc_id"], p["start"], zlib.crc32(p["ids"])) for p in pieces)


def test_neighbours_are_alike(spark):
    """Documents that share a sequence share a language far more often than any two do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    pieces = sorted(packing.packed(docs, PATH).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
    order = list(dict.fromkeys(p["doc_id"] for p in pieces))
    near = np.mean([lang[a] == lang[b] for a, b in itertools.pairwise(order)])
    any_two = sum(v * v for v in np.unique(list(lang.values()), return_counts=True)[1] / len(lang))
    assert near > any_two + 0.2


def test_odd_rows(spark):
    schema = "doc_id long, text string, key int, n int, ids string, row int"
    rows = [(1, "one two"), (2, None), (3, ""), (None, "no id"), (4, "word " * 30_000), (5, "same"), (5, "same"), (5, "same")] + [(i, "a copy of one text") for i in range(100, 400)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], schema)
    pieces = packing.packed(docs, PATH, size=512).collect()
    check_pieces(pieces, rows, 512)
    assert packing.packed(docs.limit(0), PATH).collect() == []
    check_pieces(packing.packed(docs.where("doc_id = 2"), PATH).collect(), [(2, None)])
