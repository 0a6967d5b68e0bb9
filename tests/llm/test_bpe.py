import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridsift.llm import bpe, pieces
from gridsift.llm.q_bpe import op7_bpe_automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "  a  b\n\n c", "aaa aaaa aaaaa", "it's <|endoftext|> x<|endoftext|>", "日本語 😀 ١٢٣ ½", "\x00\t\x0b\x1c zz　x", "hello" * 4000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(library, sf):
    texts = [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()] + ODD[1:]
    c = bpe.codec(PATH)
    for t in texts:
        ids = c.encode(t)
        assert list(memoryview(ids).cast("I")) == library.encode(t, add_special_tokens=False).ids
        assert c.decode(ids) == library.decode(list(memoryview(ids).cast("I")), skip_special_tokens=False)


def test_broken_utf8_decodes_as_in_the_library(library):
    c = bpe.codec(PATH)
    ids = library.encode("é😀", add_special_tokens=False).ids[:-1]
    assert c.decode(b"".join(i.to_bytes(4, "little") for i in ids)) == library.decode(ids, skip_special_tokens=False)


def test_nulls_repeats_extra_columns_and_empty_tables(spark, library):
    rows = [(i % 5 if i else None, t, "clash") for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert bpe.round_trip(df, PATH).select(*bpe.decode(bpe.encode(df, PATH), PATH).columns).collect() == back
    assert len(back) == len(rows) and all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_rows_of_the_query(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7_bpe_automaton(spark, sf).collect()}
    want = {}
    for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert got == want


def test_small_tables_and_parts_give_the_same_ids(library, monkeypatch):
    rng = random.Random(5)
    parts = ["a", "b", "the", " ", " ", "\n", "\t", " ", ".", ",", "'", "'s", "1", "é", "中", " ", "’", "!", "-", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 40))) for _ in range(3000)), "x" * 70000 + " y", "\n" * 5000, "".join(rng.choices("ab", k=3000))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(pieces, "SLICE", 64)
    monkeypatch.setattr(pieces, "PART_BYTES", 1000)
    monkeypatch.setattr(bpe, "WORDS", 50)
    c = bpe.Codec(PATH)
    c.pieces = pieces.PieceTable(c._learn, c._with_special, list(c.special), entries=256)
    assert [list(memoryview(c.encode(t)).cast("I")) for t in texts] == want
    assert c.pieces.n <= 256


@pytest.mark.parametrize("segment,segments,warm", [(384, 512, 128), (64, 3, 20), (70, 5, 2), (64, 4, 0)])
def test_long_unbroken_words(library, monkeypatch, segment, segments, warm):
    rng = random.Random(9)
    n = 60_000 if segment == 384 else 4000
    texts = ["".join(rng.choices(x, k=n)) for x in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "éèà", "ABCxyz019+/", ["the", "tion", "ing", "national", "er"])]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n)), " " * n, "-" * n, "=-" * n, "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "-" * segment, "a" * (segment + 1)]
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    monkeypatch.setattr(bpe, "SEGMENTS", segments)
    monkeypatch.setattr(bpe, "WARM", warm)
    redone = []
    go_on = bpe.Automaton._go_on
    monkeypatch.setattr(bpe.Automaton, "_go_on", lambda self, *x: redone.append(1) or go_on(self, *x))
    c = bpe.Codec(PATH)
    for t in texts:
        ids = c.encode(t)
        assert list(memoryview(ids).cast("I")) == library.encode(t, add_special_tokens=False).ids
        assert c.decode(ids) == t
    assert bool(redone) == (warm < 100)


def test_a_long_word_takes_bounded_memory():
    c, word = bpe.Codec(PATH), "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=1_500_000))
    c.encode("warm up")
    tracemalloc.start()
    assert len(c.encode(word)) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # was some 400 bytes for each byte of the word
