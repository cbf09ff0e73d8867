import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm.common import kept
from siftline.llm.hashing import flat
from siftline.llm.token_files import Pieces, TokenFile, cuts, encode_levels, file_chunks, splits, token_table, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n", "a", " a", "a ", "Don't  stop\t\tnow \n x", "naïve café — déjà vu", "x\x1cy\x85 z", "a\xa0 \n b  c",
    "<|endoftext|> inside <| ok", "日本語　テキスト です", "é​  t", "1 2  3   4\r\n5", "!!  ??' 's 'll", "word " * 3000, "﻿x y", "tail   ", "a\n \n\tb",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def corpus():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("ab .,'\n\t\xa0é1\x1c!", k=rng.randrange(60))) for _ in range(300)]
    rows = [(i * 7 % 331, t) for i, t in enumerate(texts)]
    return rows + [(None, "null id"), rows[7], (3, "same id, other text")]


def test_files_hold_what_the_library_says(spark):
    rows, t = corpus(), library()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "2 as start", "3 as uri").repartition(5)
    want = {(d, text): [*t.encode(text or "", add_special_tokens=False).ids, 0] for d, text in rows}
    got = token_table(frame, tokenizer=PATH, file_tokens=700).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        crcs = {zlib.crc32(np.array(ids, "<u4").tobytes()): len(ids) for (d, _), ids in want.items() if d == r.doc_id}
        assert crcs.get(r.ids_crc32) == r.n_tokens


def test_random_access(spark):
    frame = spark.createDataFrame([(0, "Don't stop now, naïve café"), (1, None), (2, "word " * 2000)], "doc_id long, text string")
    manifest = write_tokens(frame, tokenizer=PATH, end=50256).collect()
    for row in manifest:
        f = TokenFile(row.uri)
        ids = f.ids()
        assert len(f) == row.n_tokens == len(ids)
        assert [f[i] for i in range(len(f))] == ids.tolist()


def test_levels():
    for ids in ([], [0], [255, 256, 65535, 65536, 1 << 24, 3, (1 << 32) - 1], list(range(0, 200_000, 37))):
        x = np.array(ids, np.uint32)
        levels = encode_levels(x)
        assert sum(len(c) for c, _, _ in levels) == sum(max(1, -(-int(v).bit_length() // 8)) for v in ids)
        raw = b"".join(file_chunks([1, None], [x, x[:1]]))
        import tempfile

        with tempfile.NamedTemporaryFile() as out:
            out.write(raw)
            out.flush()
            f = TokenFile(out.name)
            assert f.ids().tolist() == ids + ids[:1]
            assert [f[i] for i in range(0, len(f), 7)] == (ids + ids[:1])[::7]


def test_empty(spark):
    assert token_table(spark.createDataFrame([], "doc_id long, text string"), tokenizer=PATH).collect() == []


def encoded(pieces, texts):
    return [x.tolist() for x in pieces.encode(pa.array(texts, pa.string()))]


def test_a_small_table_changes_nothing():
    rng, t = random.Random(8), library()
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    texts = [rng.choice([" ", "　", "\n"]).join(han(rng.choice([1, 3, 200])) for _ in range(20)) for _ in range(200)]
    texts += [" ".join(rng.choice(["the", "of", "on", "é" * rng.randrange(9), "x" * rng.randrange(30), "a\0b"]) for _ in range(50)) for _ in range(200)]
    rng.shuffle(texts)
    for places in (1, 16, 1 << 12):
        pieces = Pieces(PATH, places=places)
        size = sum(x.nbytes for x in (pieces.low, pieces.high, pieces.size, pieces.worth, pieces.ids))
        assert pieces.splits and size <= 45 * places
        for a in range(0, len(texts), 40):
            assert encoded(pieces, texts[a : a + 40]) == [t.encode(x, add_special_tokens=False).ids for x in texts[a : a + 40]]
    again = [texts[0], "a b a", "", "a b", texts[0]]
    for _ in range(3):
        assert encoded(pieces, again) == [t.encode(x, add_special_tokens=False).ids for x in again]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x00\x1c\x85\xa0\u2003\u3000\u1680'<|>ab.1é日"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_text_as_the_library_has_it(texts):
    held = kept("test-pieces", lambda: (Pieces(PATH, places=256), library()))
    assert encoded(held[0], texts) == [held[1].encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_begin_where_blanks_follow_other_characters():
    texts = ["", "a b  c ", " x\ty", "", "a\xa0b c"]
    data, offsets = flat(pa.array(texts))
    at = np.append(cuts(data, offsets), len(data))
    assert [bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:])] == ["a", " b", "  c", " ", " x", "\ty", "a\xa0b c"]


def test_a_tokenizer_of_another_kind_gets_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert not splits(path)
    rows = [(i, x) for i, x in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in token_table(frame, tokenizer=path, end=None).collect()}
    assert got == {i: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, x in rows}
