import zlib

import numpy as np
import pytest

from passagemill.llm import packing, token_shards
from passagemill.llm.tokens import SPECIAL, Encoder, vocabulary_paths

ODD = ["", " ", "  ", "a  b", " a", "a ", "it's x\n\n y\t z", "a \n b", "\n", "x  y", "a <|endoftext|> b", "  <|endoftext|>", "😀 é  ü", "a" * 20000, "1 " * 1000 + "2", "\x1c a \x1cb"]


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(plain):
    encoder = Encoder(*vocabulary_paths(), SPECIAL)
    for text, ids in zip(ODD * 2, encoder.encode(ODD * 2), strict=True):
        assert list(ids) == plain(text), text[:40]
    assert len(encoder.encode([None])[0]) == 0


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "x " * 3000), (None, "nobody's")], d.schema)).repartition(5, "doc_id")


def test_packing_round_trip(docs, plain):
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = packing.pack_documents(docs).toPandas()
    assert set(pieces.doc_id.dropna()) | {None} == set(texts)
    pieces["doc_id"] = pieces["doc_id"].fillna(-1)
    for doc, g in pieces.groupby("doc_id"):
        ids = [*plain(texts[None if doc == -1 else doc]), 0]
        g = g.sort_values("start")
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids) == g.doc_tokens.iloc[0]
        for s, n, crc in zip(g.start, g.length, g.ids_crc32, strict=True):
            assert zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == crc
    padding = total = 0
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        n = g.length.sum()
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
        total += n
    assert padding < 0.05 * total


def test_packing_keeps_few_windows_open():
    w = packing.OpenWindows(10, 2)
    assert w.place(6, ["a"]) is None and w.place(7, ["b"]) is None
    assert w.place(3, ["c"]) == [(["b"], 0), (["c"], 7)]  # fills the fullest
    assert w.place(9, ["d"]) is None
    assert w.place(5, ["e"]) == [(["d"], 0)]  # none fits: the fullest is emitted


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).count() == 0
    assert token_shards.write_shards(none, f"file://{tmp_path}/none").count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4099):
        for key in (1, 99):
            assert sorted(token_shards.feistel(np.arange(n), n, key)) == list(range(n))
    assert list(token_shards.feistel(np.arange(1000), 1000, 1)) != list(token_shards.feistel(np.arange(1000), 1000, 2))


def test_shards_round_trip_and_resume(docs, plain, tmp_path):
    folder = f"file://{tmp_path}/shards"
    index = token_shards.write_shards(docs, folder, length=256, shard_numbers=50).toPandas().sort_values("slot")
    assert list(index.slot) == list(range(len(index)))
    read = list(token_shards.read_slots(folder, 0, 256))
    assert [zlib.crc32(x.tobytes()) for x in read] == list(index.ids_crc32)
    assert index.shard.nunique() > 3 and list(index.sequence) != sorted(index.sequence)
    again = list(token_shards.read_slots(folder, 77, 256))
    assert len(again) == len(read) - 77 and all((a == b).all() for a, b in zip(again, read[77:], strict=True))
    kept = [x[:n] for _, x, n in sorted(zip(index.sequence, read, index.n_tokens, strict=True), key=lambda t: t[0])]
    stream = np.concatenate(kept)
    want = sorted(tuple([*plain(r.text), 0]) for r in docs.collect())
    got, run = [], []
    for i in stream:
        run.append(int(i))
        if i == 0:
            got.append(tuple(run))
            run = []
    # id 0 is also a token of texts ("!"), so runs are compared joined
    assert sum(map(len, got)) == sum(map(len, want)) and sorted(x for g in got for x in g) == sorted(x for w in want for x in w)
