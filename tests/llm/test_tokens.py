"""Operators 1 and 3, against the tokenizer itself."""

import io
import struct
import zlib
from collections import defaultdict

import pytest
from lectern.llm.packing import CLOSING, TIERS, pack_block, pack_documents, step_groups
from lectern.llm.queries import word_bpe
from lectern.llm.token_files import FileReader, FileWriter, fetch_documents, read_token_files, write_token_files
from lectern.llm.tokenizing import WordEncoder

pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_words_encode_like_texts(plain):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = WordEncoder(word_bpe(), remembered=50)
    parts = st.sampled_from([*"aAé ÉßÀÿ×÷\n\t'st12.,!0", "'ll", "\x1c", "́", "İ", "Σ", "漢", "\U0001f600", "<|endoftext|>", "</w>", "\x85", "ﬁ", "가", "ᆨ", "J̌"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(parts, max_size=40).map("".join) | st.text(max_size=40))
    def same(text):
        try:
            data = text.encode()
        except UnicodeEncodeError:
            return
        assert encoder.encode([data])[0] == packed(plain(text))

    same()


def ids_of(rows, plain, end):
    return [(r.doc_id, [*plain(r.text), end]) for r in rows]


@pytest.mark.parametrize("table", ["small", "edges", "nothing"])
def test_token_files(request, table, plain):
    docs = request.getfixturevalue(table)
    files = write_token_files(docs, word_bpe(), end_id=1, frame_ids=500)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(files).collect())
    start, want = 0, []
    for doc_id, ids in sorted(ids_of(docs.collect(), plain, 1)):
        want.append((start, doc_id, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert got == want


def test_fetch_reads_only_wanted(small, plain, spark):
    files = write_token_files(small.select("doc_id", "text", small.text.alias("path")), word_bpe(), end_id=1)
    wanted = spark.createDataFrame([(3,), (17,), (10**9,)], "doc_id long")
    got = {r.doc_id: r.ids for r in fetch_documents(files, wanted).collect()}
    texts = {r.doc_id: r.text for r in small.collect()}
    assert got == {k: [*plain(texts[k]), 1] for k in (3, 17)}


def test_damage_is_found():
    out = io.BytesIO()
    writer = FileWriter(out, frame_ids=4)
    for k in range(6):
        writer.add(k, packed([k] * 3))
    writer.close()
    data = bytearray(out.getvalue())
    reader = FileReader(io.BytesIO(bytes(data)))
    assert [d[0] for d in reader.documents] == [*range(6)] and len(reader._frames) == 3
    assert list(reader.ids([4]))[0] == (4, packed([4] * 3))
    import zstandard

    stream = zstandard.ZstdDecompressor().decompressobj()
    assert stream.decompress(bytes(data[: reader._frames[0][1]])) == packed([0] * 3 + [1] * 3)
    reader._frames[1] = (*reader._frames[1][:3], 7)
    with pytest.raises(ValueError):
        reader.frame(1)
    with pytest.raises(ValueError):
        FileReader(io.BytesIO(b"short"))


@pytest.mark.parametrize("table", ["small", "edges", "nothing"])
def test_packing(request, table, plain):
    docs = request.getfixturevalue(table)
    rows = pack_documents(docs, word_bpe(), end_id=2, block_ids=3000).collect()
    left = defaultdict(int)
    for _, ids in ids_of(docs.collect(), plain, 2):
        left[tuple(ids)] += 1
    ids = {d: i for d, i in ids_of(docs.collect(), plain, 2)}
    n = defaultdict(int)
    for d, _ in ids_of(docs.collect(), plain, 2):
        n[d] += 1
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(packed(ids[r.doc_id][r.start : r.start + r.length]))
        covered[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    assert {d: sorted(c) for d, c in covered.items()} == {d: sorted([*range(len(i))] * n[d]) for d, i in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at == tier and tier in (*TIERS, *CLOSING)


def test_a_block_is_packed_by_tiers():
    windows, left = pack_block([5000, 600, 300, 212, 100, 3000], [], last=False)
    assert not left or sum(p[0] for p in left) < 4096
    assert (4096, [(4096, 0, 0, 0)]) in windows
    for tier, pieces in windows:
        assert sum(p[0] for p in pieces) == tier


def test_step_groups_balance():
    sizes = [4096] * 10 + [1024] * 40 + [512] * 80
    groups = step_groups(sizes, step_ids=30_000)
    cost = defaultdict(float)
    for n, g in zip(sizes, groups, strict=True):
        cost[g] += n + n * n / 4096
    assert max(cost.values()) < 1.1 * min(cost.values())


def test_special_tokens_as_the_library_reads_them():
    from lectern.llm.tokenizing import encoder
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    for text in ("a <|endoftext|> b", "Xx<|startoftext|>Yy, <|ENDOFTEXT|>.", "<|endoftext|><|endoftext|>!", "É<|endoftext|> A", "<| A |>", "Plain TEXT."):
        assert encoder(word_bpe()).encode([text.encode()])[0] == packed(t.encode(text, add_special_tokens=False).ids), text
