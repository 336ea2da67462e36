import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from basewright.llm import huffman
from basewright.llm.subwords import WordCoder, tokenizer_path
from basewright.llm.token_files import read_token_files, write_token_files

ODD = [
    "", "don't I'LL we've 'S 'sx it's", "a\x1cb\xa0c d é é É ÀÉ Straße İx ΣΑΣ ΑΣ", "<|endoftext|>x <|startoftext|>", "日本語 テスト 12３ ½ ٣",
    "a__b_c 1a2b ¿que? «x»…", "x'''s ''re '' 'll'll", "😀👍🏽 é́", " ª º µ ÿß÷×", "Ä a ̈b", "\n\t \r", "x" * 5000, "word " * 40000,
]


def test_word_coder_equals_whole_texts():
    words, whole = WordCoder(tokenizer_path(), keep=3), Tokenizer.from_file(tokenizer_path())
    for text in ODD + ODD:
        assert words.encode(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (300, 9), (5000, 16), (40000, 16)])
def test_code_lengths_and_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(49408, np.int64)
    counts[rng.choice(49408, n, False)] = (rng.pareto(0.5, n) * 5).astype(np.int64).clip(1, 10**12)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(int)
    assert used.min() >= 1 and used.max() <= limit and (n == 1 or (2.0 ** -used).sum() == 1)
    ids = rng.choice(np.flatnonzero(counts), 70_001).astype("<u2")
    blocks = [huffman.encode_block(x, huffman.canonical_codes(lengths), lengths.astype(np.int64)) for x in np.split(ids, [65536])]
    assert np.array_equal(huffman.Decoder(lengths, limit).blocks(blocks), ids)


def test_lengths_are_optimal_without_a_limit_in_the_way():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1, 1, 1])
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((counts * huffman.code_lengths(counts, 16)).sum()) == total


def test_files_round_trip(spark, tmp_path):
    texts = [*ODD, None, "same", "same"]
    ids = [*range(len(texts) - 3, 0, -1), 500, 77, 77, None]
    rows = list(zip(ids, [*texts, "null id"], ["x"] * len(ids)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    folder = f"file://{tmp_path}/out"
    write_token_files(docs, folder)
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    whole, at = Tokenizer.from_file(tokenizer_path()), 0
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    for row, (doc, text, _) in zip(got, rows):
        want = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert read_token_files(spark, folder).count() == 0


def test_batches_equal_single_texts():
    words, whole = WordCoder(tokenizer_path(), keep=50), Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, "", " ", "\x1f a\x0b", "<|ENDOFTEXT|> Foo <|endoftext|>Bar", "Foo bar, foo BAR\x85", "x\x00y \x00"]
    for batch in (texts, texts[::-1], ["\t"], [""]):
        want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in batch]
        assert [ids.tolist() for ids in words.encode_all(pa.array(batch))] == want
    assert words.encode_all(pa.array([], pa.string())) == []
