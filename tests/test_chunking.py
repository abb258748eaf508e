import pytest

from folioforge.operators import chunking

SCHEMA = "document_id string, block_index int, block_id string, text string, heading_path array<string>, page int"


def words(n, p="w"):
    return " ".join(f"{p}{i}" for i in range(n))


def chunk(spark, rows, *sizes):
    blocks = spark.createDataFrame([("version-1", i, f"block_{i:06d}", t, h, p) for i, (t, h, p) in enumerate(rows)], SCHEMA)
    return chunking.chunks(blocks, "document_id", *sizes).orderBy("ordinal").collect()


def test_sizes_ids_and_overlap_start(spark):
    got = chunk(spark, [(words(460, "a"), ["A"], None), (words(460, "b"), ["B"], None)], 320, 380, 40)
    assert len(got) >= 3 and all(r.word_count <= 380 for r in got)
    assert got[0].chunk_id == "version-1:000000" and got[1].source_spans[0].start_word == 340


def test_overlap_shares_words(spark):
    got = chunk(spark, [(words(150, "a"), ["A"], None), (words(150, "b"), ["A"], None)], 120, 120, 20)
    assert got[0].text.split()[-20:] == got[1].text.split()[:20] and got[1].source_spans[0].start_word == 100


def test_spans_over_blocks(spark):
    got = chunk(spark, [("하나 둘", ["A"], None), ("셋 넷 다섯 여섯", ["A"], None)], 4, 4, 1)
    assert [(s.block_index, s.start_offset, s.end_offset, s.start_word, s.end_word) for s in got[0].source_spans] == [(0, 0, 4, 0, 2), (1, 0, 3, 0, 2)]
    assert (got[1].block_start, got[1].source_spans[0].start_word) == (1, 1)


def test_empty_and_bad_options(spark):
    assert chunk(spark, [("", ["A"], None)]) == []
    with pytest.raises(ValueError, match="overlap"):
        chunk(spark, [("a", ["A"], None)], 10, 20, 10)
    with pytest.raises(ValueError, match="exceed"):
        chunk(spark, [("a", ["A"], None)], 30, 20, 10)


def test_pages_and_headings_end_chunks(spark):
    pages = chunk(spark, [(words(80), ["A"], 1), (words(80), ["A"], 2)])
    assert [r.location.page for r in pages] == [1, 2]
    got = chunk(spark, [("Title", ["T"], None), ("intro text", ["T"], None), ("Part", ["T", "P"], None), ("a | b", ["T", "P"], None)])
    assert [r.block_start for r in got] == [0, 2] and [r.focus_block for r in got] == [0, 2]


def test_sentence_ends_first(spark):
    text = " ".join(f"w{i}" + ("." if i in (9, 12) else "") for i in range(40))
    got = chunk(spark, [(text, [], None)], 8, 16, 0)
    assert got[0].word_count == 10
    assert sum(r.word_count for r in got) == 40


def test_batches(spark):
    rows = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate((5, 5, 5, 20, 1, 1))], "document_id string, ordinal int, text string")
    got = [r.batch for r in chunking.batches(rows, "document_id", "ordinal", most=2, chars=12).orderBy("ordinal").collect()]
    assert got == [0, 0, 1, 2, 3, 3]
