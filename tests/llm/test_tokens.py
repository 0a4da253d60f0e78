"""Tokenizer operators against the libraries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from quillgraph.llm import bin_slack, registry
from quillgraph.llm.piece_bpe import encode_documents, piece_encoder
from quillgraph.llm.tokens import segment_ids

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
MIXED = st.text(st.sampled_from(list("  \n\taThe.ing▁é世\x85\xa0 \r\x1c'sl!<>/0")), max_size=40) | st.text(max_size=30)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=200, deadline=None)
@given(MIXED)
def test_pieces_equal_library(text):
    import sentencepiece

    library = test_pieces_equal_library.__dict__.setdefault(
        "library", sentencepiece.SentencePieceProcessor(model_file=PIECES)
    )
    ids, decoded = piece_encoder(PIECES).round_trip(text)
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert decoded == library.decode(ids.tolist())


def test_pieces_of_long_runs(library):
    for text in (" " * 77, "a" * 500, "ab" * 300, "\n" * 40, "=" * 200, "tion" * 100, "  the" * 50):
        ids, decoded = piece_encoder(PIECES).round_trip(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert decoded == library.decode(ids.tolist())


@settings(max_examples=200, deadline=None)
@given(MIXED)
def test_segments_equal_whole_text(text):
    from tokenizers import Tokenizer

    whole = test_segments_equal_whole_text.__dict__.setdefault("whole", Tokenizer.from_file(BYTES))
    whole.encode_special_tokens = True
    assert segment_ids(BYTES).encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("  \n\t\rThe.in's é1²ª<|>")), max_size=60))
def test_plain_texts_equal_library(text):
    from tokenizers import Tokenizer

    whole = test_plain_texts_equal_library.__dict__.setdefault("whole", Tokenizer.from_file(BYTES))
    assert segment_ids(BYTES).encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_not_remembered():
    from tokenizers import Tokenizer

    from quillgraph.llm.tokens import WHOLE_CHARS, SegmentIds

    encoder, whole = SegmentIds(BYTES), Tokenizer.from_file(BYTES)
    texts = ["It's a plain text,\n with   white space\t\tand 12 cafés. ", "", "\n \n", "東京 is 'not' plain", "a <|endoftext|> b", " " * WHOLE_CHARS + "long"]
    made = encoder.encode(texts[:3])
    assert not encoder.known
    made += encoder.encode(texts[3:])
    assert [ids.tolist() for ids in made] == [whole.encode(text, add_special_tokens=False).ids for text in texts]


def test_piece_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    made = registry.op8_piece_backtracking(spark, SF).toPandas().set_index("doc_id")
    assert len(made) == len(docs)
    for doc_id, text in docs.items():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = made.loc[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_piece_edge_cases(spark):
    rows = [(1, None, 5), (1, "", 6), (None, " the ", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    made = encode_documents(docs, PIECES).collect()
    assert sorted(r["decoded"] for r in made) == ["", "", " the "]
    assert [r["ids"] for r in made if not r["decoded"]] == [[1, 2], [1, 2]]
    assert encode_documents(docs.limit(0), PIECES).count() == 0


def packed_equals(docs, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // capacity)
        at = 0
        for r in own:
            assert r["start"] == at
            part = np.asarray(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // capacity)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"].to_dict()
    bins, least = packed_equals(docs, registry.op10_bin_slack_packing(spark, SF).collect(), 2048)
    assert bins <= least + 1


def test_packing_edge_cases(spark):
    texts = {1: None, 2: "", 3: "a b " * 30, 4: "the " * 8, 5: "the " * 8, 6: "x"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id int, text string, length int")
    rows = bin_slack.pack(docs.repartition(3), BYTES, capacity=16).collect()
    packed_equals(texts, rows, 16)
    assert bin_slack.pack(docs.limit(0), BYTES).count() == 0
    twice = bin_slack.pack(docs.union(docs), BYTES, capacity=16).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in twice) == Counter((r["doc_id"], r["piece"]) for r in rows * 2)


def test_fullest_combination_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = 40
        counts = np.zeros(capacity + 1, np.int64)
        for length in rng.integers(1, capacity, 6):
            counts[length] += rng.integers(1, 3)
        first = int(np.flatnonzero(counts)[-1])
        sums = {0}
        items = [length for length in range(1, capacity + 1) for _ in range(counts[length] - (length == first))]
        for item in items:
            sums |= {s + item for s in sums if s + item <= capacity - first}
        chosen = bin_slack.fullest(counts, first, capacity)
        assert sum(k * n for k, n in chosen.items()) == first + max(sums)
        assert all(n <= counts[k] for k, n in chosen.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "a", "b_", " ", "  ", "\n", "é", "'s", "<", "12", "世", "endoftext"]), max_size=14))
def test_special_token_strings_as_in_the_library(parts):
    from tokenizers import Tokenizer

    text = "".join(parts)
    loaded = test_special_token_strings_as_in_the_library.__dict__
    for name in ("default", "plain"):
        if name not in loaded:
            loaded[name] = Tokenizer.from_file(BYTES)
    default, plain = loaded["default"], loaded["plain"]
    plain.encode_special_tokens = True
    assert segment_ids(BYTES).encode([text])[0].tolist() == default.encode(text, add_special_tokens=False).ids
    made = segment_ids(BYTES, plain_specials=True).encode([text])[0].tolist()
    assert made == plain.encode(text, add_special_tokens=False).ids


def test_packing_keeps_special_tokens(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id int, text string")
    (row,) = bin_slack.pack(docs, BYTES).collect()
    assert (row["length"], row["ids_crc32"]) == (4, zlib.crc32(np.asarray([64, 50256, 65, 0], "<u4").tobytes()))


def test_token_files_hold_special_strings_as_text(spark, tmp_path):
    from quillgraph.llm.separator_scan import scan_separators, write_token_files

    docs = spark.createDataFrame([("a<|endoftext|>b",)], "text string")
    write_token_files(docs, BYTES, 50256, f"{tmp_path}/ids")
    assert [r["n_tokens"] for r in scan_separators(spark, f"{tmp_path}/ids", 50256).collect()] == [9]
