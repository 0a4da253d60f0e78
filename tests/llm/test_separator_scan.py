"""Separator scan against a sequential reading of the same files."""

from collections import Counter
from glob import glob

import numpy as np
import pytest

import public_tokenizers
from quillgraph.llm import registry
from quillgraph.llm.separator_scan import scan_separators, write_token_files

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def lengths_of(ids, end_id):
    rows, start = [], 0
    for at in np.flatnonzero(ids == end_id).tolist():
        rows.append((len(rows), start, at - start, True))
        start = at + 1
    if start < len(ids):
        rows.append((len(rows), start, len(ids) - start, False))
    return rows


def test_counts_equal_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    expected = Counter(len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False))
    rows = registry.op1_separator_scan(spark, SF).collect()
    assert Counter(r["n_tokens"] for r in rows) == expected
    assert all(r["closed"] for r in rows)
    assert len({(r["file_no"], r["doc_no"]) for r in rows}) == len(texts)


@pytest.mark.parametrize("width", [2, 4])
def test_blocks_are_stitched(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    streams = {
        "many": rng.integers(0, 4, 5000),
        "none": np.full(300, 9),
        "only": np.zeros(70, int),
        "open": np.append(rng.integers(0, 300, 2000), 5),
        "one": np.array([0]),
    }
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(ids.astype(f"<u{width}").tobytes())
    (tmp_path / "empty").write_bytes(b"")
    made = scan_separators(spark, str(tmp_path), 0, width, block_bytes=64).collect()
    for name, ids in streams.items():
        own = sorted((r["doc_no"], r["start"], r["n_tokens"], r["closed"]) for r in made if r["file"].endswith(f"/{name}"))
        assert own == lengths_of(ids, 0)
    assert not [r for r in made if r["file"].endswith("/empty")]


def test_written_files_hold_the_ids(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "the of \n"), (3, "the of \n"), (None, "é" * 5)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)
    write_token_files(docs, BYTES, 50256, f"{tmp_path}/t")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    expected = [i for _, t in texts for i in [*tokenizer.encode(t or "").ids, 50256]]
    assert np.frombuffer(open(glob(f"{tmp_path}/t/part-*")[0], "rb").read(), "<u2").tolist() == expected
    with pytest.raises(Exception, match="too wide"):
        write_token_files(docs, BYTES, 200, f"{tmp_path}/u", width=1)


def test_half_ids_are_refused(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole ids"):
        scan_separators(spark, str(tmp_path), 0).collect()
