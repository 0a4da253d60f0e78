"""Chat formatting, line rules, language and toxicity: edge cases, held-out accuracy, oracles."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import chat_format, hyperdim, line_rules, pu_toxicity, registry

SF = "/root/testdata/sf0.01"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(frame, columns):
    return sorted(([str(r[c]) for c in columns] for r in frame), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    made = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(made.columns)
    expected = con.sql(registry.SQL[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert rows_of(made.collect(), columns) == sorted(([str(r[p]) for p in places] for r in expected.fetchall()), key=str)


def test_escape_is_reversible(spark):
    alphabet = list("<[|\\/sINST]SY>x ") + ["<|", "|>", "[INST]", "</s>", "<<SYS>>", chat_format.END]
    texts = []

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(alphabet), max_size=12))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    made = frame.select("t", chat_format.escape(frame.t).alias("e"), chat_format.unescape(chat_format.escape(frame.t)).alias("u"))
    for r in made.collect():
        assert r["u"] == r["t"]
        assert not any(s in r["e"] for s in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_chat_edge_cases(spark):
    rows = [
        (1, 1, "user", "q"), (1, 2, "assistant", "a<|end|>"), (1, 3, "user", None), (2, None, None, "x"), (2, 0, "assistant", ""),
        (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 5, "system", "s"),
    ]
    given_rows = spark.createDataFrame([(*r, "z") for r in rows], "conv_id int, turn int, role string, text string, example string")
    examples = chat_format.prefix_examples(given_rows)
    made = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    assert {k: r["n_turns"] for k, r in made.items()} == {1: 3, 2: 2, 3: 3, None: 1}
    assert made[1]["turns_sha256"] == digest("user\nq\nassistant\na<|end|>\nuser\n\n")
    assert made[1]["loss_sha256"] == digest("a<|end|>") and made[1]["loss_chars"] == 8
    assert made[2]["turns_sha256"] == digest("\nx\nassistant\n\n") and made[2]["loss_chars"] == 0
    assert made[3]["loss_sha256"] == digest("aab")
    assert examples.filter("conv_id = 1").count() == 2 and examples.filter("conv_id = 3").count() == 3
    assert chat_format.read_back(chat_format.prefix_examples(given_rows.limit(0))).count() == 0


def test_line_edge_cases(spark):
    sentence = "This is a line of ten words that ends here."
    menu = "Home | News | Sport | About | Contact"
    texts = [
        (1, None), (2, ""), (3, " \n\t\n"), (4, f"{sentence}\n{menu}\nAll rights reserved.\nAnother one follows after it, with nothing in common but its length."),
        (5, "\n".join([menu] * 9 + [sentence])), (6, f"{sentence}\n{sentence}"), (6, f"{sentence}\n{sentence}"), (None, "word " * 400 + "."),
    ]
    frame = spark.createDataFrame([(*t, [1]) for t in texts], "doc_id int, text string, words array<int>")
    made = [r.asDict() for r in line_rules.clean_lines(frame.repartition(2)).collect()]
    assert len(made) == len(texts)
    by_id = {r["doc_id"]: r for r in made}
    assert all(by_id[i]["base_failed"] and not by_id[i]["kept"] for i in (1, 2, 3))
    assert by_id[4]["kept"] and by_id[4]["text"] == f"{sentence}\nAnother one follows after it, with nothing in common but its length." and by_id[4]["n_failed_lines"] == 2
    assert not by_id[5]["kept"]
    assert by_id[6]["n_dup_lines"] == 1 and by_id[6]["n_repeat_words"] == 20 and by_id[6]["base_failed"]
    assert by_id[None]["n_repeat_words"] == 400
    assert line_rules.clean_lines(frame.limit(0)).count() == 0


def test_line_verdicts_follow_quality(spark):
    made = registry.op4_line_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = made[(made.quality == 1) & ~made.base_failed], made[made.quality == 0]
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.05


def test_language_held_out(spark):
    made = registry.op5_hyperdim_language(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = made.merge(docs, on="doc_id")
    assert len(both) == len(docs) and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_bundle_equals_plain_sum(monkeypatch):
    monkeypatch.setattr(hyperdim, "CHUNK_CHARS", 7)
    own = hyperdim.Profiler(256, 3, 1)
    text = "Ab, cde!!  Ünd so 12 weiter — 世界"
    plain = np.zeros(256)
    symbols = "".join(c if c.isalpha() else " " for c in text.lower())
    symbols = " " + " ".join(symbols.split()) + " "
    for i in range(len(symbols) - 2):
        codes = tuple(0 if c == " " else ord(c) for c in symbols[i : i + 3])
        plain += own._gram(codes)
    made = own.bundle([text, "", "12"])
    assert np.allclose(made[0], plain / np.linalg.norm(plain), atol=1e-6)
    assert not made[1:].any()


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (None, "the dog", "en"), (4, "the end", None)]
    train = spark.createDataFrame([(*r, 0) for r in rows], "doc_id int, text string, lang string, score int")
    prototypes = hyperdim.learn_prototypes(train)
    assert sorted(prototypes) == ["de", "en"]
    asked = spark.createDataFrame([(1, "the cat"), (1, "die katze"), (2, None), (3, ""), (None, "12 !"), (5, "ж")], "doc_id int, text string")
    made = [(r["doc_id"], r["lang_pred"]) for r in hyperdim.identify(asked, prototypes).collect()]
    assert sorted(made[:5], key=str) == sorted([(1, "en"), (1, "de"), (2, "und"), (3, "und"), (None, "und")], key=str)
    assert {r["lang_pred"] for r in hyperdim.identify(asked, {}).collect()} == {"und"}
    assert hyperdim.identify(asked.limit(0), prototypes).count() == 0
    assert hyperdim.learn_prototypes(train.limit(0)) == {}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    made = registry.op7_pu_toxicity(spark, sf).toPandas()
    both = made.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.predicted == 1).sum() > 0.9 and hit / (held.toxic == 1).sum() > 0.7
    assert len(made) == 10_000 and made.score.between(0, 1).all()


def test_risk_is_not_fitted_below_zero():
    rng = np.random.default_rng(1)
    rows = [np.array([1, *rng.integers(100, 5000, 20)]) if i < 60 else rng.integers(100, 5000, 20) for i in range(600)]
    positive = np.arange(600) < 30
    distinct = [np.unique(r) for r in rows]
    weights, bias = pu_toxicity.train(np.concatenate(distinct), np.array([len(r) for r in distinct]), positive, 0.1)
    scores = np.array([weights[np.unique(r)].sum() + bias for r in rows])
    assert (scores[:60] > 0).all() and (scores[60:] > 0).mean() < 0.02


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "bad idiot"), (1, "bad idiot"), (2, None), (3, ""), (None, "idiot"), (4, "fine")], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1), (4, 0)], "doc_id int, toxic int")
    made = pu_toxicity.score(docs.withColumn("label", docs.doc_id), pu_toxicity.learn(docs, labels)).collect()
    assert len(made) == 6 and all(0 <= r["score"] <= 1 for r in made)
    none = pu_toxicity.learn(docs.limit(0), labels.limit(0))
    assert {round(r["score"], 6) for r in pu_toxicity.score(docs, none).collect()} == {0.001}
    assert pu_toxicity.score(docs.limit(0), none).count() == 0
