import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lavrado.llm import tiktoken_codec

from . import cases


def test_one_row_of_repeated_rows_is_kept_whole(spark, sf_dir, tmp_path):
    words = lambda k: " ".join(f"word{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, words(0)), (1, words(0)), (None, words(1)), (None, words(1)), (7, words(2)), (None, words(2)), (5, words(2)), (9, words(3)), (9, words(4)), (None, words(5) + " end"), (None, words(5))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.near_copies(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text.removesuffix(" end")) for r in kept) == sorted([(1, words(0)), (0, words(1)), (5, words(2)), (9, words(3)), (9, words(4)), (0, words(5))])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 1, 5, 9, 9]
    codec = tiktoken_codec.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(r.n_tokens for r in out) == sorted(len(codec.encode_ordinary(r.text)) for r in kept)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    have = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        found = {r.doc_id: r.text for r in out.collect()}
        if name == "language":
            assert found == {i: t for i, t in have.items() if any(c.isalpha() for c in t or "")}
        if name == "near_dedup":
            keep = {r[0] for r in cases.near(list(have.items()), 5) if r[3]}
            assert found == {i: have[i] for i in keep}
        if name == "suffix_dedup":
            assert found.keys() == have.keys()
            gone = {r[0]: r[2] for r in cases.cut_repeats(list(have.items()), 200)}
            assert all(0 <= len(have[i].encode()) - gone[i] - len(found[i].encode()) <= 6 * max(1, gone[i] // 200) for i in have)
        if name == "decontaminate":
            assert found == {i: have[i] for i, *_, bad in cases.contaminated(list(have.items()), items) if not bad}
        have = found
        docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in have.items()], docs.schema)
    codec = tiktoken_codec.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens) for r in last} == {(i, len(codec.encode_ordinary(t))) for i, t in have.items()}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)


def odd(spark):
    """Rows with nulls, repeats and ties, and columns of names that operators use inside."""
    names = "lang_pred, score, ambiguous, row, _row, own, spans, items, digest, _cut, cut, n_words, contamination, key, node, component_id, kept, ids".split(", ")
    prose = lambda k: " ".join(f"{w}{k}{i % 7}x{i}" for i, w in enumerate(["der", "wald", "river", "stone"] * 20))
    texts = [None, "", " ", "½", "a", prose(0), prose(0), prose(1), prose(1) + " end", prose(2), "…" * 300, "word " * 60, "word " * 61]
    rows = [(None if k % 4 == 3 else k // 2, t, ("en", None)[k % 2], None, None, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:7], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))


def test_stages_of_odd_rows(spark, sf_dir):
    docs = odd(spark).cache()
    n = len(odd(spark).columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert all(len(r) == n and r["own"].startswith("own") and r["_row"] == r["own"].replace("own", "_row") for r in rows)
        kept = sorted((r.text or "") for r in rows)
        if name == "language":
            assert kept == sorted(t for (t,) in docs.select("text").collect() if any(c.isalpha() for c in t or ""))
        if name == "near_dedup":
            assert len(kept) == len({t for t in kept if t.strip()}) + sum(not t.strip() for t in kept) and len(rows) == 10
        if name == "suffix_dedup":
            assert len(rows) == docs.count() and sum(r.text is None for r in rows) == 1 and all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in rows)
        if name == "decontaminate":
            assert len(rows) == docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    out = last(spark, docs, sf_dir).collect()
    assert len(out) == docs.count() and all(len(r.ids) == 4 * r.n_tokens for r in out) and last(spark, docs.limit(0), sf_dir).count() == 0


def test_a_corpus_without_languages_is_kept(spark, sf_dir):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.languages(spark, docs, sf_dir)
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
