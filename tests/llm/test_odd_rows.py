"""Invalid bytes, very long words and clashing names, for every operator and stage that reads texts."""

import os

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import common, decontaminate, linededup, mixing, pii, quality, sharding, simhash, substrings, tokens

NAMES = ("row", "id", "name", "key", "rid", "digest", "group", "node", "runs", "lines", "gone", "kept", "maybe", "__maybe", "__domain", "__epoch", "__tokens", "full", "last_key", "epoch", "slot", "shard", "label", "score", "score_", "n", "h", "words", "spans", "items")


@pytest.fixture(scope="module")
def odd(spark):
    """Invalid bytes at the start, inside and at the end; a word of 3 MB; and columns of all names that operators use."""
    texts = ["encode('good words here and there', 'utf-8')", "concat(unhex('FF'), encode('bad start', 'utf-8'))", "concat(encode('bad ', 'utf-8'), unhex('C328'), encode(' middle', 'utf-8'))", "concat(encode('bad end', 'utf-8'), unhex('E282'))", "encode(repeat('long', 750000), 'utf-8')", "null", "unhex('')"]
    rows = " union all ".join(f"select {i}L doc_id, cast({t} as string) text, 'en' lang, 'src{i}' source" for i, t in enumerate(texts))
    return spark.sql(rows).select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


def test_operators(spark, odd):
    ids = list(range(7))
    bench = spark.sql("select 1L item_id, cast(concat(unhex('FF'), encode('bad start', 'utf-8')) as string) text, 5 words union all select 2, 'middle', 5")
    found = {r.doc_id: r for r in decontaminate.contamination(odd, bench).collect()}
    assert sorted(found) == ids and found[1]["items"] == ["1"] and found[2]["items"] == ["2"] and not found[4].contaminated
    model = quality.fit(odd, spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int"))
    assert sorted(r.doc_id for r in quality.score(odd, model).collect()) == ids
    assert quality.keep_good(odd, model, -1.0).collect() == odd.collect()
    assert sorted(r.doc_id for r in substrings.repeated_words(odd, 2, 1).collect()) == ids
    assert sorted(r.doc_id for r in pii.find_personal_data(odd).collect()) == ids
    assert sorted(r.doc_id for r in simhash.near_duplicates(odd).collect()) == ids
    for kept in (simhash.representatives(odd), simhash.similar_representatives(odd)):
        assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5]  # wordless texts are one group
    mixed = mixing.mix(odd, {}, 2.0, 2, 1, F.lit("d"))
    assert mixed.columns == ["__domain", "__epoch", "__tokens", *(c for c in odd.columns if c not in ("__domain", "__epoch", "__tokens"))]
    # a leaf without a word has no budget
    assert sorted((r.doc_id, r["__epoch"]) for r in mixed.collect()) == [(i, e) for i in range(5) for e in (0, 1)]
    assert sorted(r.doc_id for r in linededup.dedup_lines(odd).collect()) == ids
    assert sorted(r.doc_id for r in sharding.place(odd, ("a", "b")).collect()) == ids
    gone = odd.where("doc_id = 2").select("doc_id", common.digest().alias("digest"))
    left = common.without(odd, gone)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 3, 4, 5, 6]


def test_token_counts(spark, odd):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["good words here and there", "\ufffdbad start", "bad \ufffd( middle", "bad end\ufffd", "long" * 750_000, "", ""]
    expected = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(odd, path).collect()) == expected


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_stages(spark, odd):
    import corpus_pipeline

    more = odd.drop("slot", "shard")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, "/root/testdata/sf0.001")
        assert out.columns == more.columns + ["slot", "shard"] * (name == "sharding")
        assert len(out.collect()) <= 7


def test_tables_are_removed(docs, tmp_path, monkeypatch):
    """An operator leaves the tables that its result reads, and no others."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    out = substrings.repeated_words(docs)
    left = set(os.listdir(tmp_path / "tidewheel"))
    assert 0 < len(left) <= 3 and out.count() == docs.count()
    assert left == {f.rsplit("/", 2)[-2] for f in out.inputFiles() if "tidewheel" in f}


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Far)
