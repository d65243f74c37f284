import pytest

from tidewheel.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        yield r[0], len((r[1] or "").encode()), n, n > 512


COLUMNS = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
ODD = ["it's we'll they'VE", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "中文字 and ١٢٣ ½ ²", "tab\there  two nbsp 　x\n\n\n y ", "՘֋ a​b 👩‍👩‍👧 é", "x" * 3000, " " * 2000, "\x00\x01 \x1c\x1f\x85 z", "don''t 'S"]


def test_against_library(spark, docs, rows, same, path, monkeypatch):
    more = [(1000 + i, t) for i, t in enumerate(ODD)]
    frame = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*m, "k") for m in more], "doc_id long, text string, key string"))
    expected = list(brute([*rows, *more], path))
    same(tokens.count_tokens(frame, path), COLUMNS, expected)
    monkeypatch.setattr(tokens, "HEAD", 40)  # most pre-tokens go by the shuffle
    same(tokens.count_tokens(frame, path), COLUMNS, expected)


def test_empty(nothing, path):
    assert tokens.count_tokens(nothing, path).count() == 0


def test_other_tokenizers_are_refused(nothing):
    with pytest.raises(ValueError):
        tokens.count_tokens(nothing, public_tokenizers.path("word_bpe_49k.json"))
