from __future__ import annotations

from sievework.llm.tokens import FOLDER, _encoding, token_lengths


def test_lengths(spark):
    import tiktoken
    from tokenizers import Tokenizer

    texts = ["", None, "Hello  world", "naïve ’s\n\n  x  ", "葉 🌱" * 40, " " * 3000, "a" * 20000, "don't  \t we'll"]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, tokens int")
    got = [r["tokens"] for r in token_lengths(rows, "text", ["id"]).orderBy("id").collect()]
    other = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    assert got == [len(other.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    assert isinstance(_encoding(f"{FOLDER}/byte_bpe_50k.tiktoken"), tiktoken.Encoding)
