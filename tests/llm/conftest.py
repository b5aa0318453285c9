import public_tokenizers
import pytest
from tokenizers import Tokenizer

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def tokenizer_path():
    return WORD_BPE


@pytest.fixture(scope="session")
def encode():
    """Ids of one whole text, by the library alone."""
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with nulls, empty, long and repeated texts, and columns with clashing names."""
    rows = [
        (1, "The cat sat. The cat sat! Ünïcode ß 123", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, "word " * 9000, "en", "b"),
        (5, "The cat sat. The cat sat! Ünïcode ß 123", "fr", "a"),
        (5, "The cat sat. The cat sat! Ünïcode ß 123", "fr", "a"),
        (7, " \t\r\n\x0b\x0c ", "de", "b"),
        (None, "no id here", "de", None),
        (9, "日本語 é İstanbul ΣΑΣ\x85x\x1cy\xa0z don't CAN'T ...,!?  ", "ja", "a"),
    ]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, start long, slot long")
    return df
