import public_tokenizers
import pytest

#: Columns whose names the operators might use themselves.
MESSY = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, part int, score string, rid long, label string, c0 string, tid string, n_words string"
LONG = "word another " * 30_000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
TEXTS = [
    (1, None, None),
    (2, "", "en"),
    (3, "   \n\t ", "en"),
    (4, "The cat, sat on the mat. It's 12.5 degrees; naïve café!", "en"),
    (5, "The cat, sat on the mat. It's 12.5 degrees; naïve café!", "en"),
    (5, "The cat, sat on the mat. It's 12.5 degrees; naïve café!", "en"),
    (6, "12345 --- !!! ...", "de"),
    (7, LONG, "en"),
    (8, "x" * 5000, "fr"),
    (9, "<|endoftext|> and <|startoftext|> inside, don't stop", "en"),
    (10, "日本語のテキスト 🙂 ﬁ ǅ é", "fr"),
    (11, "\r\nline one\r\n\r\nline  two end ", "de"),
    (None, "no id here", "en"),
    (12, " ".join(WORDS), "en"),
    (13, " ".join(WORDS[:-1] + ["changed"]), "en"),
    (14, "hi", None),
]


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, lang, None, None, "k", "h", 1, "s", 2, "l", "c", "t", "n") for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, MESSY).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], MESSY)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")
