"""Token counts of prefixes against the library on whole prefixes."""

import random

import pytest
from sentencepiece import SentencePieceProcessor

from keepsake.llm import queries, token_counts

MODEL = queries.tokenizer("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
BITS = [*"abzABZ é日本'.,!?$%&*#|\n\t 019-_/\x85\x1c Σςİ①▁\x00²½", "the", "ing", "<s>", "</s>", "<0x0A>",
        "<unk>", "  ", "     ", "\r\n", "한국", " not"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return token_counts.PrefixCounter(MODEL, kept_words=500)


def odd_texts(n, length=30):
    some = random.Random(11)
    return ["".join(some.choice(BITS) for _ in range(some.randrange(length))) for _ in range(n)]


def test_every_prefix_counts_as_the_library_says(library, own):
    for text in odd_texts(600):
        want = [len(x) for x in library.encode([text[:k] for k in range(len(text) + 1)])]
        assert token_counts.counts_of(own.table(text)).tolist() == want


def test_runs_of_blanks_and_long_words(library, own):
    for text in [" " * n + end for n in range(40) for end in ("", "a", "(", "the")] + [
        "a" * 5000, "ab" * 3000 + "日本" * 900, "0123456789" * 500, "-" * 777, "\n" * 99]:
        assert own.count(text) == len(library.encode(text)), text[:50]


def test_query_equals_the_library_on_whole_texts(spark, library):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.queries()["op11_token_counts"](spark, SF).collect()}
    assert len(found) == len(texts)
    for r in texts:
        n = len(library.encode(r.text or ""))
        got = found[r.doc_id]
        assert (got.n_tokens, got.over_limit) == (n, n > 4096)
        assert got.n_bytes == len((r.text or "").encode())


def test_odd_rows_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, " \n", "x"), (3, "word", "x"), (3, "word", "x"),
            (4, "é日本①<s>\t", "x"), (5, "lorem ipsum " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    counted = token_counts.prefix_tables(docs.withColumnRenamed("N_TOKENS", "n_tokens"), MODEL)
    assert counted.columns == ["doc_id", "text", "n_bytes", "n_tokens", "prefix_tokens"]
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, len(r.prefix_tokens)) for r in counted.collect())
    want = sorted((repr(i), len((t or "").encode()), len(library.encode(t or "")), len(t or ""))
                  for i, t, _ in rows)
    assert got == want
    assert token_counts.prefix_tables(docs.limit(0), MODEL).count() == 0


def test_budgets_without_encoding_again(spark, library):
    texts = [None, "", *odd_texts(60, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = token_counts.prefix_tables(docs, MODEL)
    for r in token_counts.truncations(counted, [0, 7, 40]).collect():
        text = r.text or ""
        counts = [len(x) for x in library.encode([text[:k] for k in range(len(text) + 1)])]
        for cut, budget in zip(r.truncations, (0, 7, 40)):
            at = max(k for k, n in enumerate(counts) if n <= budget)
            assert (cut.budget, cut.n_chars, cut.n_tokens) == (budget, at, counts[at])
    for r in token_counts.truncate(counted, 7).collect():
        whole = texts[r.doc_id]
        counts = [len(x) for x in library.encode([(whole or "")[:k] for k in range(len(whole or "") + 1)])]
        at = max(k for k, n in enumerate(counts) if n <= 7)
        assert r.text == (None if whole is None else whole[:at])
        assert (r.n_tokens, r.n_bytes) == (counts[at], len((r.text or "").encode()))
        assert token_counts.counts_of(r.prefix_tokens).tolist() == counts[: at + 1]
    with pytest.raises(ValueError):
        token_counts.truncations(counted, [-1])


def test_other_models_are_refused():
    with pytest.raises(Exception):
        token_counts.PrefixCounter(queries.tokenizer("byte_bpe_50k.json"))
