"""The encoder's shortcuts against the library on whole texts and odd ones."""

import random
from array import array

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from keepsake.llm import queries
from keepsake.llm.encoding import Encoder

BITS = [*"abzABZ é日本'.,!?$%&*#|\n\t 019-_/\x85\x1c Σςİß", "'s", "'ll", "<|endoftext|>", "  ", "\r\n", "?!"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kept", [200, 50_000])
def test_ids_are_the_library_s(name, kept):
    path = queries.tokenizer(name)
    own, library = Encoder(path, kept), Tokenizer.from_file(path)
    column = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0)
    some = random.Random(4)
    texts = [t or "" for t in column.to_pylist()[:400]]
    texts += ["".join(some.choice(BITS) for _ in range(some.randrange(40))) for _ in range(4000)]
    for at in range(0, len(texts), 256):
        batch = texts[at : at + 256]
        for text, ids, want in zip(
            batch, own.encode(batch), library.encode_batch(batch, add_special_tokens=False)
        ):
            assert ids == array("I", want.ids).tobytes(), text[:80]


def test_a_batch_s_words_are_looked_up_once(monkeypatch):
    path = queries.tokenizer("word_bpe_49k.json")
    own, library = Encoder(path, 20), Tokenizer.from_file(path)
    texts = ["left out", "", " \n\t", "the Cat, the cat,\u00a0the\u3000CAT", "<|endoftext|>the\x1c(916) x."] * 9
    texts += [" the cat " * 500, "\u212ba \u1e9e \u0130x ??? ,a 12.", "last\x0bone\x85"]
    seen, inner = [], own._between_signs
    monkeypatch.setattr(own, "_between_signs", lambda words: seen.append(words) or inner(words))
    for at in (1, 11):
        found = own.encode(pa.array(texts)[at:])
        wanted = library.encode_batch(texts[at:], add_special_tokens=False)
        assert found == [array("I", w.ids).tobytes() for w in wanted]
    assert len(seen) == 2 and all(len(words) == len(set(words)) < 30 for words in seen)


def test_byte_level_words_are_looked_up_once(monkeypatch):
    path = queries.tokenizer("byte_bpe_50k.json")
    own, library = Encoder(path, 20), Tokenizer.from_file(path)
    texts = ["left out", "", " ", "\n", "the Cat, the cat,\n\nthe  Cat\n The CAT.", "a \nb\n", "don't?!"] * 9
    texts += [" the cat " * 500, "caña Épée ß", "<|endoftext|>the cat"]
    uneven = ["a   b", "a\n\n\nb", "a \n b", "end  ", "end \n", "\n\n", "    in\n        in", "a\tb", "a\0 b"]
    uneven += ["a\x1cb", "a\x85 b", "a  　b", "\r\na   ", "  a\x0b\x0cb"]
    seen, inner = [], own._between_signs
    monkeypatch.setattr(own, "_between_signs", lambda words: seen.append(words) or inner(words))
    for some, calls in ((texts[1:], 1), (uneven + texts, None)):
        seen.clear()
        found = own.encode(pa.array(["left out", *some])[1:])
        wanted = library.encode_batch(some, add_special_tokens=False)
        assert found == [array("I", w.ids).tobytes() for w in wanted]
        assert calls is None or len(seen) == calls and len(seen[0]) == len(set(seen[0])) < 30
