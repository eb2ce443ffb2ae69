"""Token ids by the tokenizers library, with the ids of frequent words kept per task."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keepsake.llm.common import kept

#: A worker keeps the ids of so many words (or of one batch's) and then starts anew; of a quarter
#: for the byte-level pattern, where a word with and without a blank or a capital letter is two.
KEPT_WORDS = 800_000

# Letters whose lower case and composed forms are letters too, and signs that no pattern of the
# two known tokenizers joins with a letter before them.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_SIGNS = r".,!?$%&*#|"
_ODD_SPACE = r"\s\x1c-\x1f\x85"

#: Cuts at places where the byte-level tokenizer's own pattern always cuts, given text whose only
#: white space is blanks and line ends. Other white space comes out alone and is then handled by
#: encoding the whole text.
_BYTE_LEVEL = re.compile(
    rf" ?[{_LETTERS}]+(?=[ \n{_SIGNS}]|\Z)| ?[{_SIGNS}]+(?=[ \n]|\Z)| ?[^{_ODD_SPACE}]+"
    r"|[ \n]+(?![^ \n])|[ \n]+|[\s\S]"
)

_LETTERS_ONLY = re.compile(rf"[{_LETTERS}]+")
_WORD = re.compile(rf" ?[{_LETTERS}]+")

#: Where the byte-level pattern does not cut before each blank and around each line end: in longer
#: white space, at the end of a text, and at other white space (the zero byte marks cuts).
_UNEVEN = (
    r"[ \n]{3}|[ \n]{2}\z|[\x00\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


def _byte_signs() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones of Latin-1 stand for themselves,
    the others, in order, for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(256 + n) for n, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()
_BLANK = _BYTE_SIGNS[0x20]


class _Words(dict):
    """Ids by word; those of a word that is not there are made by ``of`` and kept."""

    def __init__(self, of: Callable[[str], bytes]) -> None:
        super().__init__()
        self._of = of

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._of(word)
        return ids


def _before_blanks(texts: pa.Array) -> pa.Array:
    """What the byte-level pattern parts in even texts: words with the blank before them, and line
    ends."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
    return pc.split_pattern(marked, "\0")


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    The result is that of ``Tokenizer.encode(text, add_special_tokens=False)``. Where the
    tokenizer's file shows one of the two known patterns, texts are cut into words first and each
    distinct word is encoded once; any other tokenizer encodes whole texts. The byte-level pattern
    cuts before blanks and around line ends; the lower-case one drops white space, so there what
    stands between white space is a word. Signs behind a word are looked up apart from it.
    """

    def __init__(self, path: str, kept_words: int | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._stems: dict[str, bytes] = {}
        self._others = _Words(lambda word: self._new([word])[0])
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.top_id = max([*self._tokenizer.get_vocab(with_added_tokens=True).values(), 0])
        self._added = [t["content"] for t in parts.get("added_tokens") or ()]
        self._cut = self._pattern(parts)
        self._lower = self._cut is pc.ascii_split_whitespace
        self._letters = _LETTERS_ONLY if self._lower else _WORD
        self._kept = kept_words or (KEPT_WORDS if self._lower else KEPT_WORDS // 4)

    @staticmethod
    def _pattern(parts: dict) -> Callable[[pa.Array], pa.Array] | None:
        before, normal = parts.get("pre_tokenizer") or {}, parts.get("normalizer")
        plain = not parts.get("truncation") and not parts.get("padding")
        if plain and normal is None and before.get("type") == "ByteLevel":
            if before.get("use_regex") and not before.get("add_prefix_space"):
                return _before_blanks
        steps = [n.get("type") for n in (normal or {}).get("normalizers", ())]
        cuts = [p.get("type") for p in before.get("pretokenizers", ())]
        if plain and steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]:
            split = before["pretokenizers"][0]
            words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            if split["pattern"] == {"Regex": words} and split["behavior"] == "Removed":
                return pc.ascii_split_whitespace
        return None

    def _new(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _stem(self, word: str) -> bytes:
        """The ids of letters that are one unit of the pattern: the library's model takes them."""
        if not word.isascii():
            written = word.encode().decode("latin-1").translate(_BYTE_SIGNS)
        else:
            written = word if word[0] != " " else _BLANK + word[1:]
        return array("I", [t.id for t in self._tokenizer.model.tokenize(written)]).tobytes()

    def _between_signs(self, words: list[str]) -> list[bytes]:
        """The ids of words that the pattern parts from their neighbours: most often letters, then
        signs."""
        stems, others, out = self._stems, self._others, []
        for word in words:
            stem = word.rstrip(_SIGNS)
            ids = stems.get(stem)
            if ids is None:
                if not self._letters.fullmatch(stem):
                    out.append(others[word])
                    continue
                if self._lower:
                    low = stem.lower()
                    ids = stems.get(low) or self._stem(low)
                else:
                    ids = self._stem(stem)
                stems[stem] = ids
            if len(stem) != len(word):
                ids += others[word[len(stem) :]]
            out.append(ids)
        return out

    def _uneven(self, text: str) -> bytes:
        """The ids of a text with white space that the pattern may cut in other places."""
        if _ODD.search(text):
            return self._new([text])[0]
        return b"".join(self._between_signs(_BYTE_LEVEL.findall(text)))

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that Arrow cuts into words.

        Arrow also numbers the batch's distinct words; only these are looked up, and their ids are
        laid out by number.
        """
        if len(self._stems) + len(self._others) > self._kept:
            self._stems.clear()
            self._others.clear()
        whole = texts
        if not self._lower:
            uneven = pc.match_substring_regex(texts, _UNEVEN)
            if uneven.true_count:
                texts = pc.if_else(uneven, "", texts)
        cut = self._cut(texts)
        words = cut.flatten().dictionary_encode()
        found = self._between_signs(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts = np.cumsum(sizes) - sizes
        number = words.indices.to_numpy()
        size = sizes[number]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(firsts[number] - ends[:-1], size)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        bounds = ends[np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))]
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        if not self._lower:
            for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)):
                out[i] = self._uneven(whole[i].as_py())
        for added in self._added:
            for i in np.flatnonzero(pc.match_substring(whole, added).to_numpy(zero_copy_only=False)):
                out[i] = self._new([whole[i].as_py()])[0]
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if self._cut is None:
            return self._new(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        return self._by_words(
            texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        )


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file, kept with its words from task to task of a worker."""
    return kept(("encoder", path), lambda: Encoder(path))
