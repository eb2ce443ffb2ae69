"""Token counts of every prefix, by dynamic programming over the pieces of a SentencePiece model.

A merging tokenizer has one encoding for each text, and a row of pieces is an encoding exactly if
each two neighbours in it are one: encoding the two alone gives them back. So the last piece of
every prefix is found from the ones before: of the pieces that end there, it is the one that stands
well beside the last piece of what it leaves. A prefix has one token more than what its last piece
leaves. A text's table holds the change of the count at each of its characters; how many tokens a
prefix has and where a budget runs out are then read off, and nothing is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import add_columns, kept, set_aside

#: A worker keeps the tables of so many words, and so many pairs of pieces, then starts anew.
KEPT_WORDS = 400_000
_LONG = 64  # characters of a word that is not kept
_PIECE = ""  # where a node of the pieces' tree holds the piece that begins there
_BLANK = "▁"  # how SentencePiece writes a blank


def _cuts(numbers: str) -> tuple[re.Pattern, ...]:
    """Ways to cut a text, from fine to whole; blanks go with what follows them. ``numbers`` are
    signs like ² that Python counts among the word characters though they are no letters."""
    no_letter = f"(?! )[\\W_{numbers}]"
    return (
        re.compile(rf" *[^\W\d_{numbers}]+| +(?:{no_letter})*|(?:{no_letter})+|\d"),
        re.compile(r" *[^ ]+| +"),
        re.compile(r"[\s\S]+"),
    )


class PrefixCounter:
    """``table(text)`` gives, for each character, the change of the token count there (int8).

    The sum of the first k is the number of tokens that ``SentencePieceProcessor.encode`` gives
    the first k characters, without begin and end; strings of special tokens are plain text. Takes
    merging (BPE) models with byte fallback that leave the text as it is but for a blank put in
    front; another model is refused.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [
            i
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        #: Merges take the highest score first, the leftmost of equal ones.
        self._scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self._kept = kept_words
        self._tables: dict[str, bytes] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        # Pieces by their characters from the last to the first.
        self._ends: dict = {}
        for piece in self._scores:
            node = self._ends
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[_PIECE] = piece
        self._cut = self._finest_cut()
        probe = "  An ① ﬁrst, 12.50\tprobe\néè 한 "
        if any(model.is_unused(i) for i in plain) or len(model.encode(probe)) != self.count(probe):
            raise ValueError(f"{path} is no plain merging model with byte fallback")

    def _finest_cut(self) -> re.Pattern:
        """The first way that never cuts between two characters that stand together in a piece."""
        pairs = {a + b for p in self._scores for a, b in zip(p, p[1:])}
        pairs = {p.replace(_BLANK, " ") for p in pairs}
        signs = {c for p in pairs for c in p if not c.isalpha() and not c.isdecimal()}
        for cut in _cuts("".join(sorted(c for c in signs if re.match(r"[^\W_]", c)))):
            if all(len(cut.match(p).group()) == 2 for p in pairs):
                return cut
        raise AssertionError("the last cut cuts nothing")

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text, merge by merge."""
        parts = list(text)
        while len(parts) > 1:
            found = [self._scores.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in found if s is not None), default=None)
            if best is None:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _beside(self, before: str, piece: str) -> bool:
        """Whether the two stand as they are when encoded together."""
        if len(self._pairs) >= self._kept:
            self._pairs.clear()
        wanted = [before, piece] if before else [piece]
        good = self._pairs[before, piece] = self._merged(before + piece) == wanted
        return good

    def _word(self, word: str) -> bytes:
        """The changes of the count along one word."""
        last, counts, changes = [""], [0], bytearray()
        root, pairs = self._ends, self._pairs
        for end, char in enumerate(word):
            # The pieces that end here, from short to long; a character alone is always one.
            node, start = root.get(char), end
            piece, cost = char, 1 if node and _PIECE in node else len(char.encode())
            while True:
                if piece is not None:
                    good = pairs.get((last[start], piece))
                    if good is None:
                        good = self._beside(last[start], piece)
                    if good:
                        break
                start -= 1
                node = node.get(word[start]) if node and start >= 0 else None
                if node is None:
                    raise AssertionError(f"no piece ends at {end} of {word[:80]!r}")
                piece, cost = node.get(_PIECE), 1
            last.append(piece)
            counts.append(counts[start] + cost)
            changes.append((counts[-1] - counts[-2]) & 255)
        return bytes(changes)

    def table(self, text: str) -> bytes:
        if not text:
            return b""
        words = self._cut.findall(" " + text.replace(_BLANK, " "))
        new = set(words).difference(self._tables)
        if len(self._tables) + len(new) > self._kept:
            self._tables, new = {}, set(words)
        for word in new:
            self._tables[word] = self._word(word.replace(" ", _BLANK))
        data = b"".join(map(self._tables.__getitem__, words))
        for word in new:
            if len(word) > _LONG:
                del self._tables[word]
        # The blank in front belongs to the first character.
        first = int.from_bytes(data[:1], signed=True) + int.from_bytes(data[1:2], signed=True)
        return first.to_bytes(1, signed=True) + data[2:]

    def count(self, text: str) -> int:
        return int(counts_of(self.table(text))[-1])


def counter(path: str) -> PrefixCounter:
    """The counter of a model's file, kept with its words from task to task of a worker."""
    return kept(("counter", path), lambda: PrefixCounter(path))


def counts_of(table: bytes) -> np.ndarray:
    """The token count of each prefix, that of no character first."""
    changes = np.frombuffer(table, np.int8)
    counts = np.zeros(len(changes) + 1, np.int64)
    np.cumsum(changes, out=counts[1:])
    return counts


def longest_prefix(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens.

    A longer prefix may have fewer tokens than a shorter one, so all of them count; -1 if not even
    the empty one fits (a negative budget).
    """
    within = np.flatnonzero(counts_of(table) <= budget)
    return int(within[-1]) if len(within) else -1


def prefix_tables(docs: DataFrame, model: str) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and prefix_tokens to every row of ``docs`` (text, any others).

    prefix_tokens is binary, one signed byte for each character: how much the token count changes
    there (see :func:`counts_of`). Null text counts as empty: 0, 0 and no bytes. Repeated rows
    stay, columns of these names are replaced, and an empty table gives no rows. There is no
    shuffle and nothing is cut short; a text's table is as long as the text.
    """

    def work() -> Callable[[list[bytes]], list[pa.Array]]:
        own = counter(model)

        def one(texts: list[bytes]) -> list[pa.Array]:
            tables = [own.table(t.decode()) for t in texts]
            totals = [int(np.frombuffer(t, np.int8).sum(dtype=np.int64)) for t in tables]
            return [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array(tables, pa.binary()),
            ]

        return one

    return add_columns(
        docs, {"n_bytes": "long", "n_tokens": "long", "prefix_tokens": "binary"}, work
    )


def truncations(counted: DataFrame, budgets: list[int]) -> DataFrame:
    """Where each text of ``counted`` (prefix_tokens, any others) stays within each budget.

    Adds ``truncations``: one (budget, n_chars, n_tokens) per budget, in the given order, for the
    longest prefix of at most that many tokens, read off the table. A null table is an empty text.
    """
    for budget in budgets:
        if budget < 0:
            raise ValueError("a budget is at least 0")

    def cuts(tables: list[bytes]) -> list[pa.Array]:
        rows = []
        for table in tables:
            counts = counts_of(table)
            row = []
            for budget in budgets:
                at = int(np.flatnonzero(counts <= budget)[-1])
                row.append({"budget": budget, "n_chars": at, "n_tokens": int(counts[at])})
            rows.append(row)
        of_cut = pa.struct(
            [("budget", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())]
        )
        return [pa.array(rows, pa.list_(of_cut))]

    kind = "array<struct<budget: bigint, n_chars: bigint, n_tokens: bigint>>"
    return add_columns(counted, {"truncations": kind}, lambda: cuts, text="prefix_tokens")


def truncate(counted: DataFrame, budget: int) -> DataFrame:
    """``counted`` (text, prefix_tokens, any others) with each text cut to its longest prefix of
    at most ``budget`` tokens, and n_tokens and prefix_tokens made to fit. Null texts stay null."""
    own, back = set_aside(counted, ["truncations"])
    cut = truncations(own, [budget]).withColumn("__cut", F.col("truncations")[0])
    n = F.col("__cut.n_chars").cast("int")
    changed = {
        "text": F.expr("substring(cast(text as string), 1, int(__cut.n_chars))"),
        "prefix_tokens": F.expr("substring(prefix_tokens, 1, int(__cut.n_chars))"),
        "n_tokens": F.col("__cut.n_tokens"),
        "n_bytes": F.coalesce(F.octet_length(F.substring(F.col("text").cast("string"), F.lit(1), n)), F.lit(0)).cast("long"),
    }
    names = [c for c in ("n_bytes", "text", "prefix_tokens", "n_tokens") if c in counted.columns]
    return cut.withColumns({c: changed[c] for c in names}).select(back)
