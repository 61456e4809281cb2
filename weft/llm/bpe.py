"""BPE encoding and decoding with tree concatenation.

Short texts are encoded where they lie. A long text is cut into pieces that are
encoded in parallel: at white space, where encodings simply follow each other, and
inside a run without any split, which is halved down to leaves. The leaves of a run
are joined as a tree. A join re-encodes a window around the seam, and widens it
until the window's outer tokens agree with those on both sides; every pair of
neighbours is then one that the merges leave alone, so the whole equals the
encoding of the unsplit run.

The vocabulary is a file of the tokenizers library, named by a parameter. It must
split at white space and use byte-level BPE with word ends, as ``word_bpe_49k.json``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

#: A run without white space of so many characters is cut into leaves of at most so many.
LEAF = 8_192
#: A text of so many characters is cut into pieces whether it has such a run or not. The ids are the same on either side of both bounds.
LONG_TEXT = 1 << 15
#: The tokenizer's white space, and the pattern of its words.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GAPS = re.compile(f"[{WHITE}]+")
CHUNKS = re.compile(f"[^{WHITE}]+")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
WORD_END = "</w>"
#: Characters below this one are their own NFC form, and lower as the library lowers them.
PLAIN = "\u0250"
#: Entries of a worker's memo before it starts afresh.
MEMO = 250_000
PIECE = T.StructType().add("seq", T.IntegerType()).add("run", T.IntegerType()).add("kind", "string").add("piece", "string")
CODED = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")


def byte_alphabet() -> dict[int, str]:
    """Byte to character of byte-level BPE: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    return table | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in table)}


BYTES = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})


class Encoder:
    """One vocabulary, with a memo of what white-space separated chunks encode to.

    Words of plain Latin chunks are looked up here, which takes two thirds of the time that
    the library's own splitting of every new chunk takes; all others go to the library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)  # for the inside of a run: no word end
        self.whole = self.tokenizer.model
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.tokens = [""] * (max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
        for token, i in [*model["vocab"].items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]:
            self.tokens[i] = token
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one word, given in lower case and the byte alphabet, as bytes of int32."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            found = self.words[word] = np.array([t.id for t in self.whole.tokenize(word)], np.int32).tobytes()
        return found

    def miss(self, chunk: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if max(chunk) >= PLAIN or "<|" in chunk and any(x in chunk for x in self.special):
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.int32).tobytes()
        else:
            low = chunk.lower()
            words = [low] if low.isalpha() else WORDS.findall(low)
            ids = b"".join([self.word(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTES)) for w in words])
        self.memo[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as the library gives them without adding special tokens; none for null."""
        if not text:
            return np.zeros(0, np.int32)
        memo, miss = self.memo, self.miss
        chunks = [x for x in GAPS.split(text) if x] if any(x in text for x in "\x1c\x1d\x1e\x1f") else text.split()
        return np.frombuffer(b"".join([memo.get(x) or miss(x) for x in chunks]), np.int32)

    def decode(self, ids) -> str:
        """Tokens joined by spaces, special ones included; unknown ids are skipped."""
        tokens, n = self.tokens, len(self.tokens)
        return " ".join([tokens[i] for i in ids if 0 <= i < n])

    def run_words(self, chunk: str) -> list[str]:
        """The words of a chunk without special tokens, in lower case and the byte alphabet."""
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))
        return [x for x, _ in found]

    def leaf(self, piece: str, last: bool) -> list[int]:
        return [t.id for t in (self.whole if last else self.inner).tokenize(piece)]

    def text_of(self, ids: list[int]) -> tuple[str, bool]:
        """What ids of one word spell, and whether its end is among them."""
        found = "".join(self.tokens[i] for i in ids)
        return (found.removesuffix(WORD_END), True) if found.endswith(WORD_END) else (found, False)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of one word, from theirs."""
        a = b = 4
        while left and right:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.leaf(*self.text_of(left[-a:] + right[:b]))
            ok_left = a == len(left) or window[0] == left[-a]
            ok_right = b == len(right) or window[-1] == right[b - 1]
            if ok_left and ok_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = (a if ok_left else 2 * a), (b if ok_right else 2 * b)
        return left + right

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours pair by pair, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def halves(word: str, leaf: int) -> list[str]:
    """The word, halved until no part is longer than ``leaf``."""
    if len(word) <= leaf:
        return [word]
    mid = len(word) // 2
    return halves(word[:mid], leaf) + halves(word[mid:], leaf)


def pieces(own: Encoder, text: str, leaf: int) -> list[dict]:
    """Pieces of a long text in order: ``text`` to encode as it is, ``inner`` and ``end`` as leaves of one word."""
    found: list[tuple[int, str, str]] = []
    run, at = 0, 0
    while at < len(text):
        if len(text) - at <= leaf:
            found.append((run, "text", text[at:]))
            break
        cut = max(text.rfind(x, at, at + leaf + 1) for x in " \n\t\r")
        if cut > at:
            found.append((run, "text", text[at:cut]))
            at = cut
            continue
        m = CHUNKS.search(text, at)
        if m is None:
            break
        if m.start() > at + leaf:
            at = m.start()
            continue
        end = m.end()
        if end - at <= leaf or any(x in m[0] for x in own.special):
            found.append((run, "text", text[at:end]))
        else:
            for word in own.run_words(m[0]):
                run += 1
                leaves = halves(word, leaf)
                found += [(run, "inner", x) for x in leaves[:-1]] + [(run, "end", leaves[-1])]
            run += 1
        at = end
    return [{"seq": i, "run": r, "kind": k, "piece": p} for i, (r, k, p) in enumerate(found)]


def encode_texts(
    docs: DataFrame, path: str, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",), leaf: int = LEAF, long_text: int = LONG_TEXT, decode: bool = False
) -> DataFrame:
    """``keep_cols`` and ids array<int>: every whole text, encoded as the library encodes it.

    With ``decode``, a column decoded has what the ids decode to; one pass does both.
    Null and empty texts give no ids. Texts with a run of ``leaf`` characters
    without white space (and some from half as many), and texts of ``long_text`` or more, are encoded in pieces by
    several tasks and joined as trees; a text's pieces meet in one task, as its ids do
    in one row. Repeated rows give repeated results, columns besides
    ``keep_cols`` aren't read, an empty table gives no rows.
    """

    def coded(own: Encoder, ids: list) -> pd.DataFrame:
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([own.decode(x.tolist()) if decode else None for x in ids], dtype=object)})

    @F.pandas_udf(CODED)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for texts in batches:
            yield coded(own, [own.encode(x) for x in texts])

    @F.pandas_udf(T.ArrayType(PIECE))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series([pieces(own, x, leaf) for x in texts], dtype=object)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode_pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = encoder(path)
        for kinds, texts in batches:
            yield pd.Series([own.encode(x) if k == "text" else own.leaf(x, k == "end") for k, x in zip(kinds, texts)], dtype=object)

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, ids, run = encoder(path), [], []
        for kind, part in rows.sort_values("seq")[["kind", "part"]].itertuples(index=False):
            if kind == "text":
                ids.append(np.asarray(part, np.int32))
                continue
            run.append(list(part))
            if kind == "end":
                ids.append(np.array(own.tree(run), np.int32))
                run = []
        return coded(own, [np.concatenate(ids)]).assign(uid=key[0])

    rows = docs.select(F.struct(*keep_cols).alias("kept"), F.col(text_col).alias("text"))
    # A run of leaf characters fills a block of half as many; in other blocks the test ends at the first white space.
    half = max(1, leaf // 2)
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / half).cast("int") - 1)
    unsplit = (F.length("text") >= leaf) & F.exists(starts, lambda k: ~F.substr("text", k * half + 1, F.lit(half)).rlike(f"[{WHITE}]"))
    is_long = F.coalesce((F.length("text") >= long_text) | unsplit, F.lit(False))
    short = rows.where(~is_long).select("kept", encode("text").alias("coded")).select("kept", "coded.*")
    # Ids depend on the text alone: copies of a text meet by its digest, which stays the same whatever runs again, and are encoded once.
    long = rows.where(is_long).withColumn("uid", F.sha2("text", 256))
    cut_up = long.select("uid", F.explode(cut("text")).alias("p")).groupBy("uid", "p.seq").agg(F.first("p.kind").alias("kind"), F.first("p.piece").alias("piece"))
    parts = cut_up.select("uid", "seq", "kind", encode_pieces("kind", "piece").alias("part"))
    joined = parts.groupBy("uid").applyInPandas(join, "ids array<int>, decoded string, uid string")
    blank = F.lit("") if decode else F.lit(None).cast("string")
    whole = long.select("uid", "kept").join(joined, "uid", "left").select("kept", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.coalesce("decoded", blank).alias("decoded"))
    return short.unionByName(whole).select("kept.*", "ids", *["decoded"] * decode)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``: the ids' tokens joined by spaces, as the library decodes with special tokens kept.

    Null ids give an empty text, ids outside the vocabulary are skipped.
    """

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for lists in batches:
            yield pd.Series(["" if x is None else own.decode(x.tolist()) for x in lists], dtype=object)

    return rows.withColumn(out_col, decode(ids_col))
