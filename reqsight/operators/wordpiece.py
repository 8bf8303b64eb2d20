"""Uncased WordPiece encoding.

Basic tokenisation (lower case, accents off, control characters off, split at white space, every punctuation
and CJK character a token) is done by built-in functions over the whole text; only the first ``max_len - 2``
tokens of a text, which is all that can get into its encoding, go to Python for the greedy
longest-match-first search, in Arrow batches; all other columns pass through it as they are. The vocabulary is a
parameter, broadcast once, and searched as a trie. Tokenizers are not trained here: a vocabulary is a rule
(``character_vocab``), a public tokenizer file (``subword_vocab``) or the user's own.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reqsight.fixed import MAX_LEN

# Worker-side functions of this module travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of UTF-8 that a vocabulary to broadcast may have.
MAX_VOCAB_BYTES = 64 << 20
MAX_WORD = 100  # characters of a word that the encoder splits; longer ones are unknown
#: Rows whose words a worker holds as Python objects at a time, and split words that it remembers.
ROWS_AT_ONCE, MAX_KNOWN = 256, 20_000
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]

# The CJK blocks whose characters are tokens of their own.
_CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{2F800}-\x{2FA1F}"
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
_TOKEN = rf"[{_CJK}]|[{_PUNCT}]|[^\s\p{{Z}}{_CJK}{_PUNCT}]+"


def _accented() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that decompose into one base letter and marks, and their bases."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        flat = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(flat) == 1 and flat != chr(code):
            pairs.append((chr(code), flat))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def basic_tokens(text: Column) -> Column:
    """Uncased basic tokens of the whole text (none for NULL)."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accented())
    t = F.regexp_replace(t, r"\p{Mn}+|(?![\t\n\r])[\p{Cc}\p{Cf}\x{FFFD}]", "")
    return F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))


class PieceTrie:
    """A vocabulary as a trie with two roots: node 0 for the start of a word, node 1 for what follows (``##``)."""

    def __init__(self, vocab: dict[str, int]):
        self.unk = vocab["[UNK]"]
        self.step: dict[int, int] = {}
        self.piece: list[int] = [-1, -1]  # the id of the token that ends in a node
        for token, number in vocab.items():
            inside = token.startswith("##") and len(token) > 2
            if inside:
                self._add(1, token[2:], number)
            self._add(0, token, number)  # a word may also start by the characters ##

    def _add(self, node: int, token: str, number: int) -> None:
        for ch in token:
            key = node << 21 | ord(ch)
            if key not in self.step:
                self.step[key] = len(self.piece)
                self.piece.append(-1)
            node = self.step[key]
        self.piece[node] = number

    def split(self, word: str) -> list[int]:
        """Ids by greedy longest match; a word that does not split, or of over ``MAX_WORD`` characters, is unknown."""
        if len(word) > MAX_WORD:
            return [self.unk]
        ids, start, n, step, piece = [], 0, len(word), self.step.get, self.piece
        while start < n:
            node, found, end, at = int(start > 0), -1, start, start
            while at < n and (node := step(node << 21 | ord(word[at]))) is not None:
                at += 1
                if piece[node] >= 0:
                    found, end = piece[node], at
            if found < 0:
                return [self.unk]
            ids.append(found)
            start = end
        return ids


_TRIES: dict[int, tuple[dict, PieceTrie]] = {}


def _trie(vocab: dict[str, int]) -> PieceTrie:
    """This process's trie of the broadcast vocabulary, kept from task to task."""
    if id(vocab) not in _TRIES:
        _TRIES.clear()
        _TRIES[id(vocab)] = vocab, PieceTrie(vocab)
    return _TRIES[id(vocab)][1]


def encode_wordpiece(df: DataFrame, vocab: dict[str, int], text: str = "text",
                     max_len: int = MAX_LEN) -> DataFrame:
    """Adds ``ids`` and ``mask`` (ARRAY<INT>[max_len]): [CLS] pieces [SEP], padded."""
    if (size := sum(len(t.encode()) for t in vocab)) > MAX_VOCAB_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large to broadcast; at most {MAX_VOCAB_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    cols = df.columns
    data = df.withColumn("_words", F.slice(basic_tokens(F.col(text)), 1, max_len - 2))  # a token gives a piece at least
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("mask", T.ArrayType(T.IntegerType()))])

    def slices(batches):
        return (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE))

    def run(batches):
        v, known = shared.value, {}
        trie = _trie(v)
        cls, sep, pad = v["[CLS]"], v["[SEP]"], v["[PAD]"]
        for batch in slices(batches):
            ids_col, mask_col = [], []
            for words in batch.column(len(cols)).to_pylist():
                pieces = [cls]
                for w in words:
                    if w not in known:
                        known[w] = trie.split(w)
                    pieces += known[w]
                    if len(pieces) >= max_len - 1:
                        break
                pieces = pieces[:max_len - 1] + [sep]
                ids_col.append(pieces + [pad] * (max_len - len(pieces)))
                mask_col.append([1] * len(pieces) + [0] * (max_len - len(pieces)))
            known = known if len(known) < MAX_KNOWN else {}
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids_col, mask_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cols)], *lists], names=[*cols, "ids", "mask"])

    return data.mapInArrow(run, schema).select(*cols, "ids", "mask")


def character_vocab() -> dict[str, int]:
    """A small vocabulary by rule: the specials, then every printable ASCII character and its ``##`` form."""
    vocab = {t: i for i, t in enumerate(SPECIALS)}
    for ch in map(chr, range(33, 127)):
        for token in (ch, "##" + ch):
            vocab[token] = len(vocab)
    return vocab


def subword_vocab(path: str, suffix: str = "</w>") -> dict[str, int]:
    """A vocabulary of subwords out of a public tokenizers JSON file: the specials, then every text of its tokens (the
    word-end mark left out) that is all printable ASCII and its ``##`` form, in the order of the file's ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    texts = dict.fromkeys(t.removesuffix(suffix) for t, _ in sorted(tokens.items(), key=lambda x: x[1]))
    vocab = {t: i for i, t in enumerate(SPECIALS)}
    for t in texts:
        if t and all("!" <= ch <= "~" for ch in t):
            vocab[t], vocab["##" + t] = len(vocab), len(vocab) + 1
    return vocab


def vocab_from_corpus(df: DataFrame, text: str = "text", min_count: int = 5) -> DataFrame:
    """A vocabulary table (token, id) derived by Spark: the rule-made character tokens, then every word of at
    least ``min_count`` occurrences, by count. A table, as it grows with the corpus; the caller collects it or not."""
    from pyspark.sql import Window
    base = character_vocab()
    spark = df.sparkSession
    words = (df.select(F.explode(basic_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
             .filter((F.col("n") >= min_count) & ~F.col("token").isin(*base)))
    # numbered by (count class, count, token); a count class is the position of the count's highest bit
    size = F.length(F.bin("n"))
    words = words.withColumn("k", size)
    later = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    classes = words.groupBy("k").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(later), F.lit(0))).drop("c")
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "token"))
    ids = words.join(classes, "k").select("token", (F.lit(len(base) - 1) + F.col("before") + place).cast("int").alias("id"))
    return spark.createDataFrame(list(base.items()), "token string, id int").unionByName(ids)
