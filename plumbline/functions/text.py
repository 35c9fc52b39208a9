"""Words, n-grams and text features as column expressions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as a Unicode-aware splitter sees it, including the four ASCII separators (fixed values).
WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(text: Column) -> Column:
    """Maximal runs without white space; case and punctuation stay."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


#: Words held at once in a Python worker.
_WORDS = 1 << 19


def split_runs(texts: Iterator[list[str | None]]) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """``(words, lengths)`` of runs of texts, the words one text after the other and numbered: ``str.split`` parts at the characters of ``WHITE``. A null text has no words."""
    held, lengths = [], []
    for batch in texts:
        for t in batch:
            w = (t or "").split()
            held += w
            lengths.append(len(w))
            if len(held) >= _WORDS:
                yield pa.array(held, pa.string()).dictionary_encode(), np.array(lengths, np.int64)
                held, lengths = [], []
    if held:
        yield pa.array(held, pa.string()).dictionary_encode(), np.array(lengths, np.int64)


def windows(lengths: np.ndarray, n: int) -> np.ndarray:
    """Where a window of n words begins that lies in one text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    return np.flatnonzero(text[: max(0, len(text) - n + 1)] == text[n - 1 :]) if len(text) >= n else np.empty(0, np.int64)


def with_word_counts(df: DataFrame, held: list[str], text_col: str = "text", lines: bool = False, compressed: bool = False) -> DataFrame:
    """``(*held, n_words, ttr)``: words of each text and their type-token ratio, split once, by ``str.split``; its share of repeated lines and its compressibility too, if asked for.

    ``str.splitlines`` and ``str.strip`` part and trim at the characters of ``repeated_lines``.
    """

    def count(batches):
        for batch in batches:
            texts = batch.column(len(held)).to_pylist()
            w = [None if t is None else t.split() for t in texts]
            more = [pa.array([of(t) for t in texts], pa.float64()) for _, of in features]
            n, ttr = [None if x is None else len(x) for x in w], [len(set(x)) / len(x) if x else 0.0 for x in w]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ttr, pa.float64()), *more], names)

    rows, features = df.select(*held, text_col), [*([("repeated_lines", _repeated_lines)] if lines else []), *([("compressibility", _compressibility)] if compressed else [])]
    made = [("n_words", T.LongType()), ("ttr", T.DoubleType()), *[(c, T.DoubleType()) for c, _ in features]]
    names = [*held, *[c for c, _ in made]]
    return rows.mapInArrow(count, T.StructType([*rows.schema.fields[:-1], *[T.StructField(*c) for c in made]]))


def with_words(df: DataFrame, held: list[str], text_col: str = "text") -> DataFrame:
    """``(*held, tokens)``: the words of each text, by ``str.split``."""

    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([None if t is None else t.split() for t in batch.column(len(held)).to_pylist()], pa.list_(pa.string()))], [*held, "tokens"])

    rows = df.select(*held, text_col)
    return rows.mapInArrow(split, T.StructType([*rows.schema.fields[:-1], T.StructField("tokens", T.ArrayType(T.StringType()))]))


def word_tokens(text: Column) -> Column:
    """Runs of Unicode word characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    """Contiguous n-grams joined by ``separator``; none if there are fewer than n tokens."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), separator))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def detokenise(tokens: Column, separator: str = " ") -> Column:
    """Text of word tokens (of characters with an empty separator)."""
    return F.array_join(tokens, separator)


def subwords(vocabulary: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """``(tokenise, detokenise)`` by a tokenizer file that every worker can read: texts to ids without special tokens, and ids to text without special tokens."""

    def model():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = model()
        for column in columns:
            yield pa.array([None if t is None else found.encode(t, add_special_tokens=False).ids for t in column.to_pylist()], pa.list_(pa.int32()))

    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = model()
        for column in columns:
            yield pa.array([None if ids is None else found.decode(ids, skip_special_tokens=True) for ids in column.to_pylist()], pa.string())

    return F.arrow_udf(encode, "array<int>"), F.arrow_udf(decode, "string")


def truncate_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(words(text), 1, most), " ")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: The characters of WHITE, for trimming (fixed values).
WHITE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: F.btrim(x, F.lit(WHITE_CHARACTERS))), lambda x: x != "")
    return let(lines, lambda v: F.when(F.size(v) > 0, 1 - F.size(F.array_distinct(v)) / F.size(v)).otherwise(F.lit(0.0)))


def digit_share(text: Column) -> Column:
    return share(F.regexp_count(text, F.lit(r"\p{Nd}")), F.length(text))


def punctuation_share(text: Column) -> Column:
    # letters, numbers and Unicode white space, by their classes
    return share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\p{Z}\t-\r\x85]")), F.length(text))


def type_token_ratio(text: Column) -> Column:
    return let(words(text), lambda w: share(F.size(F.array_distinct(w)), F.size(w)))


@F.pandas_udf(T.LongType())
def zlib_bits(text):
    """Bits of the zlib-compressed UTF-8 text at the default level."""
    return text.map(lambda t: 8 * len(zlib.compress((t or "").encode())))


def _repeated_lines(t: str | None) -> float:
    lines = [y for x in (t or "").splitlines() if (y := x.strip())]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


def _compressibility(t: str | None) -> float:
    plain = (t or "").encode()
    return 1 - len(zlib.compress(plain, 6)) / max(1, len(plain))


@F.pandas_udf(T.DoubleType())
def compressibility(text):
    """1 minus compressed over plain bytes."""
    return text.map(_compressibility)
