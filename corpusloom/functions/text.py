"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import WHITE_SPACE, WHITE_SPACE_POINTS

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: A run of the white space that words are split at. The first class is wider and has few members to ask: most characters, of any script, are told by it alone.
_LATIN = "".join(f"\\x{c:02X}" for low, high in WHITE_SPACE_POINTS for c in range(low, high + 1) if c < 0x100)
_RANGES = [(low, high) for low, high in WHITE_SPACE_POINTS if low > 0xFF]
_OTHERS = "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in _RANGES)
WORD_GAP = f"[{_LATIN}\\x{{{_RANGES[0][0]:X}}}-\\x{{{_RANGES[-1][1]:X}}}&&[{_LATIN}{_OTHERS}]]+"


def nfc(text: Column) -> Column:
    """Canonical composition. ASCII text is left alone; the composer that Spark ships is called for the rest.

    Null stays null. operators.normalize_udf is the same in an Arrow UDF, for a Spark without that class.
    """
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.isNull() | (F.length(text) == F.octet_length(text)), text).otherwise(composed)


def clean(text: Column) -> Column:
    """What normalisation does after composition: control characters go, three line feeds or more become two, ends are stripped."""
    text = F.regexp_replace(text, CONTROL, "")
    return F.btrim(F.regexp_replace(text, "\n{3,}", "\n\n"), F.lit(WHITE_SPACE))


def normalize_text(text: Column) -> Column:
    """NFC, control characters removed, blank lines limited to one, Unicode white space stripped at both ends."""
    return clean(nfc(text))


def words(text: Column) -> Column:
    """Words between runs of Unicode white space; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous runs of n tokens; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def joined_ngrams(tokens: Column, n: int) -> Column:
    """Contiguous runs of n words, each as one string with a space between words, which hold no white space themselves.

    Strings, unlike arrays, are hashed when they are told apart.
    """
    if n == 1:
        return tokens
    follow = lambda x, i: F.concat_ws(" ", x, *[F.get(tokens, i + k) for k in range(1, n)])
    return F.when(F.size(tokens) >= n, F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - n + 1), follow)).otherwise(F.array().cast("array<string>"))


def distinct_n(tokens: Column, n: int) -> Column:
    """Distinct n-grams of words over all n-grams, 0.0 if there are none."""
    return F.when(F.size(tokens) >= n, F.size(F.array_distinct(joined_ngrams(tokens, n))) / (F.size(tokens) - n + 1)).otherwise(F.lit(0.0))


def char_length(text: Column) -> Column:
    return F.length(text).cast("long")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def wrap_special(ids: Column, bos: int, eos: int) -> Column:
    """Ids between the begin and end marks."""
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def cut_at_end(ids: Column, eos: int) -> Column:
    """Ids before the first end mark, all if there is none."""
    at = F.array_position(ids, F.lit(eos))
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def last_block(ids: Column, block: int) -> Column:
    """The last `block` ids."""
    return F.when(F.size(ids) > block, F.slice(ids, -block, block)).otherwise(ids)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 where bottom is 0 or null."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))
