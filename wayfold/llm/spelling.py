"""Spelling variants of words in point names and addresses, found by PartEnum signatures of letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wayfold.llm.common import text_bytes
from wayfold.runtime import spool

LEAST_LETTERS, LEAST_COUNT = 5, 3
PARTS, DIFFERENT = 4, 2
HELD_WORDS = 1 << 18

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _slipped(run: bytes, h: int) -> bytes:
    """The run without one code point, chosen by a hash."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def _counts(slip: int | None):
    def run(batches):
        held = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = Counter(_RUN.findall(text.lower()))
                if slip:
                    start = zlib.crc32(key + b":")
                    for w in [w for w in found if not zlib.crc32(w, start) % slip]:
                        n = found.pop(w)
                        held[_slipped(w, zlib.crc32(w, start))] += n
                held.update(found)
                if len(held) > HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    return run


def count_words(pois: DataFrame, key: str = "poi_id", text: str = "address", slip: int | None = None) -> DataFrame:
    """(word, n) of all maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; null texts have none.

    For trials with planted misspellings: with ``slip``, a run of whose ``<key>:<run>`` the unsigned crc32 h is
    divisible by ``slip`` loses its code point h % length (null key: empty), and counts as what is left, if anything is.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary").alias("key")
    rows = pois.select(name, text_bytes(text).alias("text")).mapInArrow(_counts(slip), "word binary, n bigint")
    return rows.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")).filter("word <> ''")


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, own, sig): two words of edit distance one share a signature that is some word's own.

    A word's letter multiset is a binary vector over (letter, how many times met before).  Its
    dimensions are dealt by letter to ``parts`` parts.  One edit changes at most DIFFERENT dimensions, so that at least ``parts``
    - DIFFERENT parts stay equal: every choice of that many parts, as they stand, is a signature.
    An edit also leaves one half of the shorter word where it was, so each choice is made once with the first and once with the last half of the word,
    for a shorter word of the word's own length (``own``) and of one letter less: this keeps anagrams apart.
    """
    size = F.length("word")
    letters = F.array_sort(F.filter(F.split("word", ""), lambda c: c != ""))
    part = lambda p: F.array_join(F.filter(F.col("letters"), lambda c: F.ascii(c) % parts == p), "")
    split = words.select("word", size.alias("size"), letters.alias("letters")).select("word", "size", *[part(p).alias(f"p{p}") for p in range(parts)])

    def signature(length: Column, half: Column, side: str, kept: tuple[int, ...]) -> Column:
        return F.xxhash64(length, F.lit(side), half, F.lit("".join(map(str, kept))), *[F.col(f"p{p}") for p in kept])

    each = []
    for less in (0, 1):
        length = F.col("size") - less
        first = (length / 2).cast("int")
        for side, half in (("first", F.left("word", first)), ("last", F.right("word", length - first))):
            for kept in combinations(range(parts), parts - DIFFERENT):
                each.append(F.struct(F.lit(less == 0).alias("own"), signature(length, half, side, kept).alias("sig")))
    return split.select("word", F.explode(F.array(*each)).alias("s")).select("word", "s.own", "s.sig")


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, near), both ways: words that differ by exactly one inserted, deleted or replaced code point."""
    sigs = signatures(words, parts)
    a = sigs.filter("own").select(F.col("word").alias("a"), "sig")
    b = sigs.select(F.col("word").alias("b"), "own", "sig")
    # of two words of one length each is met once, of others the shorter one's signature is its own
    met = a.join(b, "sig").filter(~F.col("own") | (F.col("a") < F.col("b")))
    near = met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()
    return near.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("x")).select("x.*")


def follow(links: DataFrame) -> DataFrame:
    """(word, root): where chains of (word, form) without circles end; their lengths double from round to round."""
    state = spool(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        state = spool(state.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(
    pois: DataFrame, key: str = "poi_id", text: str = "address", *, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
    slip: int | None = None, parts: int = PARTS,
) -> DataFrame:
    """Words of point names or addresses, each with the more usual word it is likely a variant of (``mesjid``: ``masjid``).

    Words are the distinct runs of letters (``count_words``, also for ``slip``) of at least ``least_letters`` code points and ``least_count``
    occurrences over all rows.  Two words are near if they differ by exactly one inserted, deleted or replaced code point.  A word's form is its near word with most
    occurrences (ties: smallest in code-point order), if these are at least twice its own.

    Returns word, n, n_near (near words), form, form_n (form's n; both null without form) and root: the last word
    reached by following forms, the word itself without form.  Null and empty texts have no words; repeated rows count each time; an empty table gives no
    rows; other columns are not read.
    """
    words = spool(count_words(pois, key, text, slip).filter((F.length("word") >= least_letters) & (F.col("n") >= least_count)))
    near = near_words(words, parts).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("form"))).alias("best"))
    usual = (-F.col("best.less")) >= 2 * F.col("n")
    table = spool(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.form")).alias("form"),
        F.when(usual, -F.col("best.less")).alias("form_n"),
    ))
    roots = follow(table.filter("form is not null").select("word", "form"))
    return table.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
