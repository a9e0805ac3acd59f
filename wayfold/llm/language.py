"""Language of free texts by cross-parsing against suffix automata."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

UNKNOWN = "und"
BATCH_CHARACTERS = 1 << 19


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that accepts every substring's continuation of ``text``."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Parser:
    """Row of ``table`` for each word: its letters, then its phrases in every language.

    The automata of all languages stand in one hash table of arrays (state and letter to
    state); unseen words of many texts are spelt side by side, letter by letter.
    """

    LIMIT = 1 << 16
    FEW = 32
    _SPREAD = 0x9E3779B97F4A7C15

    def __init__(self, sample: dict[str, str]):
        self.rows: dict[str, int] = {}
        self.langs = sorted(sample)
        # a longer sample yields longer matches by chance: each phrase costs the bits of a place in it
        self.bits = np.array([math.log2(2 + len(sample[k])) for k in self.langs])
        self.table = np.zeros((1024, 1 + len(self.langs)), dtype=np.int32)
        self.letters = {c: i for i, c in enumerate(sorted({" ", *"".join(sample.values())}), 1)}
        self.wide = len(self.letters) + 1
        # number of each code point: -2 not met yet, -1 no letter, 0 a letter outside the samples
        self.codes = np.full(0x110000, -2, dtype=np.int32)
        self.base = np.zeros(len(self.langs), dtype=np.int64)
        self.fresh = np.zeros((len(self.langs), self.wide), dtype=np.int64)
        keys, targets, states = [], [], 0
        for i, k in enumerate(self.langs):
            step = suffix_automaton(sample[k])
            self.base[i] = states
            self.fresh[i] = states
            for ch, to in step[0].items():
                self.fresh[i, self.letters[ch]] = to + states
            sizes = np.fromiter(map(len, step), dtype=np.int64, count=len(step))
            letter = np.fromiter((self.letters[ch] for s in step for ch in s), dtype=np.int64, count=int(sizes.sum()))
            keys.append(np.repeat(np.arange(len(step)) + states, sizes) * self.wide + letter)
            targets.append(np.fromiter((to for s in step for to in s.values()), dtype=np.int64, count=len(letter)) + states)
            states += len(step)
        self._fill(np.concatenate([*keys, np.empty(0, np.int64)]), np.concatenate([*targets, np.empty(0, np.int64)]))

    def _fill(self, keys: np.ndarray, targets: np.ndarray) -> None:
        size = max(1, (2 * len(keys)).bit_length())
        self.shift, self.mask = 64 - size, (1 << size) - 1
        self.keys, self.targets = np.full(1 << size, -1, dtype=np.int64), np.zeros(1 << size, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.targets[slot[mine]] = targets[mine]
            keys, targets, slot = keys[~mine], targets[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(self._SPREAD)) >> np.uint64(self.shift)).astype(np.int64)

    def _next(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """State after the letter, -1 where there is none."""
        key = (state * self.wide + letter).ravel()
        slot = self._slot(key)
        got = self.keys[slot]
        far = np.flatnonzero((got != key) & (got >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) & self.mask
            got[far] = self.keys[slot[far]]
            far = far[(got[far] != key[far]) & (got[far] >= 0)]
        return np.where(got == key, self.targets[slot], -1).reshape(state.shape)

    def _finish(self, i: int, state: int, letters: list[int]) -> int:
        """Phrases that the rest of one word ends in one language, beginning in a state."""
        n, base, fresh = 0, int(self.base[i]), self.fresh[i]
        for c in letters:
            key = state * self.wide + c
            slot = ((key * self._SPREAD) & 0xFFFFFFFFFFFFFFFF) >> self.shift
            while (got := self.keys.item(slot)) != key and got >= 0:
                slot = (slot + 1) & self.mask
            if got == key:
                state = self.targets.item(slot)
            else:
                n += state != base
                state = fresh.item(c)
                n += state == base
        return n + (state != base)

    def _spell(self, words: list[str]) -> np.ndarray:
        """Letters and phrases of words (longest matches needed to spell them; an unseen letter is a phrase of its own)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        for c in np.unique(points[self.codes[points] == -2]).tolist():
            self.codes[c] = self.letters.get(chr(c), 0) if chr(c).isalpha() else -1
        code = self.codes[points].astype(np.int64)
        is_letter = code >= 0
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        spelt = np.bincount(np.repeat(np.arange(len(words)), sizes)[is_letter], minlength=len(words))
        code = code[is_letter]
        order = np.argsort(-spelt, kind="stable")
        length = spelt[order]
        start = (np.cumsum(spelt) - spelt)[order]
        # every word begins with a space, as each of the sample's does
        state = np.repeat(self.fresh[:, [self.letters[" "]]], len(words), axis=1)
        n = np.zeros(state.shape, dtype=np.int64)
        base, j = self.base[:, None], 0
        while (m := int(np.searchsorted(-length, -j, side="left"))) > self.FEW:
            c = code[start[:m] + j]
            at, fresh = state[:, :m], self.fresh[:, c]
            to = self._next(at, c)
            stuck = to < 0
            n[:, :m] += stuck * ((at != base).astype(np.int64) + (fresh == base))
            state[:, :m] = np.where(stuck, fresh, to)
            j += 1
        n[:, m:] += (state[:, m:] != base) & (length[m:] > 0)
        for w in range(m):
            rest = code[start[w] + j:start[w] + length[w]].tolist()
            for i in range(len(self.langs)):
                n[i, w] += self._finish(i, int(state[i, w]), rest)
        out = np.zeros((len(words), 1 + len(self.langs)), dtype=np.int32)
        out[order, 0] = length
        out[order, 1:] = n.T
        return out

    def parse(self, texts: list[str]) -> np.ndarray:
        """Letters and phrases of each text."""
        got = [t.lower().split() for t in texts]
        every = [w for t in got for w in t]
        if len(self.rows) > self.LIMIT:
            self.rows.clear()
        new = list(set(every) - self.rows.keys())
        if new:
            first = len(self.rows)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first:first + len(new)] = self._spell(new)
            self.rows.update(zip(new, range(first, first + len(new))))
        rows = np.fromiter(map(self.rows.__getitem__, every), dtype=np.int64, count=len(every))
        ends = np.cumsum([len(t) for t in got], dtype=np.int64)
        sums = np.concatenate([np.zeros((1, self.table.shape[1]), np.int64), np.cumsum(self.table[rows], axis=0, dtype=np.int64)])[ends]
        return np.diff(sums, axis=0, prepend=np.zeros((1, sums.shape[1]), np.int64))


_parsers: dict[str, Parser] = {}


def training_sample(records: DataFrame, key: str, text: str, label: str, texts_per_language: int) -> dict[str, str]:
    """Distinct words of at most ``texts_per_language`` labelled texts of each language, chosen by hash.

    Languages with a long tail of texts are thinned before they are ranked, so
    no task orders all texts of one language.
    """
    rows = records.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.length(text)).alias("h"),
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 4.0 * texts_per_language / n))])
    thin = rows.filter((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) <= share[F.col("lang")])
    w = Window.partitionBy("lang").orderBy("h", "text")
    chosen = thin.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= texts_per_language)
    seen: dict[str, set] = {k: set() for k in sizes}
    for r in chosen.select("lang", "text").toLocalIterator():
        seen[r["lang"]].update("".join(c for c in w if c.isalpha()) for w in r["text"].lower().split())
    return {k: " " + " ".join(sorted(v - {""})) + " " for k, v in seen.items() if v - {""}}


def identify_language(
    records: DataFrame, labelled: DataFrame, key: str = "poi_id", text: str = "address", label: str = "lang",
    texts_per_language: int = 96,
) -> DataFrame:
    """Language of every record's whole text.

    ``labelled`` has ``key``, ``text`` and ``label``; a bounded sample of it
    (``texts_per_language``) becomes one suffix automaton for each language.  A
    text is cut, word by word, into the fewest longest matches with each
    language's automaton; phrases are weighted with the bits of a place in the
    sample and divided by the letters.  The smallest wins; ties go to the first
    language by name.  The project's records carry no language field, so the
    operator is general; by default it reads a point's address.

    Returns key, lang_pred, score, bits_per_letter.  ``score`` is the winner's
    share of 2^-bits over all languages (0 to 1).  Null, empty or letterless
    text: ``und``, score 0, bits null; likewise when nothing was labelled.
    Repeated rows and null keys each keep their row; other columns are not read.
    """
    kind = records.schema[key].dataType.simpleString()
    parse = _parse(records, labelled, key, text, label, texts_per_language, None)
    return records.select(F.col(key).alias("row"), F.col(text).alias("text")).mapInArrow(
        parse, f"row {kind}, lang_pred string, score double, bits_per_letter double").withColumnRenamed("row", key)


def without_unidentified(
    records: DataFrame, labelled: DataFrame, key: str = "poi_id", text: str = "address", label: str = "lang", texts_per_language: int = 96,
) -> DataFrame:
    """Records whose language :func:`identify_language` tells (not ``und``), with all their columns, in one pass."""
    parse = _parse(records, labelled, key, text, label, texts_per_language, records.columns.index(text))
    rows = records.select(F.struct(*[F.col(c) for c in records.columns]).alias("row"))
    found = rows.mapInArrow(parse, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, bits_per_letter double")
    return found.filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def _in_pieces(batches, field: int | None):
    """Slices of about BATCH_CHARACTERS (of one text at least), and their texts."""
    for b in batches:
        texts = b.column(1) if field is None else pc.struct_field(b.column(0), field)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            done = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + BATCH_CHARACTERS, side="right")))
            yield b.slice(i, j - i), [t or "" for t in texts.slice(i, j - i).to_pylist()]
            i = j


def _parse(records: DataFrame, labelled: DataFrame, key: str, text: str, label: str, texts_per_language: int, field: int | None):
    """Rows of a payload and a text (or with the text as a field of the payload): payload, language, score, bits per letter."""
    sample = training_sample(labelled, key, text, label, texts_per_language)
    shared = records.sparkSession.sparkContext.broadcast(sample)
    name = repr(sorted((k, len(v), hash(v)) for k, v in sample.items()))

    def run(batches):
        if name not in _parsers:
            _parsers.clear()
            _parsers[name] = Parser(shared.value)
        p = _parsers[name]
        for b, texts in _in_pieces(batches, field):
            lang, score, cost = [], [], []
            for got in p.parse(texts):
                if not p.langs or got[0] == 0:
                    lang.append(UNKNOWN), score.append(0.0), cost.append(None)
                    continue
                bits = got[1:] * p.bits
                i = int(np.argmin(bits))
                lang.append(p.langs[i])
                score.append(float(1.0 / np.exp2(np.maximum(bits[i] - bits, -1000.0)).sum()))
                cost.append(float(bits[i] / got[0]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64())],
                names=["row", "lang_pred", "score", "bits_per_letter"],
            )

    return run
