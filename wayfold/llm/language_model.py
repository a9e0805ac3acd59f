"""Hierarchical Pitman-Yor language model: seating sampled in parallel, texts scored by averaged predictions."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wayfold.llm.common import WordHashes, golomb_pack, golomb_unpack, keep_buckets, keep_table, shuffle_width, text_bytes, words
from wayfold.llm.jaccard_join import _mix
from wayfold.runtime import spool

END = b"\n"
OWN_CONTEXTS = 1 << 15
# contexts beyond the most frequent are told apart by so many bits
CONTEXT_BITS = 48
BLOCK_TOKENS = 1 << 20
OWNER_TOKENS = 1 << 20
STRENGTH = 1.0
EXACT_SEATS = 256
PIECE_TOKENS = OWNER_TOKENS >> 4
TOKEN_LISTS = ("codes", "tokens", "rare", "n_train")
# sums of logarithms travel as whole numbers: units of the model's and of the base's
UNITS = (1e-7, 1e-9)


def pack_numbers(values: np.ndarray) -> bytes:
    """Rows of whole numbers, compressed with bytes of equal weight side by side."""
    planes = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(blob: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(rows, -1)


def _pack_words(v: np.ndarray, frequent: np.ndarray) -> bytes:
    """Sorted distinct words: places of frequent ones, hashes of the others."""
    at = np.searchsorted(frequent, v)
    at[at == len(frequent)] = 0
    own = (frequent[at] == v) if len(frequent) else np.zeros(len(v), bool)
    places = golomb_pack(at[own].astype(np.uint64))
    return struct.pack("<I", len(places)) + places + golomb_pack(v[~own])


def _unpack_words(blob: bytes, frequent: np.ndarray) -> np.ndarray:
    n = 4 + struct.unpack_from("<I", blob)[0]
    return np.sort(np.concatenate([frequent[golomb_unpack(blob[4:n]).astype(np.int64)], golomb_unpack(blob[n:])]))


def _pack_tokens(runs: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> bytes:
    halves = np.concatenate([ctx, doc]).astype("<u2").view(np.uint8).reshape(2, -1, 2)
    raw = np.ascontiguousarray(runs.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() + np.ascontiguousarray(halves.transpose(0, 2, 1)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack_tokens(blob: bytes, words_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    runs = np.ascontiguousarray(raw[:4 * words_].reshape(4, -1).T).view("<u4").ravel()
    ctx, doc = np.ascontiguousarray(raw[4 * words_:].reshape(2, 2, -1).transpose(0, 2, 1)).view("<u2").reshape(2, -1)
    return runs, ctx, doc


def _pack_contexts(all_: np.ndarray, at: np.ndarray) -> bytes:
    """Contexts of tokens as places ``at`` in a sorted list: the distinct ones, then each token's place among them."""
    used, place = np.unique(at, return_inverse=True)
    own = golomb_pack(all_[used])
    planes = np.ascontiguousarray(place.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return struct.pack("<I", len(own)) + own + zstandard.ZstdCompressor(level=3).compress(planes)


def _unpack_contexts(blob: bytes) -> np.ndarray:
    n = 4 + struct.unpack_from("<I", blob)[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[n:]), np.uint8).reshape(4, -1)
    return golomb_unpack(blob[4:n])[np.ascontiguousarray(planes.T).view("<u4").ravel()]


def _stream(batches, limit=BLOCK_TOKENS):
    """(first row of the block, keys, flags, word hashes, text lengths) of blocks of texts."""
    hashes = WordHashes()
    end = hashes.of([END])
    keys, flags, got, n, total = [], [], [], [], 0
    for b in batches:
        for k, f, t in zip(*(b.column(i).to_pylist() for i in range(3))):
            h = np.concatenate([hashes.of(words(t)), end])
            keys.append(k), flags.append(f), got.append(h), n.append(len(h))
            total += len(h)
            if total >= limit or len(keys) == 0xFFFF:
                yield keys, np.array(flags, dtype=bool), np.concatenate(got), np.array(n)
                keys, flags, got, n, total = [], [], [], [], 0
    if keys:
        yield keys, np.array(flags, dtype=bool), np.concatenate(got), np.array(n)


def _word_counts(batches):
    for _, held, h, n in _stream(batches):
        v, c = np.unique(h[np.repeat(~held, n)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c)], names=["word", "n"])


def _send(frequent: np.ndarray, rank: np.ndarray, pieces: np.ndarray, owners: int, kind):
    """Tokens of a block by owner: sorted distinct words, run lengths, then context and text of each token, and hashes of the contexts that have no rank.

    The block's first row also names its texts, those to learn from first.  A word's tokens
    have one owner; those of words too frequent for that are spread by context, over as many
    owners as their count calls for.
    """
    from pyspark import TaskContext

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        end = WordHashes().of([END])[0]
        for keys, held, h, n in _stream(batches):
            block, seq = (part << 24) | seq, seq + 1
            at = np.searchsorted(frequent, h)
            at[at == len(frequent)] = 0
            own = (frequent[at] == h) if len(frequent) else np.zeros(len(h), bool)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            before = np.empty_like(h)
            before[1:], before[first] = h[:-1], end
            at_b = np.searchsorted(frequent, before)
            at_b[at_b == len(frequent)] = 0
            known = (frequent[at_b] == before) if len(frequent) else np.zeros(len(h), bool)
            far, far_at = np.unique(_mix(before[~known]) >> np.uint64(64 - CONTEXT_BITS), return_inverse=True)
            number = np.empty(len(h), dtype=np.int64)
            number[known], number[~known] = rank[at_b[known]], far[far_at].astype(np.int64)
            # frequent contexts by rank, then the block's others in the order of their hashes
            ctx = np.empty(len(h), dtype=np.int64)
            ctx[known], ctx[~known] = rank[at_b[known]], far_at + len(frequent)
            piece = np.where(own, number % pieces[at], 0) if len(pieces) else np.zeros(len(h), np.int64)
            owner = (_mix(h + piece.astype(np.uint64)) % np.uint64(owners)).astype(np.int32)
            line_up = np.argsort(held, kind="stable")
            place = np.empty(len(n), np.int64)
            place[line_up] = np.arange(len(n))
            doc = np.repeat(place, n)
            order = np.lexsort((ctx << 16 | doc, h, owner))
            h, ctx, doc, owner = h[order], ctx[order], doc[order], owner[order]
            edges = np.searchsorted(owner, np.arange(owners + 1))
            out = ([], [], [], [], [])
            for o, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    v, c = np.unique(h[a:b], return_counts=True)
                    x = ctx[a:b]
                    others = _pack_contexts(far, x[x >= len(frequent)] - len(frequent))
                    for x, y in zip(out, (o, block, _pack_words(v, frequent), _pack_tokens(c, np.minimum(x, len(frequent)), doc[a:b]), others)):
                        x.append(y)
            more = [None] * (len(out[0]) - 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.binary()) for x in out[2:]),
                pa.array([int((~held).sum())] * len(out[0]), pa.int32()),
                pa.array([[keys[i] for i in line_up], *more], pa.list_(kind)), pa.array([n[line_up].tolist(), *more], pa.list_(pa.int64())),
            ], names=["owner", "block", *TOKEN_LISTS, "keys", "n_tokens"])

    return run


def _tokens_of(blocks, frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context, training flag, place (block number << 16 | text) of an owner's tokens; its contexts without a rank.

    These are numbered after the frequent ones, in the order of their hashes.
    """
    h, ctx, far, train, place = [], [], [], [], []
    for i, (codes, tokens, others, n_train) in enumerate(blocks):
        v = _unpack_words(codes, frequent)
        runs, c, doc = _unpack_tokens(tokens, len(v))
        doc = doc.astype(np.int64)
        h.append(np.repeat(v, runs))
        ctx.append(c)
        far.append(_unpack_contexts(others))
        train.append(doc < n_train)
        place.append(doc + (i << 16))
    ctx = np.concatenate(ctx).astype(np.int64)
    rare, at = np.unique(np.concatenate(far), return_inverse=True)
    ctx[ctx == len(frequent)] = at + len(frequent)
    return np.concatenate(h), ctx, np.concatenate(train), np.concatenate(place), rare


def _pairs(h, ctx, train):
    """Distinct words, training count of each (context, word) pair, pair of each token."""
    v, w = np.unique(h, return_inverse=True)
    key, pair = np.unique((w.astype(np.uint64) << np.uint64(32)) | ctx.astype(np.uint64), return_inverse=True)
    count = np.bincount(pair, weights=train, minlength=len(key)).astype(np.int64)
    return v, (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count, pair


def _restaurants(frequent):
    """An owner's blocks and its training pairs, in one row."""
    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_pylist() for c in TOKEN_LISTS]
        h, ctx, train, _, rare = _tokens_of(zip(*cols), frequent.value)
        v, w, c, n, _ = _pairs(h[train], ctx[train], np.ones(int(train.sum()), bool))
        one = lambda x: pa.array([x], pa.binary())
        return pa.table({
            "owner": table.column("owner")[:1], "words": one(golomb_pack(v)), "runs_w": one(np.bincount(w, minlength=len(v)).astype("<u4").tobytes()),
            "ctx_w": one(c.astype("<u4").tobytes()), "n_w": one(n.astype("<u4").tobytes()), "contexts": one(golomb_pack(rare)),
            "blocks": pa.array([table.column("block").to_pylist()], pa.list_(pa.int64())),
            **{k: pa.array([table.column(k).to_pylist()], pa.list_(table.column(k).type)) for k in (*TOKEN_LISTS, "keys", "n_tokens")},
        })

    return run


def seat(rng, customers: np.ndarray, discount: float, strength, parent: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers are seated anew, one after another.

    A customer opens a table with weight (strength) * parent and joins one of the
    dish's with weight (seated - discount * tables).  From EXACT_SEATS on, customers
    come in groups of a sixteenth of those seated, with one chance for the group.
    """
    order = np.argsort(-customers, kind="stable")
    left = customers[order]
    tables = (left > 0).astype(np.float64)
    open_weight = (np.broadcast_to(strength, customers.shape) * parent)[order]
    j, top = 1, int(left[0]) if len(left) else 0
    while j < top:
        live = int(np.searchsorted(-left, -j, side="left"))
        size = 1 if j < EXACT_SEATS else j // 16
        t, o = tables[:live], open_weight[:live]
        chance = o / (o + np.maximum(j - discount * t, 1e-9))
        if size == 1:
            t += rng.random(live) < chance
        else:
            t += rng.binomial(np.minimum(size, left[:live] - j), chance)
        j += size
    out = np.empty(len(customers))
    out[order] = tables
    return out


class Kitchen:
    """Seating of one owner's dishes, given what all owners share."""

    def __init__(self, row: dict, shared: dict):
        self.s = shared
        self.words = golomb_unpack(row["words"])
        self.word = np.repeat(np.arange(len(self.words)), np.frombuffer(row["runs_w"], "<u4"))
        self.ctx = np.frombuffer(row["ctx_w"], "<u4").astype(np.int64)
        self.rare = golomb_unpack(row["contexts"])
        # tables and customers of every context met here: those of all owners' frequent ones, then those sent for the others
        sent = [unpack_numbers(p["totals"], 2) for p in row.get("parts") or []]
        far = np.concatenate(sent, axis=1) if sent else np.zeros((2, len(self.rare)))
        self.T2, self.c2 = (np.concatenate([shared[k], x]) for k, x in zip(("T2", "c2"), far))
        self.n = np.frombuffer(row["n_w"], "<u4").astype(np.int64)
        at = np.searchsorted(shared["frequent"], self.words)
        at[at == len(shared["frequent"])] = 0
        self.hot = (shared["frequent"][at] == self.words) if len(shared["frequent"]) else np.zeros(len(self.words), bool)
        self.hot_at = at
        self.rng = np.random.default_rng([shared["seed"], shared["round"], row["owner"]])
        self.tables = (self.n > 0).astype(np.float64)
        self.gather()

    def gather(self) -> None:
        """Customers of the parent restaurant: every table sends one; frequent words' come from all owners."""
        s = self.s
        up = np.bincount(self.word, weights=self.tables, minlength=len(self.words))
        up[self.hot] = s["hot_up"][self.hot_at[self.hot]]
        top = seat(self.rng, up.astype(np.int64), s["d1"], STRENGTH + s["d1"] * s["T1"], np.full(len(up), s["uniform"]))
        self.parent = self.above(up, top)

    def above(self, up, top):
        s = self.s
        return (np.maximum(up - s["d1"] * top, 0) + (STRENGTH + s["d1"] * s["T1"]) * s["uniform"]) / (STRENGTH + s["C1"])

    def sweep(self) -> None:
        s = self.s
        strength = STRENGTH + s["d2"] * self.T2[self.ctx]
        self.tables = seat(self.rng, self.n, s["d2"], strength, self.parent[self.word])
        self.gather()

    def predict(self, word: np.ndarray, ctx: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of pairs; ``word`` -1: a word without training tokens."""
        s = self.s
        unknown = (STRENGTH + s["d1"] * s["T1"]) * s["uniform"] / (STRENGTH + s["C1"])
        up = np.where(word >= 0, self.parent[word] if len(self.parent) else unknown, unknown)
        total = self.c2[ctx]
        own = np.maximum(n - s["d2"] * tables, 0) + (STRENGTH + s["d2"] * self.T2[ctx]) * up
        return own / (STRENGTH + total)


def _rows(b: pa.RecordBatch):
    for i in range(b.num_rows):
        yield {name: b.column(name)[i].as_py() for name in b.schema.names}


def _seating(shared, sweeps: int, parts: int):
    """Tables and customers of each restaurant at an owner after some sweeps; of contexts without a rank, packed by part of their hashes."""
    def run(batches):
        s = shared.value
        for b in batches:
            for row in _rows(b):
                k = Kitchen(row, s)
                for _ in range(sweeps):
                    k.sweep()
                m = len(s["frequent"])
                t2 = np.bincount(k.ctx, weights=k.tables, minlength=m + len(k.rare))
                up = np.bincount(k.word, weights=k.tables, minlength=len(k.words))
                c2 = np.bincount(k.ctx, weights=k.n, minlength=len(t2))
                hot = k.hot_at[k.hot]
                kinds = [("t2", np.flatnonzero(t2[:m]), t2), ("c2", np.flatnonzero(c2[:m]), c2)]
                out = [(kind, at, x[at]) for kind, at, x in kinds] + [("hot", hot, up[k.hot])]
                cold = up[~k.hot]
                top = seat(k.rng, cold.astype(np.int64), s["d1"], STRENGTH + s["d1"] * s["T1"], np.full(len(cold), s["uniform"])) if len(cold) else cold
                few = [(k.n == 1).sum(), (k.n == 2).sum(), (cold == 1).sum(), (cold == 2).sum(), cold.sum(), top.sum()]
                out.append(("sum", np.arange(len(few)), np.array(few, dtype=float)))
                # parts are ranges of hashes, so an owner's parts in order are its whole list
                edges = np.searchsorted(k.rare, [-(-(i << CONTEXT_BITS) // parts) for i in range(1, parts)])
                cuts = [0, *np.asarray(edges).tolist(), len(k.rare)]
                far = [(i, golomb_pack(k.rare[a:b]), pack_numbers(np.array([t2[m + a:m + b], c2[m + a:m + b]]).astype("<i8")))
                       for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                n = sum(len(at) for _, at, _ in out)
                none = [None] * n
                yield pa.RecordBatch.from_arrays([
                    pa.array([kind for kind, at, _ in out for _ in range(len(at))] + ["rare"] * len(far)),
                    pa.array(np.concatenate([*(at for _, at, _ in out), [i for i, *_ in far]]).astype(np.int32)),
                    pa.array(np.concatenate([*(x for *_, x in out), np.zeros(len(far))]).astype(float)),
                    pa.array([row["owner"]] * (n + len(far)), pa.int32()),
                    pa.array(none + [x for _, x, _ in far], pa.binary()), pa.array(none + [x for *_, x in far], pa.binary()),
                ], names=["kind", "i", "x", "owner", "contexts", "totals"])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Tables and customers of one part's contexts over all owners, for every owner in the order it sent them."""
    sent = [golomb_unpack(x) for x in table.column("contexts").to_pylist()]
    of = np.unique(np.concatenate(sent), return_inverse=True)[1]
    here = np.concatenate([unpack_numbers(x, 2) for x in table.column("totals").to_pylist()], axis=1)
    whole = np.array([np.bincount(of, weights=x).astype(np.int64)[of] for x in here])
    ends = np.cumsum([len(x) for x in sent])
    return pa.table({
        "owner": table.column("owner"), "part": table.column("i"),
        "totals": pa.array([pack_numbers(x) for x in np.split(whole, ends[:-1], axis=1)], pa.binary())})


def _scores(shared, burn_in: int, samples: int):
    """Sums over each text's tokens of an owner: model and base log10 probabilities, known tokens."""
    def run(batches):
        s = shared.value
        for b in batches:
            for row in _rows(b):
                k = Kitchen(row, s)
                h, ctx, train, place, _ = _tokens_of(zip(*(row[c] for c in TOKEN_LISTS)), s["frequent"])
                v, w, c, n, pair = _pairs(h, ctx, train)
                at = np.searchsorted(k.words, v)
                at[at == len(k.words)] = 0
                known = (k.words[at] == v) if len(k.words) else np.zeros(len(v), bool)
                word = np.where(known, at, -1)[w]
                # training pairs stand in the same order in both lists
                mine = np.flatnonzero(n > 0)
                for _ in range(burn_in):
                    k.sweep()
                p = np.zeros(len(n))
                for _ in range(samples):
                    k.sweep()
                    tables = np.zeros(len(n))
                    tables[mine] = k.tables
                    p += k.predict(word, c, n, tables)
                model = np.log10(p / samples)
                count = np.bincount(k.word, weights=k.n, minlength=len(k.words))
                count[k.hot] = s["hot_n"][k.hot_at[k.hot]]
                of = np.where(word >= 0, count[word] if len(count) else 0, 0)
                # frequent words may be known from other owners only
                lone = (word < 0) & np.isin(v, s["frequent"])[w]
                if lone.any():
                    i = np.searchsorted(s["frequent"], v[w[lone]])
                    of[lone] = s["hot_n"][i]
                    top = seat(k.rng, s["hot_up"][i].astype(np.int64), s["d1"], STRENGTH + s["d1"] * s["T1"], np.full(len(i), s["uniform"]))
                    up = k.above(s["hot_up"][i], top)
                    model[lone] = np.log10((STRENGTH + s["d2"] * k.T2[c[lone]]) * up / (STRENGTH + k.c2[c[lone]]))
                base = np.log10((of + 1) / (s["N"] + (s["V"] + 1.0)))
                slots, slot = np.unique(place, return_inverse=True)
                sums = [np.bincount(slot, weights=x[pair], minlength=len(slots)) for x in (model, base, (of > 0).astype(float))]
                sums = [np.rint(-sums[0] / UNITS[0]), np.rint(-sums[1] / UNITS[1]), sums[2]]
                cut = np.searchsorted(slots, np.arange(len(row["blocks"]) + 1) << 16)
                part = lambda i, j: pack_numbers(np.array([np.diff(slots[i:j] & 0xFFFF, prepend=0), *(x[i:j] for x in sums)]).astype("<i8"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["blocks"], pa.int64()), pa.array([part(i, j) for i, j in zip(cut, cut[1:])], pa.binary()),
                    pa.array(row["n_train"], pa.int32()), pa.array(row["keys"], b.column("keys").type.value_type),
                    pa.array(row["n_tokens"], pa.list_(pa.int64())),
                ], names=["block", "sums", "n_train", "keys", "n_tokens"])

    return run


def _texts(total: int, key: str):
    """Texts of one block from the sums of all owners."""
    def run(parts: pa.Table) -> pa.Table:
        at = next(i for i, x in enumerate(parts.column("keys").is_valid().to_pylist()) if x)
        keys, n = (parts.column(c)[at].values for c in ("keys", "n_tokens"))
        held = np.arange(len(keys)) >= parts.column("n_train")[at].as_py()
        sums = np.zeros((3, len(keys)), np.int64)
        for blob in parts.column("sums").to_pylist():
            texts, *more = unpack_numbers(blob, 4)
            sums[:, np.cumsum(texts)] += more
        return pa.table({
            key: keys, "held_out": pa.array(held), "n_tokens": n, "n_known": pa.array(sums[2]),
            "train_tokens": pa.array([total] * len(keys), pa.int64()), "base_score": pa.array(-sums[1] * UNITS[1]), "score": pa.array(-sums[0] * UNITS[0]),
        })

    return run


def score_texts(
    pois: DataFrame, held_out, key: str = "poi_id", text: str = "address", rounds: int = 2, burn_in: int = 1, samples: int = 2, seed: int = 7,
) -> DataFrame:
    """Hierarchical Pitman-Yor scores of whole texts, learnt from the rows where ``held_out`` is false.

    Words stand between ASCII white space, A-Z lower-cased; every text (null:
    empty) ends with one end token.  A word's context is the word before it (the
    end token at the start); every context has a restaurant of its own.  All share one
    parent restaurant over words, and that a uniform base.  Discounts come from counts of counts.

    Words are owned by hash (frequent ones by word and context), so a dish's
    customers, tables and parent share are in one place whatever its count.  A round
    re-seats all customers of every dish given the other dishes' tables of the
    round before (Gibbs sampling of whole dishes, in parallel) and adds up the
    tables of each restaurant (those of the most frequent contexts in one table for
    all, those of the others by range of their hashes, for the owners that hold them); in the last round predictions are averaged over
    ``samples`` seatings after ``burn_in``.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram, log10), score (log10 probability; perplexity is 10^(-score/n_tokens)).
    Words are told apart by 64-bit hashes, contexts by 48 bits of them.  Repeated rows are scored each and counted
    each; an empty table gives no rows; other columns are not read.
    """
    spark = pois.sparkSession
    kind = pois.schema[key].dataType
    rows = pois.select(F.col(key).alias("key"), held_out.alias("held"), text_bytes(text).alias("text"))
    counts = spool(rows.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    best = counts.orderBy(F.desc("n"), "word").limit(OWN_CONTEXTS).collect()
    hot = np.array([r["word"] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    frequent, rank = hot[order], np.arange(len(hot))[order]
    owners = max(1, math.ceil(1.2 * total / OWNER_TOKENS))
    from pyspark.sql.pandas.types import to_arrow_type

    name = kind.simpleString()
    pieces = np.array([-(-r["n"] // PIECE_TOKENS) for r in best], dtype=np.int64)[order]
    sent = rows.mapInArrow(
        _send(frequent, rank, pieces, owners, to_arrow_type(kind)),
        f"owner int, block bigint, codes binary, tokens binary, rare binary, n_train int, keys array<{name}>, n_tokens array<bigint>")
    width = shuffle_width(pois)
    kept = keep_buckets(sent.groupBy("owner").applyInArrow(
        _restaurants(spark.sparkContext.broadcast(frequent)),
        f"owner int, words binary, runs_w binary, ctx_w binary, n_w binary, contexts binary, blocks array<bigint>, codes array<binary>, tokens array<binary>, rare array<binary>, "
        f"n_train array<int>, keys array<array<{name}>>, n_tokens array<array<bigint>>"), "owner", width)
    model = kept.select("owner", "words", "runs_w", "ctx_w", "n_w", "contexts")
    parts = max(1, owners // 8)

    shared = {
        "frequent": frequent, "hot_n": np.array([r["n"] for r in best], dtype=float)[order], "hot_up": np.zeros(len(hot)), "seed": seed, "round": 0,
        "uniform": 1.0 / (vocabulary + 1), "N": float(total), "V": float(vocabulary), "d1": 0.5, "d2": 0.5, "T1": 0.0, "C1": 0.0,
        "T2": np.zeros(len(hot)), "c2": np.zeros(len(hot)),
    }
    for r in range(rounds + 1):
        shared["round"] = r
        sent_out = spark.sparkContext.broadcast(dict(shared))
        seated = keep_table((model if r == 0 else model.join(back, "owner", "left")).mapInArrow(
            _seating(sent_out, 1 if r else 0, parts), "kind string, i int, x double, owner int, contexts binary, totals binary"))
        got = seated.filter("kind <> 'rare'").groupBy("kind", "i").agg(F.sum("x").alias("x")).toPandas()
        # one row an owner, in the buckets of the kept table
        back = spool(seated.filter("kind = 'rare'").select("i", "owner", "contexts", "totals").groupBy("i").applyInArrow(
            _totals, "owner int, part int, totals binary").groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("parts"))).hint("shuffle_hash")
        of = lambda name, size: np.bincount(got.i[got.kind == name], weights=got.x[got.kind == name], minlength=size)
        shared["T2"], shared["c2"], shared["hot_up"] = of("t2", len(hot)), of("c2", len(hot)), of("hot", len(hot))
        one, two, u1, u2, cold_up, cold_top = of("sum", 6)
        hot_up = shared["hot_up"]
        if r == 0:
            bound = lambda a, b: float(min(0.95, max(0.05, a / max(1.0, a + 2 * b))))
            shared["d2"] = bound(one, two)
            shared["d1"] = bound(u1 + (hot_up == 1).sum(), u2 + (hot_up == 2).sum())
        shared["C1"] = float(cold_up + hot_up.sum())
        top = seat(np.random.default_rng([seed, r]), hot_up.astype(np.int64), shared["d1"], STRENGTH + shared["d1"] * shared["T1"], np.full(len(hot), shared["uniform"]))
        shared["T1"] = float(cold_top + top.sum())
    shared["round"] = rounds + 1
    last = spark.sparkContext.broadcast(dict(shared))
    sums = kept.join(back, "owner", "left").mapInArrow(
        _scores(last, burn_in, samples),
        f"block bigint, sums binary, n_train int, keys array<{name}>, n_tokens array<bigint>")
    return sums.groupBy("block").applyInArrow(
        _texts(int(total), key),
        f"`{key}` {name}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
