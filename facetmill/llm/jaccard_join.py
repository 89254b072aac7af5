"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets are distinct word shingles. Sets of similar size (a size band) hash their tokens into the same
number of segments. Two linked sets differ in at most D tokens, so with segments whose allotments add
up to more than D, some segment differs in less than its allotment: none (indexed by the hash of its
tokens) or one token (indexed also by the hashes with any one token left out). The allotment of a
band is chosen by cost: signatures written against chance collisions of small segments.

A band has some segments more than it needs, so linked sets have several equal signatures. Rows of a
signature that few sets have are counted in pairs, and pairs with too few equal signatures are
dropped; rows of a crowded signature are only tied to one of their ids, which loses nothing. The
components of these candidates hold every linked pair. A component of usual size is verified in one
task, every pair of it. Large ones come from common passages, and grow faster than the input; there
pairs are looked for again, by the tokens of each set that the fewest members have: linked sets share
one of them. A pair that such a token of few sets shows is verified, a hub with some of its neighbours
in a task, and what that links is one class. Only where such a token is crowded itself, blocks whose
sizes can be linked at all meet afterwards, large classes in blocks of their own, so cost doesn't grow
with the square of a family of copies. Equal sets are one class from the start. Verification
counts common tokens by matrix products over hashed 64-bit tokens and returns links that span the
components, not all pairs.

Defined results: null, empty or blank text has no shingles and is linked with nothing; fewer words
than a shingle form one shingle; repeated rows are one document twice. An id that stands on different
texts stands for each of them: whatever they are linked with is one component, and each row keeps its
own number of shingles. A row without an id takes the component of a row with an equal set, or none,
and links nothing. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches, discard, join_hot, materialize
from facetmill.llm.components import connected_components

#: Cost of a chance collision, in signatures; tokens of an average segment under which collisions are
#: likely.
COLLISION, SMALL_SEGMENT = 40.0, 5
#: Segments beyond those needed, as a share of them: the weakest of a set that its signatures skip.
EXTRA = 0.3
#: One more equal signature is needed of a pair for so many segments of its band.
EVIDENCE = 12
#: Rows up to which a signature's pairs are counted; rows of more are tied to one id. The bit of a
#: signature that is unset in the row of a lot where it is crowded, which so comes first.
CROWDED, SPARSE = 16, 16
#: Sets beyond which a token's rows are joined where they are.
HOT_TOKEN = 100_000
#: Evidence of a pair that a crowded signature ties; a pair's equal signatures add up to far less.
TIED = 1e6
#: Sample that tells common tokens: its documents, how many must hold a token, tokens kept at most.
SAMPLE_DOCS, COMMON_DOCS, COMMON_TOKENS = 5000, 3, 200_000
#: Members of a component that one task verifies, and their tokens; larger ones are split.
BLOCK, BLOCK_TOKENS = 1500, 2_000_000
#: Signatures that a task combines before sending them.
LOT = 400_000
#: Up to so many ids of members, copies, classes or blocks (32 bytes each) are sent to all executors;
#: beyond, rows are shuffled.
BROADCAST_ROWS = 1_000_000


def band_ratio(percent: int) -> float:
    """Of a band's bounds. Linked sizes differ by 100/percent at most; with its square about half of
    the sets need the next band too, and few bytes go into segments for the band's top size."""
    return (100 / percent) ** 2 if percent < 100 else 2.0


def band_of(size: int, percent: int) -> int:
    return int(np.floor(np.log(max(size, 1)) / np.log(band_ratio(percent)) + 1e-9))


def band_top(band: int, percent: int) -> int:
    """No size in the band is larger."""
    return int(np.ceil(band_ratio(percent) ** (band + 1) - 1e-6))


def allotment(band: int, percent: int) -> tuple[int, int]:
    """Segments without and with one-deletion neighbourhoods, for pairs up to the band's top size."""
    top = band_top(band, percent)
    # |X ^ Y| = |X| + |Y| - 2 |X & Y|, and |X & Y| >= t/(1+t) (|X| + |Y|).
    differ = int((100 - percent) * 2 * top // (100 + percent))
    best = None
    for deletions in range(0, differ // 2 + 2):
        exact = max(differ + 1 - 2 * deletions, 0)
        if exact + deletions == 0:
            continue
        mean = top / (exact + deletions)
        # A signature costs itself and its chance collisions; a deletion leaves a token fewer.
        one = lambda size: 1 + COLLISION * np.exp(-3 * max(size, 0) / SMALL_SEGMENT)
        cost = exact * one(mean) + deletions * (one(mean) + mean * one(mean - 1))
        if best is None or cost < best[0]:
            best = cost, exact, deletions
        if deletions > 4 and cost > 4 * best[0]:
            break
    return best[1], best[2]


def token_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text the ascending distinct hashes of its word shingles."""
    low = K.LOWER[buf]
    start, end, at = K.words(low, offs, K.WHITE)
    h = K.span_hash(K.prefix_hash(low), start, end)
    out = []
    for s, e in zip(at[:-1], at[1:]):
        w = h[s:e]
        out.append(np.unique(K.shingles(w, min(width, len(w)))) if len(w) else np.zeros(0, np.uint64))
    return out


_plans: dict[tuple[int, int], tuple[int, int, int, int]] = {}


def signatures(tokens: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The set's 64-bit signatures in its own band, and in the next ones if it can reach there.

    A band has some segments more than it needs. Each set leaves out ``extra`` of its own, the weakest:
    those with the fewest tokens outside ``common``, then the fewest tokens. No pair is lost: linked
    sets have ``extra`` + ``needed`` equal segments, and the strongest ``needed`` of these are among the
    weakest of neither. The lowest four bits of a signature tell how many a pair needs, the next one that
    no lot has found it crowded.
    """
    n = len(tokens)
    bands = [band_of(n, percent)]
    while (n * 100) // percent >= band_ratio(percent) ** (bands[-1] + 1) - 1e-6:
        bands.append(bands[-1] + 1)
    value, place = K.mix(tokens ^ np.uint64(0x5DEECE66D)), K.mix(tokens) >> np.uint64(32)
    known = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
    rare = common[known] != tokens if len(common) else np.ones(n, bool)
    out = []
    for band in bands:
        if (band, percent) not in _plans:
            exact, deletions = allotment(band, percent)
            needed = 1 if deletions else min(1 + exact // EVIDENCE, 15)
            exact += needed - 1
            _plans[band, percent] = exact, deletions, int(np.ceil(exact * EXTRA)), needed
        exact, deletions, extra, needed = _plans[band, percent]
        m = exact + deletions + extra
        segment = (place % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, value)
        near = segment >= exact + extra  # those with one-deletion neighbourhoods
        salt = K.mix(np.uint64(band << 20) + np.arange(m, dtype=np.uint64))
        mark = lambda h, needed=needed: (K.mix(h) & ~np.uint64(31)) | np.uint64(SPARSE + needed)
        whole = mark(total ^ salt)
        if extra:
            strength = np.bincount(segment[rare], minlength=m)[: exact + extra] * 4096 + np.bincount(segment, minlength=m)[: exact + extra]
            order = np.lexsort((whole[: exact + extra], strength))
            out.append(whole[order[extra:]])
            out.append(whole[exact + extra :])
        else:
            out.append(whole)
        if deletions:
            out.append(mark((total[segment[near]] - value[near]) ^ salt[segment[near]]))
    return np.unique(np.concatenate(out))


def common_tokens(docs: DataFrame, width: int, n_docs: int) -> np.ndarray:
    """Tokens that are common in a bounded sample. They only rank segments, so any sample is exact."""
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = token_sets(*K.column(batch), width)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64())], ["token"])

    counts = sample.select("id", "text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_DOCS)
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _fingerprints(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit halves for each set: sums of its tokens' hashes, so equal sets have equal ones."""
    halves = [np.array([np.add.reduce(K.mix(s ^ np.uint64(salt))) for s in sets], np.uint64) for salt in (0, 0xABCDEF987654321)]
    return [pa.array(h.view(np.int64)) for h in halves]


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """id, n_shingles and the two halves of the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = token_sets(*K.column(batch), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *_fingerprints(sets)], ["id", "n_shingles", "fp1", "fp2"])
        K.release()

    return docs.mapInArrow(run, "id long, n_shingles long, fp1 long, fp2 long")


def _combine(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lot's rows. Of a signature that is crowded in the lot alone one row stays, which says so; its other
    rows are tied to that row's id by signatures of their own. So however common a signature is, a lot
    sends one row of it."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    crowded = np.repeat(size > CROWDED, size)
    tied = crowded & (np.arange(len(sig)) > np.repeat(first, size))
    extra = np.unique(np.stack([ids[tied], np.repeat(ids[first], size)[tied]], 1), axis=0)
    extra = extra[extra[:, 0] != extra[:, 1]]
    own = K.mix(K.mix(extra[:, 0].astype(np.uint64)) ^ extra[:, 1].astype(np.uint64) ^ np.uint64(0x1234567))
    own = (own & ~np.uint64(31)) | np.uint64(SPARSE)
    sig = np.where(crowded, sig & ~np.uint64(SPARSE), sig)
    return np.concatenate([sig[~tied], own, own]), np.concatenate([ids[~tied], extra[:, 0], extra[:, 1]])


def _pairs(signed: DataFrame) -> DataFrame:
    """a, b and the evidence for the pair: 1 or more if it must be verified, ``TIED`` or more if it is tied."""
    worth = np.array([TIED, *(1 / np.arange(1, 16))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, ids, said = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # said to be crowded
        hub: tuple[int, int] | None = None  # of a crowded signature that goes on

        def found(sig: np.ndarray, ids: np.ndarray, said: np.ndarray) -> pa.RecordBatch:
            a, b, w = [], [], []
            if len(sig):
                first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                size = np.diff(np.append(first, len(sig)))
                many, tie = (size > CROWDED) | said[first], ids[first].copy()
                if hub is not None and sig[0] == hub[0]:
                    many[0], tie[0] = True, hub[1]
                many, tie = np.repeat(many, size), np.repeat(tie, size)
                a.append(ids[many]), b.append(tie[many]), w.append(np.full(many.sum(), TIED))
                for d in range(1, min(CROWDED, len(sig))):
                    at = np.flatnonzero((sig[d:] == sig[:-d]) & ~many[d:])
                    if not len(at):
                        break
                    x, y = ids[at + d], ids[at]
                    a.append(np.maximum(x, y)), b.append(np.minimum(x, y)), w.append(worth[sig[at] & 15])
            columns = [np.concatenate(x) if x else np.zeros(0) for x in (a, b, w)]
            keep = columns[0] != columns[1]
            return pa.RecordBatch.from_arrays([pa.array(c[keep], k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "w"])

        for batch in batches:
            more, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            sig, ids, said = (np.concatenate(x) for x in ((sig, more | SPARSE), (ids, key), (said, (more & SPARSE) == 0)))
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1]))  # the last signature may go on
            on = hub is not None and hub[0] == sig[-1]
            if on or said[last] or len(sig) - last > CROWDED:
                yield found(sig, ids, said)
                hub = hub if on else (int(sig[-1]), int(ids[last]))
                last = len(sig)
            else:
                yield found(sig[:last], ids[:last], said[:last])
                hub = None
            sig, ids, said = sig[last:], ids[last:], said[last:]
        yield found(sig, ids, said)
        K.release()

    ordered = signed.repartition(F.col("sig").bitwiseOR(F.lit(SPARSE).cast("long"))).sortWithinPartitions("sig", "id")
    return ordered.mapInArrow(run, "a long, b long, w double")


def _in_lots(made: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of sig and id; what comes to a lot is combined before it is sent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            sig, ids = _combine(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held.clear()
            sig = sig.view(np.int64)
            for a in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (sig, ids)], ["sig", "id"])

    for some in made:
        held.append(some)
        if sum(len(x) for x, _ in held) > LOT:
            yield from send()
    yield from send()
    K.release()


def _signature_rows(docs: DataFrame, width: int, percent: int, shared: Broadcast) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            found = [signatures(s, percent, shared.value) if len(s) else s for s in token_sets(*K.column(batch), width)]
            if found:
                yield np.concatenate(found), np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(f) for f in found])

    return docs.mapInArrow(lambda batches: _in_lots(made(batches)), "sig long, id long")


def _rare_rows(sets: DataFrame, percent: int) -> DataFrame:
    """sig and id of the tokens of each set that the fewest of the sets have. The order is the same for all
    sets, and a set that lacks so many of another's tokens can't be linked with it: so linked sets have one
    of these in common."""
    each = sets.select("id", F.xxhash64("tokens").alias("own"), F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    shared = materialize(each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "tokens")
    known = Window.partitionBy("id", "own")
    placed = join_hot(each, shared, ["token"], F.col("n") > HOT_TOKEN).withColumn("at", F.dense_rank().over(known.orderBy("n", "token")))
    # Tokens of one set alone come first and find nothing: they only take places.
    alone = F.col("size") - F.max("at").over(known)
    first = F.expr(f"size - (size * {percent}L + 99) div 100 + 1")
    few = materialize(placed.withColumn("alone", alone).where(F.col("at") <= first - F.col("alone")).select("token", "id").distinct(), "rare")
    discard(shared)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            token, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield (K.mix(token.view(np.uint64)) & ~np.uint64(31)) | np.uint64(SPARSE + 1), ids

    return few.mapInArrow(lambda batches: _in_lots(made(batches)), "sig long, id long")


def _sets_of(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` (id, text, more columns) with the set in place of the text."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, _ragged(token_sets(*K.column(batch), width), pa.int64())], [*keep, "tokens"])
        K.release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(run, fields + ", tokens array<long>")


def _common(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many tokens each of the first ``left`` sets has in common with each of the others; with
    ``left`` 0, each set with each."""
    n = len(sets)
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    times = np.bincount(at, minlength=len(token))
    everywhere = int((times == n).sum())
    useful = np.flatnonzero((times > 1) & (times < n))
    place = np.full(len(token), -1)
    place[useful] = np.arange(len(useful))
    row, col = row[place[at] >= 0], place[at][place[at] >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.full((left or n, n - left), float(everywhere), np.float32)
    for a in range(0, len(useful), 2048):
        lo, hi = np.searchsorted(col, [a, a + 2048])
        m = np.zeros((n, min(2048, len(useful) - a)), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m[: left or n] @ m[left:].T
    return out.astype(np.int32)


def _links(ids: np.ndarray, sets: list[np.ndarray], percent: int, left: int = 0) -> list[tuple[int, int]]:
    """Links that span the components of the exact similarity graph of the sets; with ``left``, only
    pairs between the first ``left`` sets and the others are looked at."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int32)
    both = size[: left or n, None] + size[None, left:]
    linked = (100 + percent) * _common(sets, left) >= percent * both  # 100 * common >= percent * union
    if not left:
        np.fill_diagonal(linked, False)
    out: list[tuple[int, int]] = []
    seen = np.zeros(n, bool)
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        queue = [first]
        while queue:
            i = queue.pop()
            if not left:
                new = np.flatnonzero(linked[i] & ~seen)
            elif i < left:
                new = left + np.flatnonzero(linked[i] & ~seen[left:])
            else:
                new = np.flatnonzero(linked[:, i - left] & ~seen[:left])
            seen[new] = True
            queue.extend(new.tolist())
            out.extend((int(ids[i]), int(ids[j])) for j in new if ids[i] != ids[j])
    return out


def _verify(groups: DataFrame, percent: int) -> DataFrame:
    """Links within each lot; ``groups`` has lot, side (0, or 0 and 1 where only pairs of both sides
    count), id, tokens. Lots come one after another in sorted partitions, so memory is bounded by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, ids, sides, sets = None, [], [], []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1 and (0 in sides):
                found.extend(_links(np.array(ids), sets, percent, sides.count(0) if 1 in sides else 0))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
            found.clear()
            return out

        for batch in batches:
            lots, side, key = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for i, x in enumerate(lots):
                if x != lot:
                    close()
                    lot, ids, sides, sets = x, [], [], []
                new = flat[bounds[i] : bounds[i + 1]]
                same = range(bisect_left(ids, key[i], sides.index(side[i])), len(ids)) if sides[-1:] == [side[i]] else ()
                if any(np.array_equal(sets[k], new) for k in same):
                    continue  # a repeated row
                ids.append(key[i])
                sides.append(side[i])
                sets.append(new.copy())
            yield flush()
        close()
        yield flush()
        K.release()

    ordered = groups.select("lot", "side", "id", "tokens").repartition(F.col("lot")).sortWithinPartitions("lot", "side", "id")
    return ordered.mapInArrow(run, "a long, b long")


def _sent(few: DataFrame) -> DataFrame:
    """The written table, to be sent to all executors if it is small."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def _candidate_links(sets: DataFrame, chains: DataFrame, percent: int) -> DataFrame:
    """The verified ones among the candidate edges ``chains``: a node with a part of the
    greater nodes that it is tied to makes a lot, so a hub is spread over many."""
    edges = chains.join(sets.select(F.col("id").alias("a")).distinct(), "a")
    hubs = materialize(edges.groupBy("b").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("parts")), "hubs")
    crowded = F.col("parts") > 100
    dealt = join_hot(edges, hubs, ["b"], crowded).select("b", F.col("a").alias("id"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    many = sets.select("id", "tokens").join(dealt, "id").select("id", "tokens", "b", "part", F.lit(1).alias("side"))
    one = join_hot(sets.select("id", "tokens"), hubs.withColumnRenamed("b", "id"), ["id"], crowded)
    one = one.select("id", "tokens", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    out = materialize(_verify(one.unionByName(many).withColumn("lot", F.concat_ws(":", "b", "part")), percent), "links")
    discard(hubs)
    return out


def _block_links(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links between members of crowds (id, tokens, root) that no verified candidate edge has put in one class.

    Members are dealt to blocks by size, those of a class that fills one by themselves. Two blocks of a
    crowd meet unless they are of one such class, or no size in one can be linked to a size in the other."""
    full = materialize(classes.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= BLOCK // 2), "full")
    named = classes.join(_sent(full), "root").select(F.col("node").alias("id"), F.col("root").alias("class"))
    named = materialize(named.unionByName(full.select(F.col("root").alias("id"), F.col("root").alias("class"))), "classes")
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    held = sets.join(_sent(named), "id", "left").withColumn("size", F.size("tokens"))
    held = held.withColumn("group", F.concat_ws(":", "root", F.coalesce(F.col("class").cast("string"), F.lit("alone")), F.floor(F.log(F.col("size").cast("double")) / step)))
    parts = F.greatest(F.ceil(F.count("*") / (BLOCK // 2)), F.ceil(F.sum("size") / (BLOCK_TOKENS // 2))).cast("int")
    groups = materialize(held.groupBy("root", "class", "group").agg(parts.alias("parts"), F.min("size").alias("lo"), F.max("size").alias("hi")), "groups")
    blocks = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", "class", "lo", "hi", F.struct("group", "part").alias("block"))
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = (F.col("x.root") == F.col("y.root")) & (F.col("x.block") <= F.col("y.block"))
    meet &= (percent * F.col("x.lo") <= 100 * F.col("y.hi")) & (percent * F.col("y.lo") <= 100 * F.col("x.hi"))
    meet &= F.col("x.class").isNull() | F.col("y.class").isNull() | (F.col("x.class") != F.col("y.class"))
    pairs = x.join(y, meet).select(F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    pairs = pairs.withColumn("lot", F.concat_ws("|", "p.group", "p.part", "q.group", "q.part"))
    sides = pairs.select("lot", F.lit(0).alias("side"), "p.*").unionByName(pairs.where("p <> q").select("lot", F.lit(1).alias("side"), "q.*"))
    sides = materialize(sides, "lots")
    placed = held.join(_sent(groups.select("group", "parts")), "group").select("id", "tokens", "group", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    out = materialize(_verify(placed.join(_sent(sides), ["group", "part"]), percent), "links")
    discard(full, named, groups, sides)
    return out


def _large_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of large components (id, tokens), by their rare tokens: the pairs that tokens
    of few sets show are verified, and sets that crowded ones tie meet as blocks."""
    rare = _rare_rows(sets, percent)
    found = _pairs(rare).groupBy("a", "b").agg(F.sum("w").alias("w"))
    found = materialize(found.where("w > 0.999").select("a", "b", (F.col("w") >= TIED).alias("tied")), "found")
    links = _candidate_links(sets, found.select("a", "b"), percent)
    tied = connected_components(found.where("tied").select("a", "b"))
    roots = materialize(tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct()), "tied")
    crowds = sets.join(_sent(roots.withColumnRenamed("node", "id")), "id")
    out = links.unionByName(_block_links(crowds, connected_components(links), percent))
    discard(found)
    return out


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, percent: int = 90) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every document: rows are linked when
    100 * common >= percent * union of their shingle sets."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # One class for equal sets: its least id stands for it.
    found = materialize(_set_rows(rows, width), "sets")
    same = ["fp1", "fp2", "n_shingles"]
    copied = materialize(found.where("n_shingles > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select(*same, "rep"), "copied")
    sized = materialize(found.join(_sent(copied), same, "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep")), "classes")
    # Ids that stand for no class are left out of the search; those of several classes link them.
    by_id = sized.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.max(F.col("id") == F.col("rep")).alias("stands"))
    odd = materialize(by_id.where("NOT stands OR lo <> hi"), "copies")
    several = odd.where("lo <> hi").select("id")
    alone = rows.where("id IS NOT NULL").join(_sent(materialize(odd.where("NOT stands").select("id"), "others")), "id", "left_anti")
    shared = spark.sparkContext.broadcast(common_tokens(rows, width, found.count()))  # COMMON_TOKENS at most
    evidence = _pairs(_signature_rows(alone, width, percent, shared)).groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 0.999")
    chains = materialize(evidence.select("a", "b"), "chains")
    shared.destroy()
    lots = connected_components(chains)
    nodes = lots.select(F.col("node").alias("id"), "root").unionByName(lots.select(F.col("root").alias("id"), "root").distinct())
    members = materialize(nodes.join(sized.where("id = rep").select("id", "n_shingles").distinct(), "id"), "members")
    large = members.groupBy("root").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("tokens")).where((F.col("members") > BLOCK) | (F.col("tokens") > BLOCK_TOKENS))
    large = materialize(large.select("root", F.lit(True).alias("large")), "large")
    members = materialize(members.join(_sent(large), "root", "left").select("id", "root", "large").distinct(), "members")
    held = materialize(_sets_of(rows.join(_sent(members), "id"), width), "lot-sets")
    usual = held.where("large IS NULL").select(F.col("root").alias("lot"), F.lit(0).alias("side"), "id", "tokens")
    links = materialize(_verify(usual, percent), "links")
    if large.count():
        links = links.unionByName(_large_links(held.where("large").select("id", "tokens"), percent))
    if several.count():
        links = links.unionByName(sized.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    linked = connected_components(links)
    discard(found, copied, chains, members, held)
    roots = sized.join(linked, sized.rep == linked.node, "left")
    return roots.select(F.col("id").alias(key), "n_shingles", F.coalesce("root", "rep").alias("component_id"))
