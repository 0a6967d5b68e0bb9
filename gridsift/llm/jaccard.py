"""Exact n-gram Jaccard join of whole texts by prefix tokens and signature trees.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one class from the start. Two
sets of Jaccard 0.8 or more share a token among the first n - ceil(0.8 n) + 1 of each in any common order; here
tokens found to be frequent come last, the rest in hash order. So tokens split the work into groups, and no link is
lost. The groups are used twice:

1. Each set is paired with the least sets of its groups, the ``LEADS`` that most of its groups have. Of those that
   bitmaps do not rule out, the least is compared with it exactly. The components of these links hold most copies, without pairs inside a large group.
2. Groups that still span components go to signature trees, first for each set's nearest others, then for all pairs: leaves are sets, nodes hold OR-combined bitmaps and
   size ranges, and a dual traversal drops node pairs by their largest possible overlap. The remaining pairs across
   components are compared exactly.

One shuffle by token drops tokens of a single set and finds each group's least set; tokens that tasks found frequent
are salted there. Groups with the same members are used once. A group of more than ``GROUP`` sets is dealt out as
pairs of blocks, where large components have blocks of their own that are not paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import Scratch, staged, trimmed
from .words import hashed, mix, shingles

#: A token in this many sets among WINDOW tokens of a task is frequent. This orders tokens; results do not depend on it.
FREQUENT, WINDOW = 8, 4_000_000
#: Most frequent tokens that are told to all tasks (8 bytes each).
MOST_FREQUENT = 2_000_000
#: Sets in a group, or in two blocks of one, that a signature tree is built for.
GROUP = 4096
FANOUT = 8
#: First tries of a set. What they miss is left to the trees, so results do not depend on it.
LEADS = 2
#: Second tries: a set's nearest others in a group that its component does not hold. Again, the rest is left to the trees.
NEAREST = 3
#: Most documents whose ids are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_DOCS = 2_000_000
#: Parts of a frequent token's group when leads are found.
SALTS = 256
_BITS = 512
_LONGS = [f"s{i}" for i in range(_BITS // 64)]


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For groups of rows: the first row, and each row's sorted distinct shingle hashes."""
    for a, _, h, at in hashed(column):
        s, off = shingles(h, at, n)
        out = []
        for i in range(len(off) - 1):
            x = np.sort(s[off[i] : off[i + 1]])
            out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
        yield a, out


def _key(x: np.ndarray) -> int:
    """A set's 64-bit key, over all its hashes and its size."""
    with np.errstate(over="ignore"):
        return int(mix(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)[None] + np.uint64(len(x)))[0].view(np.int64)) if len(x) else 0


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of _BITS bits for each set, as 8 integers."""
    bits = np.zeros((len(sets), _BITS), bool)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    if len(row):
        bits[row, (np.concatenate(sets) >> np.uint64(64 - 9)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


_META = "doc_id long, n int, set_id long, " + ", ".join(f"{c} long" for c in _LONGS) + ", frequent binary"


def describe(docs: DataFrame, text: str, doc_id: str, shingle: int, text_hash: bool = False) -> DataFrame:
    """A row for each document (its set's size, key and bitmap), and rows that only hold a task's frequent tokens.

    With ``text_hash``, a document's row has the hash of its text too.
    """
    names = ["doc_id", "n", "set_id", *_LONGS, "frequent", *(["text_hash"] if text_hash else [])]

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, seen, found = [], 0, set(), []

        def reduce():
            nonlocal held, size
            if held:
                token, count = np.unique(np.concatenate(held), return_counts=True)
                found.append(token[count >= FREQUENT])
            held, size = [], 0

        for batch in batches:
            for a, sets in _sets(batch.column(1), shingle):
                keys = [_key(x) for x in sets]
                sig = _signatures(sets)
                for x, k in zip(sets, keys, strict=True):
                    if k not in seen:
                        held.append(x)
                        size += len(x)
                if len(seen) < 1_000_000:
                    seen.update(keys)
                if size >= WINDOW:
                    reduce()
                cols = [batch.column(0).slice(a, len(sets)), pa.array([len(x) for x in sets], pa.int32()), pa.array(keys, pa.int64()), *(pa.array(sig[:, i]) for i in range(len(_LONGS))), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *(c.slice(a, len(sets)) for c in batch.columns[2:])], names)
        reduce()
        tokens = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        nulls = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * (1 + len(_LONGS))]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array([tokens.tobytes()], pa.binary()), *([pa.nulls(1, pa.int64())] if text_hash else [])], names)

    more = [F.xxhash64(text).alias("text_hash")] if text_hash else []
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *more).mapInArrow(trimmed(run, False), _META + (", text_hash long" if text_hash else ""))


def frequent_tokens(meta: DataFrame) -> np.ndarray:
    """The sorted tokens that tasks found frequent; of more than MOST_FREQUENT, those that so many tasks found that they are fewer."""

    def tokens(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64))], ["token"])

    rows = meta.where(F.col("frequent").isNotNull()).select("frequent").mapInArrow(tokens, "token long")
    rows = staged(rows.groupBy("token").agg(F.count("*").alias("n")), "frequent")
    least, total = 1, 0
    for r in sorted(rows.groupBy("n").agg(F.count("*").alias("tokens")).collect(), reverse=True):  # a row for each number of tasks
        total += r.tokens
        if total > MOST_FREQUENT:
            least = r.n + 1
            break
    found = rows.where(F.col("n") >= least).select("token").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def postings(docs: DataFrame, frequent, text: str, shingle: int) -> DataFrame:
    """token, salt, set_id of each set's prefix tokens; a task gives each set once. ``frequent`` is a broadcast sorted array; other tokens' salt is -1."""

    def run(batches: Iterator[pa.RecordBatch]):
        late, seen = frequent.value, set()
        bits = np.zeros(1 << 22, bool)
        bits[late >> np.uint64(42)] = True
        for batch in batches:
            for _, sets in _sets(batch.column(0), shingle):
                token, owner, salt = [], [], []
                for x in sets:
                    key = _key(x)
                    if not len(x) or key in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    p = len(x) - (4 * len(x) + 4) // 5 + 1
                    hot = bits[x >> np.uint64(42)]
                    if hot.any():
                        at = np.flatnonzero(hot)
                        hot[at] = late[np.minimum(np.searchsorted(late, x[at]), len(late) - 1)] == x[at]
                        x, hot = np.concatenate((x[~hot], x[hot])), np.concatenate((hot[~hot], hot[hot]))
                    token.append(x[:p])
                    owner.append(np.full(p, key))
                    salt.append(np.where(hot[:p], key % SALTS, -1))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(salt), pa.int32()), pa.array(np.concatenate(owner))], ["token", "salt", "set_id"])

    return docs.select(F.col(text).alias("text")).mapInArrow(trimmed(run, False), "token long, salt int, set_id long")


def _shared(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by (token, salt, set_id): those of groups of several sets, and all of salted groups, once each, with the least set of the group."""
    names, held = ["token", "salt", "set_id", "lead"], None
    for batch in batches:
        x = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        old = held is not None
        if old:
            x = np.concatenate((held[0][:, None], x), 1)
        if not x.shape[1]:
            continue
        again = np.append(False, (np.diff(x) == 0).all(0))
        x = x[:, ~again]
        new = np.append(True, (np.diff(x[:2]) != 0).any(0))
        first = np.flatnonzero(new)
        lead = np.repeat(x[2, first], np.diff(np.append(first, len(new))))
        if old:
            lead[: first[1] if len(first) > 1 else None] = held[1]
            new[0] = held[2]
        keep = (x[1] >= 0) | ~new | np.append(~new[1:], False)
        keep[-1] = False
        held = x[:, -1].copy(), lead[-1], new[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[0, keep]), pa.array(x[1, keep], pa.int32()), pa.array(x[2, keep]), pa.array(lead[keep])], names)
    if held is not None and (held[0][1] >= 0 or not held[2]):
        yield pa.RecordBatch.from_arrays([pa.array(held[0][:1]), pa.array(held[0][1:2], pa.int32()), pa.array(held[0][2:]), pa.array([held[1]], pa.int64())], names)


def shared_tokens(rows: DataFrame) -> DataFrame:
    """token, salt, set_id, lead of the rows of postings() whose group holds another set (of salted groups, all rows)."""
    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "set_id").mapInArrow(trimmed(_shared, False), "token long, salt int, set_id long, lead long")


def _leads(live: DataFrame) -> DataFrame:
    """a, b: for each set the ``LEADS`` that most of its groups have; leads of a salted token's parts also meet the least of them."""
    parts = live.where("salt >= 0").groupBy("token", "lead").agg(F.lit(1).alias("one"))
    least = parts.groupBy("token").agg(F.min("lead").alias("least"))
    across = parts.join(least, "token").where("least < lead").select(F.col("lead").alias("set_id"), F.col("least").alias("lead"))
    leads = live.where("lead < set_id").select("set_id", "lead").unionByName(across).groupBy("set_id", "lead").agg(F.count("*").alias("k"))
    leads = leads.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "lead")), asc=False), 1, LEADS).alias("x"))  # at most two leads for each prefix token
    return leads.select(F.explode("x.lead").alias("a"), F.col("set_id").alias("b"))


def _may_link(na: Column, nb: Column, a: list[Column], b: list[Column]) -> Column:
    """Whether two sets' sizes and bitmaps allow a Jaccard similarity of 0.8: bits that one lacks are tokens that it lacks."""
    lost = lambda x, y: sum((F.bit_count(p.bitwiseAND(F.bitwise_not(q))) for p, q in zip(x, y, strict=True)), F.lit(0))
    overlap = F.least(na - lost(a, b), nb - lost(b, a))
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (9 * overlap >= 4 * (na + nb))


def _pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda k: classes.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in _LONGS])
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    cols = lambda k: [F.col(f"{c}_{k}") for c in _LONGS]
    return rows.where(_may_link(F.col("n_a"), F.col("n_b"), cols("a"), cols("b"))).select("a", "b")


def _texts_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text: str, doc_id: str, scratch: Scratch) -> DataFrame:
    """The texts of the sets in ``pairs`` (a, b), one document of each class (and others that have its doc_id)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = scratch.staged(wanted.join(classes.select("set_id", F.col("doc_id").alias("_j_doc")), "set_id").select("_j_doc").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_DOCS
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_j_doc")), "left_semi").select("text")


def _paired(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs whose values in ``sets`` (set_id, value) pass ``test``, a function of two buffers."""
    side = lambda k, v: sets.select(F.col("set_id").alias(k), F.col("value").alias(v))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(trimmed(run, False), "a long, b long").distinct()


def _of_sets(texts: DataFrame, value, shingle: int) -> DataFrame:
    """set_id and value (binary) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for _, sets in _sets(batch.column(0), shingle):
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in sets], pa.int64()), pa.array([value(x) for x in sets], pa.binary())], ["set_id", "value"])

    return texts.mapInArrow(trimmed(run, False), "set_id long, value binary")


def _wide(x: np.ndarray) -> bytes:
    """Size and bitmap of a set in a power of two of bits, at least twice its size."""
    bits = np.zeros(1 << max(9, int(2 * len(x) - 1).bit_length()), bool)
    bits[(x & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.int64(len(x)).tobytes() + np.packbits(bits).tobytes()


def _wide_may_link(x, y) -> bool:
    """As _may_link(), by bitmaps as wide as the sets; the wider is folded onto the other."""
    nx, ny = (int(np.frombuffer(v, np.int64, 1)[0]) for v in (x, y))
    x, y = (np.frombuffer(v, np.uint8, -1, 8) for v in (x, y))
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), 0).view(np.uint64) for v in (x, y))
    overlap = min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))
    return 9 * overlap >= 4 * (nx + ny)


def _link(x, y) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= 80 * (len(x) + len(y) - shared)


def narrowed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text: str, doc_id: str, shingle: int, scratch: Scratch) -> DataFrame:
    """The staged ``pairs`` of set keys that bitmaps as wide as the sets do not rule out."""
    with Scratch(docs.sparkSession) as own:
        wide = own.staged(_of_sets(_texts_of(docs, classes, pairs, text, doc_id, own), _wide, shingle).dropDuplicates(["set_id"]), "wide")
        return scratch.staged(_paired(pairs, wide, _wide_may_link), "narrowed")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text: str, doc_id: str, shingle: int, scratch: Scratch) -> DataFrame:
    """The staged ``pairs`` of set keys whose whole sets link. Sets are rebuilt for these documents only."""
    with Scratch(docs.sparkSession) as own:
        return scratch.staged(_paired(pairs, _of_sets(_texts_of(docs, classes, pairs, text, doc_id, own), lambda x: x.tobytes(), shingle), _link), "verified")


class SignatureTree:
    """Nodes over sets in order of size and bitmap: OR-combined bitmaps, size ranges and greatest bit slack, level by level."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        order = np.lexsort((*bits.T[::-1], n))
        self.order, self.levels = order, []
        n, bits = n[order], bits[order].view(np.uint64)
        level = (n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64), bits)
        self.levels.append(level)
        while len(level[0]) > FANOUT:
            cut = np.arange(0, len(level[0]), FANOUT)
            level = (np.minimum.reduceat(level[0], cut), np.maximum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.bitwise_or.reduceat(level[3], cut, axis=0))
            self.levels.append(level)


def _possible(x: tuple, y: tuple) -> np.ndarray:
    """Which node pairs may hold a link: sizes within 0.8, and shared bits plus slack reach the least overlap."""
    overlap = np.bitwise_count(x[3] & y[3]).sum(1, dtype=np.int64) + np.minimum(x[2], y[2])
    return (5 * x[1] >= 4 * y[0]) & (5 * y[1] >= 4 * x[0]) & (9 * overlap >= 4 * (x[0] + y[0]))


def _possible_sets(x: tuple, y: tuple) -> np.ndarray:
    """The closer bound for two sets, by the bits that each lacks."""
    lost = lambda a, b: np.bitwise_count(a & ~b).sum(1, dtype=np.int64)
    return 9 * np.minimum(x[0] - lost(x[3], y[3]), y[0] - lost(y[3], x[3])) >= 4 * (x[0] + y[0])


def traverse(s: SignatureTree, t: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal from the roots' level: positions (in s and in t) of the pairs of sets that may link.

    For s is t, each pair comes once. Pairs of nodes are worked on in slices, so that few are held at once.
    """
    same, out = s is t, []
    top_s, top_t = len(s.levels) - 1, len(t.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(s.levels[top_s][0])), np.arange(len(t.levels[top_t][0])), indexing="ij"))
    todo = [(top_s, top_t, i, j)]
    while todo:
        ls, lt, i, j = todo.pop()
        if len(i) > 1 << 15:
            half = len(i) // 2
            todo += [(ls, lt, i[:half], j[:half]), (ls, lt, i[half:], j[half:])]
            continue
        if same:
            keep = i <= j
            i, j = i[keep], j[keep]
        keep = _possible(tuple(x[i] for x in s.levels[ls]), tuple(x[j] for x in t.levels[lt]))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not ls and not lt:
            keep = _possible_sets(tuple(x[i] for x in s.levels[0]), tuple(x[j] for x in t.levels[0]))
            keep &= i < j if same else True
            out.append((s.order[i[keep]], t.order[j[keep]]))
            continue
        ds, dt = (ls >= lt), (lt >= ls)
        if ds:
            i, j, ls = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(j, FANOUT), ls - 1
            keep = i < len(s.levels[ls][0])
            i, j = i[keep], j[keep]
        if dt:
            i, j, lt = np.repeat(i, FANOUT), (j[:, None] * FANOUT + np.arange(FANOUT)).ravel(), lt - 1
            keep = j < len(t.levels[lt][0])
            i, j = i[keep], j[keep]
        todo.append((ls, lt, i, j))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _nearest(p: np.ndarray, q: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the pairs are among the ``NEAREST`` of either of their sets, by shared bits over sizes."""
    if not len(p):
        return np.zeros(0, bool)
    bits = bits.view(np.uint64)
    score = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64) / np.bitwise_count(bits[p] | bits[q]).sum(1, dtype=np.int64)
    ends, pair = np.concatenate((p, q)), np.tile(np.arange(len(p)), 2)
    order = np.lexsort((pair, -score[pair], ends))
    first = np.searchsorted(ends[order], ends[order], "left")
    keep = np.zeros(len(p), bool)
    keep[pair[order][np.arange(len(order)) - first < NEAREST]] = True
    return keep


def _group_pairs(batches: Iterator[pa.RecordBatch], nearest: bool = False):
    """Rows sorted by (token, i, j) to candidate pairs across components, group by group: all, or each set's nearest."""
    held: list[tuple] = []
    last = None

    def pairs(rows: list[np.ndarray]):
        x = np.concatenate(rows, 1)
        i, j, block, ids, comp, n, bits = x[1, 0], x[2, 0], x[3], x[4], x[5], x[6], np.ascontiguousarray(x[7:].T)
        if i == j:
            s = SignatureTree(n, bits)
            p, q = traverse(s, s)
        else:
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                return None
            p, q = traverse(SignatureTree(n[left], bits[left]), SignatureTree(n[right], bits[right]))
            p, q = left[p], right[q]
        keep = comp[p] != comp[q]
        p, q = p[keep], q[keep]
        if nearest:
            keep = _nearest(p, q, n, bits)
            p, q = p[keep], q[keep]
        a, b = ids[p], ids[q]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        cuts = np.flatnonzero((np.diff(x[:3], axis=1) != 0).any(0)) + 1
        for part in np.split(x, cuts, axis=1):
            key = tuple(part[:3, 0])
            if last is not None and key != last:
                if (found := pairs(held)) is not None:
                    yield found
                held = []
            last = key
            held.append(part)
    if held and (found := pairs(held)) is not None:
        yield found


def tree_candidates(live: DataFrame, classes: DataFrame, labels: DataFrame, scratch: Scratch, nearest: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of sets of different components that share a group and that no node pair's bound rules out.

    With ``nearest``, only those that are among the nearest of either set in a group.
    """
    rows = live.select("token", "set_id").join(labels.withColumnsRenamed({"node": "set_id"}), "set_id", "left").withColumn("comp", F.coalesce("component", "set_id"))
    h = F.xxhash64("set_id")
    groups = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y")).where("lo < hi")
    once = scratch.staged(groups.groupBy("size", "x", "y").agg(F.min("token").alias("token")).select("token", "size"), "groups")
    rows = rows.join(once, "token").join(classes.select("set_id", "n", *_LONGS), "set_id")
    zero = F.lit(0).cast("long")
    rows = _dealt(rows) if once.where(F.col("size") > GROUP).head(1) else rows.withColumns({"block": zero, "other": zero})
    rows = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "comp", F.col("n").cast("long").alias("n"), *_LONGS)
    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(trimmed(lambda batches: _group_pairs(batches, nearest), False), "a long, b long").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with their block and, once for each, the ``other`` blocks that they meet: 0 and 0 in a group of up to GROUP sets.

    Of a larger group, components of more than half of GROUP sets get blocks of their own, after those that the rest
    share. A row meets all blocks that may hold other components.
    """
    half = GROUP // 2
    large = F.col("size") > GROUP
    of_comp = rows.where(large).groupBy("token", "comp").agg(F.count("*").alias("m"))
    own = F.col("m") > half
    # at most size / half entries in each array
    plan = of_comp.groupBy("token").agg(
        F.ceil(F.coalesce(F.sum(F.when(~own, F.col("m"))), F.lit(0)) / half).cast("long").alias("mixed"),
        F.array_sort(F.collect_list(F.when(own, F.struct("comp", F.ceil(F.col("m") / half).cast("long").alias("k"))))).alias("own"),
    )
    start = F.aggregate(F.filter("own", lambda x: x["comp"] < F.col("comp")), F.col("mixed"), lambda a, x: a + x["k"])
    k = F.get(F.filter("own", lambda x: x["comp"] == F.col("comp")), 0)["k"]
    total = F.aggregate("own", F.col("mixed"), lambda a, x: a + x["k"])
    dealt = rows.join(plan, "token", "left").withColumns({"_start": start, "_k": k, "_total": total})
    h = F.xxhash64("set_id", F.lit(7))
    block = F.when(F.col("_k").isNotNull(), F.col("_start") + F.pmod(h, F.col("_k"))).otherwise(F.pmod(h, F.col("mixed")))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_total") - 1), lambda b: F.col("_k").isNull() | (b < F.col("_start")) | (b >= F.col("_start") + F.col("_k")))
    zero = F.lit(0).cast("long")
    dealt = dealt.withColumns({"block": F.coalesce(block, zero), "other": F.explode(F.when(F.col("_total").isNotNull(), met).otherwise(F.array(zero)))})
    return dealt.select(*rows.columns, "block", "other")


def _components(docs: DataFrame, text: str, doc_id: str, shingle: int, text_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of describe() for documents, and set_id, doc_id (its least), comp of each set that is not empty.

    With ``text_hash``, sets have ``least`` too: no_id, doc_id and text_hash of the first of their documents in that order.
    """
    spark = docs.sparkSession
    meta = staged(describe(docs, text, doc_id, shingle, text_hash), "sets")
    own = meta.where(F.col("frequent").isNull()).drop("frequent")
    some = own.where("n > 0")
    least = [F.min(_row()).alias("least")] if text_hash else []
    classes = staged(some.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in _LONGS], *least), "classes")
    frequent = spark.sparkContext.broadcast(frequent_tokens(meta))
    check = (text, doc_id, shingle)
    with Scratch(spark) as scratch:
        live = scratch.staged(shared_tokens(postings(docs, frequent, text, shingle)), "live")
        star = narrowed(docs, classes, scratch.staged(_pruned(_leads(live), classes), "star"), *check, scratch)
        star = scratch.staged(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
        links = verified(docs, classes, star, *check, scratch)
        labels = scratch.staged(components(links), "star-labels")
        near = scratch.staged(tree_candidates(live, classes, labels, scratch, nearest=True), "near")
        more = verified(docs, classes, narrowed(docs, classes, near, *check, scratch), *check, scratch)
        links = scratch.staged(links.unionByName(more), "near-links")
        labels = scratch.staged(components(links), "near-labels")
        more = scratch.staged(tree_candidates(live, classes, labels, scratch), "tree")
        more = verified(docs, classes, narrowed(docs, classes, more, *check, scratch), *check, scratch)
        merged = staged(components(links.unionByName(more)), "components")
    frequent.destroy()

    sets = classes.select("set_id", "doc_id", *(["least"] if text_hash else []))
    return own, sets.join(merged.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("component", "set_id"))


def _row() -> Column:
    """What orders documents of a component: doc_id, nulls last, then the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def jaccard_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    n_shingles is the size of the row's set; component_id is the smallest doc_id that links of Jaccard 0.8 or more
    reach, itself included. A null, empty or wordless text has no shingles and only its own component. Equal texts
    always share a component; a null doc_id counts as larger than any. Repeated doc_ids give a row each.
    """
    own, grown = _components(docs, text, doc_id, shingle)
    least = grown.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = grown.join(least, "comp").select("set_id", "component_id")
    out = own.join(of_set, "set_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_firsts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, first of every row of ``docs``: whether it is the first of its component by doc_id, nulls last, then text hash.

    Components are those of jaccard_classes(), whatever the doc_ids. Rows that agree in doc_id and text are all first or
    none is; rows without shingles are first.
    """
    own, grown = _components(docs, text, doc_id, shingle, text_hash=True)
    least = grown.groupBy("comp").agg(F.min("least").alias("least"))
    out = own.join(grown.select("set_id", "comp").join(least, "comp").select("set_id", "least"), "set_id", "left")
    return out.select("doc_id", "text_hash", ((F.col("n") == 0) | _row().eqNullSafe(F.col("least"))).alias("first"))
