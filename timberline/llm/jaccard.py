"""Similarity join on word shingles: texts whose Jaccard similarity reaches a threshold.

Texts with the same set of shingles are one class from the start. A forest of signature trees has one
root for each list of classes that share a key; lists that many keys share are one root.

Keys are chosen so that similar sets share one. A set's tokens are dealt by their leading bits into
groups, of one or two tokens on average; sets at least 80 % alike differ in a quarter as many tokens as
they have at most, so most groups of similar sets are equal. Groups in a common order, large ones
first, are keys, as many as may differ and one more. A key of several tokens is hardly ever shared by
chance or through a passage alone. Small sets use their first tokens instead (prefix filter).

Below a root, leaves are class signatures, inner nodes OR-ed bitmaps with size ranges. Dual traversal
leaves the pairs whose largest possible overlap suffices; roots too wide for a task are dealt out as
pairs of tiles. Candidates are then checked on their full sets. Wide roots first compare a few pairs of
neighbours, and what is connected by then isn't compared again: links only matter for components.

Nearly all keys occur once. Keys go to their buckets packed, a batch of classes at a time, and only
those of several classes come out as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import checked_broadcast, components, narrow, stage
from timberline.llm.shingles import alike, mix, shingle_sets
from timberline.llm.signature_tree import candidate_pairs, signature

#: Sets of fewer tokens use single tokens as keys, and so do all below the least percentage.
GROUPED_FROM, GROUPED_PERCENT = 64, 80
#: A level has 2^level groups: the most that give this many tokens each on average.
PER_GROUP = 1.2
_LEVEL = np.uint64(0xD6E8FEB86659FD93)
#: Members in a tile of a root, and from how many members on a root has pivots first.
TILE, WIDE = 512, 64
#: Wide roots of a class that take part in the first round, and pairs of a member that each then gives out.
ROOTS, FIRST = 4, 4
#: Keys are so many bits long; keys of different groups that are equal by chance only make a candidate more.
KEY_BITS = 48
#: Keys in a bucket, about, and classes with one key that a batch packs; keys of more are listed by a join.
BUCKET, PACKED = 1 << 18, 64
#: Bytes of text or of sets, about, and keys that a task works on at once, however many rows a batch has.
TEXT_BYTES, KEYS_AT_ONCE = 1 << 22, 1 << 19
#: Numbers of roots with two members begin here.
TWOS = 1 << 62
#: Partners of one text that a task checks.
PARTNERS = 2000


def _level(n: int) -> int:
    return int(np.log2(n / PER_GROUP))


def differing(n: int, percent: int) -> int:
    """The most tokens in which a set of ``n`` tokens and a similar one may differ, taken together."""
    return n * (100 - percent) // percent


def group_keys(tokens: np.ndarray, level: int, wanted: int) -> tuple[np.ndarray, int]:
    """The first ``wanted`` keys of a sorted set's groups at a level, and how many there are."""
    group = tokens >> np.uint64(64 - level)
    start = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
    size = np.diff(np.append(start, len(tokens)))
    key = mix(np.add.reduceat(mix(tokens + _LEVEL), start) + np.uint64(int(_LEVEL) * level & 0xFFFFFFFFFFFFFFFF))
    if len(key) <= wanted:
        return key, len(key)
    order = np.lexsort((key, -np.minimum(size, 3)))
    return key[order[:wanted]], len(key)


def set_keys(tokens: np.ndarray, percent: int, plain_for: np.ndarray) -> tuple[np.ndarray, bool]:
    """A set's keys, and whether its groups may be too few (then plain keys must be used as well).

    ``plain_for``: sizes of sets for which that happened; sets that may be similar use plain keys too.
    """
    n = len(tokens)
    if n == 0:
        return tokens, False
    grouped = percent >= GROUPED_PERCENT
    most = n * 100 // percent  # the size of the largest similar set
    keys, short = [], False
    if not grouped or n < GROUPED_FROM or ((100 * plain_for >= percent * n) & (100 * n >= percent * plain_for)).any():
        keys.append(mix(tokens[: n - -(-percent * n // 100) + 1]))
    if grouped and most >= GROUPED_FROM:
        wanted = differing(n, percent) + 1
        for level in range(_level(max(n, GROUPED_FROM)), _level(most) + 1):
            found, there = group_keys(tokens, level, wanted)
            keys.append(found)
            short |= there < wanted
    return np.unique(np.concatenate(keys) >> np.uint64(64 - KEY_BITS)), short


def _parts(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices (not copies) with at most so much in a column, or one row.

    Much: bytes of texts, entries of lists. A batch holds ten thousand rows, and what a task makes of
    them is several times as large; a worker keeps most of the memory that it ever had.
    """
    for batch in batches:
        values = batch.column(column)
        much = values.value_lengths() if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(much, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
            yield batch.slice(start, end - start)
            start, before = end, ends[end - 1]
    pa.default_memory_pool().release_unused()


def _described(docs: DataFrame, size: int, percent: int, plain_for: list[int]) -> DataFrame:
    """doc_id, the set's size, digest, signature and keys, and whether its groups may be too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.array(plain_for, np.int64)
        for batch in _parts(batches, "text", TEXT_BYTES):
            n, d1, d2, bits, keys, few = [], [], [], [], [], []
            for tokens in shingle_sets(batch.column("text").to_pylist(), size):
                digest = _digest(tokens)
                first, short = set_keys(tokens, percent, plain)
                few.append(short)
                n.append(len(tokens))
                d1.append(digest[0])
                d2.append(digest[1])
                bits.append(signature(tokens) if len(tokens) else b"")
                keys.append(first.view(np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "d1": pa.array(d1, pa.int64()),
                    "d2": pa.array(d2, pa.int64()),
                    "bits": pa.array(bits, pa.binary()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                    "few": pa.array(few, pa.bool_()),
                }
            )

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bits binary, keys array<long>, few boolean")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Neighbouring rows with equal ``by``, as sorting has put them; one group at a time."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        for c in by:
            v = table.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        carry = table.slice(cuts[-1])
    if carry is not None and carry.num_rows:
        yield carry


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers as eight rows of bytes, which compress where neighbours have leading bytes in common."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers start, and their lengths."""
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return start, np.diff(np.append(start, len(ordered)))


def _shared_keys(leaves: DataFrame, about: int) -> DataFrame:
    """Keys of several classes: (key, a, b) for a key of these two, (key, a, -1) for each class of a key
    of more, (key, -1, -1) for a key that some batch had too many classes of to pack them all.

    ``leaves``: a row per class, id and keys (distinct). ``about``: how many keys there may be in all.
    """
    buckets = 1 << max(6, (about // BUCKET).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "keys", KEYS_AT_ONCE):
            lists = batch.column("keys")
            key = lists.flatten().to_numpy()
            if not len(key):
                continue
            id_ = np.repeat(batch.column("id").to_numpy(), lists.value_lengths().to_numpy())
            order = np.argsort(key, kind="stable")
            start, size = _runs(key[order])
            cut = key[order[start[size > PACKED]]]
            keep = np.ones(len(key), bool)
            keep[order[np.arange(len(key)) - np.repeat(start, size) >= PACKED]] = False
            key, id_ = key[keep], id_[keep]
            bucket = key & (buckets - 1)
            order = np.argsort(bucket, kind="stable")
            bucket, key, id_ = bucket[order], key[order], id_[order]
            start, size = _runs(bucket)
            bounds = list(zip(start.tolist(), (start + size).tolist()))
            of_cut = {x: cut[cut & (buckets - 1) == x] for x in np.unique(cut & (buckets - 1)).tolist()}
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(bucket[start], pa.int64()),
                    "keys": pa.array([_planes(key[x:y]) for x, y in bounds], pa.binary()),
                    "ids": pa.array([_planes(id_[x:y]) for x, y in bounds], pa.binary()),
                    "cut": pa.array([_planes(of_cut[x]) if x in of_cut else b"" for x in bucket[start].tolist()], pa.binary()),
                }
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket"]):
            key, id_, cut = (
                np.concatenate([_from_planes(x) for x in group.column(c).to_pylist()]) for c in ("keys", "ids", "cut")
            )
            order = np.lexsort((id_, key))
            key, id_ = key[order], id_[order]
            start, size = _runs(key)
            packed = ~np.isin(key[start], cut)
            two = start[packed & (size == 2)]
            more = np.flatnonzero(np.repeat(packed & (size > 2), size))
            cut = np.unique(cut)
            none = np.full(len(more) + len(cut), -1)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(np.concatenate((key[two], key[more], cut)), pa.int64()),
                    "a": pa.array(np.concatenate((id_[two], id_[more], none[: len(cut)])), pa.int64()),
                    "b": pa.array(np.concatenate((id_[two + 1], none)), pa.int64()),
                }
            )

    packed = leaves.select("id", "keys").mapInArrow(pack, "bucket long, keys binary, ids binary, cut binary")
    tasks = max(leaves.sparkSession.sparkContext.defaultParallelism, buckets // 4)
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(read, "key long, a long, b long")


def _tree_candidates(members: DataFrame, percent: int, first: int | None = None) -> DataFrame:
    """(a, b): pairs of classes below a root that no tree rules out and that aren't connected yet.

    ``members``: root, m (its members), id, part (what it is connected to), n, bits, roots (the wide roots
    of the class). A root with more than a tile of members is dealt out as pairs of tiles. A pair that shares
    wide roots is given out by the smallest of these and by no other. With ``first``, a tile of a wide root
    is compared with itself alone and gives out no more than so many pairs for each member, for so many wide
    roots of a class: a first round, to connect most of them, whose work grows with the members.
    """
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id", "root"), F.ceil(F.col("m") / TILE)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    if first is not None:
        members = members.where((F.col("m") <= WIDE) | F.array_contains(F.slice("roots", 1, ROOTS), F.col("root")))
        other = F.when(F.col("m") > WIDE, F.col("own")).otherwise(0)
    dealt = (
        members.withColumns({"tiles": tiles, "own": own})
        .withColumn("other", other)
        .select(
            "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "part", "n", "bits", "roots",
            (F.col("m") > WIDE).cast("int").alias("wide"),
        )
    )
    by = ["root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, by):
            if group.num_rows < 2:
                continue
            ids, part, n = (group.column(c).to_numpy() for c in ("id", "part", "n"))
            across = group.column("side").to_numpy() if group.column("i")[0].as_py() != group.column("j")[0].as_py() else None
            pairs = candidate_pairs(group.column("bits").to_pylist(), n, percent, across)
            pairs = pairs[part[pairs[:, 0]] != part[pairs[:, 1]]]
            wide = group.column("wide")[0].as_py()
            if not wide or first is None:
                pairs = pairs[~_share_below(group.column("roots"), group.column("root")[0].as_py() if wide else TWOS, pairs)]
            else:
                # Any partners, not the first by size: those that turn out not to be alike differ from member to member.
                pairs = pairs[np.lexsort((np.random.default_rng(len(pairs)).random(len(pairs)), pairs[:, 1]))]
                pairs = pairs[np.arange(len(pairs)) - np.searchsorted(pairs[:, 1], pairs[:, 1]) < first]
            a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    ordered = dealt.repartition(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, "a long, b long").where("a < b").distinct()


def _share_below(roots: pa.ChunkedArray, root: int, pairs: np.ndarray) -> np.ndarray:
    """Whether the two of each pair share a wide root smaller than ``root``: their rows of a bit table, AND-ed."""
    lists = roots.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().to_numpy()
    below = flat < root
    if not len(pairs) or not below.any():
        return np.zeros(len(pairs), bool)
    known, place = np.unique(flat[below], return_inverse=True)
    table = np.zeros((len(lists), -(-len(known) // 64)), np.uint64)
    np.bitwise_or.at(table, (row[below], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    out = np.empty(len(pairs), bool)
    each = max(1, (1 << 21) // table.shape[1])
    for k in range(0, len(pairs), each):
        part = pairs[k : k + each]
        out[k : k + each] = (table[part[:, 0]] & table[part[:, 1]]).any(axis=1)
    return out


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _linked(pairs: DataFrame, leaves: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``pairs`` (staged) of classes whose full sets are similar; texts of no other rows are read
    again. ``leaves``: a class (id), the document that stands for it and its digest.

    A text's set is sent to its partners' side once for each pair, dealt out so that no task checks
    more than a bounded number of partners for one text. Other texts of a repeated doc_id that are
    read with it have other digests.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    of = stage(leaves.join(ids, "id", "left_semi").select("id", F.col("doc_id").alias("doc"), "d1"), "ids")
    named = docs.join(checked_broadcast(of), F.col("doc_id") == F.col("doc")).select("id", "d1", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "text", TEXT_BYTES):
            found = shingle_sets(batch.column("text").to_pylist(), size)
            rows = zip(batch.column("id").to_pylist(), batch.column("d1").to_pylist(), found)
            own = [(i, s.tobytes()) for i, d, s in rows if _digest(s)[0] == d]
            yield pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in own], pa.int64()), "tokens": pa.array([s for _, s in own], pa.binary())})

    tokens = stage(named.mapInArrow(sets, "id long, tokens binary"), "sets")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts"))
    partner = pairs.join(salts, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(1).alias("turn")
    )
    self_ = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(0).alias("turn"))
    # Pairs are narrow, sets are not: while pairs are few by count, sets move only to where they are compared.
    both = checked_broadcast(stage(partner.union(self_), "turns")).join(tokens, "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in _parts(batches, "tokens", TEXT_BYTES):
            a_out, b_out = [], []
            for row in batch.to_pylist():
                if (row["a"], row["salt"]) != now:
                    now, own = (row["a"], row["salt"]), []
                set_ = np.frombuffer(row["tokens"], np.uint64)
                if row["turn"] == 0:
                    own.append(set_)
                elif any(alike(x, set_, percent) for x in own):
                    a_out.append(row["a"])
                    b_out.append(row["id"])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    ordered = both.repartition("a", "salt").sortWithinPartitions("a", "salt", "turn")
    return ordered.mapInArrow(check, "a long, b long").distinct()


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept (the first of its component).

    Words are runs without blanks, A-Z lowered; a text's set holds its ``size``-word shingles, or its
    whole sequence if it is shorter; two texts link when 100 * intersection >= ``percent`` * union.
    The component is the smallest doc_id that links reach. A text without words links with nothing,
    nor does a row without an id. Rows that repeat an id are judged by their own text. Sets are
    compared by 64-bit token hashes, and told apart by 64 bits of their digest. An empty table gives no rows.
    """
    texts = narrow(docs, id_col, text_col)

    def described(plain_for: list[int]) -> DataFrame:
        return stage(_described(texts, size, percent, plain_for).withColumn("id", F.monotonically_increasing_id()), "described")

    rows = described([])
    # Hash groups of a set may by rare chance be too few to be sure of a common key.
    few = [r["n"] for r in rows.where("few").select("n").distinct().collect()]
    if few:
        rows = described(few)
    named = rows.where("doc_id is not null and n > 0")
    classes = named.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    many = stage(classes.where("copies > 1").select("d1", "d2", "rep", "first"), "copies")
    # A class stands in its first row, whose number names it; copies drop out here. A doc_id that is repeated
    # with another text is in several classes.
    of = named.join(checked_broadcast(many), ["d1", "d2"], "left").where("rep is null or rep = id")
    leaves = of.select("id", "doc_id", "d1", F.coalesce("first", "doc_id").alias("first"), "n", "bits", "keys")
    about = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * (100 - percent) // 100
    # Most keys have one class, and most others two.
    shared = stage(_shared_keys(leaves, about), "keys")
    pairs = shared.where("b >= 0").select(F.col("a").alias("low"), F.col("b").alias("high")).distinct()
    cut = stage(shared.where("a < 0").select("key").distinct(), "cut")
    listed = shared.where("a >= 0 and b < 0").select("key", F.col("a").alias("id"))
    if not cut.isEmpty():
        keys = leaves.select("id", F.explode("keys").alias("key"))
        listed = listed.union(stage(keys.join(checked_broadcast(cut), "key").select("key", "id"), "lists"))
    # Keys with the same list of classes are one root: by number, ends and hash of the list.
    lists = listed.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mark")
    )
    roots = lists.groupBy("m", "low", "high", "mark").agg(F.min("key").alias("root")).select(F.col("root").alias("first"), "m")
    roots = stage(stage(roots, "roots").withColumn("root", F.monotonically_increasing_id()), "roots")
    listed = stage(listed.join(checked_broadcast(roots), F.col("key") == F.col("first")).select("root", "m", "id"), "listed")
    wide = listed.where(F.col("m") > WIDE)
    of_class = wide.groupBy("id").agg(F.array_sort(F.collect_list("root")).alias("roots"))

    # Roots of two come after all others, by a number of their own.
    pairs = stage(pairs, "twos").withColumn("root", F.monotonically_increasing_id() + F.lit(TWOS))
    two = pairs.select("root", F.lit(2).cast("long").alias("m"), F.explode(F.array("low", "high")).alias("id"))
    below = stage(listed.select("id").union(two.select("id")).distinct(), "below")
    facts = leaves.select("id", "n", "bits").join(checked_broadcast(below), "id", "left_semi").join(of_class, "id", "left")
    facts = stage(facts.withColumn("roots", F.coalesce("roots", F.array().cast("array<long>"))), "facts")

    # First all pairs of narrow roots and a few of wide ones, then what isn't connected by these.
    members = listed.union(two).join(facts, "id").withColumn("part", F.col("id"))
    candidates = stage(_tree_candidates(members, percent, FIRST), "candidates")
    links = stage(_linked(candidates, leaves, texts, size, percent), "links")
    found = stage(components(links), "components")

    # Wide roots whose members are all connected have nothing to add.
    parts = wide.join(checked_broadcast(found), F.col("id") == F.col("node"), "left")
    parts = stage(parts.select("root", "m", "id", F.coalesce("component", "id").alias("part")), "parts")
    ends = parts.groupBy("root").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    apart = stage(ends.where("lo <> hi").select("root"), "apart")
    members = parts.join(checked_broadcast(apart), "root", "left_semi").join(facts, "id")
    rest = _tree_candidates(members, percent).join(candidates, ["a", "b"], "left_anti")
    rest = stage(rest, "candidates")
    if not rest.isEmpty():
        links = stage(links.union(_linked(rest, leaves, texts, size, percent)), "links")
        found = stage(components(links), "components")

    # The smallest class of a component isn't among the nodes. Its smallest doc_id names it.
    heads = found.select(F.col("component").alias("node"), "component").distinct()
    found = stage(found.union(heads), "nodes")
    first = leaves.select("id", "first").join(checked_broadcast(found), F.col("id") == F.col("node"))
    first = first.groupBy("component").agg(F.min("first").alias("least"))
    found = stage(found.join(first, "component").select("node", "least"), "firsts")
    all_ = rows.select("doc_id", "n", "d1", "d2", "id").join(checked_broadcast(many), ["d1", "d2"], "left")
    all_ = all_.withColumn("class", F.coalesce("rep", "id"))
    linked = all_.join(checked_broadcast(found), (F.col("class") == F.col("node")) & F.col("doc_id").isNotNull() & (F.col("n") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "first", "doc_id"))
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )
