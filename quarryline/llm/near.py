"""N-gram Jaccard join in metric space (operator 9).

Jaccard distance is a metric, but almost all documents lie at distance 1 from each other, so no
choice of pivot documents alone divides a corpus. The first pivots are therefore single shingles.
In one fixed order of shingles (rare ones first) a document's nearest pivot is its first shingle,
and its ball of the join's radius reaches the regions of its first ``n - ceil(t * n) + 1`` shingles
only: two documents within the radius share one of these. A document is replicated to those regions.

The order takes a fixed share of the shingle space first, by the number of sets that hold each
shingle, then the rest of that space's complement by hash, and the shingles that are frequent in
some block of texts last. So a passage that many texts share comes behind what each has alone, and
only texts that are near to each other meet. The counts are taken by ranges of the hash: a block
of texts sends each range one packed array, so no shingle and no text has rows of its own there.

Regions with the same members are one. A region is cut by size: two linked sets of sizes n <= m
have m <= n / t, so a set stands in its own size class and, as a guest, in the next one if its
window (its size and its place in the order) reaches that far. In such a cell, pivots are
documents: every member is held against the cell's pivot by their whole texts, and members within
the radius are linked. The cell is joined again around members outside the pivot's component, as
new pivots, until none is left: by then all pairs are tested, or are in one component, or are
excluded by the triangle inequality |d(x, p) - d(y, p)| > radius, by their sizes, or by their
places in the order. So no link between components is lost, and a group of near copies costs a
star of links, not all pairs. Members of a pivot are dealt to tasks in chunks, and joins by cell
take cells that hold a large share of all rows apart, so a group may hold any share of the rows.

Equal sets are one node (64-bit hashes of words, shingles and sets; a clash is the only error; the
48 bits of the packed arrays can only add candidates). Components are found by alternating
large-star and small-star steps on tables of links.

Defined results: texts without words have no shingles and link with nothing; repeated rows are
linked; a null doc_id takes part but is never the smallest id (a component of nulls alone has
null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import aside, back, discard, join_shares, materialise, read, temporary
from quarryline.llm.words import SOLID, Members, give_back, scan, text_chunks, windows

#: A shingle in this many sets of one block is counted as frequent; the most frequent that are put last.
#: Both shape the order of shingles alone: any order gives the same links.
FREQUENT, MOST_FREQUENT = 2, 250_000
#: Shingles of the fixed share for each one that a set's reach needs on average (also order alone).
SHARE = 1.6
#: Shingles in a block of packed arrays, and in a range of the hash.
BLOCK, RANGE = 1 << 19, 150_000
#: Members of a pivot in one chunk; pivots that a cell takes in its second round, and at most in one.
CHUNK, PIVOTS, MOST_PIVOTS = 250, 64, 4_096
#: Rows that are broadcast to pick texts from the table; beyond, both sides are shuffled.
PICKED = 200_000
_LAST = 2**31 - 1


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    w = scan(texts, SOLID)
    count = w.count()
    h, _ = windows(w, k)
    short: dict[int, np.ndarray] = {n: windows(w, n)[0] for n in range(1, k) if (count == n).any()}
    out = []
    for a, n in zip(w.first[:-1].tolist(), count.tolist()):
        out.append(np.unique(h[a : a + n - k + 1]) if n >= k else short[n][a : a + 1] if n else h[:0])
    return out


def set_key(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sets_of(batch: pa.RecordBatch, k: int):
    for chunk in text_chunks(batch):
        yield chunk, shingle_sets(chunk.column("text"), k)


def _nodes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (doc_id, tid, n, key), and counts of shingles that are frequent in a batch."""

    def run(batches):
        for batch in batches:
            seen, sets = set(), []
            for chunk, own in _sets_of(batch, k):
                keys = [set_key(s) for s in own]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("tid"), pa.array([len(s) for s in own], pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "tid", "n", "key"])
                for key, s in zip(keys, own):
                    if key not in seen:
                        seen.add(key)
                        sets.append(s)
                if sum(map(len, sets)) > 2 * BLOCK:
                    yield frequent(sets)
                    sets = []
            yield frequent(sets)
        give_back()

    def frequent(sets):
        h, c = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        h, c = h[c >= FREQUENT], c[c >= FREQUENT]
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(c.astype(np.int64)), pa.array(np.full(len(h), -1, np.int64)), pa.array(_signed(h))], ["doc_id", "tid", "n", "key"])

    rows = materialise(docs.mapInArrow(run, "doc_id long, tid long, n long, key long"), "near-rows")
    kept = rows.where("n >= 0")
    kept.scratch_path = rows.scratch_path
    return kept, rows.where("n < 0").groupBy("key").agg(F.sum("tid").alias("sets"))


def _pack(tokens: np.ndarray) -> bytes:
    """The six low bytes of sorted tokens, a plane for each, as their leading bytes repeat."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view(np.uint64).ravel()


def _reach(n, num: int, den: int):
    """How many shingles of a set of size n its reach holds."""
    return n + 1 + (-num * n) // den


def _shared(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray, ranges: int) -> DataFrame:
    """Rows of sets (key, n, sampled, sent, late) and of the sets' shared tokens (key, token, rank).

    A token is a shingle's 48 bits. ``sampled`` counts a set's tokens of the fixed share, ``sent``
    those and the following ones up to its reach, ``late`` has the frequent shingles that its reach
    takes in. ``rank`` is the number of sets that hold a token of the share, or _LAST behind it.
    ``frequent`` is in the order of frequency, the least frequent first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    share = np.uint64(min(65_536, int(65_536 * SHARE * (den - num) / den)))
    low = np.uint64(0xFFFF)

    def run(batches):
        last = Members(shared.value.view(np.uint64))
        by_frequency = np.empty(len(last.sorted), np.int64)
        by_frequency[np.searchsorted(last.sorted, shared.value.view(np.uint64))] = np.arange(len(last.sorted))
        seen, tokens, owners, held = set(), [], [], 0

        def block():
            t, o = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(t)
            t, o = t[order], o[order]
            at = np.searchsorted(((t >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1).astype(np.uint64))
            parts = np.flatnonzero(np.diff(at))
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([_pack(t[at[i] : at[i + 1]]) for i in parts], pa.binary()), pa.array([o[at[i] : at[i + 1]].tobytes() for i in parts], pa.binary()), none, none, none, none, pa.nulls(len(parts), pa.list_(pa.int64()))], _PACKED)

        for batch in batches:
            for _, every in _sets_of(batch, k):
                own, keys = [], []
                for s in every:
                    key = set_key(s)
                    if len(s) and key not in seen:
                        seen.add(key)
                        own.append(s)
                        keys.append(key)
                if not own:
                    continue
                keys = np.array(keys, np.int64)
                n = np.array([len(s) for s in own], np.int64)
                flat, doc = np.concatenate(own), np.repeat(np.arange(len(own)), n)
                is_late = np.zeros(len(flat), bool)
                is_late[last.find(flat)[0]] = True
                t, d = flat[~is_late] >> np.uint64(16), doc[~is_late]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
                t, d = t[new], d[new]
                first = (t & low) < share
                sampled = np.bincount(d[first], minlength=len(own))
                reach = _reach(n, num, den)
                behind = np.cumsum(~first)
                start = np.searchsorted(d, np.arange(len(own)))
                before = np.r_[0, behind][start]
                sent = first | (behind - before[d] <= (reach - sampled)[d])
                n_sent = np.bincount(d[sent], minlength=len(own))
                late: list = [()] * len(own)
                border = np.r_[0, np.cumsum(n)]
                for i in np.flatnonzero(n_sent < reach).tolist():
                    x = flat[border[i] : border[i + 1]][is_late[border[i] : border[i + 1]]]
                    x = x[np.argsort(by_frequency[np.searchsorted(last.sorted, x)])]
                    late[i] = _signed(x[: reach[i] - n_sent[i]]).tolist()
                none = pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys % ranges, pa.int32()), none, none, pa.array(keys), pa.array(n), pa.array(sampled, pa.int64()), pa.array(n_sent, pa.int64()), pa.array(late, pa.list_(pa.int64()))], _PACKED)
                tokens.append(t[sent])
                owners.append(keys[d[sent]])
                held += len(tokens[-1])
                if held >= BLOCK:
                    yield block()
                    tokens, owners, held = [], [], 0
        if held:
            yield block()
        tokens.clear()
        owners.clear()
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        blocks, sets = table.filter(table["tokens"].is_valid()), table.filter(table["key"].is_valid())
        _, at = np.unique(sets["key"].to_numpy(), return_index=True)
        sets = sets.take(at).select(["key", "n", "sampled", "sent", "late"]).append_column("token", pa.nulls(len(at), pa.int64())).append_column("rank", pa.nulls(len(at), pa.int64()))
        t = np.concatenate([np.zeros(0, np.uint64), *[_unpack(x.as_py()) for x in blocks["tokens"]]])
        o = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_py(), np.int64) for x in blocks["owners"]]])
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        group = np.r_[True, t[1:] != t[:-1]].cumsum()[: len(t)] - 1
        count = np.bincount(group, minlength=1)[group]
        t, o, count = t[count > 1], o[count > 1], count[count > 1]
        rank = np.where((t & low) < share, count, _LAST)
        none = pa.nulls(len(t), pa.int64())
        found = pa.table([pa.array(o), none, none, none, pa.nulls(len(t), pa.list_(pa.int64())), pa.array(_signed(t)), pa.array(rank, pa.int64())], sets.schema.names)
        return pa.concat_tables([sets, found.cast(sets.schema)])

    packed = docs.select("text").mapInArrow(run, "part int, tokens binary, owners binary, key long, n long, sampled long, sent long, late array<long>")
    return materialise(packed.groupBy("part").applyInArrow(meet, "key long, n long, sampled long, sent long, late array<long>, token long, rank long"), "near-shared")


_PACKED = ["part", "tokens", "owners", "key", "n", "sampled", "sent", "late"]


def _members(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(token, key, n, pos): the sets within reach of each shared token; ``pos`` is its place in the set's order, or less."""
    rows = shared.where("token is not null").groupBy("key").agg(F.count_if(F.col("rank") < _LAST).alias("first"), F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("items"))
    sets = shared.where("token is null").select(F.col("key").alias("_key"), "n", "sampled", "sent", "late")
    both = sets.join(rows, F.col("_key") == F.col("key"), "left").drop("key").withColumnRenamed("_key", "key")
    place = lambda token, pos: F.struct(token.alias("token"), pos.cast("long").alias("pos"))
    early = F.transform("items", lambda x, i: place(x["token"], F.when(x["rank"] < _LAST, F.col("sampled") - F.col("first") + i).otherwise(F.col("sampled"))))
    early = F.filter(F.coalesce(early, F.array().cast("array<struct<token: long, pos: long>>")), lambda x: x["pos"] < F.col("n") + 1 - F.ceil(num * F.col("n") / den))
    late = F.transform("late", lambda x, i: place(x, F.col("sent") + i))
    members = both.select("key", "n", F.explode(F.concat(early, late)).alias("m")).select("m.token", "key", "n", "m.pos")
    return members.where(_largest("n", "pos", num, den) * den >= F.col("n") * num)


def _largest(n: str, pos: str, num: int, den: int) -> Column:
    """The largest size of a set that may link with one of size n in the region of its pos-th shingle.

    Linked sets share some shingle so early that neither has passed more than it can lack; in that
    shingle's region this holds, so a pair that is left out of one region is met in another one.
    """
    return F.floor((F.col(n) - F.col(pos)) * (num + den) / num) - F.col(n)


def _may_meet(a: str, b: str, pos_a: str, pos_b: str, num: int, den: int) -> Column:
    near = (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)
    return near & (F.col(b) <= _largest(a, pos_a, num, den)) & (F.col(a) <= _largest(b, pos_b, num, den))


def _cells(members: DataFrame, num: int, den: int) -> DataFrame:
    """(cell, size, pivot, pivot_n, pivot_pos, key, n, pos, home): regions of the same members as one, cut by size."""
    groups = members.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("n", "key")).alias("y"))
    groups = materialise(groups.where("size > 1").select("token", "size", F.xxhash64("size", "x", "y").alias("region")), "near-groups")
    rows = members.count()
    regions = join_shares(members, groups, "token", rows, "inner").groupBy("region", "key").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    width = math.log(den / num) * 1.001  # a little wider, so that rounding never parts two sizes by two classes
    classes = lambda n: F.floor(F.log(n) / width)
    regions = regions.withColumns({"own": classes(F.col("n")), "most": classes(F.greatest(F.col("n"), _largest("n", "pos", num, den)))})
    stands = F.array(F.struct(F.col("own").alias("class"), F.lit(True).alias("home")), F.struct((F.col("own") + 1).alias("class"), F.lit(False).alias("home")))
    stands = F.explode(F.filter(stands, lambda x: x["class"] <= F.col("most")))
    cells = regions.withColumn("s", stands).select(F.xxhash64("region", "s.class").alias("cell"), "key", "n", "pos", "s.home")
    cells = materialise(cells, "near-regions")
    pivot = F.min(F.when(F.col("home"), F.struct("pos", "key", "n"))).alias("p")
    heads = cells.groupBy("cell").agg(F.count("*").alias("size"), pivot).where("size > 1 and p is not null")
    heads = materialise(heads.select("cell", "size", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.pos").alias("pivot_pos")), "near-heads")
    out = materialise(join_shares(cells, heads, "cell", cells.count(), "inner"), "near-cells")
    discard(cells, groups)
    return out, heads


def _verify(texts: DataFrame, pairs: DataFrame, k: int, name: str) -> DataFrame:
    """(a, b, n_a, n_b, common) for distinct pairs of nodes: members meet their pivot's text in chunks."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    member = pairs.join(sizes.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.lit(1).alias("role"))
    pivot = sizes.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    jobs = member.unionByName(pivot).hint("shuffle_hash")
    dealt = texts.join(jobs, F.col("key") == F.col("node")).select("a", "chunk", "role", "key", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def measure(batches):
        at, items = None, None
        for batch in batches:
            for chunk, own in _sets_of(batch, k):
                out = []
                for a, part, role, b, s in zip(*[chunk.column(i).to_pylist() for i in range(4)], own):
                    if role == 0:
                        at, items = (a, part), s
                    elif at == (a, part):
                        place = np.minimum(np.searchsorted(items, s), len(items) - 1)
                        out.append((a, b, len(items), len(s), int((items[place] == s).sum())))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["a", "b", "n_a", "n_b", "common"])

    return materialise(dealt.mapInArrow(measure, "a long, b long, n_a long, n_b long, common long"), name)


def _pick_texts(docs: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, text): one text of each node that stands in a cell."""
    wanted = materialise(nodes.select("key", F.col("rep.did").alias("did"), F.col("rep.tid").alias("rtid")).join(cells.select("key").distinct(), "key"), "near-wanted")
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_did"), F.col("tid").alias("_tid"), "text")
    few = wanted.count() <= PICKED
    found = texts.join(F.broadcast(wanted) if few else wanted.hint("merge"), (F.col("_did") == F.col("did")) & (F.col("_tid") == F.col("rtid")))
    return materialise(found.select("key", "text").dropDuplicates(["key"]), "near-texts")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of a link (a, b) is connected with.

    ``links`` is read several times. Of each round its links alone are written; what leads to them is persisted until then.
    """
    edges, written = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), False
    while True:
        n = edges.count()
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        lower = F.when(F.col("v") < F.col("u"), F.col("v"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.max(lower).alias("most"), F.max("v").alias("last"), F.count("*").alias("size")).persist()
        # Components are stars around their smallest nodes where no node has two smaller ones, or a smaller and a larger one.
        if least.where("m < u and (m < most or last > u)").count() == 0:
            least.unpersist()
            return (edges if written else edges.distinct()).select(F.col("a").alias("node"), F.col("b").alias("component"))
        large = join_shares(both.where("v > u"), least.select("u", "m", "size"), "u", 2 * n, "inner").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().persist()
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("size")).persist()
        small = join_shares(large.withColumnRenamed("a", "u"), down, "u", n, "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("u", "m")).where("a != b").distinct()
        small = materialise(small, "near-links")
        for table in (down, large, least):
            table.unpersist()
        if written:
            discard(edges)
        edges, written = small, True


def link_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, tid, n_shingles, node, component_id) for every row of docs (doc_id, text).

    ``tid`` is the text's hash, ``node`` the component's name (null without words), ``component_id`` its smallest doc_id.
    Documents link where ``den * common >= num * union`` of their sets of k-word shingles.
    """
    with temporary(docs.sparkSession) as keep:
        rows, own = _link(docs, k, num, den)
        keep(rows, own)
    with_words = rows.where("n > 0").join(own, F.col("key") == F.col("_key"), "left").select("doc_id", "tid", F.col("n").alias("n_shingles"), "node", "component_id")
    return with_words.unionByName(rows.where("n = 0").select("doc_id", "tid", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id")))


def _link(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the keys of their sets, and for each key its component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tid", F.xxhash64("text"))
    rows, counts = _nodes(docs.select("doc_id", "tid", "text"), k)
    # A task, not the driver, merges the partitions' top rows; the driver gets at most MOST_FREQUENT numbers, as Arrow.
    top = materialise(counts.orderBy(F.desc("sets"), "key").limit(MOST_FREQUENT).orderBy("sets", "key").coalesce(1).select("key"), "near-frequent")
    frequent = top.toArrow().column("key").to_numpy()
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("did"), "tid"))
    nodes = materialise(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"), rep.alias("rep")), "near-nodes")
    total = rows.where("n > 0").agg(F.sum("n")).first()[0] or 0
    shared = _shared(docs, k, num, den, np.asarray(frequent, np.int64), 1 + int(total * SHARE * (den - num) / den) // RANGE)
    members = materialise(_members(shared, num, den), "near-members")
    discard(shared)
    cells, heads = _cells(members, num, den)
    discard(members)
    texts = _pick_texts(docs, nodes, cells)
    pairs = cells.where("key != pivot").where(_may_meet("n", "pivot_n", "pos", "pivot_pos", num, den)).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    component, tested, used, more, count = None, None, None, True, 0
    while more:
        if count:
            pairs, heads, used, more = _next_pairs(cells, heads, tested, component, used, num, den, min(PIVOTS * 4 ** (count - 1), MOST_PIVOTS), count)
        pairs = materialise(pairs.distinct(), f"near-pairs{count}")
        if count and pairs.isEmpty():  # nothing to test around these pivots; the next batch may have links
            count += 1
            continue
        new = _verify(texts, pairs, k, f"near-tested{count}")
        tested = new if tested is None else tested.unionByName(new)
        linked = new.where(F.col("common") * (num + den) >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b")
        if component is None:
            component = components(linked)
        elif not linked.isEmpty():
            component = components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(linked))
        count += 1
    discard(cells, texts)
    ids = nodes.join(component, F.col("key") == F.col("node"), "left").select("key", "least_id", F.coalesce("component", "key").alias("component"))
    least = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    own = materialise(ids.select("key", "component").join(least, "component").select(F.col("key").alias("_key"), F.col("component").alias("node"), "component_id"), "near-components")
    return rows, own


def _next_pairs(cells, heads, tested, component, used, num, den, most, count):
    """The pairs of the next round: every cell's next pivots with members of other components.

    Also the heads of cells that are not settled, all pivots taken so far, and whether a cell has open
    members beyond them. Cells of two are settled.
    """
    of = component.select(F.col("node"), "component")
    of_pivot = of.withColumnsRenamed({"node": "_p", "component": "pc"})
    lead = heads.where("size > 2").join(of_pivot, F.col("pivot") == F.col("_p"), "left").select("cell", "size", F.coalesce("pc", "pivot").alias("pc")).persist()
    rows = cells.count()
    r = join_shares(cells.where("size > 2 and key != pivot").select("cell", "pivot", "key", "n", "pos", "home"), lead, "cell", rows, "inner")
    r = r.join(of.withColumnsRenamed({"node": "_k", "component": "c"}), F.col("key") == F.col("_k"), "left").withColumn("c", F.coalesce("c", "key")).drop("_k")
    distance = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("d"))
    r = materialise(r.join(distance, (F.col("pivot") == F.col("_a")) & (F.col("key") == F.col("_b")), "left").drop("_a", "_b"), f"near-open{count}")
    lead.unpersist()
    outside = r.where("c != pc")
    if used is not None:
        outside = outside.join(used.select(F.col("cell").alias("_r"), F.col("y").alias("_y")), (F.col("cell") == F.col("_r")) & (F.col("key") == F.col("_y")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("pos", "key"))
    ranked = materialise(outside.withColumn("k", rank).where(F.col("k") <= most + 1), f"near-pivots{count}")
    more = not ranked.where(F.col("k") > most).isEmpty()
    # A cell without open members outside its pivot's component is settled, as components only grow.
    heads = ranked.where("k = 1").select("cell", "size", "pivot")
    pivots = ranked.where(F.col("k") <= most).select("cell", "size", F.col("key").alias("y"), F.col("n").alias("y_n"), F.col("pos").alias("y_pos"), F.col("c").alias("y_c"), F.col("home").alias("y_home"), F.col("d").alias("dy"))
    now = pivots.select("cell", "y")
    used = now if used is None else used.unionByName(now)
    members = r.withColumnRenamed("d", "dx").drop("size", "pc", "pivot")
    both = join_shares(members, pivots, "cell", rows, "inner")
    inside = F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= 1 - num / den + 1e-9, F.lit(True))
    pairs = both.where((F.col("c") != F.col("y_c")) & (F.col("home") | F.col("y_home")) & inside).where(_may_meet("n", "y_n", "pos", "y_pos", num, den))
    pairs = pairs.select(F.col("y").alias("a"), F.col("key").alias("b"))
    done = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    done = done.union(done.select("_b", "_a"))
    return pairs.join(done, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), heads, used, more


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: the one of smallest doc_id (texts without words all stay)."""
    with temporary(docs.sparkSession) as keep:
        linked = materialise(link_documents(docs, k, num, den), "near-linked")
        words, did = linked.where("n_shingles > 0"), F.coalesce("doc_id", F.lit(0))
        # A row is the one that stays where it comes first by (doc_id, text); equal rows are all that one.
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), did.alias("did"), "tid")
        best = words.groupBy("node").agg(F.min(order).alias("w"))
        best = materialise(best.select(F.col("w.did").alias("_did"), F.col("w.tid").alias("_tid")), "near-best")
        distinct = words.select(did.alias("_near_did"), F.col("tid").alias("_near_tid")).distinct()
        gone = keep(materialise(distinct.join(best, (F.col("_near_did") == F.col("_did")) & (F.col("_near_tid") == F.col("_tid")), "left_anti"), "near-gone"))
        repeated = not words.groupBy(did, "tid").count().where("count > 1").isEmpty()
    names = {"_near_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_near_t": F.xxhash64(F.coalesce("text", F.lit("")))}
    few = gone.count() <= PICKED
    keyed = aside(docs, names).withColumns(names)
    kept = keyed.join(F.broadcast(gone) if few else gone.hint("merge"), (F.col("_near_d") == F.col("_near_did")) & (F.col("_near_t") == F.col("_near_tid")), "left_anti")
    if repeated:  # one of each stays
        has_words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(has_words).dropDuplicates(["_near_d", "_near_t"]).unionByName(kept.where(~has_words))
    return back(kept.drop("_near_d", "_near_t"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its set of 4-word shingles and the smallest doc_id that links reach (85 %)."""
    linked = link_documents(read(spark, sf_dir, "documents"), 4, 85, 100)
    return linked.select("doc_id", "n_shingles", "component_id")


#: DuckDB: all pairs that share a shingle, then the transitive closure.
OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d),
t AS MATERIALIZED (SELECT DISTINCT hash(list_sort(sh)) AS g, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0),
x AS MATERIALIZED (SELECT g, n, unnest(sh) AS v FROM t),
l AS MATERIALIZED (SELECT a.g AS a, b.g AS b FROM x a JOIN x b ON a.v = b.v AND a.g <> b.g AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY a.g, a.n, b.g, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
c(g, o) AS (SELECT g, g FROM t UNION SELECT l.b, c.o FROM c JOIN l ON l.a = c.g),
m AS (SELECT c.g, min(s.doc_id) AS component_id FROM c JOIN (SELECT hash(list_sort(sh)) AS g, doc_id FROM s WHERE len(sh) > 0) s ON s.g = c.o GROUP BY c.g)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.component_id END AS component_id FROM s LEFT JOIN m ON m.g = hash(list_sort(s.sh))
"""
