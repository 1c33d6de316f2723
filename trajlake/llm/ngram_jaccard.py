"""Similarity join of documents by the Jaccard index of their word n-gram sets, through prefix trees.

1. N-grams get one global order: those known to be frequent last, by frequency, else by hash. Any order gives the same
   result; this one keeps what many documents share out of the prefixes.
2. Two similar sets share an n-gram in their prefixes of that order, and one more for each n-gram by which the prefixes
   are longer. Equal sets are one class from here on.
3. Classes that share a prefix n-gram are a group. Small groups give candidate pairs, a bounded number for each member.
   Large ones give none: their members are described anew by what sets them apart from a pivot that most of them resemble.
   Those near it link by that alone, through one member; the others look for partners by the n-grams of their differences,
   in groups that are cut likewise, level by level. So many near copies that just miss the threshold don't meet in pairs.
4. Candidates between components are verified in blocks: a probe's partners are stored as a prefix tree of their ordered
   n-grams, and the probe walks it, so that what partners share is overlapped once and a subtree ends where the rest is
   too short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import drop, materialize, scratch, small_broadcasts, unused
from trajlake.llm.components import components

#: The frequent n-grams that the order knows: so many at most (12 bytes each are broadcast), which occur in so many documents
#: of one in PART.
FREQUENT, FREQUENT_FROM, PART = 1 << 20, 3, 8
#: Pairs, about, that a task's group of the verification has.
BLOCK = 256
#: Members of a group, about, up to which they meet in pairs; larger ones become cells, for so many levels (beyond, all pairs
#: meet). Which groups are large shows in one in PART of the members.
HOT, LEVELS = 128, 4
#: Members of a cell that its pivot is made of; bytes of all pivots up to which they are broadcast, and the parts that the
#: cells are cut into for a join by shuffle beyond that.
SAMPLE, PIVOT_BYTES, SALTS = 16, 1 << 25, 64
#: A prefix is longer by an n-gram for each so many of its set.
SPARE = 50
#: Ids, n-grams or cells up to which a table of them is broadcast; beyond it both sides are shuffled.
BROADCAST = 250_000
#: Rows of 16 bytes up to which a list of sets is broadcast to pick these; beyond it the sets are shuffled. The driver holds
#: some 140 bytes a row of a broadcast.
NODES = 1 << 19


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text with the text's number, by text and hash."""
    data, bounds = _text.raw(texts)
    data = _text.LOWER[data]
    starts, ends, first = _text.spans(data, bounds, _text.NOT_SPACE)
    words, owner, n = _text.hashes(data, starts, ends), _text.owners(first), np.diff(first)
    grams = _text.windows(words, size)
    whole = owner[: len(grams)] == owner[size - 1 :] if len(grams) else np.zeros(0, bool)
    found, of = [grams[whole]], [owner[: len(grams)][whole]]
    for short in range(1, size):
        at = np.flatnonzero(n == short)
        h = np.full(len(at), short, np.uint64)
        for j in range(short):
            h = h * _text._BASE + words[first[at] + j]
        found.append(_text.mix(h))
        of.append(at)
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted, and in how many documents they are, by one in PART of the documents.

    They only make the global order, and any order gives the same result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches, limit=1 << 23):
            gram, n = np.unique(_sets(piece.column("text"), size)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    part = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PART)) == 0).select(F.col("text").cast("string").alias("text"))
    counts = part.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.col("n").desc(), "gram").limit(FREQUENT).toArrow()
    gram, n = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.int32)
    order = np.argsort(gram)
    return gram[order], n[order]


def _ordered(texts: pa.Array, size: int, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram sets in the global order, one after another, and where each begins."""
    grams, of = _sets(texts, size)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    gram, n = known
    if len(gram):
        at = np.minimum(np.searchsorted(gram, grams), len(gram) - 1)
        cost = np.where(gram[at] == grams, n[at], 0)
        grams = grams[np.lexsort((cost, of))]  # stable: by hash within a cost
    return grams, bounds


def _nodes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(grams ^ _text._BASE), dtype=np.uint64)])
    return _text.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _walk(probe: np.ndarray, partners: list[tuple[int, bytes]], p: int, q: int) -> list[int]:
    """The partners whose Jaccard index with probe is p/q at least, by a walk of the tree of their n-grams.

    Sorted, the partners are the tree's leaves from left to right: the depth that one shares with the last is where their
    paths part, and the overlaps down to there are taken over. overlap and reach hold, by depth, the n-grams in common so
    far and how much of the probe lies behind the last of them.
    """
    order = np.argsort(probe)
    by_hash, found = probe[order], []
    last, known = np.zeros(0, np.uint64), 0
    overlap, reach = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for key, blob in sorted(partners, key=lambda x: x[1]):
        path = np.frombuffer(blob, ">u8").astype(np.uint64)
        need = -(-p * (len(probe) + len(path)) // (p + q))
        n = min(len(path), len(last), known)
        parted = path[:n] != last[:n]
        depth = int(parted.argmax()) if parted.any() else n
        overlap, reach, last = overlap[: depth + 1], reach[: depth + 1], path
        while depth < len(path) and overlap[depth] + min(len(path) - depth, len(probe) - reach[depth]) >= need:
            step = path[depth : depth + 128]
            at = np.minimum(np.searchsorted(by_hash, step), len(by_hash) - 1)
            hit = by_hash[at] == step
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(hit)])
            reach = np.concatenate([reach, np.maximum.accumulate(np.maximum(reach[-1], np.where(hit, order[at] + 1, 0)))])
            depth += len(step)
        known = depth
        if depth == len(path) and overlap[depth] >= need:
            found.append(key)
    return found


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table, marked to be broadcast if it has rows rows at most; a larger one is joined by a shuffle, small as its files may be."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")


def _groups(rows: DataFrame, member: F.Column) -> tuple[DataFrame, DataFrame]:
    """Members of rows (key, node and others) by key: small groups (key, members) of two or more, and the rows of large ones.

    Rows of large groups are told by a broadcast of their keys and never dealt by key.
    """
    part = rows.filter(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(PART)) == 0).groupBy("key").agg(F.count("*").alias("c"))
    keys = materialize(part.filter(F.col("c") >= max(2, HOT // PART)).select("key"), "jaccard_keys")
    told = rows.join(_small(keys.withColumn("large", F.lit(True)), BROADCAST), "key", "left")
    hot = materialize(told.filter("large").drop("large"), "jaccard_hot")
    cold = told.filter("large IS NULL").withColumn("c", F.count("*").over(W.partitionBy("key"))).filter("c > 1")
    groups = materialize(cold.groupBy("key").agg(F.collect_list(member).alias("members")), "jaccard_groups")
    drop(keys)
    return groups, hot


def _recentre(cells: DataFrame, sets: DataFrame, known, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Members of the cells as what sets them apart from their cell's pivot, and links that follow from that alone.

    The pivot has the n-grams of most of a few members. For any pivot, sets a and b differ in |A| + |B| - 2 |A & B|
    n-grams, A and B being their differences from it. With w = (p + q) |A| - (q - p) n they link when
    w(a) + w(b) <= 2 (p + q) |A & B|. So all that link for their w alone link with the member of least w, and other
    partners share n-grams of A and B: first those that few have, then those that others have and they lack.
    """
    some = cells.groupBy("cell", F.pmod(F.xxhash64("node"), F.lit(SAMPLE)).alias("nth")).agg(F.min_by("node", F.xxhash64("node", F.lit(1))).alias("node"))

    def agree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gram, n = np.unique(np.concatenate([np.frombuffer(x, ">u8") for x in rows["grams"]]), return_counts=True)
        return pd.DataFrame({"cell": [key[0]], "pivot": [gram[n * 2 > len(rows)].astype(">u8").tobytes()]})

    pivots = materialize(_small(some, NODES).join(sets, "node").select("cell", "grams").groupBy("cell").applyInPandas(agree, "cell long, pivot binary"), "jaccard_pivots")
    size = pivots.agg(F.sum(F.octet_length("pivot") + 64)).first()[0] or 0
    placed = _small(cells, NODES).join(sets, "node")
    if size <= PIVOT_BYTES:
        placed = placed.join(F.broadcast(pivots), "cell")
    else:
        salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "salt"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = known.value[0]
        for batch in batches:
            n, lists = [], []
            for grams, pivot in zip(batch.column("grams"), batch.column("pivot"), strict=True):
                grams, pivot = (np.frombuffer(x.as_buffer(), ">u8").astype(np.uint64) for x in (grams, pivot))
                added, lacking = grams[~_among(grams, pivot)], pivot[~_among(pivot, np.sort(grams))]
                common = _among(added, often)
                n.append(len(grams))
                lists.append(np.concatenate([added[~common], lacking, added[common]]).view(np.int64))
            d = np.array([len(x) for x in lists], np.int64)
            n = np.array(n, np.int64)
            deltas = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(d)).astype(np.int32)), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("node"), pa.array(n), pa.array(d), pa.array((p + q) * d - (q - p) * n), deltas], names=["cell", "node", "n", "d", "w", "delta"])

    deltas = materialize(placed.select("cell", "node", "grams", "pivot").mapInArrow(differ, "cell long, node long, n long, d long, w long, delta array<long>"), "jaccard_deltas")
    least = materialize(deltas.groupBy("cell").agg(F.min(F.struct("w", "node")).alias("least")).select("cell", F.col("least.w").alias("least_w"), F.col("least.node").alias("star")), "jaccard_stars")
    near = deltas.join(_small(least, BROADCAST), "cell")
    sure = F.col("w") + F.col("least_w") <= 0
    stars = near.filter(sure & (F.col("node") != F.col("star"))).select(F.col("star").alias("a"), F.col("node").alias("b"))
    stars = materialize(stars.distinct(), "jaccard_links")
    # By the member of least w, and as similar sets differ from the pivot by about as much: w(b) >= w(a) - 2 (q - p) n(b).
    by_least = F.ceil((F.col("w") + F.col("least_w")) / (2 * (p + q)))
    by_size = F.ceil((F.col("w") - F.ceil(F.col("n") * (q * (q - p)) / p)) / (p + q))
    shared = F.greatest(F.lit(1), by_least, by_size).cast("int")
    upto = F.slice("delta", F.lit(1), F.greatest(F.lit(0), F.col("d").cast("int") - shared + 1))
    root = F.when(sure, F.col("star")).otherwise(F.col("node")).alias("root")
    members = materialize(near.select("cell", "node", "d", "w", root, F.posexplode(upto).alias("pos", "key")), "jaccard_members")
    drop(pivots, deltas, least)
    return members, stars


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _verify(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Those of the pairs (a, b, home) that are similar. Each set goes once to every home in which it is a pair's.

    A home's pairs are mostly those of a family, so partners meet many probes. A task's group has as many homes as hold
    about BLOCK pairs. What has no set here shares too few n-grams to be similar to anything.
    """
    n = pairs.count()
    groups = n // BLOCK + 1
    dealt = pairs.select(F.pmod(F.xxhash64("home"), F.lit(groups)).alias("part"), "a", "b")
    nodes = dealt.select("part", F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = (F.broadcast(nodes) if 2 * n <= NODES else nodes.hint("merge")).join(sets, "node")
    nodes = nodes.select("part", "node", "grams").toDF("part", "node", "grams")  # toDF: columns of its own, for cogroup

    def verify(pairs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        blobs, out = dict(zip(nodes["node"], nodes["grams"], strict=True)), []
        for a, partners in pairs.groupby("a")["b"]:
            if a in blobs:
                probe = np.frombuffer(blobs[a], ">u8").astype(np.uint64)
                out += [(a, b) for b in _walk(probe, [(b, blobs[b]) for b in partners if b in blobs], p, q)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("part").cogroup(nodes.groupBy("part")).applyInPandas(verify, "a long, b long")


def _able(x: F.Column, y: F.Column, p: int, q: int) -> F.Column:
    """Whether two members that meet in an n-gram can be similar by what is left from there on, and aren't known to be.

    For the first n-grams that similar sets share, as many as their prefixes have to spare and one, this holds, so no pair
    is lost.
    """
    left = F.least(x["d"] - x["pos"], y["d"] - y["pos"]) + F.greatest(x["spare"], y["spare"])
    w = x["w"] + y["w"]
    return (x["root"] != y["root"]) & (w > 0) & (left * (2 * (p + q)) >= w)


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members x and y, each once, that meet in more n-grams than their prefixes have to spare.

    home is one of the homes that they meet in.
    """
    ends = F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"), F.least("x.spare", "y.spare").alias("spare")
    by = met.select(*ends, "home").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("spare").alias("spare"), F.min("home").alias("home"))
    return by.filter("c > spare").select("a", "b", "home")


def _links(groups: DataFrame, hot: DataFrame, sets: DataFrame, known, p: int, q: int) -> DataFrame:
    """Links (a, b) whose components are those of all links, from small groups and the rows of large ones.

    A large group becomes a cell of the next level: at first, one cell for all those in which the same member is first by
    hash (they are mostly the same members), later one for those of the same members.
    """
    links, whole, level = None, groups, 0
    member = F.struct("node", "d", "w", F.lit(0).cast("long").alias("spare"), "pos", "root")
    while level < LEVELS:
        by = hot.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("first"), F.bit_xor(F.xxhash64("node")).alias("same"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        by = by.filter("lo <> hi").select("key", F.xxhash64("same" if level else "first").alias("cell"))
        cells = materialize(hot.join(_small(by, BROADCAST), "key").select("cell", "node").distinct(), "jaccard_cells")
        if cells.isEmpty():
            break
        members, stars = _recentre(cells, sets, known, p, q)
        links = stars if links is None else links.unionByName(stars)
        drop(cells, hot)
        rows = members.select(F.xxhash64("cell", "key").alias("key"), "node", "d", "w", "pos", "root")
        groups, hot = _groups(rows, member)
        drop(members)
        whole, level = whole.unionByName(groups), level + 1

    # First each group's members against one of them, where they share enough; then what is not joined by that.
    x, y = F.col("x"), F.col("y")
    first = F.array_min(F.transform("members", lambda m: F.named_struct(F.lit("h"), F.xxhash64(m["node"]), F.lit("m"), m)))["m"]
    whole = whole.select(first.alias("first"), "members")
    home = F.col("first.node").alias("home")
    met = whole.select(F.col("first").alias("x"), F.explode("members").alias("y"), home).filter(_able(x, y, p, q))
    tried = materialize(_pairs(met), "jaccard_pairs")
    found = materialize(_verify(tried, sets, p, q), "jaccard_links")
    links = found if links is None else links.unionByName(found)
    labels = components(links)

    met = whole.select(F.explode("members").alias("x"), "members", home)
    met = met.select("x", F.explode(F.filter("members", lambda m: (m["node"] > x["node"]) & _able(x, m, p, q))).alias("y"), "home")
    if level == LEVELS:
        side = lambda c: hot.select("key", member.alias(c))
        late = side("x").join(side("y"), "key").filter("y.node > x.node").filter(_able(x, y, p, q))
        met = met.unionByName(late.select("x", "y", F.col("y.node").alias("home")))
    pairs = _pairs(met).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    for end in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    pairs = materialize(pairs.filter(apart).select("a", "b", "home"), "jaccard_pairs")
    found = materialize(_verify(pairs, sets, p, q), "jaccard_links")
    drop(tried, pairs, hot)
    return links.unionByName(found)


def _similar_groups(docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    p, q = similarity
    context = docs.sparkSession.sparkContext
    known = context.broadcast(frequent(docs, size))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            grams, bounds = _ordered(piece.column("text"), size, known.value)
            n = np.diff(bounds)
            upto = np.where(n > 0, np.minimum(n, n - -(-p * n // q) + 1 + n // SPARE), 0)  # what the larger of two similar sets looks up
            ends = np.cumsum(upto)
            pick = np.arange(ends[-1]) - np.repeat(ends - upto - bounds[:-1], upto)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(grams[pick].view(np.int64)))
            node = pa.array(_nodes(grams, bounds), mask=n == 0)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), node, prefix], names=["doc_id", "n", "node", "prefix"])

    with_prefix = materialize(rows.mapInArrow(prefixes, "doc_id long, n long, node long, prefix array<long>"), "jaccard_prefixes")
    by_set = with_prefix.filter(F.col("node").isNotNull()).groupBy("node")
    classes = materialize(by_set.agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "jaccard_classes")
    documents, least = materialize(with_prefix.drop("prefix"), "jaccard_documents"), materialize(classes.select("node", "least"), "jaccard_least")
    drop(with_prefix)
    n = F.col("n")
    as_member = n.alias("d"), (2 * p * n).alias("w"), F.floor(n / SPARE).alias("spare"), "pos", F.col("node").alias("root")
    groups, hot = _groups(classes.select("node", "n", F.posexplode("prefix").alias("pos", "key")), F.struct("node", *as_member))
    drop(classes)
    # A partner has p/q of a set's n-grams at least, and a prefix longer accordingly: so many n-grams they share.
    met = groups.select(F.inline("members")).select("node", "d").unionByName(hot.select("node", n.alias("d"))).groupBy("node").agg(F.count("*").alias("c"), F.first("d").alias("n"))
    wanted = materialize(met.filter(F.col("c") > F.floor(F.ceil(n * p / q) / SPARE)).select("node").join(least, "node"), "jaccard_wanted")
    ids = wanted.select(F.col("least").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    ids = _small(ids, BROADCAST)
    texts = rows.join(ids, "doc_id", "left_semi").unionByName(rows.filter("doc_id IS NULL"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            grams, bounds = _ordered(piece.column("text"), size, known.value)
            blobs = [grams[a:b].astype(">u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(grams, bounds)), pa.array(blobs, pa.binary())], names=["node", "grams"])

    sets = texts.select("text").mapInArrow(whole, "node long, grams binary")
    sets = materialize(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "jaccard_sets")
    hot = hot.join(wanted.select("node"), "node", "left_semi").select("key", "node", *as_member)

    links = _links(groups, materialize(hot, "jaccard_hot"), sets, known, p, q)
    drop(sets, wanted, groups)
    joined = components(links).join(least.hint("merge"), "node")
    roots = joined.groupBy("root").agg(F.min("least").alias("id"))
    linked = joined.join(roots, "root").select("node", "id")
    least = least.join(linked, "node", "left").select("node", F.coalesce("id", "least").alias("least"))
    ids = documents.join(least, "node", "left")
    return ids.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def similar_groups(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A text's set has its distinct n-grams of size words (A-Z lower-cased); a text with fewer words is one n-gram. Documents
    link when the Jaccard index is similarity (p, q), that is p/q, at least. component_id is the least doc_id reachable.
    N-grams and sets are known by 64-bit hashes.

    Null, empty or blank text: n_shingles 0, no links. Null doc_id: the row keeps n_shingles and, having no id to be reached
    by, gets the least doc_id of its equals and their links, else null. Repeated rows give repeated results, and equal sets
    always link. No rows give no rows. Other columns are ignored.
    """
    with small_broadcasts(docs.sparkSession):
        return _similar_groups(docs, size, similarity)


def drop_similar(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """The documents, with all their columns, but of each group of similar ones only that with the least doc_id.

    Rows without a doc_id or text stay. Rows that share a doc_id stay or go together.
    """
    name = unused("gone", docs.columns)
    with scratch(docs.sparkSession):
        gone = similar_groups(docs, size, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
        gone = materialize(gone, "jaccard_gone", keep=True)
    return docs.join(_small(gone, BROADCAST), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, similarity=(90, 100))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(t) FROM r WHERE s = d.doc_id) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""
