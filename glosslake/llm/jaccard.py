"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct five-word shingles; two link when their
Jaccard similarity is at least 3/4.  The join is exact and finds components:

1. Equal sets are one node (grouped by a 128-bit digest).
2. Shingles are 64-bit hashes in a global order: first the hashes in the lowest
   ``REGION`` of the hash range, rarest first, then the others by hash.  Linked
   sets share one of their first ``n div 4 + 1`` tokens.  A token of one node
   alone can link nothing; most nodes have only such tokens there and are done.
3. Nodes are partitioned into groups: at every shared token, each node is
   compared with one leader of the token (the node with the fewest tokens of
   its own), and verified links make the groups.  The comparisons grow with the
   number of tokens, not with the square of a group.
4. Nodes that still share a token with another group are ordered anew: all of
   their tokens, rarest first among these nodes.  A passage that many documents
   share then comes last in each of them and pairs nothing.
5. The token-group matrix holds every group's token union.  Where a token is
   still shared by several groups, the smaller group's nodes query the larger
   groups: a node's overlap with the union bounds its overlap with every member,
   and only groups that the bound lets pass are opened: one member for each token
   first, as one link connects two groups, and, where groups are still apart, the
   members of those parts of a group whose own unions let pass.  A common token counts only where enough of both sets comes after it in
   the order.

Sets are compared by their bitmaps first (differing bits bound the overlap),
then by their hashes; both are computed again from the texts of the candidates
alone, so nothing is shipped for the rest.

Defined cases: null, empty and blank texts have no shingles, link with nothing
and are their own component; texts of one to four words are one shingle; very
long texts are used whole; repeated rows are rows of equal sets, in one
component; a row with a null doc_id links like others, and a component of such
rows alone has a null id; an empty table gives no rows; other columns are not
read.  Tables on the way are written to the shared folder and deleted as soon
as nothing reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, discard, map_batches, materialize, table
from .components import components
from .words import chunks, mixed, windows, words_of

SHINGLE = 5
#: Share of the hash range whose tokens are counted; more than the quarter that a prefix needs.
REGION = 0.3
EDGE = int(REGION * 2**64)
#: Tokens of a part of a group's union, about.
UNION_PART = 1024
#: Bits of a set's bitmap; sets of far more tokens fill it and are compared in full.
BITMAP = 2048
#: Rounds in which one member of a group stands for it at each token, before parts of the groups are asked.
TRIES = 1
#: Tokens of a node, its first ones in the order, whose members stand for a group in a round.
STAND_INS = 3
#: Members of a part of a group, about, whose union is asked before its members are.
SUBGROUP = 32
#: Parts that meet queries of a pair of groups in the first round, about; a pair without a link meets ``MORE`` times as many in the next.
FIRST = 4
MORE = 8


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    words = words_of(texts)
    h = windows(words.hashes, list(range(SHINGLE)), SHINGLE)
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            salted = words.hashes[a:b] * np.arange(3, 3 + 2 * (b - a), 2).astype(np.uint64)
            out.append(mixed(np.array([salted.sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(h[:0])
    return out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), m (tokens in the region), digest, tokens (the region's, or a prefix if that is longer), text_md5."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi])
                size = [len(s) for s in sets]
                region = [int(np.searchsorted(s, np.uint64(EDGE))) for s in sets]
                first = [s[: max(m, n // 4 + 1)] for s, m, n in zip(sets, region, size, strict=True)]
                names = [md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(region, pa.int64()), pa.array(map(_digest, sets), pa.binary()), _lists(first), pa.array(names, pa.binary())],
                    names=["doc_id", "n", "m", "digest", "tokens", "text_md5"],
                )

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, m long, digest binary, tokens array<long>, text_md5 binary"
    return map_batches(docs.select("doc_id", "text"), sketch, shape)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens (all, sorted) and bits (a bitmap of them) of the nodes in ``wanted`` (node, doc_id, digest, text_md5).

    Rows are found by their doc_id, those without one by their text's MD5, so
    that they are no single key.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi])
                maps = pa.array(map(bitmap, sets), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), _lists(sets), maps], names=["digest", "tokens", "bits"])

    n = wanted.count()
    nameless = lambda md5: F.when(F.col("doc_id").isNull(), md5)
    ids = broadcast_if_small(wanted.select(F.col("doc_id").alias("_id"), nameless(F.col("text_md5")).alias("_md5")), n)
    own = docs.select("doc_id", "text", nameless(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).alias("_own"))
    texts = own.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_own").eqNullSafe(F.col("_md5")), "left_semi").select("text")
    sets = map_batches(texts, whole, "digest binary, tokens array<long>, bits binary")
    return sets.join(broadcast_if_small(wanted.select("digest", "node"), n), "digest").select("node", "tokens", "bits")


def bitmap(s: np.ndarray) -> bytes:
    """BITMAP bits, one set for each token."""
    bits = np.zeros(BITMAP, bool)
    bits[s % np.uint64(BITMAP)] = True
    return np.packbits(bits).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bitmaps can't rule out: bits that differ are tokens that one set has alone."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITMAP // 8) for c in ("left", "right"))
            apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(7 * ((size - apart) // 2) >= 3 * size))

    side = lambda x, bits: sets.select(F.col("node").alias(x), F.col("bits").alias(bits), F.size("tokens").cast("long").alias(f"n{x}"))
    both = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    return map_batches(both.select("a", "b", "left", "right", "na", "nb"), check, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; a written table."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = [linked(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = materialize(possible(pairs, sets), "possible")
    own = left.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a")
    both = own.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b")
    out = materialize(map_batches(both.select("a", "b", "left", "right"), check, "a long, b long"), "links", few=True)
    discard(left)
    return out


def near(n: str | Column, other: str | Column) -> Column:
    """Sizes between which a similarity of 3/4 is possible."""
    return 4 * F.least(n, other) >= 3 * F.greatest(n, other)


def shared_tokens(nodes: DataFrame) -> DataFrame:
    """node, tok, df of every emitted token that two nodes or more have; a written table."""
    each = nodes.select("node", F.explode("tokens").alias("tok"))
    # Written first: the join's sides are plain shuffles then, and a token that very many nodes share can be split.
    df = materialize(each.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    out = materialize(each.join(df, "tok").select("node", "tok", "df"), "shared")
    discard(df)
    return out


def prefixes(shared: DataFrame, nodes: DataFrame, whole: bool = False) -> DataFrame:
    """The shared tokens in each node's prefix: node, tok, n, tail, own.

    tail: how many of the node's tokens come later in the order (at most);
    own: the share of its emitted tokens that no other node has;
    whole: all tokens are emitted, so that the region is all of the hash range.

    Tokens outside the region are emitted by unsigned hash, so only that orders
    them: by their counts, a token could come after ones that others don't emit.
    """
    region = F.lit(True) if whole else (F.col("tok") >= 0) & (F.col("tok") < EDGE)
    of = Window.partitionBy("node")
    sized = shared.join(nodes.select("node", "n", "m"), "node")
    ranked = (
        sized.withColumn("inside", F.sum(region.cast("int")).over(of)).withColumn("all", F.count(F.lit(1)).over(of))
        .withColumn("at", F.row_number().over(of.orderBy(F.when(region, 0).otherwise(1), F.when(region, F.col("df")), F.col("tok").bitwiseXOR(F.lit(-(2**63))))))
    )
    k = F.expr("n div 4 + 1")
    lone = F.col("m") - F.col("inside")
    own = 1 - F.col("all") / F.greatest("m", k)
    place = F.when(region, lone + F.col("at")).otherwise(F.col("m") + F.col("at") - F.col("inside"))
    return ranked.where(~region | (lone + F.col("at") <= k)).select("node", "tok", "n", (F.col("n") - place).alias("tail"), own.alias("own"))


def reachable(n: str, tail: str, other_n: str, other_tail: str) -> Column:
    """Whether two sets whose first common token has these tails can link: one and the shorter tail are all they can share."""
    return 7 * (1 + F.least(tail, other_tail)) >= 3 * (F.col(n) + F.col(other_n))


def leader_pairs(prefix: DataFrame) -> DataFrame:
    """Each node with the leaders of its prefix tokens."""
    leaders = (
        prefix.groupBy("tok").agg(F.min(F.struct("own", "node", "n", "tail")).alias("lead"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
        .select("tok", F.col("lead.node").alias("b"), F.col("lead.n").alias("nb"), F.col("lead.tail").alias("tb"))
    )
    pairs = prefix.select("tok", F.col("node").alias("a"), "n", "tail").join(leaders, "tok")
    return pairs.where((F.col("a") != F.col("b")) & near("n", "nb") & reachable("n", "tail", "nb", "tb")).select("a", "b").distinct()


def with_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """df with comp, the group of its node; a node without links is one by itself."""
    return df.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def contested(prefix: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes that may link to a node of another group: those share a prefix token, and their sizes and tails allow it; a written table."""
    grouped = materialize(with_group(prefix.select("node", "tok", "n", "tail"), groups), "grouped")
    open_ = (
        grouped.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("tail").alias("longest"))
        .where("lo <> hi").drop("lo", "hi")
    )
    # Written first, like the matrix: a hot token's rows can be split in the join.
    open_ = materialize(open_, "open")
    rest = grouped.join(open_, "tok").where("4 * n >= 3 * least and 4 * most >= 3 * n")
    out = materialize(rest.where(reachable("n", "tail", "least", "longest")).select("node").distinct(), "contested")
    discard(grouped, open_)
    return out


def overlaps(asked: DataFrame, shared: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """q, g, inside of the asked pairs: how many tokens of q are in the union of g's sets.

    A union is cut by token into parts of about ``UNION_PART`` tokens, and a
    query's tokens are dealt to the parts in one go, so a pair is joined by a
    row for each part and not one for each token, and no row grows with a group.
    """
    own = with_group(shared.select("node", "tok"), groups).select(F.col("comp").alias("g"), "tok")
    union = materialize(own.join(asked.select("g").distinct(), "g", "left_semi").distinct(), "union")
    counts = materialize(union.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / UNION_PART).alias("parts")), "counts")
    part = lambda tok: F.pmod(tok, F.col("parts"))
    theirs = union.join(broadcast_if_small(counts), "g").groupBy("g", part(F.col("tok")).alias("part")).agg(F.collect_list("tok").alias("theirs"))
    theirs = materialize(theirs, "parts")
    ask = asked.select("q", "g").join(broadcast_if_small(counts), "g").join(sets.select(F.col("node").alias("q"), "tokens"), "q")
    whole = ask.where("parts = 1").select("q", "g", F.lit(0).cast("long").alias("part"), F.col("tokens").alias("mine"))
    each = ask.where("parts > 1").select("q", "g", F.explode("tokens").alias("tok"), "parts").withColumn("part", part(F.col("tok")))
    mine = whole.unionByName(each.groupBy("q", "g", "part").agg(F.collect_list("tok").alias("mine")))
    both = mine.join(theirs, ["g", "part"]).select("q", "g", F.size(F.array_intersect("mine", "theirs")).alias("n"))
    out = materialize(both.groupBy("q", "g").agg(F.sum("n").alias("inside")), "inside", few=True)
    discard(union, counts, theirs)
    return out


def group_links(prefix: DataFrame, shared: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect groups: nodes of different groups that share a prefix token, as far as groups are not connected already; a written table.

    The token-group matrix and the unions rule most groups out for a node.  One
    link is enough to connect two groups, so the nodes left are compared with one
    member for each of ``STAND_INS`` tokens first, others in each of ``TRIES`` rounds.
    For pairs of groups that are still apart, the matrix is made once more over
    parts of about ``SUBGROUP`` members, whose unions are small, and the members
    of the parts that it can't rule out are asked: of ``FIRST`` parts at first, of
    ``MORE`` times as many in the next round, and in the last round of all parts,
    each round for the pairs of groups alone that the rounds before have not linked.
    prefix and shared are over all tokens of the contested nodes, whose sets are in ``sets``.
    """
    size = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    grouped = with_group(prefix.select("node", "tok", "n", "tail"), groups).join(size, "comp", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    grouped = materialize(grouped, "sized")
    matrix = materialize(
        grouped.groupBy("tok", F.col("comp").alias("g"), F.col("size").alias("gs"))
        .agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("tail").alias("longest")),
        "matrix",
    )
    asked = (
        grouped.select(F.col("node").alias("q"), "tok", "n", "tail", "comp", "size").join(matrix, "tok")
        .where("(size < gs or (size = gs and comp < g)) and 4 * n >= 3 * least and 4 * most >= 3 * n").where(reachable("n", "tail", "least", "longest"))
        .groupBy("q", "g", "n").agg(F.min("least").alias("least"))
    )
    asked = materialize(asked, "asked")
    discard(matrix)
    inside = overlaps(asked, shared, groups, sets)
    passed = asked.join(inside, ["q", "g"]).where("4 * inside >= 3 * n and 7 * inside >= 3 * (n + least)").select("q", "g")
    of = grouped.select(F.col("node").alias("q"), "tok", F.col("n").alias("nq"), F.col("tail").alias("tq"), F.col("comp").alias("cq"))
    ask = materialize(passed.join(of, "q"), "ask")
    discard(asked, inside)
    members = grouped.select(F.col("comp").alias("g"), "tok", F.col("node").alias("b"), "n", "tail")
    found = []
    ends = [grouped.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")).distinct() for x in ("a", "b")]
    met = lambda links: links.join(ends[0], "a").join(ends[1], "b")

    def compared(ask: DataFrame, members: DataFrame, by: str) -> None:
        near_ones = ask.join(members, [by, "tok"]).where(near("n", "nq") & reachable("n", "tail", "nq", "tq"))
        pairs = materialize(near_ones.select(F.col("q").alias("a"), "b").distinct(), "pairs")
        found.append(verified(pairs, sets))
        discard(pairs)

    for salt in range(TRIES):
        if ask.isEmpty():
            break
        one = members.groupBy("g", "tok").agg(F.min_by(F.struct("b", "n", "tail"), F.xxhash64("b", F.lit(salt))).alias("m"))
        first = F.slice(F.sort_array(F.collect_list(F.struct("tq", "tok", "nq")), asc=False), 1, STAND_INS)
        few = ask.groupBy("q", "g").agg(F.explode(first).alias("t")).select("q", "g", "t.*")
        compared(few, one.select("g", "tok", "m.*"), "g")
        if found[-1].isEmpty():
            continue
        edges = met(reduce(DataFrame.unionByName, found)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        whole = components(edges)
        mine, theirs = (whole.select(F.col("node").alias(x), F.col("comp").alias(f"w_{x}")) for x in ("cq", "g"))
        apart = F.coalesce("w_cq", "cq") != F.coalesce("w_g", "g")
        rest = materialize(ask.join(broadcast_if_small(mine), "cq", "left").join(broadcast_if_small(theirs), "g", "left").where(apart).drop("w_cq", "w_g"), "ask")
        discard(ask, whole)
        ask = rest
    if not ask.isEmpty():
        # The matrix once more, over parts of the groups: their unions are small and rule most of them out.
        own = grouped.select("node", F.col("comp").alias("g"), "n", "size").distinct().join(ask.select("g").distinct(), "g", "left_semi")
        sub = F.xxhash64("g", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SUBGROUP)))
        own = materialize(own.select("node", "g", "n", sub.alias("sub")), "subgroups")
        sizes = own.groupBy("g", "sub").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        asked = ask.select("q", "g", "cq", F.col("nq").alias("n")).distinct().join(sizes, "g").where("4 * n >= 3 * least and 4 * most >= 3 * n")
        asked = materialize(asked.select("q", "cq", F.col("g").alias("of"), F.col("sub").alias("g"), "n", "least"), "asked")
        inside = overlaps(asked, shared, own.select("node", F.col("sub").alias("comp")), sets)
        passed = asked.join(inside, ["q", "g"]).where("4 * inside >= 3 * n and 7 * inside >= 3 * (n + least)")
        passed = materialize(passed.select("q", "cq", F.col("of").alias("g"), F.col("g").alias("sub")), "passed")
        counts = materialize(passed.groupBy("cq", "g").agg(F.count(F.lit(1)).alias("parts")), "counts")
        # A place by chance among the parts of a pair of groups, which needs no sort of a pair that has very many.
        place = F.pmod(F.xxhash64("q", "sub"), F.col("parts"))
        todo = materialize(passed.join(broadcast_if_small(counts), ["cq", "g"]).select("q", "cq", "g", "sub", place.alias("place")), "todo")
        most = counts.agg(F.max("parts")).first()[0] or 0
        discard(passed, counts)
        of = grouped.select(F.col("comp").alias("g"), "tok", F.col("node").alias("b"), "n", "tail").join(own.select(F.col("node").alias("b"), "sub"), "b")
        each = ask.select("q", "tok", "nq", "tq").distinct()
        least, end = 0, FIRST
        while least < most:
            turn = todo.where((F.col("place") >= least) & (F.col("place") < end)).select("q", "sub")
            compared(turn.join(each, "q"), of.select("sub", "tok", "b", "n", "tail"), "sub")
            least, end = end, MORE * end
            if least < most and not found[-1].isEmpty():
                linked_ones = materialize(met(found[-1]).select(F.col("ca").alias("cq"), F.col("cb").alias("g")).distinct(), "met")
                rest = materialize(todo.where(F.col("place") >= least).join(broadcast_if_small(linked_ones), ["cq", "g"], "left_anti"), "todo")
                discard(todo, linked_ones)
                todo = rest
                if todo.isEmpty():
                    break
        discard(own, asked, inside, todo)
    discard(grouped, ask)
    return reduce(DataFrame.unionByName, found) if found else sets.sparkSession.createDataFrame([], "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), comp and text_md5 of every row of docs; comp is the same long for linked rows; a written table."""
    rows = materialize(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = rows.where("n > 0")
    copies = some.groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "node")
    copies = materialize(copies, "first")  # a digest that very many rows have can be split in the join
    spare = materialize(some.select("row", "digest").join(copies, "digest").where("row <> node").select("row", "node"), "copies", few=True)
    discard(copies)
    nodes = some.withColumnRenamed("row", "node").join(broadcast_if_small(spare.select(F.col("row").alias("node"))), "node", "left_anti")
    shared = shared_tokens(nodes)
    prefix = materialize(prefixes(shared, nodes), "prefix")
    discard(shared)
    keys = nodes.select("node", "doc_id", "digest", "text_md5")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(keys.join(nodes, "node", "left_semi"), "wanted", few=True)
        sets = materialize(full_sets(docs, wanted), "sets")
        if sets.count() != wanted.count():  # rows may repeat an id and its text
            again, sets = sets, materialize(sets.dropDuplicates(["node"]), "sets")
            discard(again)
        discard(wanted)
        return sets

    pairs = materialize(leader_pairs(prefix), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    found = verified(pairs, sets)
    discard(pairs, sets)
    groups = components(found)
    open_ = contested(prefix, groups)
    discard(prefix)
    sets = sets_of(open_)
    all_tokens = sets.select("node", "tokens", F.size("tokens").cast("long").alias("n")).withColumn("m", F.col("n"))
    shared = shared_tokens(all_tokens)
    prefix = materialize(prefixes(shared, all_tokens, whole=True), "prefix")
    comps = components(found.unionByName(group_links(prefix, shared, groups, sets)))
    discard(open_, shared, prefix, sets, groups, found)
    whole = (
        rows.select("doc_id", "n", "row", "text_md5").join(spare, "row", "left").withColumn("node", F.coalesce("node", "row"))
        .join(broadcast_if_small(comps), "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("comp"), "text_md5")
    )
    out = materialize(whole, "classes", few=True)
    discard(rows, spare, comps)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and text_md5 of every row of docs."""
    whole = classes(docs)
    # Written first, and of groups alone: a group that very many rows belong to can be split in the join.
    ids = whole.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    out = whole.join(broadcast_if_small(materialize(ids, "ids")), "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_md5")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; texts without words stay.

    The one that stays has the smallest doc_id, and the least MD5 of its text
    among rows without one.  A document is a doc_id with its text: rows that
    repeat both count as one, and one of them stays; different texts of one
    doc_id are different documents.
    """
    whole = classes(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))) == F.col("_md5"))
    named = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")).alias("first")
    kept = materialize(whole.groupBy("comp").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("comp", "first.doc_id", "first.text_md5"), "kept")
    other = ~(F.col("w.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("w.text_md5") == F.col("k.text_md5")))
    gone = whole.alias("w").join(broadcast_if_small(kept).alias("k"), "comp").where(other).select("w.doc_id", "w.text_md5")
    gone = materialize(named(gone.distinct()), "gone")
    left = docs.join(broadcast_if_small(gone), same, "left_anti")
    again = whole.groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = materialize(named(again), "again")
    discard(whole, kept)
    if n := again.count():
        again = broadcast_if_small(again, n)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_md5")


OP4_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
c AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
b AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
p AS MATERIALIZED (SELECT x, y FROM b JOIN c cx ON cx.r = x JOIN c cy ON cy.r = y WHERE 100 * b.n >= 75 * (cx.n + cy.n - b.n)),
e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
k AS (SELECT r AS x, r AS y FROM w UNION SELECT k.x, e.y FROM k JOIN e ON e.x = k.y)
SELECT w.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(o.doc_id) AS component_id FROM w LEFT JOIN c USING (r) JOIN k ON k.x = w.r JOIN w o ON o.r = k.y GROUP BY w.r, w.doc_id
"""
