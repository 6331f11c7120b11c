"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from the head of its base conversation and its own later turns. No
rebuilt text is made: a sequence of turns has the fingerprint sum(letter(i) * base ** i), which
composes, so a rebuilt prefix is its base's head combined with a shifted difference of two of its
own prefixes. Equal fingerprints of one depth are a group, a node of the trie.

Groups are verified. Every turn carries the place of the first stored turn of the same role and
text (texts are compared whole, also where digests are equal), and a group is right if its members
agree on the reference of the last turn and on the parent's group; by induction from the root
their sequences are equal. Where a group fails, all fingerprints are made with the next base.

Everything else is sums over (conversation, depth), which combine before they are shuffled. A
conversation is the owner of the nodes whose smallest member it is, and these are the nodes from
some depth on. So what is summed over a node's subtree is summed over its members: all their code
points beyond the node, less what owners hold, which is one text per node.

Conversations of any length are cut by ranges of their turns, and the pieces' products combined.
The members that end in a node are joined to short texts by many tasks; the digest of these is
streamed.

Defined cases: rows without conv_id belong to no conversation. Turns come by turn (null first),
then role, then text; repeated rows are turns like others. Null roles and texts are empty.
Negative ids round towards zero, as ``%`` does in SQL. The root exists as soon as there is a
conversation; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.shared import checked_join, keep

#: The distance of bases and the number of different heads.
EVERY = 100
HEADS = 6

#: Fingerprints are sums modulo this prime, four at once.
PRIME = (1 << 31) - 1
PARTS = 4
_DIGIT = 8
#: Ids in one text of ends.
IDS_AT_ONCE = 1 << 16
#: A merge row has some eight numbers.
_ROW_BYTES = 160


@dataclass(frozen=True)
class Letters:
    """Bases of the four sums, and what turns a reference into four letters."""

    bases: tuple[int, ...]
    salt: int

    @classmethod
    def drawn(cls, seed: int) -> Letters:
        return cls(tuple(int(b) for b in np.random.default_rng(seed).integers(1 << 20, PRIME, PARTS)), seed)

    def power(self, i: int, exponent: Column) -> Column:
        """``bases[i] ** exponent`` for an exponent below 2 ** 40, from five tables of powers."""
        found = F.lit(1).cast("long")
        for digit in range(5):
            step = pow(self.bases[i], 1 << (_DIGIT * digit), PRIME)
            table = F.expr(f"array({', '.join(f'{pow(step, n, PRIME)}L' for n in range(1 << _DIGIT))})")
            at = F.shiftright(exponent.cast("long"), _DIGIT * digit).bitwiseAND(F.lit((1 << _DIGIT) - 1))
            found = found * F.get(table, at) % PRIME
        return found

    def back(self, i: int, steps: Column) -> Column:
        """``bases[i] ** -steps`` for fewer steps than there are heads."""
        once = pow(self.bases[i], PRIME - 2, PRIME)
        return F.get(F.array(*[F.lit(pow(once, n, PRIME)).cast("long") for n in range(HEADS)]), steps)

    def letter(self, i: int, reference: Column) -> Column:
        return F.pmod(F.xxhash64(reference, F.lit(self.salt), F.lit(i)), F.lit(PRIME))


def _sha256(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def head_size(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def _stored(conversations: DataFrame, digest) -> DataFrame:
    """(conv_id, seq, digest, role, text): turns with their place in the order of all turns."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        # Rows that are equal in all else may lie on both sides of a cut.
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    return keep(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", F.monotonically_increasing_id().alias("seq"), digest(F.col("role"), F.col("text")).alias("digest"), "role", "text")
    )


def _referenced(stored: DataFrame) -> DataFrame:
    """(conv_id, seq, ref, chars): turns with the first place of an equal turn."""
    content = F.struct("role", "text")
    first = keep(
        stored.groupBy("digest")
        .agg(F.min("seq").alias("ref"), (F.min(content) != F.max(content)).alias("mixed"))
    )
    turns = stored.select("conv_id", "seq", "digest", F.length("text").cast("long").alias("chars"))
    plain = turns.join(first.filter("NOT mixed").select("digest", "ref").hint("shuffle_merge"), "digest")
    found = plain.select("conv_id", "seq", "ref", "chars")
    collided = first.filter("mixed").select("digest")
    if not collided.isEmpty():
        unlike = keep(stored.join(collided.hint("shuffle_merge"), "digest", "left_semi"))
        exact = unlike.groupBy("role", "text").agg(F.min("seq").alias("ref"))
        some = unlike.join(exact.hint("shuffle_merge"), ["role", "text"])
        found = found.unionByName(some.select("conv_id", "seq", "ref", F.length("text").cast("long").alias("chars")))
    return keep(found)


_SUMS = [f"q{i}" for i in range(PARTS)]


def _products(turns: DataFrame, letters: Letters) -> DataFrame:
    """``turns`` with ``pos`` and the products up to and including each turn, over whole conversations.

    The products of a piece, the turns of a conversation in one range of the order, are running
    sums; pieces before a piece shift it and add to it.
    """
    local = Window.partitionBy("conv_id", "piece").orderBy("seq")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("piece", F.shiftright("seq", 33)).withColumn("at", (F.row_number().over(local) - 1).cast("long"))
    terms = placed.select(
        "*", *[(letters.letter(i, F.col("ref")) * letters.power(i, F.col("at")) % PRIME).alias(f"t{i}") for i in range(PARTS)]
    )
    run = keep(
        terms.select(
            "conv_id", "piece", "at", "ref", "chars",
            F.sum("chars").over(upto).alias("c"),
            *[(F.sum(f"t{i}").over(upto) % PRIME).alias(q) for i, q in enumerate(_SUMS)],
            *[f"t{i}" for i in range(PARTS)],
        )
    )
    last = F.max_by(F.struct("c", *_SUMS), "at").alias("last")
    pieces = run.groupBy("conv_id", "piece").agg(F.count("*").alias("size"), last).select("conv_id", "piece", "size", "last.*")
    # A conversation has at most as many pieces as the order has ranges, and nearly all have one.
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sized = pieces.withColumn("size", F.coalesce(F.sum("size").over(before), F.lit(0)))
    moved = sized.select(
        "conv_id", "piece", "size", "c",
        *[letters.power(i, F.col("size")).alias(f"p{i}") for i in range(PARTS)],
        *[(F.col(q) * letters.power(i, F.col("size")) % PRIME).alias(q) for i, q in enumerate(_SUMS)],
    )
    heads = keep(
        moved.select(
            "conv_id", "piece",
            F.col("size").alias("size_before"),
            F.sum("c").over(before).alias("c_before"),
            *[f"p{i}" for i in range(PARTS)],
            *[(F.sum(q).over(before) % PRIME).alias(f"{q}_before") for q in _SUMS],
        ).filter("size_before > 0")
    )
    whole = checked_join(run, heads, ["conv_id", "piece"], "left", _ROW_BYTES)

    def shifted(i: int, column: str) -> Column:
        shift = F.coalesce(f"p{i}", F.lit(1))
        return ((F.col(column) * shift + F.coalesce(f"q{i}_before", F.lit(0))) % PRIME).alias(f"q{i}")

    return keep(
        whole.select(
            "conv_id",
            (F.col("at") + F.coalesce("size_before", F.lit(0))).alias("pos"),
            "ref",
            "chars",
            (F.col("c") + F.coalesce("c_before", F.lit(0))).alias("c"),
            *[shifted(i, q) for i, q in enumerate(_SUMS)],
            *[(F.col(f"t{i}") * F.coalesce(f"p{i}", F.lit(1)) % PRIME).alias(f"t{i}") for i in range(PARTS)],
        )
    )


def _rebuilt(turns: DataFrame) -> DataFrame:
    """One row per conversation: how its head and its own turns compose, kept.

    ``h`` own turns are replaced by ``heads[0..hb)``; ``own`` are the products of those h turns.
    """
    h = head_size(F.col("conv_id"))
    at_h = F.when(F.col("pos") == h - 1, F.struct("c", *_SUMS))
    own = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.max("c").alias("c_all"), F.max(at_h).alias("own")
    ).withColumn("h", h)
    firsts = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % EVERY == 0))
    heads = firsts.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "ref", "chars", "c", *_SUMS))).alias("heads")
    )
    # At most 199 conversations share a base.
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).join(heads.hint("shuffle_merge"), "base", "left")
    hb = F.least(F.col("h"), F.coalesce(F.size("heads"), F.lit(0))).cast("int")
    none = F.struct(F.lit(0).cast("long").alias("c"), *[F.lit(0).cast("long").alias(q) for q in _SUMS])
    last = F.get("heads", F.col("hb") - 1)
    head = F.when(F.col("hb") > 0, F.struct(*[last[c].alias(c) for c in ("c", *_SUMS)])).otherwise(none)
    longer = F.col("n") > F.col("h")
    return keep(
        joined.withColumn("hb", F.greatest(hb, F.lit(0)))
        .withColumn("head", head)
        .withColumn("own", F.when(F.col("h") > 0, F.col("own")).otherwise(none))
        .select(
            "conv_id", "n", "h", "hb", "head", "own",
            F.when(F.col("hb") > 0, F.slice("heads", F.lit(1), F.col("hb"))).alias("heads"),
            (F.col("hb") + F.when(longer, F.col("n") - F.col("h")).otherwise(0)).alias("size"),
            (F.col("head.c") + F.when(longer, F.col("c_all") - F.col("own.c")).otherwise(0)).alias("total"),
        )
    )


def _keys(sums: list[Column], names: tuple[str, str]) -> list[Column]:
    """Four sums as two numbers of 62 bits."""
    return [(sums[2 * i] * (1 << 31) + sums[2 * i + 1]).alias(name) for i, name in enumerate(names)]


_PREFIX = ["conv_id", "depth", "a", "b", "pa", "pb", "ref", "chars", "before", "size", "total"]


def _prefixes(turns: DataFrame, rebuilt: DataFrame, letters: Letters) -> DataFrame:
    """One row per rebuilt conversation and depth: key of the prefix and of its parent, last turn."""
    zero = F.lit(0).cast("long")
    nothing = F.lit(None).cast("long")
    root = rebuilt.select(
        "conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), nothing.alias("pa"), nothing.alias("pb"),
        nothing.alias("ref"), zero.alias("chars"), zero.alias("before"), "size", "total",
    )
    each = rebuilt.filter("hb > 0").select("conv_id", "size", "total", "heads", F.posexplode("heads").alias("i", "t"))
    parent = [F.when(F.col("i") > 0, F.get("heads", F.col("i") - 1)[q]).otherwise(zero) for q in _SUMS]
    head = each.select(
        "conv_id", (F.col("i") + 1).cast("long").alias("depth"),
        *_keys([F.col(f"t.{q}") for q in _SUMS], ("a", "b")), *_keys(parent, ("pa", "pb")),
        "t.ref", "t.chars", (F.col("t.c") - F.col("t.chars")).alias("before"), "size", "total",
    )
    parts = rebuilt.filter("n > h").select("conv_id", "h", "hb", "head", "own", "size", "total")
    later = checked_join(turns, parts, "conv_id", "inner", _ROW_BYTES).filter("pos >= h")

    def composed(i: int, upto: Column) -> Column:
        """The head's product and, shifted behind it, the difference of two own prefixes."""
        own = F.pmod(upto - F.col(f"own.q{i}"), F.lit(PRIME))
        return (F.col(f"head.q{i}") + own * letters.back(i, F.col("h") - F.col("hb"))) % PRIME

    own = later.select(
        "conv_id", (F.col("pos") + 1 - F.col("h") + F.col("hb")).alias("depth"),
        *_keys([composed(i, F.col(q)) for i, q in enumerate(_SUMS)], ("a", "b")),
        *_keys([composed(i, F.col(q) - F.col(f"t{i}")) for i, q in enumerate(_SUMS)], ("pa", "pb")),
        "ref", "chars", (F.col("head.c") + F.col("c") - F.col("own.c") - F.col("chars")).alias("before"), "size", "total",
    )
    return keep(root.select(_PREFIX).unionByName(head.select(_PREFIX)).unionByName(own.select(_PREFIX)))


_NODE = ["depth", "a", "b"]


def _nodes(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """Groups of prefixes, and whether each is one sequence."""
    checks = ("ref", "pa", "pb")
    nodes = keep(
        prefixes.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.count_if(F.col("size") == F.col("depth")).alias("n_ends"),
            F.sum(F.col("total") - F.col("before")).alias("beyond"),
            F.min("before").alias("before"),
            *[F.min(c).alias(c) for c in checks],
            F.max(F.struct(*checks)).alias("highest"),
            F.min(F.struct(*checks)).alias("lowest"),
        )
    )
    return nodes.drop("highest", "lowest"), nodes.filter("highest <> lowest").isEmpty()


def _owners(nodes: DataFrame) -> DataFrame:
    """(conv_id, first, first_before, parent_id, leaf): the least depth a conversation owns, and what lies there."""
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("int")
    owners = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "before", "pa", "pb")).alias("f"), F.max(leaf).cast("long").alias("leaf")
    ).select("conv_id", "leaf", F.col("f.depth").alias("first"), F.col("f.before").alias("first_before"), "f.pa", "f.pb")
    root = nodes.filter("depth = 0").first()
    parents = nodes.filter("depth > 0").select(
        (F.col("depth") + 1).alias("first"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_id")
    )
    deep = owners.filter("first > 1").join(parents.hint("shuffle_merge"), ["first", "pa", "pb"])
    top = F.when(F.col("first") == 1, F.lit(root["conv_id"] if root else None)).cast("long")
    named = owners.filter("first <= 1").withColumn("parent_id", top)
    return keep(deep.unionByName(named).drop("pa", "pb"))


def _ends(prefixes: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes in which conversations end."""
    order = [*_NODE, "conv_id"]
    ranged = prefixes.filter("size = depth").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = ranged.mapInArrow(_joined, "depth long, a long, b long, first long, ids string")
    ordered = texts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return ordered.mapInArrow(_digested, "depth long, a long, b long, ends_sha256 string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one node as one text each."""
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(4)]
        same = np.all([c[1:] == c[:-1] for c in columns[:3]], axis=0) if batch.num_rows else np.empty(0, bool)
        starts = np.flatnonzero(np.r_[True, ~same]) if batch.num_rows else np.empty(0, int)
        bounds = [*starts.tolist(), batch.num_rows]
        cuts = [at for x, y in zip(bounds, bounds[1:]) for at in range(x, y, IDS_AT_ONCE)]
        texts = [",".join(map(str, columns[3][x:y].tolist())) for x, y in zip(cuts, [*cuts[1:], batch.num_rows], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c[cuts], pa.int64()) for c in columns], pa.array(texts, pa.string())], ["depth", "a", "b", "first", "ids"]
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its texts, which come in order."""
    node, digest = None, None

    def made(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_NODE, "ends_sha256"])

    for batch in batches:
        done = []
        names = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
        for name, ids in zip(names, batch.column(4), strict=True):
            if name == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
            digest.update(ids.as_py().encode())
        yield made(done)
    if node is not None:
        yield made([(*node, digest.hexdigest())])


def _sequences(conversations: DataFrame, digest, tries) -> tuple[DataFrame, DataFrame]:
    """Verified nodes and the prefixes they group."""
    turns = _referenced(_stored(conversations, digest))
    for letters in tries:
        products = _products(turns, letters)
        prefixes = _prefixes(products, _rebuilt(products), letters)
        nodes, right = _nodes(prefixes)
        if right:
            return nodes, prefixes
    raise RuntimeError("fingerprints of unlike conversations were equal in every try")


def prefix_trie(
    conversations: DataFrame,
    *,
    digest=_sha256,
    tries: tuple[Letters, ...] = tuple(Letters.drawn(seed) for seed in (101, 102, 103)),
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Results depend neither on the quality of ``digest(role, text)`` nor on the letters tried.
    """
    nodes, prefixes = _sequences(conversations, digest, tries)
    owners = _owners(nodes)
    owned = checked_join(prefixes, owners.select("conv_id", "first", "first_before", "leaf"), "conv_id", "inner", _ROW_BYTES)
    # What an owner holds of a node's subtree begins at the node, or where it begins to own.
    begins = F.when(F.col("depth") >= F.col("first"), F.col("before")).otherwise(F.col("first_before"))
    below = owned.groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.col("total") - begins).alias("distinct"))
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")
    ).agg(F.count("*").alias("n_children"))
    whole = (
        nodes.join(below.hint("shuffle_merge"), _NODE)
        .join(children.hint("shuffle_merge"), _NODE, "left")
        .join(_ends(prefixes).hint("shuffle_merge"), _NODE, "left")
    )
    named = checked_join(keep(whole), owners.select("conv_id", "first", "parent_id"), "conv_id", "inner", _ROW_BYTES)
    return named.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("beyond") - F.col("distinct")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
