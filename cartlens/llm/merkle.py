"""Merkle manifest of a dataset: a digest of every row, of every language and of all, with proofs.

Time-forward processing over trees whose nodes are labelled (level, place). Digests travel as messages in
label order: a node takes the messages of its children from the head of the queue, hashes them and sends its
digest to its own parent. The queue is external: it is a written table, dealt and sorted by label, and of a
slice of LEVELS levels each task holds only the queue of one block (the 2 ** LEVELS nodes under one node of the
next slice). A reversed sweep sends proofs down the same way: a block gets the proof of its top node, every node
sends its children its own proof behind their sibling.

A tree is one language. Its leaves ascend by doc_id (null first), then by leaf digest; equal rows are leaves of
their own. The top digests of all trees, by language (null first), are the leaves of a last tree. A row's null
columns enter its leaf as `-`; empty texts as `0:`. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import documents, stage
from cartlens.operators.ranking import running_total

LEVELS = 10
TAMPERED = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, place long, n long, digest string"
PROOF = [
    T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()),
    T.StructField("proof", T.ArrayType(T.StringType())),
]
PROOF_COLUMNS = {"subroot": pa.string(), "root": pa.string(), "proof": pa.list_(pa.string())}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(**other: Column) -> Column:
    """The digest of a row of documents; `other` gives columns in place of its own."""

    def part(name: str) -> Column:
        value = other.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, COLUMNS)).cast("binary"), 256)


def tampered() -> Column:
    """True for the documents of which a copy with one character more in n_chars is to be found out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and claimed (the leaf of the copy that is to be verified) of every row, written down."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    claimed = F.when(tampered() & F.col("n_chars").isNotNull(), leaf_digest(n_chars=more)).otherwise(F.col("leaf"))
    # Sorts a null language before all others.
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = documents(docs).withColumn("leaf", leaf_digest()).select(tree.alias("tree"), "doc_id", "leaf", claimed.alias("claimed"))
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with their place in their tree and its number of leaves `n`, written down."""
    ranked = running_total(rows.withColumn("one", F.lit(1).cast("long")), ["tree"], order, "one")
    return stage(ranked.withColumn("place", F.col("upto") - 1).withColumn("n", F.col("overall")).drop("one", "upto", "overall"), "placed")


def height(n: int) -> int:
    return (n - 1).bit_length()


def digests_above(first: int, digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digest of every node (level, place) over neighbouring nodes that start at place `first`."""
    known = {(0, first + i): digest for i, digest in enumerate(digests)}
    if not levels:
        return known
    queue = [(1, place >> 1, place, digest) for (_, place), digest in known.items()]
    heapify(queue)
    while queue:
        level, place = queue[0][:2]
        received = ""
        while queue and queue[0][:2] == (level, place):
            received += heappop(queue)[3]
        known[level, place] = digest = sha(received)
        if level < levels:
            heappush(queue, (level + 1, place >> 1, place, digest))
    return known


def proofs_below(known: dict[tuple[int, int], str], levels: int, proof: list[str]) -> dict[int, list[str]]:
    """Proof of every lowest node, from the proof of the highest one: siblings marked L or R, `-` for none."""
    queue = [(-level, -place, proof) for level, place in known if level == levels]
    out = {}
    while queue:
        level, place, behind = heappop(queue)
        level, place = -level, -place
        if level == 0:
            out[place] = behind
            continue
        left, right = (level - 1, 2 * place), (level - 1, 2 * place + 1)
        if right in known:
            heappush(queue, (1 - level, -left[1], [f"R{known[right]}", *behind]))
            heappush(queue, (1 - level, -right[1], [f"L{known[left]}", *behind]))
        else:
            heappush(queue, (1 - level, -left[1], ["-", *behind]))
    return out


def _block(nodes: pa.Table, limit: int) -> tuple[pa.Table, int, dict[tuple[int, int], str]]:
    nodes = nodes.sort_by("place")
    levels = min(limit, height(nodes.column("n")[0].as_py()))
    return nodes, levels, digests_above(nodes.column("place")[0].as_py(), nodes.column("digest").to_pylist(), levels)


def risen(limit: int) -> Callable[[pa.Table], pa.Table]:
    """A block's top node, as a node of the slice `limit` levels above."""

    def run(nodes: pa.Table) -> pa.Table:
        nodes, levels, known = _block(nodes, limit)
        above = -(-nodes.column("n")[0].as_py() >> levels)
        ((place, digest),) = [(place, digest) for (level, place), digest in known.items() if level == levels]
        return pa.table({"tree": nodes.column("tree")[:1], "place": [place], "n": pa.array([above], pa.int64()), "digest": [digest]})

    return run


def sunk(limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's nodes with their proofs, from the proof of its top."""

    def run(nodes: pa.Table, tops: pa.Table) -> pa.Table:
        nodes, levels, known = _block(nodes, limit)
        top = tops.to_pylist()[0]
        found = proofs_below(known, levels, top["proof"])
        places = nodes.column("place").to_pylist()
        more = {"subroot": [top["subroot"]] * len(places), "root": [top["root"]] * len(places), "proof": [found[p] for p in places]}
        for name, kind in PROOF_COLUMNS.items():
            nodes = nodes.append_column(name, pa.array(more[name], kind))
        return nodes

    return run


def slices(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every LEVELS-th level, from the given leaves to one top node of each tree (NODE), written down."""
    highest = height(nodes.agg(F.max("n")).first()[0] or 1)
    out = [nodes]
    for _ in range(-(-highest // LEVELS)):
        out.append(stage(in_blocks(out[-1].select("tree", "place", "n", "digest")).applyInArrow(risen(LEVELS), NODE), "nodes"))
    return out


def in_blocks(nodes: DataFrame):
    return nodes.groupBy("tree", F.shiftright("place", LEVELS).alias("block"))


def delivered(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest of `levels` with subroot, root and proof of every node, from those of the highest."""
    if len(levels) == 1:
        return levels[0].join(tops, ["tree", "place"])
    proofs = tops
    for nodes in levels[-2::-1]:
        schema = T.StructType([*nodes.schema, *PROOF])
        sent = in_blocks(nodes).cogroup(proofs.groupBy("tree", "place")).applyInArrow(sunk(LEVELS), schema)
        proofs = sent if nodes is levels[0] else stage(sent, "proofs")
    return proofs


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, place (of the leaf in its language), leaf, claimed, subroot, root, proof of every row.

    `proof` lists, from the leaf to the root, the sibling of each node on the way: `L` or `R` and its digest as it
    stands left or right of it, `-` where a node has none. `claimed` is the leaf of the copy to be verified.
    """
    rows = placed(leaves(docs), ["doc_id", "leaf", "row"]).drop("row").withColumnRenamed("leaf", "digest")
    in_language = slices(rows)
    subroots = in_language[-1].select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest")
    overall = slices(placed(subroots, ["language"]))
    no_steps = F.array().cast("array<string>")
    root = overall[-1].select("tree", "place", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), no_steps.alias("proof"))
    tops = delivered(overall, root).select(
        F.col("language").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "root", "proof"
    )
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return delivered(in_language, stage(tops, "subroot-proofs")).select(
        "doc_id", lang.alias("lang"), "place", F.col("digest").alias("leaf"), "claimed", "subroot", "root", "proof"
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        both = F.when(step.startswith("L"), F.concat(sibling, digest)).when(step.startswith("R"), F.concat(digest, sibling))
        return F.sha2(F.coalesce(both, digest).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def digest_of_proof(proof: Column) -> Column:
    siblings = F.transform(proof, lambda step: F.substring(step, 2, 64))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = merkle_manifest(docs).withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", digest_of_proof(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
