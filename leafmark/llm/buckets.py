"""Pairs within buckets of signatures, without lists of all pairs and without large tasks.

Members of a bucket agree on a band of their signatures (rows of bytes).  First each bucket
is a star around its most central member; once the links that came of it have merged
members into components, only pairs across components remain.  A bucket of more than
`piece` members is dealt into pieces by the hash of doc_id: pairs across components are
one piece's against another's, a star is that of a quarter of a piece, and a stream of
partners to confirm has an eighth, so a task's memory and work are bounded whatever the
bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm import textops as X
from leafmark.llm.common import settle

#: Members of a bucket, or partners of a document, that one task works on.
PIECE = 2048


def _central(rows: np.ndarray) -> int:
    """The row that agrees most with each column's most frequent value."""
    usual = np.array([np.bincount(c, minlength=256).argmax() for c in rows.T], np.uint8)
    return int((rows == usual).sum(axis=1).argmax())


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The other columns, group by group, of batches sorted by their first `keys` columns;
    a column `signature` is one row of bytes for each."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.to_numpy() for c in batch.columns[:keys]])
        columns = [key]
        for field, column in zip(batch.schema, batch.columns, strict=True):
            if field.name == "signature":
                columns.append(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            else:
                columns.append(column.to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            part = (key[:, a:b].T, *(c[a:b] for c in columns[1 + keys :]))
            if held and (held[-1][0][0] != part[0][0]).any():
                yield tuple(np.concatenate(c) for c in list(zip(*held, strict=True))[1:])
                held = []
            held.append(part)
    if held:
        yield tuple(np.concatenate(c) for c in list(zip(*held, strict=True))[1:])
    X.tidy()


def _stars(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sig in _groups(batches, 2):
            hub = _central(sig)
            near = (sig == sig[hub]).mean(axis=1) >= least
            near &= ids != ids[hub]
            yield pair_batch(np.full(int(near.sum()), ids[hub]), ids[near])

    return run


def _across(least: float, percent: int, bands: int, rows: int):
    """Pairs of different components: every row with `other` set against all rows of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, comp, sig, band, size, common, other, asks in _groups(batches, 3):
            ids_t, comp_t, sig_t, size_t, common_t, other_t = (c[~asks] for c in (ids, comp, sig, size, common, other))
            for i in np.flatnonzero(asks if asks.any() else other):
                most = np.minimum(common_t, common[i])
                # Of two that both ask, the later one does.
                near = (comp_t != comp[i]) & (~other_t | (ids_t < ids[i])) & (100 * most >= percent * (size_t + size[i] - most))
                near = np.flatnonzero(near)
                alike = sig_t[near] == sig[i]
                # A pair is proposed in the first band it shares, not in each.
                first = alike[:, : bands * rows].reshape(-1, bands, rows).all(axis=2).argmax(axis=1)
                near = near[(alike.mean(axis=1) >= least) & (first == band[i])]
                if len(near):
                    yield pair_batch(np.full(len(near), ids[i]), ids_t[near])

    return run


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def dealt(column: str, parts: str) -> Column:
    """A number from 0 to `parts` - 1, by the hash of `column`."""
    return F.pmod(F.xxhash64(column), F.col(parts)).cast("long")


def each_part(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))


def tasks(df: DataFrame) -> int:
    """How many tasks a step gets that works long on few bytes, so that it is not put
    together by its size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pieces(members: DataFrame, piece: int) -> DataFrame:
    """(key, part, doc_id, signature): buckets in pieces of about `piece` members; each
    piece of a divided bucket has the bucket's first member too, which may link them."""
    cut = members.withColumn("parts", F.ceil(F.col("n") / piece))
    own = cut.select("key", dealt("doc_id", "parts").alias("part"), "doc_id", "signature")
    shared = cut.where("parts > 1 AND doc_id = first").select("key", each_part("parts").alias("part"), "doc_id", "signature")
    return own.union(shared)


def proposed(members: DataFrame, least: float, piece: int = PIECE) -> DataFrame:
    """(a, b): the stars of buckets `members` (key, n, first, doc_id, signature), with n
    members of which `first` is the smallest, whose signatures agree in a share of `least`."""
    dealt_out = pieces(members, max(1, piece // 4)).repartition("key", "part").sortWithinPartitions("key", "part", "doc_id")
    return dealt_out.mapInArrow(_stars(least), "a long, b long").distinct()


def unmerged(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """The rows of `members` (key, doc_id, component, ...) in buckets of two or more
    components, with `other` (outside the bucket's largest component) and the numbers of
    pieces of all members and of the others."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.count("*").alias("components"), F.sum("c").alias("n"), F.max(F.struct("c", (-F.col("component")).alias("least"))).alias("big")
    )
    wanted = sizes.where("components > 1").select(
        "key", (-F.col("big.least")).alias("largest"), F.ceil(F.col("n") / piece).alias("parts"), F.ceil((F.col("n") - F.col("big.c")) / piece).alias("other_parts")
    )
    return settle(members.drop("n", "first").join(wanted, "key").withColumn("other", F.col("component") != F.col("largest")).drop("largest"))


def across(rows: DataFrame, least: float, percent: int, bands: int, per_band: int) -> DataFrame:
    """(a, b): of `unmerged` rows with n_shingles and common, each `other` with all members
    of its bucket that are of another component, if the signatures agree in a share of
    `least` and the sizes allow `percent`.

    A bucket in one piece is one group.  Of a larger one, a group is a piece of the members
    and one of the others, where the copies of the others have `asks` set.
    """
    columns = ["key", "i", "j", "doc_id", "component", "signature", "band", "n_shingles", "common", "other", "asks"]
    zero = F.lit(0).cast("long")
    whole = rows.where("parts = 1").withColumns({"i": zero, "j": zero, "asks": F.lit(False)})
    told = rows.where("parts > 1").withColumns({"i": dealt("doc_id", "parts"), "asks": F.lit(False)}).select("*", each_part("other_parts").alias("j"))
    asking = rows.where("parts > 1 AND other").withColumns({"j": dealt("doc_id", "other_parts"), "asks": F.lit(True)}).select("*", each_part("parts").alias("i"))
    groups = whole.select(columns).union(told.select(columns)).union(asking.select(columns))
    ordered = groups.repartition(tasks(rows), "key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")
    return ordered.mapInArrow(_across(least, percent, bands, per_band), "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, check: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], piece: int = PIECE) -> DataFrame:
    """The pairs (a, b) that `check` lets pass, given batches (a, b, text of b, part).

    The first of a pair is sent to its task once, not once for each partner: a row with
    b = a leads its partners in the sorted stream.  Partners beyond an eighth of `piece` go to
    further streams, each with its copy of `a`.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / max(1, piece // 8)).alias("parts"))
    partners = pairs.join(parts, "a").select("a", dealt("b", "parts").alias("part"), "b")
    each = partners.union(parts.select("a", each_part("parts").alias("part"), F.col("a").alias("b")))
    sent = each.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "b", "text", "part")
    ordered = sent.repartition(tasks(pairs), "a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"), "b")
    return ordered.mapInArrow(check, "a long, b long")
