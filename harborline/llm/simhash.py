"""Near duplicates by SimHash fingerprints that differ in few bits.

Links are found by ball hashing from both ends: every fingerprint emits all its
variants within half the radius and the variants are shuffled. Two fingerprints
within the radius meet at a variant halfway, and whoever meets at one is within
the radius of the others there, which is verified; so each is linked to the least
fingerprint at the variant, not to all.

A ball of 64 bits has 2,081 variants, so only fingerprints that can have a
partner emit theirs. The bits are parted in thirds; if two fingerprints are within
the radius, some two thirds of them are within two thirds of it. These shorter
balls, met in the same way, let through every fingerprint that has a partner and
hardly any other.

Defined results: a text without words, a null one too, has fingerprint zero and is
linked like any other. A null doc_id names no component: a component is named by its
least doc_id that is not null, or by null. Repeated rows get equal results. Empty
tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import whole_row
from harborline.llm.components import least_members
from harborline.session import materialise

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
CHUNK = 4096
VARIANTS_A_TASK = 500_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, A-Z lower-cased."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space alone
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        spans = [(0, len(line))]
    else:
        stops = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *stops]
        spans = [(a, b - 1) for a, b in zip(starts, stops[shingle - 1 :])]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans[at : at + CHUNK]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    major = np.packbits(2 * counts > len(spans), bitorder="little")
    return int(major.view("<u8")[0])


def fingerprint_partition(
    batches: Iterator[pa.RecordBatch], shingle: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
            ["doc_id", "text_hash", "fp"],
        )


def ball(bits: list[int], radius: int) -> np.ndarray:
    """Masks that flip up to ``radius`` of the given bits."""
    masks = [0]
    for count in range(1, radius + 1):
        masks += [sum(1 << b for b in chosen) for chosen in combinations(bits, count)]
    return np.array(masks, np.uint64)


def thirds(radius: int) -> list[tuple[int, np.ndarray]]:
    """For each pair of thirds: the mask of its bits, and its shorter ball."""
    edges = [0, 22, 43, BITS]
    parts = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    shorter = -(-(2 * radius // 3) // 2)
    found = []
    for left, right in combinations(parts, 2):
        mask = sum(1 << b for b in left + right)
        found.append((mask, ball(left + right, shorter)))
    return found


def variants(
    batches: Iterator[pa.RecordBatch], balls: list[tuple[int, np.ndarray]]
) -> Iterator[pa.RecordBatch]:
    """Every fingerprint's variants, each beside the fingerprint."""
    for batch in batches:
        values = batch.column("fp").to_numpy().view(np.uint64)
        for mask, flips in balls:
            step = max(1, 200_000 // len(flips))
            for at in range(0, len(values), step):
                part = values[at : at + step]
                keys = (part & np.uint64(mask))[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel().view(np.int64)),
                        pa.array(np.repeat(part, len(flips)).view(np.int64)),
                    ],
                    ["variant", "fp"],
                )


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by variant and fingerprint -> those that meet another fingerprint,
    each with the least at the variant. A variant may run over several batches."""
    variant = least = None
    alone = False  # whether the last variant has only its least fingerprint so far
    for batch in batches:
        keys = batch.column("variant").to_numpy()
        values = batch.column("fp").to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[keys[0] != variant or least is None, keys[1:] != keys[:-1]])
        firsts = values[starts]
        run = np.searchsorted(starts, np.arange(len(keys)), side="right") - 1
        lows = np.where(run >= 0, firsts[np.maximum(run, 0)] if len(firsts) else 0, least or 0)
        other = values != lows
        found, lowest = values[other], lows[other]
        yield found, lowest
        variant, least = keys[-1], int(lows[-1])


def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints that share a variant with another one."""
    for found, lowest in meetings(batches):
        both = np.unique(np.concatenate([found, lowest]))
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.int64())], ["fp"])


def verified(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Distinct links within the radius."""
    for found, lowest in meetings(batches):
        pairs = np.unique(np.stack([found, lowest], axis=1), axis=0)
        apart = np.bitwise_count(pairs[:, 0].view(np.uint64) ^ pairs[:, 1].view(np.uint64))
        pairs = pairs[apart <= radius]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["a", "b"]
        )


def met(fingerprints: DataFrame, balls: list[tuple[int, np.ndarray]]) -> DataFrame:
    rows = fingerprints.mapInArrow(lambda b: variants(b, balls), "variant bigint, fp bigint")
    return rows.repartition("variant").sortWithinPartitions("variant", "fp")


def spread(fingerprints: DataFrame, balls: list[tuple[int, np.ndarray]]) -> DataFrame:
    """As many tasks as the variants need, not as the fingerprints do."""
    variants_of_one = sum(len(masks) for _, masks in balls)
    tasks = max(-(-fingerprints.count() * variants_of_one // VARIANTS_A_TASK), 1)
    return fingerprints.repartition(tasks, "fp")


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius is an even number of bits, so that balls meet halfway")
    first, whole = thirds(radius), [((1 << BITS) - 1, ball(list(range(BITS)), radius // 2))]
    possible = met(spread(fingerprints, first), first).mapInArrow(partnered, "fp bigint").distinct()
    possible = spread(materialise(possible, "possible-fingerprints"), whole)
    return met(possible, whole).mapInArrow(lambda b: verified(b, radius), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """Per document: hash of its text, fp (signed 64 bits), fingerprint in hex, the
    least fingerprint it reaches (root) and component_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.cast("binary").alias("text"),
    )
    prints = materialise(
        texts.mapInArrow(
            lambda b: fingerprint_partition(b, shingle), "doc_id bigint, text_hash bigint, fp bigint"
        ),
        "simhash",
    )
    distinct = materialise(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct"
    )
    roots = least_members(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(names, "root").select("fp", "root", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(members, "fp").select(
        "doc_id", "text_hash", "fp", digits.alias("fingerprint"), "root", "component_id"
    )


def one_per_component(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The documents that stay, with all their columns: of each component the row with
    the least doc_id (nulls last) and, where rows share it, the least hash of the text.
    Rows equal in both stay once. Columns may have any names."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    least = near_duplicates(docs, shingle, radius).groupBy("root").agg(F.min(place).alias("least"))
    keep = least.select(
        F.coalesce("least.doc_id", F.lit(0)).alias("_id"),
        F.xxhash64(F.col("least.doc_id").isNull(), "least.text_hash").alias("_hash"),
    )
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(
        whole_row(docs),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col("doc_id").isNull(), text_hash).alias("_hash"),
    )
    kept = rows.join(keep, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.select("row.*")
