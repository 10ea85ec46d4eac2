"""SimHash near-duplicates by multi-index hashing.

`fingerprints` hashes every word shingle of a whole text with XXH64 and sets a
bit of the fingerprint where more than half the hashes have it.  `links` cuts
the 64 bits into `segments` equal parts.  Two fingerprints at `distance` bits
or fewer agree in some part up to r = distance // segments bits, so each
fingerprint probes, part by part, the table of that part with the Hamming ball
of radius r around its own value, and full distances verify what the tables
return.  With two parts of 32 bits and distance 3, a ball has 33 values, and a
table key is so long that unrelated fingerprints seldom share one.

Only distinct fingerprints are indexed: a group of copies, however large, is
one row of the index, and documents are joined to their class at the end.
Probes are keyed by the value looked up, and spread evenly.

Defined results.  Null or blank text: fingerprint zero, linked like any other.
Fewer words than the shingle length: one shingle of all words.  Null doc_id:
takes part, and a class of only null ids has a null component_id.  Repeated
rows: one result each.  Other columns of the input are ignored, and pass
through `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import text_bytes, text_key
from shelfcast.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 2
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text, as a signed 64-bit integer."""
    joined = b" ".join(text_bytes(text).lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    if len(starts) > shingle:
        starts, ends = starts[:1 - shingle or None], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k:k + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, *carry: str, shingle: int = SHINGLE) -> DataFrame:
    """(carry columns, _fp long) of every row."""
    kept = docs.select(*carry, F.col("text").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(carry)].copy()
            out["_fp"] = np.array([fingerprint(t, shingle) for t in b["_text"]], dtype=np.int64)
            yield out
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name != "_text")
    return kept.mapInPandas(run, schema + "_fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """Bit masks of at most `radius` of `bits` bits."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)]


def _part(fp: Column, k: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints `_fp` at most
    `distance` bits apart, each once."""
    bits = 64 // segments
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(bits, distance // segments)])
    fp = F.col("_fp")
    parts = F.array(*[F.struct(F.lit(k).alias("k"), _part(fp, k, bits).alias("v")) for k in range(segments)])
    table = fps.select(fp.alias("b"), F.explode(parts).alias("s")).select("b", "s.k", "s.v")
    probes = (fps.select(fp.alias("a"), F.explode(parts).alias("s"))
              .select("a", "s.k", F.explode(F.transform(masks, lambda m: F.col("s.v").bitwiseXOR(m))).alias("v")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # Merged: the planner does not see how far a probe unrolls, and might broadcast it.
    return probes.join(table.hint("merge"), ["k", "v"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`."""
    from shelfcast.session import materialize
    rows = materialize(fingerprints(docs, "doc_id", shingle=shingle), "simhash")
    classes = _classes(rows, distance)
    return rows.join(classes, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """(_fp, _root, component_id) of each distinct fingerprint."""
    own = rows.groupBy("_fp").agg(F.min("doc_id").alias("_own"))
    member = components(links(own.select("_fp"), distance))
    joined = own.join(member, own["_fp"] == member["node"], "left").select(
        "_fp", "_own", F.coalesce("root", "_fp").alias("_root"))
    least = joined.groupBy("_root").agg(F.min("_own").alias("component_id"))
    return joined.join(least, "_root").select("_fp", "_root", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The document of the smallest doc_id of each class, with all columns.
    Rows that share that id come down to one, of the smallest key."""
    from shelfcast.session import materialize
    # The row is one column beside the key, so that no name of it meets others.
    keyed = docs.select(F.struct("*").alias("doc"), "doc_id", "text", text_key("doc_id", "text").alias("_key"))
    rows = materialize(fingerprints(keyed.select("doc_id", "text", "_key"), "doc_id", "_key", shingle=shingle), "simhash")
    first = (rows.join(_classes(rows, distance), "_fp")
             .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy(F.col("_root")).agg(F.min("_key").alias("_key")))
    # The join and the removal of repeated rows share one shuffle, by the key.
    return (keyed.select("doc", "_key").join(first.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
            .select(*[F.col("doc")[c].alias(c) for c in docs.columns]))
