"""Exact top-k search of binary codes by incremental multi-index hashing.

A 64-bit code is cut into ``SEGMENTS`` segments. If two codes differ in at most
SEGMENTS * (r + 1) - 1 bits, some segment differs in at most r. Searching all segments at
radius 0, 1, 2, … therefore covers growing Hamming balls completely: a query is finished
when its k-th verified distance lies in the covered ball, and only unfinished queries go on
to the next radius.

One round probes the buckets of one radius: the unfinished queries' segments, each with all
masks of that many bits, are joined with the segment index of all rows. The number of masks
depends on the segment width alone. Equal codes are one entry of the index with their k + 1
smallest ids, which are all that can be among k neighbours.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import cut_lineage

BITS = 64
SEGMENTS = 4
K = 10


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i of the code says whether component i is positive; null for other lengths and null components."""
    positive = F.transform(vector, lambda x: x > 0)
    code = reduce(
        lambda sum_, i: sum_.bitwiseOR(F.when(F.get(positive, F.lit(i)), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(0)),
        range(bits),
        F.lit(0).cast("long"),
    )
    return F.when((F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull()), code)


def _segments(code: Column, segments: int) -> Column:
    width = BITS // segments
    return F.array(
        *(
            F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
            for s in range(segments)
        )
    )


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hamming_top_k(
    rows: DataFrame, queries: DataFrame, k: int = K, segments: int = SEGMENTS, id_col: str = "id", code_col: str = "code"
) -> DataFrame:
    """Per query: query_id, rank (1 to k), neighbour_id, distance; exact, ties by the smaller id.

    ``queries`` and ``rows`` hold an id and a 64-bit code. A row is no neighbour of a query of its
    own id. Rows and queries with a null id or code are left out; of rows with one id and
    code one counts, and an id with several codes counts once per code. A query gets fewer
    than k neighbours only if there are fewer. Other columns are not read. Empty tables give
    an empty result.
    """
    width = BITS // segments
    pick = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{code_col}`").cast("long").alias("code")]
    entries = cut_lineage(rows.select(*pick).dropna().distinct(), "codes")
    asked = queries.select(*pick).dropna().distinct().withColumnsRenamed({"id": "query_id", "code": "query_code"})
    # Of the rows with one code only the k + 1 of smallest id can be among k neighbours.
    first = Window.partitionBy("code").orderBy("id")
    index = cut_lineage(
        entries.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("s", F.explode(_segments(F.col("code"), segments)))
        .select(F.col("s.segment").alias("segment"), F.col("s.value").alias("value"), "code", "ids"),
        "segment-index",
    )
    # reach: the k-th distance verified so far; nothing farther can be an answer.
    # need: how many neighbours there are to find, k unless the table is smaller.
    own = entries.groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("own"))
    others = F.lit(entries.count()) - F.coalesce("own", F.lit(0).cast("long"))
    asked = asked.join(own, "query_id", "left").withColumn("need", F.least(F.lit(k), others)).drop("own")
    open_queries = cut_lineage(asked.filter("need > 0").withColumn("reach", F.lit(BITS)), "queries")
    query = ["query_id", "query_code"]
    order = Window.partitionBy(*query).orderBy("distance", "neighbour_id")
    best = None
    done = []
    for radius in range(width + 1):
        # One literal text, folded to an array once: a literal per mask would swell the plan.
        masks = ",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(width), radius))
        probes = (
            open_queries.withColumn("s", F.explode(_segments(F.col("query_code"), segments)))
            .withColumn("mask", F.explode(F.split(F.lit(masks), ",").cast("array<long>")))
            .select(
                *query,
                "reach",
                F.col("s.segment").alias("segment"),
                F.col("s.value").bitwiseXOR(F.col("mask")).alias("value"),
            )
        )
        found = (
            # The estimated size of the probes does not know how many masks there are: never broadcast them.
            probes.join(index.hint("shuffle_hash"), ["segment", "value"])
            .withColumn("distance", _distance("query_code", "code"))
            .filter(F.col("distance") <= F.col("reach"))
            .select(*query, "distance", F.explode("ids").alias("neighbour_id"))
            .filter("neighbour_id != query_id")
        )
        if best is not None:
            found = found.union(best.join(open_queries, query, "left_semi").select(found.columns))
        best = cut_lineage(
            found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best"
        )
        covered = segments * (radius + 1) - 1
        last = (
            best.join(open_queries.select(*query, "need"), query)
            .filter(F.col("rank") == F.col("need"))
            .select(*query, F.col("distance").alias("reach"))
        )
        if covered >= BITS:
            done.append(best)
            break
        done.append(best.join(last.filter(F.col("reach") <= covered), query, "left_semi"))
        reached = open_queries.drop("reach").join(last, query, "left").fillna(BITS, ["reach"])
        open_queries = cut_lineage(reached.filter(F.col("reach") > covered), "queries")
        if not open_queries.limit(1).count():
            break
    return reduce(DataFrame.union, done).select(
        "query_id", "rank", "neighbour_id", F.col("distance").cast("int").alias("distance")
    )
