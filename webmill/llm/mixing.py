"""Operator 10: mixing sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. Each set offers its words once for free, again at
cost 1, and so on (convex costs); the flow routes them to the sources' quotas. Each set's share is then filled by
documents in the order of a seeded hash. Where the share ends is found by partial sums over ever finer ranges of the
hash, without a sort of documents; equal rows, whose hashes are equal, are told apart by a second hash of their own.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webmill.llm import common as C

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
SEED = 17
#: Hash bits that each pass settles: 64 of the seeded hash, 32 of the one that tells equal rows apart.
BITS = 16


def quotas(sizes: dict[str, int], weights: dict[str, float], total: float, most: float = REPEATS) -> dict[str, float]:
    """total shared out by weight; what is above `most` times a source's size is shared again among the others."""
    out, open_, left = {}, sorted(sizes), float(total)
    while open_:
        per = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * per > most * sizes[s]]
        for s in full or open_:
            out[s] = float(most * sizes[s]) if full else weights[s] * per
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def route(words: dict[tuple[str, ...], int], quota: dict[str, float], repeats: int = REPEATS) -> dict[tuple[str, ...], float]:
    """Words to take of each membership pattern: cheapest flow from patterns (each pass over one costs one more
    than the pass before) to quotas. Patterns that share no source, however indirectly, are solved apart."""
    by_source = defaultdict(list)
    for p in words:
        for s in p:
            by_source[s].append(p)
    out, seen = {}, set()
    for first in words:
        if first in seen:
            continue
        part, todo = [], [first]
        seen.add(first)
        while todo:
            p = todo.pop()
            part.append(p)
            for q in (q for s in p for q in by_source[s]):
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        out |= _flow({p: words[p] for p in sorted(part)}, quota, repeats)
    return out


def _flow(words: dict[tuple[str, ...], int], quota: dict[str, float], repeats: int) -> dict[tuple[str, ...], float]:
    """Successive cheapest augmenting paths. Nodes are patterns and sources; a path may take words back from a source."""
    taken = dict.fromkeys(words, 0.0)
    sent: dict[tuple, float] = defaultdict(float)  # (pattern, source)
    need = {s: quota.get(s, 0.0) for p in words for s in p}
    members = defaultdict(list)
    for p in words:
        for s in p:
            members[s].append(p)
    for cost in range(repeats):  # all paths of one cost before the next: costs are those of passes alone
        for start in words:
            while True:
                room = (cost + 1) * words[start] - taken[start]
                if room <= 1e-9 * max(1, words[start]):
                    break
                back, todo, end = {start: None}, [start], None
                while todo and end is None:
                    x = todo.pop(0)
                    for y in x if isinstance(x, tuple) else [p for p in members[x] if sent[p, x] > 1e-9]:
                        if y not in back:
                            back[y] = x
                            todo.append(y)
                            if isinstance(y, str) and need[y] > 1e-9:
                                end = y
                                break
                if end is None:
                    break
                path, x = [], end
                while x is not None:
                    path.append(x)
                    x = back[x]
                path = path[::-1]
                amount = min([room, need[end], *(sent[b, a] for a, b in zip(path[1::2], path[2::2], strict=False))])
                for a, b in zip(path, path[1:], strict=False):
                    if isinstance(a, tuple):
                        sent[a, b] += amount
                    else:
                        sent[b, a] -= amount
                taken[start] += amount
                need[end] -= amount
    return taken


def _small(spark: SparkSession, columns: dict[str, tuple]) -> DataFrame:
    """A table of what the driver holds. Spark knows its size, and so whether a join may broadcast it."""
    return spark.createDataFrame(pa.table([pa.array(v, kind) for v, kind in columns.values()], names=list(columns)))


def choose(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(_m_key, _m_at, _m_tie_at): where in the order of (_m_hash, _m_tie) each pattern's documents end that, taken once
    more, come nearest to its _m_rest words. plan: (_m_key, _m_rest)."""
    ends = plan.filter("_m_rest > 0").select("_m_key", F.lit(0).cast("long").alias("at"), F.col("_m_rest").alias("rest"))
    level = rows.select("_m_key", "_m_size", "_m_hash", F.shiftrightunsigned("_m_tie", 32).alias("_m_tie"))
    hashes = None
    for k in range(6):
        first, word, shift = k % 4 == 0, "_m_hash" if k < 4 else "_m_tie", (48, 32, 16, 0, 16, 0)[k]
        inside = level.join(ends, "_m_key")
        if not first:
            inside = inside.filter(F.shiftrightunsigned(word, shift + BITS) == F.col("at"))
        if k == 1:  # few are left within the range, unless equal rows are many
            level = C.table(inside.select(*level.columns))
        bucket = F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << BITS) - 1))
        found = inside.groupBy("_m_key", "at", "rest", bucket.alias("b")).agg(F.sum("_m_size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_m_key").orderBy("b"))
        crossing = found.withColumn("upto", upto).filter("upto >= rest").groupBy("_m_key").agg(F.min(F.struct("b", "upto", "n", "at", "rest")).alias("x"))
        ends = C.table(crossing.select("_m_key", F.shiftleft("x.at", BITS).bitwiseOR(F.col("x.b")).alias("at"), (F.col("x.rest") - F.col("x.upto") + F.col("x.n")).alias("rest"), F.col("x.n").alias("n")))
        if k == 3:
            hashes = ends.select("_m_key", F.col("at").alias("_m_at"))
            level = level.join(hashes, "_m_key").filter("_m_hash = _m_at").drop("_m_at")
            ends = ends.withColumn("at", F.lit(0).cast("long"))
    # The bucket that crosses the rest: with it or without, whichever is nearer.
    last = ends.select("_m_key", (F.col("at") + (F.col("n") - F.col("rest") < F.col("rest")).cast("long")).alias("_m_tie_at"))
    return hashes.join(last, "_m_key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, whole: bool = False) -> DataFrame:
    """Per row of docs: id, source, size (words), source_size, target (of its source) and taken (words the mix takes).
    With `whole`: the rows of docs themselves, as often as the mix takes them.

    source_col is a string, or an array of strings for documents of several sources; then size and target are
    summed over them. Sources in code point order take the weights in turn, null (or an empty array) last as a
    source of its own. A null or empty text has size 0 and nothing is taken of it. Whole documents are taken, up
    to `repeats` times each. Of rows of one id and text as many are taken as the target asks for, whichever; otherwise
    equal input gives equal output. The driver holds one total for each membership pattern, as the flow is solved there.
    """
    kind = dict(docs.dtypes)[source_col]
    source = F.col(source_col)
    if kind == "string":
        key = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    else:
        key = F.when(F.coalesce(F.size(source), F.lit(0)) <= 0, F.lit("-")).otherwise(F.to_json(F.array_sort(F.array_distinct(source))))
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    columns = docs.columns if whole else []
    marked = docs.withColumns({"_m_key": key, "_m_size": size, "_m_hash": F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)), "_m_tie": F.xxhash64(F.lit(seed), F.monotonically_increasing_id())})
    rows = C.table(marked.select(*columns, F.col(id_col).alias("_m_id"), source.alias("_m_source"), "_m_key", "_m_size", "_m_hash", "_m_tie"))
    words = {k: n for k, n in rows.groupBy("_m_key").agg(F.sum("_m_size")).collect()}
    names = _names(words, kind)
    of = defaultdict(int)
    for k, n in words.items():
        for s in names[k]:
            of[s] += n
    order = sorted(s for s in of if s != "-") + ["-"] * ("-" in of)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    quota = quotas(dict(of), weight, share * sum(words.values()), repeats)
    taken = route({names[k]: n for k, n in words.items()}, quota, repeats)
    keys = list(words)
    full = {k: min(repeats, int(taken[names[k]] // words[k])) if words[k] else 0 for k in keys}
    plan = {
        "_m_key": (keys, pa.string()),
        "_m_full": ([full[k] for k in keys], pa.int32()),
        "_m_rest": ([max(0.0, taken[names[k]] - full[k] * words[k]) if full[k] < repeats else 0.0 for k in keys], pa.float64()),
        "_m_of": ([sum(of[s] for s in names[k]) for k in keys], pa.int64()),
        "_m_target": ([sum(quota[s] for s in names[k]) for k in keys], pa.float64()),
    }
    plan = _small(rows.sparkSession, plan)
    plan = C.table(plan.join(choose(rows, plan.select("_m_key", "_m_rest")), "_m_key", "left"))
    top = F.lit(-(2**63))  # hashes count as without a sign
    below = F.col("_m_hash").bitwiseXOR(top) < F.col("_m_at").bitwiseXOR(top)
    level = (F.col("_m_hash") == F.col("_m_at")) & (F.shiftrightunsigned("_m_tie", 32) < F.col("_m_tie_at"))
    passes = F.col("_m_full") + F.coalesce(below | level, F.lit(False)).cast("int")
    if whole:
        out = rows.join(plan, "_m_key").filter((F.col("_m_size") > 0) & (passes > 0))
        return out.withColumn("_m_pass", F.explode(F.sequence(F.lit(1), passes))).select(*docs.columns)
    out = rows.join(plan, "_m_key")
    return out.select(F.col("_m_id").alias(id_col), F.col("_m_source").alias("source"), F.col("_m_size").alias("size"), F.col("_m_of").alias("source_size"), F.col("_m_target").alias("target"), (F.col("_m_size") * passes).cast("long").alias("taken"))


def _names(words: dict[str, int], kind: str) -> dict[str, tuple[str, ...]]:
    import json

    return {k: ("-",) if k == "-" else (k,) if kind == "string" else tuple("+" + s for s in json.loads(k)) for k in words}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the mix takes of them: doc_id, size, source_size, target, taken."""
    return mix(C.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
