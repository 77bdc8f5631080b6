"""Knowledge graph: alias search, expansion, bridges, ranking, text pack."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.operators.ordered import cell_scan, first_per_key, join_ordered, range_numbered, top_per_key
from palimpsest.session import checkpointed, forget, settled

# --- fixed values -----------------------------------------------------------------------------------------
WEIGHTS = {"text": 1.0, "recency": 0.6, "edge": 0.5, "centrality": 0.2}
HOP, NODE_CAP, DEPTH_CAP, BRIDGE_DEPTH, BRIDGE_CAP = 1, 100, 500, 2, 100
MAX_FACTS, MAX_RELATIONS, WINDOW_DAYS = 60, 30, 30
NODE_TYPES = ["Person", "Project", "Task", "Preference", "Artifact", "Time", "Quantity", "Other"]
EDGE_TYPES = ["assigned_to", "prefers", "depends_on", "member_of", "related_to", "owns", "scheduled_for"]
NODE_ATTRS = {
    "Person": ["email", "role", "org"],
    "Project": ["status", "deadline"],
    "Task": ["status", "deadline", "priority"],
    "Preference": ["value", "scale"],
    "Artifact": ["url", "path", "format"],
    "Time": ["iso", "range"],
    "Quantity": ["value", "unit"],
    "Other": [],
}
# -----------------------------------------------------------------------------------------------------------

HUB_EDGES = 1000  # a node of more edges is a hub: its neighbours are not joined to each query
FEW_GRAMS = 100_000  # so many grams of terms go to every task
CLASS_HUBS = 16  # nodes near more hubs than this form classes of their own
SLICE_BITS = 20  # nodes are counted for so many numbers at a time
TURN_PAIRS = 1 << 25  # an edge table of more pairs is joined in turns
BLOCK_NODES = 1 << 24  # queries whose seeds reach so many nodes in all are counted together


def _by_weight():
    return [F.desc("weight"), F.asc("node_id"), F.asc("id")]


def best_alias(aliases: DataFrame) -> DataFrame:
    """One alias per key: the heaviest; ties by node id. Reduced before the shuffle, so a hot key is one row per task."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), "node_id", "id", "alias", "weight")).alias("b")
    return aliases.groupBy("alias_key").agg(best).select("alias_key", "b.node_id", "b.id", "b.alias", "b.weight")


def alias_exact(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best alias equal to each term, ignoring case, accents and outer blanks: (term, node_id, alias, weight)."""
    t = terms.select("term").distinct().withColumn("alias_key", X.alias_key("term"))
    return t.join(best_alias(aliases), "alias_key").select("term", "node_id", "id", "alias", "weight")


_WORDS = r"(?U)\w+"


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(key, F.lit(_WORDS), F.lit(0)))


def alias_token_hits(terms: DataFrame, aliases: DataFrame, limit: int) -> DataFrame:
    """Aliases sharing a word with the term, heaviest first.

    The best ``limit`` of a union of lists lie among the best ``limit`` of each, so every word keeps only that
    many aliases before the join; a word in a third of all aliases then costs no more than any other.
    """
    index = aliases.select(F.explode(_tokens(F.col("alias_key"))).alias("token"), "node_id", "id", "alias", "weight")
    index = top_per_key(index, ["token"], _by_weight(), limit)
    t = terms.select("term").distinct()
    asked = t.select("term", F.explode(_tokens(X.alias_key("term"))).alias("token"))
    hits = asked.join(index, "token").select("term", "node_id", "id", "alias", "weight").distinct()
    return top_per_key(hits, ["term"], _by_weight(), limit, rank="rank")


def _grams(text: Column, n: int) -> Column:
    length = F.length(text)
    starts = F.when(length >= n, F.sequence(F.lit(1), length - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def _own_grams(key: Column) -> Column:
    """The grams under which a term is looked up: of three characters, or the term itself if it is shorter."""
    return F.when(F.length(key) >= 3, _grams(key, 3)).otherwise(F.array(key))


def _all_grams(key: Column) -> Column:
    return F.concat(*[_grams(key, n) for n in (1, 2, 3)])


def containing(terms: DataFrame, aliases: DataFrame, limit: int | None = None) -> DataFrame:
    """(term, alias) where the alias contains the term literally; with ``limit`` only the heaviest ones of each key.

    An alias containing a term contains all its 3-grams, so each term looks only at the keys under its rarest gram; terms of
    up to three characters are grams themselves. Aliases of one key are one entry of the index, which holds only grams that some
    term asks for: where these are few, each task drops the others before anything is shuffled.
    """
    cols = ["node_id", "id", "alias", "weight", "alias_key"] + [c for c in ("created_ts",) if c in aliases.columns]
    if limit is not None:
        aliases = top_per_key(aliases, ["alias_key"], _by_weight(), limit)
    t = terms.select("term").distinct().withColumn("k", X.alias_key("term")).where("k <> ''")
    asked = checkpointed(t.select("term", "k", F.explode(_own_grams(F.col("k"))).alias("gram")))
    wanted = asked.select("gram").distinct()
    lengths = wanted.groupBy(F.length("gram").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()  # three rows at most
    if sum(r.c for r in lengths) <= FEW_GRAMS:
        wanted = F.broadcast(wanted)
    key = F.col("alias_key")
    grams = F.concat(F.array().cast("array<string>"), *[_grams(key, r.n) for r in lengths])
    keys = aliases.where("alias_key IS NOT NULL").select("alias_key").distinct()
    index = checkpointed(keys.select("alias_key", F.explode(grams).alias("gram")).join(wanted, "gram", "left_semi"))
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    rare = asked.join(counts, "gram", "left").groupBy("term", "k").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("g"))
    rare = rare.where("g.c > 0").select("term", "k", F.col("g.gram").alias("gram"))
    met = rare.join(index, "gram").where(F.col("alias_key").contains(F.col("k"))).select("term", "alias_key")
    return met.join(aliases.select(*cols), "alias_key").select("term", *cols)


# --- a stored index of aliases -----------------------------------------------------------------------------
ALIAS_COLUMNS = ["id", "node_id", "alias", "source", "weight", "alias_key"]
POST_PREFIXES = 64


def _post(kind: str, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value)


def _search_posts(key: Column, grams: Column) -> Column:
    """What the search finds a key by, or looks for: its words, its grams, as hashes."""
    return F.array_distinct(F.concat(F.transform(_tokens(key), lambda x: _post("word", x)), F.transform(grams, lambda x: _post("gram", x))))


def _prefix() -> Column:
    return F.pmod("post", F.lit(POST_PREFIXES)).cast("int").alias("prefix")


def write_alias_index(aliases: DataFrame, path: str) -> None:
    """Store aliases under their key (``whole`` rows), and each distinct key under its words and grams, in folders by the hash of that.

    A key shared by many aliases has its words and grams stored once. Folders of common grams are written by several tasks.
    """
    key = F.col("alias_key")
    named = aliases.select(*ALIAS_COLUMNS).where(key.isNotNull())
    whole = named.withColumn("post", _post("key", key)).withColumn("whole", F.lit(True))
    posts = named.select("alias_key").distinct().select("alias_key", F.explode(_search_posts(key, _all_grams(key))).alias("post"), F.lit(False).alias("whole"))
    rows = whole.unionByName(posts, allowMissingColumns=True).withColumn("prefix", _prefix())
    rows.hint("rebalance", F.col("prefix")).sortWithinPartitions("prefix", "post").write.mode("overwrite").partitionBy("prefix").parquet(path)


def _in_folders(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The folders of an index that hold a post of ``asked`` (post); their numbers, at most ``POST_PREFIXES``, pass the driver."""
    return index.where(F.col("prefix").isin(sorted(r[0] for r in asked.select(_prefix()).distinct().collect())))


def touched_aliases(index: DataFrame, terms: DataFrame, best: bool = False) -> DataFrame:
    """The aliases of a stored index that an exact match or a search of any of the terms could give; with ``best`` terms that
    have an exact match are not searched for (as ``alias_best`` does). Folders that no term touches are not read."""
    keys = checkpointed(terms.select("term").distinct().select(X.alias_key("term").alias("alias_key")).distinct().withColumn("post", _post("key", F.col("alias_key"))))
    whole, rest = index.where("whole"), keys
    if best:
        rest = checkpointed(keys.join(_in_folders(whole, keys).select("alias_key"), "alias_key", "left_anti"))
    asked = checkpointed(rest.select(F.explode(_search_posts(F.col("alias_key"), _own_grams(F.col("alias_key")))).alias("post")).distinct())
    found = _in_folders(index.where("NOT whole"), asked).join(asked, "post", "left_semi").select("alias_key").distinct()
    named = checkpointed(keys.unionByName(found.withColumn("post", _post("key", F.col("alias_key")))).distinct())
    return _in_folders(whole, named).join(named.select("alias_key"), "alias_key", "left_semi").select(*ALIAS_COLUMNS).distinct()


def alias_search(terms: DataFrame, aliases: DataFrame, limit: int = 20) -> DataFrame:
    """Word matches, or where a term has none, substring matches; heaviest first, at most ``limit`` per term."""
    # aliases of one key have the same words and grams: no more than ``limit`` of them can be shown
    aliases = checkpointed(top_per_key(aliases.where("alias_key IS NOT NULL"), ["alias_key"], _by_weight(), limit))
    terms = checkpointed(terms.select("term").distinct())
    words = checkpointed(alias_token_hits(terms, aliases, limit))
    rest = terms.join(words.select("term").distinct(), "term", "left_anti")
    subs = top_per_key(containing(rest, aliases), ["term"], _by_weight(), limit, rank="rank")
    return words.unionByName(subs.select(*words.columns))


def alias_best(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact hit, else the first search hit."""
    terms = checkpointed(terms.select("term").distinct())  # few beside the rows that name them
    exact = checkpointed(alias_exact(terms, aliases))
    rest = terms.select("term").distinct().join(exact.select("term"), "term", "left_anti")
    found = alias_search(rest, aliases, 1).select("term", "node_id", "id", "alias", "weight")
    return exact.withColumn("how", F.lit("exact")).unionByName(found.withColumn("how", F.lit("search")))


def seeds_readonly(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact hit, else for terms of three characters or more the newest alias containing the term."""
    exact = alias_exact(terms, aliases).select("term", "node_id")
    rest = terms.select("term").distinct().join(exact.select("term"), "term", "left_anti").where(F.length("term") >= 3)
    newest = first_per_key(containing(rest, aliases), ["term"], [F.desc("created_ts"), F.asc("id")])
    return exact.unionByName(newest.select("term", "node_id"))


def seeds_from_text(texts: DataFrame, aliases: DataFrame, per_token: int = 3) -> DataFrame:
    """(query_id, node_id) from the words of a text: exact alias, else up to ``per_token`` search hits each."""
    tokens = texts.select("query_id", F.explode(X.tokenize_cjk("text")).alias("term"))
    terms = tokens.select("term").distinct()
    exact = alias_exact(terms, aliases).select("term", "node_id")
    found = alias_search(terms.join(exact.select("term"), "term", "left_anti"), aliases, per_token).select("term", "node_id")
    return tokens.join(exact.unionByName(found), "term").select("query_id", "node_id").distinct()


def nodes_by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_semi")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in the set, as two equi-joins rather than one OR-join."""
    s = ids.select("id")
    by_src = edges.join(s.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
    only_dst = edges.join(s.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(s.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return by_src.unionByName(only_dst.select(*by_src.columns))


def edge_dedupe(edges: DataFrame, order: str) -> DataFrame:
    """One edge per id, else per src>type>dst; the last one wins."""
    key = F.coalesce("id", F.concat_ws(">", "src_id", "type", "dst_id"))
    packed = F.max_by(F.struct(*edges.columns), order).alias("e")
    return edges.withColumn("_k", key).groupBy("_k").agg(packed).select("e.*")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: (a, b, weight)."""
    one = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "weight")
    return one.unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "weight"))


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge stored at its end with fewer edges: (low, high, ...). No node then holds a large share of them."""
    deg = adjacency(edges).groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    e = edges.join(deg.select(F.col("a").alias("src_id"), F.col("d").alias("ds")), "src_id").join(deg.select(F.col("a").alias("dst_id"), F.col("d").alias("dd")), "dst_id")
    src_low = F.struct("ds", "src_id") <= F.struct("dd", "dst_id")
    return e.withColumn("low", F.when(src_low, F.col("src_id")).otherwise(F.col("dst_id"))).withColumn("high", F.when(src_low, F.col("dst_id")).otherwise(F.col("src_id"))).drop("ds", "dd")


def khop_expand(seeds: DataFrame, edges: DataFrame, hop: int = HOP, cap: int = DEPTH_CAP) -> DataFrame:
    """Breadth-first levels for all queries at once: (query_id, node_id, depth), at most ``cap`` new nodes a level.

    New nodes are taken by heaviest touching edge, then id. A node can only be among the first ``cap`` if it is
    among its neighbour's first ``cap`` + visited, so hubs are cut to that many neighbours before the join.
    """
    visited = seeds.select("query_id", "node_id").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    both = adjacency(edges)
    for d in range(1, hop + 1):
        most = visited.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        asked = frontier.select(F.col("node_id").alias("a")).distinct()
        near = both.join(asked, "a", "left_semi").groupBy("a", "b").agg(F.max("weight").alias("weight"))
        near = top_per_key(near, ["a"], [F.desc("weight"), "b"], cap + most)
        reached = frontier.select("query_id", F.col("node_id").alias("a")).join(near, "a").groupBy("query_id", F.col("b").alias("node_id")).agg(F.max("weight").alias("w"))
        fresh = reached.join(visited.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        frontier = top_per_key(fresh, ["query_id"], [F.desc("w"), "node_id"], cap).select("query_id", "node_id", F.lit(d).alias("depth"))
        if hop > 1:
            frontier = settled(frontier)
        visited = visited.unionByName(frontier)
    return visited


def _balls(hubs: DataFrame, both: DataFrame, k: int) -> DataFrame:
    """All nodes within ``r`` steps of each asked (hub, r): (hub, node_id, dist). Walked once for all queries."""
    radius = hubs.groupBy("hub").agg(F.max("r").alias("r"))
    ball = frontier = radius.select("hub", "r", F.col("hub").alias("node_id"), F.lit(0).alias("dist"))
    for d in range(1, k + 1):
        step = frontier.where(F.col("r") >= d).select("hub", "r", F.col("node_id").alias("a")).join(both, "a").select("hub", "r", F.col("b").alias("node_id")).distinct()
        frontier = step.join(ball, ["hub", "node_id"], "left_anti").select("hub", "r", "node_id", F.lit(d).alias("dist"))
        if d < k:
            frontier = settled(frontier)
        ball = ball.unionByName(frontier)
    return ball.select("hub", "node_id", "dist")


def _numbers(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, n): the nodes of seeds and edges numbered from 0 in their order; walks carry numbers in place of ids."""
    ids = seeds.select("node_id").unionByName(edges.select(F.col("src_id").alias("node_id"))).unionByName(edges.select(F.col("dst_id").alias("node_id")))
    ids = settled(ids.where("node_id IS NOT NULL").distinct())
    out = settled(range_numbered(ids, [], ["node_id"], "n"))
    forget(ids)
    return out


def _numbered(df: DataFrame, numbers: DataFrame, *cols: str) -> DataFrame:
    """Ids of these columns replaced by their numbers; null stays null."""
    for c in cols:
        named = numbers.select(F.col("node_id").alias(c), F.col("n").alias("_n"))
        df = df.join(named, c, "left").drop(c).withColumnRenamed("_n", c)
    return df


def _edge_pairs(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(src_id, dst_id, weight, edges): each pair of numbered ends once, with its heaviest weight and how many different edges it has."""
    pairs = _numbered(edges.select("src_id", "dst_id", "weight"), numbers, "src_id", "dst_id")
    pairs = settled(pairs.groupBy("src_id", "dst_id").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("edges")))
    several = pairs.where("edges > 1 AND src_id IS NOT NULL AND dst_id IS NOT NULL").select("src_id", "dst_id")
    if several.isEmpty():
        return pairs
    rows = edges.join(_unnumbered(several, numbers, "src_id", "dst_id"), ["src_id", "dst_id"], "left_semi").distinct()
    counts = settled(_numbered(rows.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("c")), numbers, "src_id", "dst_id"))
    out = settled(pairs.join(counts, ["src_id", "dst_id"], "left").withColumn("edges", F.coalesce("c", "edges")).drop("c"))
    forget(pairs, counts)
    return out


def _unnumbered(df: DataFrame, numbers: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.join(numbers.select(F.col("n").alias(c), F.col("node_id").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
    return df


def _pack(ids: np.ndarray) -> bytes:
    """Sorted distinct numbers of a slice as their steps, compressed byte by byte."""
    steps = np.diff(ids, prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64).astype(np.int32)


def _sliced(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (keys, ids) as rows (keys, slice, size, data), one for each slice of the numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *key, ids in zip(*[frame[k] for k in keys], frame["ids"]):
                ids = np.unique(np.asarray(ids, np.int64))
                at, first = np.unique(ids >> SLICE_BITS, return_index=True)
                out += [(*key, int(a), len(part), _pack(part & ((1 << SLICE_BITS) - 1))) for a, part in zip(at, np.split(ids, first[1:]))]
            yield pd.DataFrame(out, columns=[*keys, "slice", "size", "data"])

    return run


def _within(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``ids`` are in the sorted ``some``."""
    if not len(some):
        return np.zeros(len(ids), bool)
    return some[np.minimum(np.searchsorted(some, ids), len(some) - 1)] == ids


def _counted(cap: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For a block of queries and a slice of the nodes, the first ``cap`` of a query that two seeds or more reach: nodes on light walks, and first nodes of classes."""

    def run(key: tuple, sets: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        packed: dict[tuple[int, int], list[bytes]] = {}
        for a, r, data in zip(sets["a"], sets["r"], sets["data"]):
            packed.setdefault((a, r), []).append(data)
        held: dict[tuple[int, int], np.ndarray] = {}
        none = np.zeros(0, np.int32)

        def of(a: int, r: int) -> np.ndarray:
            if (a, r) not in held:
                parts = [_unpack(x) for x in packed.get((a, r), ())]
                held[a, r] = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else none
            return held[a, r]

        out: list[tuple] = []

        def give(query, nodes: np.ndarray, n: np.ndarray, shared: bool) -> None:
            nodes, n = nodes[n >= 2], n[n >= 2]
            first = np.lexsort((nodes, -n))[:cap]
            out.extend((query, node + (int(key[1]) << SLICE_BITS), c, shared) for node, c in zip(nodes[first].tolist(), n[first].tolist()))

        for query, seeds, met in zip(queries["query_id"], queries["seeds"], queries["met"]):
            nodes, n = np.unique(np.concatenate([of(s, 0) for s in seeds]), return_counts=True)
            by: dict[int, list[tuple[int, int]]] = {}
            for s, a, r in [] if met is None else np.asarray(met, np.int64).reshape(-1, 3).tolist():
                by.setdefault(s, []).append((a, r))
            for s, near in by.items():
                reached = np.zeros(len(nodes), bool)
                for a, r in near:
                    reached |= _within(nodes, of(a, r))
                n += reached & ~_within(nodes, of(s, 0))
            give(query, nodes, n, False)
            if len(by) > 1:  # what two seeds reach is in a list other than the longest
                *some, most = sorted((np.unique(np.concatenate([of(a, -r) for a, r in near])) for near in by.values()), key=len)
                nodes, n = np.unique(np.concatenate(some), return_counts=True)
                give(query, nodes, n + _within(nodes, most), True)
        return pd.DataFrame(out, columns=["query_id", "node_id", "n_seeds", "shared"])

    return run


def bridge_nodes(seeds: DataFrame, edges: DataFrame, k: int = BRIDGE_DEPTH, cap: int = BRIDGE_CAP, hub: int = HUB_EDGES) -> DataFrame:
    """Nodes that two or more seeds of a query reach within k hops: (query_id, node_id, n_seeds), the first ``cap`` of a query."""
    numbers = _numbers(seeds, edges)
    pairs = _edge_pairs(edges, numbers)
    found = settled(_bridges(_numbered(seeds.select("query_id", "node_id"), numbers, "node_id"), pairs, k, cap, hub))
    forget(pairs)
    return _unnumbered(found, numbers, "node_id").select("query_id", "node_id", "n_seeds")


def _bridges(seeds: DataFrame, pairs: DataFrame, k: int, cap: int, hub: int = HUB_EDGES) -> DataFrame:
    """Bridges between numbered nodes.

    Seeds walk through nodes of at most ``hub`` edges, each seed once, however many queries have it. What a seed reaches is
    kept as packed numbers, and a block of queries gets those of its seeds, a slice of the nodes at a time: no row is made for a query, a seed
    and a node. A walk that meets a larger node stops there, and it is noted which seeds came with how many steps left. What lies within
    these steps of a hub is walked once for all queries, and nodes that lie near the same hubs are equal to every query but for what
    their light walks add, so only the first ``cap`` of each such class are joined to the queries. The result does not depend on
    ``hub``. Null ids reach nothing.
    """
    base = seeds.select("query_id", "node_id").where("node_id IS NOT NULL").distinct()
    several = base.groupBy("query_id").count().where("count >= 2").select("query_id")
    base = settled(base.join(several, "query_id", "left_semi").select("query_id", F.col("node_id").alias("seed")))
    both = adjacency(pairs).select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    hubs = settled(both.groupBy("a").count().where(F.col("count") > hub).select("a"))
    light = both.join(hubs, "a", "left_anti")
    walked = frontier = settled(base.select("seed").distinct().select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth")))
    for d in range(1, k):
        step = frontier.select("seed", F.col("node_id").alias("a")).join(light, "a").select("seed", F.col("b").alias("node_id")).distinct()
        frontier = settled(step.join(walked, ["seed", "node_id"], "left_anti").withColumn("depth", F.lit(d)))
        walked = walked.unionByName(frontier)
    # the last step as lists of at most ``hub`` nodes; of longer walks a seed has several pieces
    ends = frontier.select("seed", F.col("node_id").alias("a"))
    lists = light.join(ends.select("a").distinct(), "a", "left_semi").groupBy("a").agg(F.collect_list("b").alias("ids"))
    piece = F.pmod(F.hash("a"), F.lit(min(max(1, hub) ** max(0, k - 2), 1 << 30)))
    reach = ends.join(lists, "a").unionByName(walked.select("seed", F.col("node_id").alias("a"), F.array("node_id").alias("ids")))
    reach = reach.groupBy("seed", piece.alias("piece")).agg(F.flatten(F.collect_list("ids")).alias("ids")).select("seed", "ids")
    reach = settled(reach.mapInPandas(_sliced(["seed"]), "seed long, slice int, size int, data binary"))
    # steps left at each hub; one more step includes all that fewer reach
    left = walked.where(F.col("depth") < k).join(hubs.withColumnRenamed("a", "node_id"), "node_id", "left_semi")
    left = left.select("seed", F.col("node_id").alias("hub"), (F.lit(k) - F.col("depth")).alias("r"))
    met = settled(base.join(left, "seed").select("query_id", "seed", "hub", "r"))
    asked = met.select("hub", "r").distinct()
    near = settled(_balls(asked, both, k).join(asked, "hub").where("dist <= r").select("node_id", "hub", "r"))
    few = near.groupBy("node_id").agg(F.count(F.lit(1)).alias("c")).withColumn("alone", F.col("c") > CLASS_HUBS).drop("c")
    classed = near.join(few, "node_id")
    same = classed.where("NOT alone").groupBy("node_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("hub", "r")))).alias("class"))
    classes = same.unionByName(few.where("alone").select("node_id", F.concat(F.lit("="), F.col("node_id").cast("string")).alias("class")))
    firsts = settled(top_per_key(classes, ["class"], ["node_id"], cap))
    first = firsts.groupBy("class").agg(F.min("node_id").alias("first"))
    firsts = settled(firsts.join(first, "class").select("first", "node_id"))
    counted = settled(_counts(base, reach, met, near, firsts.where("first = node_id").select("node_id"), cap))
    forget(reach, frontier, near)
    # a class whose first node has ``cap`` others before it adds nothing
    shared = top_per_key(counted.where("shared").select("query_id", F.col("node_id").alias("first"), "n_seeds"), ["query_id"], [F.desc("n_seeds"), "first"], cap)
    counts = counted.where("NOT shared").select("query_id", "node_id", "n_seeds").unionByName(shared.join(firsts, "first").select("query_id", "node_id", "n_seeds"))
    counts = counts.groupBy("query_id", "node_id").agg(F.max("n_seeds").alias("n_seeds"))
    return top_per_key(counts, ["query_id"], [F.desc("n_seeds"), "node_id"], cap)


def _counts(base: DataFrame, reach: DataFrame, met: DataFrame, near: DataFrame, firsts: DataFrame, cap: int) -> DataFrame:
    """(query_id, node_id, n_seeds, shared): blocks of queries meet the packed nodes of their seeds and hubs; ``shared`` are the first nodes of classes, counted by hubs alone."""
    sizes = reach.groupBy("seed").agg(F.sum("size").alias("size"))
    blocks = (base.join(sizes, "seed").agg(F.sum("size")).first()[0] or 0) // BLOCK_NODES + 1
    last = reach.agg(F.max("slice")).first()[0] or 0
    of = base.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    # the first nodes of classes go under the steps left as a negative number
    beside = near.unionByName(near.join(firsts, "node_id", "left_semi").withColumn("r", -F.col("r")))
    around = beside.groupBy("hub", "r", F.shiftright("node_id", SLICE_BITS).alias("_slice")).agg(F.collect_list("node_id").alias("ids")).select("hub", "r", "ids")
    around = settled(around.mapInPandas(_sliced(["hub", "r"]), "hub long, r int, slice int, size int, data binary"))
    through = met.unionByName(met.withColumn("r", -F.col("r")))
    own = of.select("block", "seed").distinct().join(reach, "seed").select("block", "slice", F.col("seed").alias("a"), F.lit(0).alias("r"), "data")
    hubs = of.join(through, ["query_id", "seed"]).select("block", "hub", "r").distinct().join(around, ["hub", "r"]).select("block", "slice", F.col("hub").alias("a"), "r", "data")
    seeds = of.groupBy("block", "query_id").agg(F.collect_list("seed").alias("seeds"))
    through = met.groupBy("query_id").agg(F.flatten(F.collect_list(F.array("seed", "hub", F.col("r").cast("long")))).alias("met"))
    asks = seeds.join(through, "query_id", "left").select(F.col("block").alias("part"), "query_id", "seeds", "met", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("of_slice"))
    schema = T.StructType([T.StructField("query_id", base.schema["query_id"].dataType), T.StructField("node_id", T.LongType()), T.StructField("n_seeds", T.LongType()), T.StructField("shared", T.BooleanType())])
    return own.unionByName(hubs).groupBy("block", "slice").cogroup(asks.groupBy("part", "of_slice")).applyInPandas(_counted(cap), schema)


def rank_score(text: Column, hours: Column, edge: Column, centrality: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum; an unknown age counts as 999 hours, other unknowns as 0."""
    w = weights or WEIGHTS
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return w["text"] * z(text) + w["recency"] / (1.0 + F.coalesce(hours, F.lit(999.0)) / 24.0) + w["edge"] * z(edge) + w["centrality"] * z(centrality)


def subgraph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, now: Column, hop: int = HOP, node_cap: int = NODE_CAP, depth_cap: int = DEPTH_CAP,
             bridge_depth: int = BRIDGE_DEPTH, bridge_cap: int = BRIDGE_CAP, mode: str = "intended") -> tuple[DataFrame, DataFrame]:
    """Seeds -> expansion -> bridges -> score -> best ``node_cap`` nodes and the edges between them, per query.

    ``mode='stub'`` scores with constants instead of age, edge weight and degree.
    """
    numbers = _numbers(seeds, edges)
    pairs = _edge_pairs(edges, numbers)
    own = settled(_numbered(seeds.select("query_id", "node_id"), numbers, "node_id"))
    wanted = settled(khop_expand(own, pairs, hop, depth_cap).select("query_id", "node_id", "depth"))
    if bridge_depth > 0:
        bridges = settled(_bridges(own, pairs, bridge_depth, bridge_cap))
        wanted = wanted.unionByName(bridges.select("query_id", "node_id", F.lit(99).alias("depth")))
    # a node's columns join the nodes kept at the end, by the number of its row
    known = nodes.join(numbers.withColumnRenamed("node_id", "id"), "id").withColumn("_row", F.monotonically_increasing_id())
    known = settled(known.withColumnRenamed("id", "_id"))
    members = wanted.groupBy("query_id", "node_id").agg(F.min("depth").alias("depth"))
    members = settled(members.join(known.select(F.col("n").alias("node_id"), "_row", "updated_ts"), "node_id"))
    inner = _pairs_inside(members, pairs)
    turns = pairs.count() // TURN_PAIRS + 1
    forget(pairs)
    ends = inner.select("query_id", F.col("src_id").alias("node_id"), "weight", "edges").unionByName(inner.select("query_id", F.col("dst_id").alias("node_id"), "weight", "edges"))
    stats = ends.groupBy("query_id", "node_id").agg(F.max("weight").alias("edge"), F.sum("edges").alias("deg"))
    top = stats.groupBy("query_id").agg(F.max("deg").alias("max_deg"))
    scored = members.join(stats, ["query_id", "node_id"], "left").join(top, "query_id", "left")
    hours = F.greatest(X.hours_between(now, "updated_ts"), F.lit(0.0))
    hours = F.when(F.col("updated_ts").isNotNull(), hours)
    if mode == "stub":
        score = rank_score(F.lit(1.0), F.lit(36.0), F.lit(0.5), F.lit(0.1))
    else:
        score = rank_score(F.lit(1.0), hours, F.col("edge"), F.col("deg") / F.col("max_deg"))
    scored = scored.select("query_id", "node_id", "_row", "depth", F.round(score, 9).alias("score"))
    kept = settled(top_per_key(scored, ["query_id"], [F.desc("score"), "node_id"], node_cap, rank="rank"))
    forget(members)
    ids = kept.select("query_id", "node_id")
    left = inner.join(ids.withColumnRenamed("node_id", "src_id"), ["query_id", "src_id"], "left_semi")
    left = left.join(ids.withColumnRenamed("node_id", "dst_id"), ["query_id", "dst_id"], "left_semi").select("query_id", F.col("src_id").alias("_src"), F.col("dst_id").alias("_dst"))
    left = settled(left)
    ends = _unnumbered(left.select("_src", "_dst").distinct().withColumns({"src_id": F.col("_src"), "dst_id": F.col("_dst")}), numbers, "src_id", "dst_id")
    rows = _rows_between(edges, ends, turns)
    columns = ["query_id", F.col("_id").alias("node_id"), "depth", *[c for c in nodes.columns if c != "id"], "score", "rank"]
    return kept.join(known, "_row").select(*columns), left.join(rows, ["_src", "_dst"]).select("query_id", *edges.columns)


def _rows_between(edges: DataFrame, ends: DataFrame, turns: int) -> DataFrame:
    """The different edges between pairs of ends. Whole rows are wide: with ``turns``, a part of the pairs is shuffled at a time."""
    if turns == 1:
        return edges.join(ends, ["src_id", "dst_id"]).distinct()
    ends, turn = settled(ends), F.pmod(F.xxhash64("src_id", "dst_id"), F.lit(turns))
    parts = [settled(edges.where(turn == t).join(ends.where(turn == t), ["src_id", "dst_id"]).distinct()) for t in range(turns)]
    return reduce(DataFrame.unionByName, parts)


def _edges_inside(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the members of a query."""
    pairs = edges.groupBy("src_id", "dst_id").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("edges"))
    found = _pairs_inside(members, pairs).select("query_id", "src_id", "dst_id")
    return found.join(edges.distinct(), ["src_id", "dst_id"]).select("query_id", *edges.columns)


def _pairs_inside(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, src_id, dst_id, weight, edges) of the pairs with both ends among the members of a query.

    The pairs are first cut to those between members of any query. Those of a query are found from the end that fewer queries hold,
    which is a hub only if both ends are.
    """
    ids = members.select("query_id", "node_id")
    some = settled(ids.groupBy("node_id").agg(F.count(F.lit(1)).alias("held")))
    one = some.select("node_id")
    near = pairs.join(one.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(one.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    near = settled(near)
    degrees = adjacency(near).groupBy("a").agg((F.count(F.lit(1)) > HUB_EDGES).alias("hub"))
    size = settled(some.join(degrees, some["node_id"] == degrees["a"]).select("node_id", "hub", "held"))
    size = size.select("node_id", F.struct("hub", "held", "node_id").alias("size"))
    ends = near.join(size.select(F.col("node_id").alias("src_id"), F.col("size").alias("s")), "src_id").join(size.select(F.col("node_id").alias("dst_id"), F.col("size").alias("d")), "dst_id")
    forward = F.col("s") <= F.col("d")
    ends = settled(ends.select(forward.alias("forward"), F.when(forward, F.col("src_id")).otherwise(F.col("dst_id")).alias("low"), F.when(forward, F.col("dst_id")).otherwise(F.col("src_id")).alias("high"), "weight", "edges"))
    forget(near)
    found = ids.withColumnRenamed("node_id", "low").join(ends, "low").join(ids.withColumnRenamed("node_id", "high"), ["query_id", "high"], "left_semi")
    found = found.distinct()  # a node given twice is a member twice
    found = settled(found.select("query_id", F.when(F.col("forward"), F.col("low")).otherwise(F.col("high")).alias("src_id"), F.when(F.col("forward"), F.col("high")).otherwise(F.col("low")).alias("dst_id"), "weight", "edges"))
    forget(ends)
    return found


def weight_text(w: Column) -> Column:
    """Two decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", w.cast("double")), r"0+$", ""), r"\.$", "")


def render_pack(queries: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, days: int = WINDOW_DAYS, hop: int = HOP, max_facts: int = MAX_FACTS, max_relations: int = MAX_RELATIONS) -> DataFrame:
    """One text block per query: seeds, facts, relations by type, footer; repeated lines are dropped.

    ``nodes`` carries ``rank``; ``edges`` holds only edges between these nodes. Ellipses follow the last fact and relation shown.
    """
    n = nodes.select("query_id", "node_id", "rank", "type", "title", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    n = settled(n)  # read by every part of the pack
    is_seed = n.join(seeds.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi")
    seed_line = is_seed.groupBy("query_id").agg(join_ordered("title", ["rank"], "; ").alias("t"))
    fact = F.format_string("- %s %s (conf=%.2f)", "type", "title", "confidence")
    facts = n.where(F.col("rank") <= max_facts).withColumn("line", fact).select("query_id", F.lit(2).alias("s"), F.col("rank").cast("long").alias("i"), F.lit(1).alias("j"), "line")
    dots = n.where(F.col("rank") == max_facts).select("query_id", F.lit(2).alias("s"), F.lit(max_facts + 1).cast("long").alias("i"), F.lit(1).alias("j"), F.lit("...").alias("line"))
    titles = n.select("query_id", "node_id", "title")
    named = edges.join(titles.select("query_id", F.col("node_id").alias("src_id"), F.col("title").alias("st")), ["query_id", "src_id"]).join(
        titles.select("query_id", F.col("node_id").alias("dst_id"), F.col("title").alias("dt")), ["query_id", "dst_id"])
    rel = settled(top_per_key(named, ["query_id"], ["type", F.desc("weight"), "st", "dt", "id"], max_relations, rank="r"))
    rel_line = F.format_string("  • %s → %s (w=%s)", "st", "dt", weight_text(F.col("weight")))
    rels = rel.select("query_id", F.lit(4).alias("s"), F.col("r").cast("long").alias("i"), F.lit(1).alias("j"), rel_line.alias("line"))
    heads = rel.groupBy("query_id", "type").agg(F.min("r").cast("long").alias("i")).select("query_id", F.lit(4).alias("s"), "i", F.lit(0).alias("j"), F.format_string("- %s:", "type").alias("line"))
    rdots = rel.where(F.col("r") == max_relations).select("query_id", F.lit(5).alias("s"), F.lit(0).cast("long").alias("i"), F.lit(0).alias("j"), F.lit("...").alias("line"))
    q = queries.select("query_id").distinct()
    fixed = lambda s, line: q.select("query_id", F.lit(s).alias("s"), F.lit(0).cast("long").alias("i"), F.lit(0).alias("j"), F.lit(line).alias("line"))
    seeds_l = q.join(seed_line, "query_id", "left").select("query_id", F.lit(0).alias("s"), F.lit(1).cast("long").alias("i"), F.lit(0).alias("j"), F.concat(F.lit("Seeds: "), F.coalesce("t", F.lit("(none)"))).alias("line"))
    sizes = n.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"))
    foot = q.join(sizes, "query_id", "left").select("query_id", F.lit(6).alias("s"), F.lit(0).cast("long").alias("i"), F.lit(0).alias("j"),
                                                   F.format_string(f"Window {days}d  Nodes %d  Hop {hop}", F.coalesce("c", F.lit(0))).alias("line"))
    lines = fixed(0, "[Memory v1]").unionByName(seeds_l).unionByName(fixed(1, "Facts:")).unionByName(facts).unionByName(dots)
    lines = lines.unionByName(fixed(3, "Relations:")).unionByName(heads).unionByName(rels).unionByName(rdots).unionByName(foot)
    # a pack has at most 60 + 30 lines and a few heads
    once = lines.groupBy("query_id", "line").agg(F.min(F.struct("s", "i", "j")).alias("o"))
    return once.groupBy("query_id").agg(F.concat(join_ordered("line", ["o"], "\n"), F.lit("\n")).alias("pack"))


# --- upkeep ------------------------------------------------------------------------------------------------
def promote_nodes(nodes: DataFrame, updates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Set confidence by (id, confidence); a node at or above the threshold becomes promoted and never goes back."""
    u = updates.groupBy("id").agg(F.max("confidence").alias("new_conf"))
    out = nodes.join(u, "id", "left")
    status = F.when(F.col("new_conf") >= threshold, "promoted").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("confidence", F.coalesce("new_conf", "confidence")).drop("new_conf")


def repeat_evidence(nodes: DataFrame, evidence: DataFrame, times: int = 3, confidence: float = 0.8) -> DataFrame:
    """Confidence updates for provisional nodes with evidence from at least ``times`` messages."""
    counts = evidence.where("subject_kind = 'node'").groupBy(F.col("subject_id").alias("id")).agg(F.count_distinct("msg_id").alias("n"))
    return nodes.where("status = 'provisional'").join(counts, "id").where(F.col("n") >= times).select("id", "n", F.lit(confidence).alias("confidence"))


def evidence_for_message(evidence: DataFrame, messages: DataFrame) -> DataFrame:
    """Subjects of the given messages, with their place by recency."""
    rows = evidence.join(messages.select("msg_id"), "msg_id", "left_semi")
    rows = rows.withColumn("_neg", -F.unix_micros("created_ts"))
    return cell_scan(rows, ["msg_id"], ["_neg", "id"], F.floor(F.col("_neg") / 86_400_000_000), rank="place").drop("_neg")


def nodes_by_alias(nodes: DataFrame, aliases: DataFrame, terms: DataFrame) -> DataFrame:
    keys = terms.select(X.alias_key("term").alias("alias_key"), "term").distinct()
    return aliases.select("alias_key", F.col("node_id").alias("id")).join(keys, "alias_key").select("term", "id").distinct().join(nodes, "id")


def assigned_tasks(nodes: DataFrame, edges: DataFrame, people: DataFrame, edge_type: str = "assigned_to") -> DataFrame:
    e = edges.where(F.col("type") == edge_type).join(people.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    return e.select("src_id", F.col("dst_id").alias("id")).join(nodes, "id")


def schema_validate(nodes: DataFrame, edges: DataFrame, attrs: str | None = None) -> DataFrame:
    """Rows outside the allow-lists: (kind, id, problem)."""
    bad_n = nodes.where(~F.col("type").isin(NODE_TYPES)).select(F.lit("node").alias("kind"), "id", F.concat(F.lit("type "), "type").alias("problem"))
    bad_e = edges.where(~F.col("type").isin(EDGE_TYPES)).select(F.lit("edge").alias("kind"), "id", F.concat(F.lit("type "), "type").alias("problem"))
    out = bad_n.unionByName(bad_e)
    if attrs:
        allowed = F.lit([]).cast("array<string>")
        for t, keys in NODE_ATTRS.items():
            allowed = F.when(F.col("type") == t, F.array(*[F.lit(k) for k in keys]).cast("array<string>")).otherwise(allowed)
        extra = F.array_sort(F.array_except(F.map_keys(attrs), allowed))
        bad_a = nodes.where(F.col(attrs).isNotNull()).select(F.lit("node").alias("kind"), "id", F.explode(extra).alias("x"))
        out = out.unionByName(bad_a.select("kind", "id", F.concat(F.lit("attr "), "x").alias("problem")))
    return out


def graph_integrity(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Dangling references and repeated (src, dst, type): (problem, id)."""
    ids = nodes.select("id")
    lost = lambda df, c, name: df.join(ids.withColumnRenamed("id", c), c, "left_anti").select(F.lit(name).alias("problem"), "id")
    dup = edges.groupBy("src_id", "dst_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n > 1").select(F.lit("edge_repeated").alias("problem"), "id")
    v = evidence.where("subject_kind = 'node'")
    return lost(edges, "src_id", "edge_src").unionByName(lost(edges, "dst_id", "edge_dst")).unionByName(lost(aliases, "node_id", "alias_node")).unionByName(
        lost(v, "subject_id", "evidence_node")).unionByName(dup)


def cascade_delete(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph without the given nodes, their edges and aliases."""
    g = gone.select("id")
    e = edges.join(g.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(g.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(g, "id", "left_anti"), e.select(*edges.columns), aliases.join(g.withColumnRenamed("id", "node_id"), "node_id", "left_anti").select(*aliases.columns)


def ttl_prune(nodes: DataFrame, edges: DataFrame, now: Column, node_days: int = 90, edge_days: int = 180, decay: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Drop provisional nodes and edges not touched for long; older edges lose ``decay`` of their weight per 30 days.

    The ages come from configuration; the rule itself is ours.
    """
    age = F.floor(X.hours_between(now, "updated_ts") / 24)
    n = nodes.where(~((F.col("status") == "provisional") & F.coalesce(age > node_days, F.lit(False))))
    e = edges.where(F.coalesce(age <= edge_days, F.lit(True))).withColumn("weight", F.col("weight") * F.pow(F.lit(1 - decay), F.greatest(F.floor(F.coalesce(age, F.lit(0)) / 30), F.lit(0))))
    return n, e
