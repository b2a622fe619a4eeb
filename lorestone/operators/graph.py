"""The relationship graph: its state from edges, bounded walks, and projection page by page."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.entities import named_requests
from ..functions.text import trim
from ..scratch import forget, materialise, small
from ..sources.schemas import FOREVER, NIL
from .versioned import ENTITY_KEY, keyset_page, latest, merge_snapshot, open_at

HOPS, PATHS, PAGE, ROUNDS = 3, 100, 500, 10
PAIR = ["src_id", "dst_id"]
#: Fixed value: the shape of a relation's name.
RELATION = r"[a-z][a-z0-9_]{0,40}"


def last_events(edges: DataFrame) -> DataFrame:
    """The event of each ordered pair that counts: the newest, of equally new ones that which ends last."""
    return latest(edges, PAIR, "updated_at", "valid_to", "edge_id")


def graph_state(edges: DataFrame, as_of: Column) -> DataFrame:
    """One edge for each ordered pair: the last event of the pair counts, and only if it is open. A close after a reopen,
    or a reopen after a close, thus keeps its order; of events of one time that which is open longest counts, since an
    assertion ends an edge before it makes its own."""
    last = last_events(edges)
    return last.where(open_at(as_of)).select("src_id", "dst_id", "relation", "valid_from", "valid_to")


def vertices(entities: DataFrame) -> DataFrame:
    now = latest(entities, ENTITY_KEY, "updated_at", "entity_id")
    return now.select(F.col("entity_id").alias("ch_id"), "scope", "key", "entity_type", "display_name", "first_seen", "last_seen")


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, relation, dir): dir 0 is out, 1 is in."""
    out = edges.select(F.col("src_id").alias("node"), F.col("dst_id").alias("other"), "relation", F.lit(0).alias("dir"))
    return out.unionByName(edges.select(F.col("dst_id").alias("node"), F.col("src_id").alias("other"), "relation", F.lit(1).alias("dir")))


def facet_ok(as_of: Column, relation: str | None = None) -> Column:
    """Whether an edge of a foreign graph, whose facets (relation, valid_from, valid_to) are texts, may be walked: it has a
    relation, that which is asked for, and is valid now. A bound that is missing or empty is open; one that is no
    timestamp closes the edge."""
    rel = F.coalesce(F.col("relation"), F.lit(""))
    bound = lambda c, default: F.when(F.coalesce(F.col(c), F.lit("")) == "", default).otherwise(F.try_to_timestamp(c))
    start, end = bound("valid_from", F.lit("0001-01-01").cast("timestamp")), bound("valid_to", F.lit(FOREVER).cast("timestamp"))
    named = (rel != "") if not relation else (rel == relation)
    return F.coalesce(named & (start <= as_of) & (end > as_of), F.lit(False))


def check_walk(relation: str | None, hops: int) -> None:
    if not 1 <= hops <= HOPS:
        raise InvalidInput(f"hops are from 1 to {HOPS}")
    if relation and not re.fullmatch(RELATION, relation):
        raise InvalidInput("the relation's name has another shape")


def neighbours(graph: DataFrame, most: int) -> DataFrame:
    """(node, others): each node's first `most` neighbours in both directions, in order."""
    ends = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    links = graph.select(F.explode(F.array(ends("src_id", "dst_id"), ends("dst_id", "src_id"))).alias("l")).select("l.*")
    place = F.dense_rank().over(Window.partitionBy("node").orderBy("other"))
    return links.withColumn("place", place).where(F.col("place") <= most).groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("others"))


def walk(graph: DataFrame, start: DataFrame, hops: int, relation: str | None = None, most: int = PATHS) -> DataFrame:
    """(query_id, node, depth, path) of the nodes within `hops` of each start (query_id, node), nearest first.

    Breadth first: each node is reached once, by the least parent path; edges may be asked to have one relation at every
    hop. A walk that has `most` nodes goes no further. The links are written once and each level once, a row for each
    walk, so no hop plans those before it again; a small frontier is sent to the links, so these aren't shuffled.

    Of a node's neighbours only the first 2 * most + 1 are kept: a walk that goes on has seen `most` nodes at most, so any
    later neighbour has `most` unseen lesser ones before it, which fill the level."""
    check_walk(relation, hops)
    links = materialise(neighbours(graph if not relation else graph.where(F.col("relation") == relation), 2 * most + 1), "walk-links")
    begin = start.where("query_id is not null").groupBy("query_id").agg(F.sort_array(F.collect_set("node")).alias("seen"))
    level = materialise(begin.select("query_id", F.lit(most).alias("left"), "seen", F.transform("seen", lambda x: F.array(x)).alias("paths")), "walk-start")
    found = None
    for depth in range(1, hops + 1):
        level = level.where("left > 0 and size(paths) > 0")
        level = _first_level(level, links, most) if depth == 1 else _next_level(level, links, most)
        reached = level.select("query_id", F.explode("paths").alias("path")).select("query_id", F.element_at("path", -1).alias("node"), F.lit(depth).alias("depth"), "path")
        found = found.unionByName(reached) if found else reached
    return found


def _first_level(level: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The level after the starts. A walk from one node takes the first of its neighbours as they are listed, so nothing
    is exchanged but starts and links; only walks from several nodes have parents to choose from."""
    one = small(level.where("size(seen) = 1").withColumn("node", F.get("seen", F.lit(0)))).join(links, "node")
    one = one.withColumn("got", F.slice(F.array_except("others", "seen"), F.lit(1), F.col("left")))
    paths = F.transform("got", lambda x: F.array(F.col("node"), x))
    one = materialise(one.select("query_id", (F.col("left") - F.size("got")).alias("left"), F.concat("seen", "got").alias("seen"), paths.alias("paths")), "walk-level")
    more = level.where("size(seen) > 1")
    return one.unionByName(_next_level(more, links, most)) if more.limit(1).count() else one


#: How far a level reads its parents' neighbours: times a bit more than twice the share of each in what the walk lacks; at
#: last all.
READ = (1, 8, None)
#: Pairs of walks and neighbours in one task.
TASK_PAIRS = 1 << 20


def _next_level(level: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The level after `level` (query_id, left, seen, paths): how many nodes each walk still lacks, its nodes so far, and
    the paths to the new ones, in their order.

    A level takes the least unseen neighbours of all parents, so of each only the first few are read. Up to the least of
    the last ones read all are known; a walk that needs nodes beyond it reads on, but no further than to the last node
    that it would take now."""
    todo, done = level.withColumn("bound", F.lit(None).cast("string")), None
    for times in READ:
        now = materialise(_expand(todo, links, most, times), "walk-level")
        whole = now.where("not open").select(*level.columns)
        done = done.unionByName(whole) if done else whole
        if times is None or not now.where("open").limit(1).count():
            return done
        todo = level.join(small(now.where("open").select("query_id", "bound")), "query_id")


def _expand(level: DataFrame, links: DataFrame, most: int, times: int | None) -> DataFrame:
    """The next level by what is read of the parents' neighbours, `open` where more must be read, up to `bound`."""
    need = F.col("left") + F.size("seen")
    reads = need if times is None else F.least(need, F.greatest(F.lit(1), (2 * F.ceil(F.col("left") / F.size("paths")) + 8).cast("int") * times))
    # Parents are numbered in the order of their paths, so the least one is found by comparing numbers.
    parents = level.select("query_id", "bound", reads.alias("reads"), (reads < need).alias("part"), F.posexplode("paths").alias("ord", "path"))
    read = small(parents.withColumn("node", F.element_at("path", -1)).drop("path")).join(links, "node")
    read = read.withColumn("others", F.when(F.col("bound").isNull(), F.col("others")).otherwise(F.filter("others", lambda x: x <= F.col("bound"))))
    stop = F.when(F.col("part") & (F.size("others") > F.col("reads")), F.col("reads") - 1)
    lists = read.select("query_id", "ord", stop.alias("stop"), F.slice("others", F.lit(1), F.col("reads")).alias("others"))
    lists = lists.unionByName(level.select("query_id", F.lit(-1).alias("ord"), F.lit(None).cast("int").alias("stop"), F.col("seen").alias("others")))
    # Lists of neighbours are exchanged, not pairs; all that follows stays with its walk. Small lists make many pairs, so
    # tasks are counted by these.
    tasks = -(-level.count() * 4 * most // TASK_PAIRS)
    tasks = [max(tasks, int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if tasks > 1 else []
    pairs = lists.repartition(*tasks, "query_id").select("query_id", "ord", "stop", F.posexplode("others").alias("i", "node"))
    nodes = pairs.groupBy("query_id", "node").agg(F.min("ord").alias("ord"), F.max(F.coalesce(F.col("i") == F.col("stop"), F.lit(False))).alias("stop"))
    n = F.sum((F.col("ord") >= 0).cast("int")).over(Window.partitionBy("query_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    took = F.when((F.col("ord") >= 0) & (F.col("n") <= most), F.struct("node", "ord"))
    got = nodes.withColumn("n", n).groupBy("query_id").agg(F.sort_array(F.collect_list(took)).alias("got"), F.min(F.when(F.col("stop"), F.col("node"))).alias("low"))
    new = level.drop("bound").join(got, "query_id").withColumn("got", F.expr("slice(got, 1, left)"))
    bound = F.when(F.size("got") == F.col("left"), F.element_at("got", -1)["node"])
    reached = F.sort_array(F.transform("got", lambda x: F.concat(F.get("paths", x["ord"]), F.array(x["node"]))))
    opened = F.col("low").isNotNull() & F.coalesce(bound > F.col("low"), F.lit(True))
    return new.select("query_id", (F.col("left") - F.size("got")).alias("left"), F.concat("seen", F.col("got")["node"]).alias("seen"), reached.alias("paths"), opened.alias("open"), bound.alias("bound"))


def starts(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, node, origin_scope): where each request (query_id, caller, key, type) begins: the entity of its key and
    type in the caller's scope, or else in the least scope that has one. A key that is no entity begins nowhere."""
    asked = named_requests(requests.where(trim("caller") != ""))
    known = latest(entities, ENTITY_KEY, "updated_at", "entity_id").select("entity_type", "key", "entity_id", "scope")
    pick = Window.partitionBy("query_id").orderBy((F.col("scope") == F.col("caller")).desc(), "scope", "entity_id")
    first = asked.join(known, ["entity_type", "key"]).withColumn("_first", F.row_number().over(pick)).where("_first = 1")
    return first.select("query_id", F.col("entity_id").alias("node"), F.col("scope").alias("origin_scope"))


def traverse(requests: DataFrame, entities: DataFrame, graph: DataFrame, nodes: DataFrame | None = None, relation: str | None = None, hops: int = 1) -> DataFrame:
    """(query_id, node, depth, path, keys, scopes) for requests (query_id, caller, key, type): from the key to its entity,
    along the graph, and to the entities on the paths; ordered by the last one. A start that isn't among the graph's
    `nodes` (ch_id), where they are given, wasn't projected yet and has no paths; a path with an unknown entity goes."""
    check_walk(relation, hops)
    begin = starts(requests, entities)
    if nodes is not None:
        begin = begin.join(nodes.select(F.col("ch_id").alias("node")).distinct(), "node", "left_semi")
    paths = walk(graph, begin.select("query_id", "node"), hops, relation)
    known = latest(entities, ENTITY_KEY, "updated_at", "entity_id").select("entity_id", "key", "scope")
    return hydrate_paths(paths, known).orderBy("query_id", "node")


def hydrate_paths(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """paths with the key of each node, and its scope if entities have one; a path with a node that isn't known goes."""
    told = [c for c in ("key", "scope") if c in entities.columns]
    # Paths of a walk share what leads to their last nodes, so these ways are told once.
    led = paths.withColumn("_way", F.slice("path", 1, F.size("path") - 1))
    steps = led.select("query_id", "_way").distinct().select("*", F.posexplode("_way").alias("i", "id")).join(entities.select(F.col("entity_id").alias("id"), *told), "id")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda x: x[c]).alias(f"_{c}s")
    ways = steps.groupBy("query_id", "_way").agg(F.count("*").alias("_n"), *[listed(c) for c in told]).where(F.col("_n") == F.size("_way"))
    whole = led.join(entities.select(F.col("entity_id").alias("node"), *told), "node").join(ways, ["query_id", "_way"])
    return whole.select(*paths.columns, *[F.concat(f"_{c}s", F.array(c)).alias(f"{c}s") for c in told])


def neighbors_fallback(edges: DataFrame, ids: list[str], as_of: Column, relation: str | None = None, most: int = PATHS) -> DataFrame:
    """One hop over the stored edges, whatever the graph holds: newest edge first. A relation is asked of both directions."""
    links = edges.where(open_at(as_of)) if relation is None else edges.where(open_at(as_of) & (F.col("relation") == relation))
    out = links.where(F.col("src_id").isin(*ids)).select(F.col("dst_id").alias("nid"), "relation", "updated_at", "edge_id")
    back = links.where(F.col("dst_id").isin(*ids)).select(F.col("src_id").alias("nid"), "relation", "updated_at", "edge_id")
    rows = out.unionByName(back).groupBy("nid", "relation").agg(F.max("updated_at").alias("ts"), F.min("edge_id").alias("ek"))
    return rows.orderBy(F.col("ts").desc(), "ek").limit(most)


def classify_edges(page: DataFrame, nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """page with `outcome`: resolved if both ends are nodes, orphan if an end is no entity either, else deferrable."""
    for end in ("src_id", "dst_id"):
        page = page.join(nodes.select(F.col("ch_id").alias(end), F.lit(True).alias(f"{end}_node")).distinct(), end, "left")
        page = page.join(entities.select(F.col("entity_id").alias(end), F.lit(True).alias(f"{end}_entity")).distinct(), end, "left")
    ghost = lambda end: F.col(f"{end}_node").isNull() & F.col(f"{end}_entity").isNull()
    outcome = F.when(F.col("src_id_node").isNotNull() & F.col("dst_id_node").isNotNull(), "resolved").when(ghost("src_id") | ghost("dst_id"), "orphan").otherwise("deferrable")
    return page.withColumn("outcome", outcome).drop(*[f"{e}_{k}" for e in ("src_id", "dst_id") for k in ("node", "entity")])


def projectable(classified: DataFrame) -> DataFrame:
    """The rows of a page before its first deferrable one. That is one key, told to all tasks, however large the page."""
    place = F.struct("updated_at", "edge_id")
    stop = classified.where("outcome = 'deferrable'").agg(F.min(place).alias("stop"))
    return classified.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (place < F.col("stop"))).drop("stop")


def edge_page(edges: DataFrame, after_ts: Column, after_id: Column, size: int = PAGE) -> DataFrame:
    return keyset_page(edges, "updated_at", "edge_id", after_ts, after_id, size)


@dataclass
class Projection:
    """A graph in the making: nodes, the edge events applied so far by (src_id, dst_id), and the cursors of both scans."""

    nodes: DataFrame
    edges: DataFrame
    entity_cursor: tuple
    edge_cursor: tuple


def cursor_start() -> tuple:
    """Before every row."""
    return ("1970-01-01 00:00:00", NIL)


def advance(cursor: tuple, ts, last_id: str) -> tuple:
    """The cursor moves forward only: a row at or before it leaves it as it is."""
    new = (str(ts), last_id)
    return new if new > cursor else cursor


def _after(cursor: tuple) -> tuple[Column, Column]:
    return F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])


def _last(page: DataFrame, tie: str):
    return page.agg(F.max(F.struct(F.col("updated_at").cast("string").alias("ts"), F.col(tie).alias("id"))).alias("m")).first()["m"]


def project_entities(state: Projection, entities: DataFrame, size: int = PAGE) -> tuple[Projection, int]:
    """(state after the next page of entities, rows of the page). Nodes are replaced by id, so a page that is applied
    again changes nothing; an empty page changes nothing either."""
    now = latest(entities, ENTITY_KEY, "updated_at", "entity_id")
    page = materialise(keyset_page(now, "updated_at", "entity_id", *_after(state.entity_cursor), size), "project-entities")
    n = page.count()
    if not n:
        forget(page)
        return state, 0
    last = _last(page, "entity_id")
    nodes = materialise(merge_snapshot(state.nodes, vertices(page), ["ch_id"]), "project-nodes")
    return Projection(nodes, state.edges, advance(state.entity_cursor, last["ts"], last["id"]), state.edge_cursor), n


def project_edges(state: Projection, edges: DataFrame, entities: DataFrame, as_of: Column, size: int = PAGE) -> tuple[Projection, DataFrame, dict[str, int]]:
    """(state after the next page of edges, the edges without its orphans, counts by outcome).

    The page is applied up to its first deferrable row, and the cursor stops before that: where it comes first, nothing
    moves. Orphans before it leave the store. The last event of a pair of nodes wins, as in `last_events`, and a closed
    one removes the pair."""
    page = materialise(edge_page(edges, *_after(state.edge_cursor), size), "project-edges")
    known = entities.select("entity_id").distinct()
    classed = materialise(classify_edges(page, state.nodes, known), "project-classes")
    done = projectable(classed)
    counts = {r["outcome"]: r["n"] for r in done.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    deferred = classed.where("outcome = 'deferrable'").limit(1).count()
    stats = {"processed": counts.get("resolved", 0), "orphans": counts.get("orphan", 0), "deferred": deferred}
    if not sum(counts.values()):
        return state, edges, stats
    last = _last(done, "edge_id")
    events = done.where("outcome = 'resolved'").select(*state.edges.columns)
    # An event of a former page may be as new as one of this page, and end later.
    newest = last_events(events.unionByName(state.edges.join(events.select(*PAIR).distinct(), PAIR, "left_semi").select(*events.columns)))
    merged = merge_snapshot(state.edges, newest, PAIR).where(open_at(as_of))
    left = edges
    if stats["orphans"]:
        left = edges.join(small(done.where("outcome = 'orphan'").select("edge_id")), "edge_id", "left_anti")
    return Projection(state.nodes, materialise(merged, "project-graph"), state.entity_cursor, advance(state.edge_cursor, last["ts"], last["id"])), left, stats


def rebuild(entities: DataFrame, edges: DataFrame, as_of: Column) -> Projection:
    """The graph from the store in one batch, without pages: nodes of all entities, and the last open event of each pair
    of them. Pages applied one after the other come to the same."""
    nodes = vertices(entities)
    ends = nodes.select("ch_id")
    whole = edges.join(ends.withColumnRenamed("ch_id", "src_id"), "src_id", "left_semi").join(ends.withColumnRenamed("ch_id", "dst_id"), "dst_id", "left_semi")
    last = last_events(whole).where(open_at(as_of))
    return Projection(nodes, last.select(*edges.columns), cursor_start(), cursor_start())


def drain(state: Projection, entities: DataFrame, edges: DataFrame, as_of: Column, size: int = PAGE, rounds: int = ROUNDS) -> tuple[Projection, DataFrame, dict[str, int]]:
    """Page after page until nothing moves: all entities, then all edges, and again while edges wait for their ends.

    An edge may wait only for entities that are still to come, so a few rounds do; more are an error."""
    total = {"entities": 0, "processed": 0, "orphans": 0, "deferred": 0}
    for _ in range(rounds):
        while (step := project_entities(state, entities, size))[1]:
            state, total["entities"] = step[0], total["entities"] + step[1]
        moved = True
        while moved:
            before = state.edge_cursor
            state, edges, stats = project_edges(state, edges, entities, as_of, size)
            total["processed"] += stats["processed"]
            total["orphans"] += stats["orphans"]
            total["deferred"] = stats["deferred"]
            moved = state.edge_cursor != before
        if not total["deferred"]:
            return state, edges, total
    raise RuntimeError(f"edges still wait after {rounds} rounds")
