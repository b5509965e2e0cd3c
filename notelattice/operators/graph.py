"""Link graph: direct links, breadth-first neighbourhoods, orphans, shared targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelattice.operators.lookup import orphans  # noqa: F401  (part of this module's surface)
from notelattice.operators.skew import HOT_SHARE, hot_keys, if_small, maybe_in, salted_join
from notelattice.session import cut_lineage, written

DIRECTIONS = ("out", "in", "both")
FRONTIER_BROADCAST_ROWS = 100_000


def _of_type(links: DataFrame, link_type: str | None) -> DataFrame:
    return links if link_type is None else links.where(F.col("link_type") == link_type)


def outlinks(links: DataFrame, slug: str, link_type: str | None = None) -> DataFrame:
    return _of_type(links, link_type).where(F.col("source_slug") == slug)


def backlinks(links: DataFrame, slug: str, link_type: str | None = None) -> DataFrame:
    return _of_type(links, link_type).where(F.col("target_slug") == slug)


def direct_links(links: DataFrame, slug: str, direction: str = "out", link_type: str | None = None) -> DataFrame:
    """Out-links, back-links, or both one after the other with duplicates kept."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    if direction == "out":
        return outlinks(links, slug, link_type)
    if direction == "in":
        return backlinks(links, slug, link_type)
    return outlinks(links, slug, link_type).unionByName(backlinks(links, slug, link_type))


def batch_direct_links(
    links: DataFrame, slugs: DataFrame, direction: str = "out", link_type: str | None = None
) -> DataFrame:
    """Direct links of every page in ``slugs(slug)``; a hub's links are spread over tasks."""
    wanted = slugs.select("slug").distinct()
    typed = _of_type(links, link_type)

    def one_way(end: str) -> DataFrame:
        keyed = typed.withColumn("slug", F.col(end))
        return salted_join(keyed, wanted, "slug", "left_semi")

    if direction == "both":
        return one_way("source_slug").unionByName(one_way("target_slug"))
    return one_way("source_slug" if direction == "out" else "target_slug")


def _edges(links: DataFrame, direction: str, link_type: str | None) -> DataFrame:
    """``(at, next)``: where one step leads."""
    typed = _of_type(links, link_type)
    forward = typed.select(F.col("source_slug").alias("at"), F.col("target_slug").alias("next"))
    backward = typed.select(F.col("target_slug").alias("at"), F.col("source_slug").alias("next"))
    if direction == "out":
        return forward
    if direction == "in":
        return backward
    return forward.unionByName(backward)


def neighbors_of(
    links: DataFrame,
    starts: DataFrame,
    depth: int = 1,
    link_type: str | None = None,
    direction: str = "out",
    hot: DataFrame | None = None,
) -> DataFrame:
    """``(start, slug, distance)``: all pages within ``depth`` steps of every page in ``starts(slug)``.

    One round per step: frontier join edges, distinct, anti join against what was seen. Every round is
    written to the shared folder, so plans stay short and a lost executor costs one round. Its
    row count is then known: a frontier of at most FRONTIER_BROADCAST_ROWS is broadcast and the edges are
    not shuffled at all; a larger one is shuffled with the edges that may begin at it, those of hub pages (``hot``, if they
    are known) spread over salts.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    edges = _edges(links, direction, link_type)
    frontier = written(starts.select(F.col("slug").alias("start"), "slug").distinct(), "frontier")
    rounds = [frontier.withColumn("distance", F.lit(0).cast("long"))]
    for distance in range(1, depth + 1):
        n_rows = frontier.count()
        if n_rows == 0:
            break
        here = frontier.withColumnRenamed("slug", "at")
        if n_rows <= FRONTIER_BROADCAST_ROWS:
            step = edges.join(F.broadcast(here), "at")
        else:
            hot = cut_lineage(hot_keys(edges, "at")) if hot is None else hot
            step = salted_join(maybe_in(edges, "at", here.select("at")), here, "at", "inner", hot)
        seen = rounds[0]
        for done in rounds[1:]:
            seen = seen.unionByName(done)
        reached = step.select("start", F.col("next").alias("slug")).distinct()
        frontier = written(reached.join(seen.select("start", "slug"), ["start", "slug"], "left_anti"), "frontier")
        rounds.append(frontier.withColumn("distance", F.lit(distance).cast("long")))
    found = rounds[0]
    for done in rounds[1:]:
        found = found.unionByName(done)
    return found.where("distance > 0")


WORD_BITS = 64  # starts that share one row of a frontier


def _numbered(starts: DataFrame) -> DataFrame:
    """``(start, word, bit)``: WORD_BITS starts to a word. Words are filled within hashed groups, so no task numbers all."""
    named = starts.select(F.col("slug").alias("start")).distinct()
    groups = F.greatest(F.ceil(named.agg(F.count("*")).scalar() / 4096), F.lit(1))
    grouped = named.withColumn("_group", F.pmod(F.xxhash64("start"), groups))
    place = F.row_number().over(Window.partitionBy("_group").orderBy("start")) - 1
    return grouped.withColumn("_place", place).select(
        "start",
        F.concat_ws(":", F.col("_group").cast("string"), F.floor(F.col("_place") / WORD_BITS).cast("string")).alias("word"),
        (F.col("_place") % WORD_BITS).cast("int").alias("bit"),
    )


def packed_neighbors(
    links: DataFrame,
    starts: DataFrame,
    depth: int = 1,
    link_type: str | None = None,
    direction: str = "out",
    broadcast_rows: int = FRONTIER_BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from many starts at once: ``(word, slug, mask, distance)`` and ``(start, word, bit)``.

    A row of the frontier is a page with the starts of one word that reached it, a bit each. A step joins the edges
    once for all of them, joins the masks with ``bit_or`` before and after the shuffle, and takes away the bits that
    were seen. Where starts reach the same pages, rows don't grow with their number but with that of the words.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    edges = _edges(links, direction, link_type)
    numbers = cut_lineage(_numbered(starts))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    frontier = cut_lineage(
        numbers.groupBy("word", F.col("start").alias("slug")).agg(F.bit_or(bit).alias("mask"))
    )
    rounds = [frontier.withColumn("distance", F.lit(0).cast("long"))]
    hot = None
    for distance in range(1, depth + 1):
        n_rows = frontier.count()
        if n_rows == 0:
            break
        here = frontier.withColumnRenamed("slug", "at")
        if n_rows <= broadcast_rows:
            step = edges.join(F.broadcast(here), "at")
        else:
            hot = cut_lineage(hot_keys(edges, "at")) if hot is None else hot
            step = salted_join(edges, here, "at", "inner", hot)
        reached = step.groupBy("word", F.col("next").alias("slug")).agg(F.bit_or("mask").alias("mask"))
        before = rounds[0]
        for done in rounds[1:]:
            before = before.unionByName(done)
        seen = before.groupBy("word", "slug").agg(F.bit_or("mask").alias("seen"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        frontier = reached.join(seen, ["word", "slug"], "left").select("word", "slug", fresh.alias("mask"))
        frontier = cut_lineage(frontier.where("mask != 0"))
        rounds.append(frontier.withColumn("distance", F.lit(distance).cast("long")))
    found = rounds[0]
    for done in rounds[1:]:
        found = found.unionByName(done)
    return found.where("distance > 0"), numbers


def unpacked(packed: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(start, slug, distance)`` of packed neighbours. Only here is there a row for each start and page."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1
    )
    rows = packed.select("word", "slug", "distance", F.explode(bits).alias("bit"))
    return rows.join(numbers, ["word", "bit"]).select("start", "slug", "distance")


def neighbors_many(
    links: DataFrame, starts: DataFrame, depth: int = 1, link_type: str | None = None, direction: str = "out"
) -> DataFrame:
    """``(start, slug, distance)``, as ``neighbors_of``, for so many starts that they are searched from together."""
    return unpacked(*packed_neighbors(links, starts, depth, link_type, direction))


def reach_counts(packed: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(start, distance, n_pages)``: how many pages every start reaches at each distance."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1
    )
    rows = packed.select("word", "distance", F.explode(bits).alias("bit"))
    counts = rows.groupBy("word", "bit", "distance").agg(F.count("*").alias("n_pages"))
    return counts.join(numbers, ["word", "bit"]).select("start", "distance", "n_pages")


HUB_LINKS = 256  # a page with more next pages than this is a hub


def reach(
    links: DataFrame,
    starts: DataFrame,
    depth: int = 1,
    link_type: str | None = None,
    direction: str = "out",
    hub_links: int = HUB_LINKS,
) -> DataFrame:
    """``(start, distance, n_pages)``, as ``reach_counts``, without a row for each start and page behind a hub.

    A way from a start meets no hub before its end, or a first one; then the rest of it is a way from that hub. So starts
    are searched from over the other pages only, and every hub that was met is searched from once. Starts that meet the
    same hubs at the same distances are one class, whose pages behind hubs are found and counted once. Of a start's own
    pages those are counted that its class has not, or has farther away.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    stored = written(_of_type(links, link_type).select("source_slug", "target_slug"), "edges")
    edges = _edges(stored, direction, None)
    steps = edges.select(F.col("at").alias("source_slug"), F.col("next").alias("target_slug"))
    # Which pages are hubs changes what is searched twice, not what is found, so a link that is there twice may count twice.
    counted = written(edges.groupBy(F.col("at").alias("slug")).agg(F.count("*").alias("n")).where(F.col("n") > hub_links), "hubs")
    hot = _hot_of(counted.withColumn("total", F.lit(edges.count())), "slug", F.col("total"))
    hubs = counted.select("slug")
    few = if_small(hubs)
    light = steps.join(few, F.col("source_slug") == few["slug"], "left_anti")
    light = written(light, "light-steps") if few is hubs else light
    hubs = few
    own = starts.select(F.col("slug").alias("start")).distinct()
    own = own.select("start", F.col("start").alias("slug"), F.lit(0).cast("long").alias("distance"))
    near = own.unionByName(neighbors_of(light, starts, depth, None, "out", hot.limit(0)))

    met = near.where(F.col("distance") < depth).join(hubs, "slug", "left_semi")
    entered = F.sort_array(F.collect_list(F.struct(F.col("slug").alias("hub"), F.col("distance").alias("after"))))
    members = met.groupBy("start").agg(entered.alias("entered"))
    members = written(members.withColumn("class", F.sha2(F.to_json("entered"), 256)), "reach-classes")
    classes = members.groupBy("class").agg(F.first("entered").alias("entered")).select("class", F.inline("entered"))
    classes = written(classes, "entered-hubs")
    first = classes.groupBy(F.col("hub").alias("slug")).agg(F.min("after").alias("after"))
    # Only a start that is a hub itself needs the whole depth behind it.
    behind = neighbors_of(steps, first.where("after = 0"), depth, None, "out", hot)
    behind = behind.unionByName(neighbors_of(steps, first.where("after > 0"), depth - 1, None, "out", hot)).withColumnRenamed("start", "hub")
    far = F.col("after") + F.col("distance")
    pages = salted_join(behind, classes, "hub", "inner").withColumn("far", far).where(F.col("far") <= depth)
    pages = written(pages.groupBy("class", "slug").agg(F.min("far").alias("far")), "class-pages")

    counts = if_small(written(pages.groupBy("class", F.col("far").alias("distance")).agg(F.count("*").alias("n")), "class-counts"))
    shared = members.select("start", "class").join(counts, "class").select("start", "distance", "n")
    mine = near.groupBy("start", "distance").agg(F.count("*").alias("n"))
    # Of a page that the class has too, only the nearer way counts; few of a start's own pages are such.
    both = maybe_in(near, "slug", pages.select("slug")).join(members.select("start", "class"), "start").join(pages, ["class", "slug"])
    twice = both.select("start", F.greatest("distance", "far").alias("distance"), F.lit(-1).cast("long").alias("n"))
    total = shared.unionByName(mine).unionByName(twice).groupBy("start", "distance").agg(F.sum("n").alias("n_pages"))
    return total.where("distance > 0 and n_pages > 0")


def neighbors(
    links: DataFrame, slug: str, depth: int = 1, link_type: str | None = None, direction: str = "out"
) -> DataFrame:
    """``(slug, distance)`` of all pages within ``depth`` steps of one page; the page itself is left out."""
    start = links.sparkSession.range(1).select(F.lit(slug).alias("slug"))
    return neighbors_of(links, start, depth, link_type, direction).select("slug", "distance")


def graph_query(
    links: DataFrame, slug: str, depth: int = 1, link_type: str | None = None, direction: str = "out"
) -> tuple[DataFrame, DataFrame]:
    """(direct links, neighbors)."""
    return (
        direct_links(links, slug, direction, link_type),
        neighbors(links, slug, depth, link_type, direction),
    )


def link_types(links: DataFrame) -> DataFrame:
    return links.select("link_type").distinct().orderBy("link_type")


def shared_links(links: DataFrame, slug_a: str, slug_b: str) -> DataFrame:
    """Targets that both pages link to, sorted."""

    def targets(slug: str) -> DataFrame:
        return outlinks(links, slug).select("target_slug")

    return targets(slug_a).intersect(targets(slug_b)).orderBy("target_slug")


def shared_links_batch(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(slug_a, slug_b, target_slug)`` for every pair in ``pairs(slug_a, slug_b)``.

    A page's targets are one row, so links are shuffled once, by their source. Pairs meet the rows of both sides; only a
    page of very many pairs makes that a join with salts.
    """
    sets = links.groupBy("source_slug").agg(F.collect_set("target_slug").alias("targets"))
    found = written(pairs.select("slug_a", "slug_b").distinct(), "pairs")
    for side in ("a", "b"):
        key = f"slug_{side}"
        own = sets.select(F.col("source_slug").alias(key), F.col("targets").alias(f"targets_{side}"))
        hot = written(hot_keys(found, key), "hot-pairs")
        found = found.join(own, key) if hot.isEmpty() else salted_join(found, own, key, "inner", hot)
    shared = F.array_intersect("targets_a", "targets_b")
    return found.select("slug_a", "slug_b", F.explode(shared).alias("target_slug"))


def target_classes(links: DataFrame, link_type: str | None = None) -> DataFrame:
    """``(slug, representative, targets)``: pages with the same set of targets are one class, named by its first slug."""
    edges = _of_type(links, link_type).select("source_slug", "target_slug")
    sets = edges.groupBy(F.col("source_slug").alias("slug")).agg(F.sort_array(F.collect_set("target_slug")).alias("targets"))
    sets = written(sets, "target-sets").withColumn("_set", F.xxhash64("targets"))
    # Equal sets have equal hashes, so a set whose hash is alone is; only the others are compared, and moved.
    repeated = sets.groupBy("_set").agg(F.count("*").alias("n")).where("n > 1").select("_set")
    repeated = written(repeated, "repeated-sets")
    few = if_small(repeated)

    def with_hash(how: str) -> DataFrame:
        return salted_join(sets, repeated, "_set", how) if few is repeated else sets.join(few, "_set", how)

    alone = with_hash("left_anti").select("slug", F.col("slug").alias("representative"), "targets")
    # Counted per set first: a class that most pages belong to is one row after the map side.
    copies = with_hash("left_semi").withColumn("_set", F.sha2(F.to_json("targets"), 256))
    named = copies.groupBy("_set", "targets").agg(F.min("slug").alias("representative"))
    members = salted_join(copies.select("slug", "_set"), named, "_set", "inner")
    return alone.unionByName(written(members.select("slug", "representative", "targets"), "set-members"))


def _hot_of(counts: DataFrame, key: str, total: Column | None = None) -> DataFrame:
    """``hot_keys`` of rows that were counted: ``counts(key, n)``, ``total`` if some are not among them."""
    total = counts.agg(F.sum("n")).scalar() if total is None else total
    return counts.where(F.col("n") * HOT_SHARE > total).select(F.col(key).alias("_hot"))


REST_TARGETS = 64  # a larger set would repeat its targets too often


def shared_link_pairs(
    links: DataFrame,
    min_shared: int = 2,
    min_jaccard: float = 0.0,
    link_type: str | None = None,
    block_rows: int = 1024,
) -> DataFrame:
    """``(slug_a, slug_b, n_shared)``: all pages that share at least ``min_shared`` targets, and that part of both.

    Pages with the same targets are one class: its members come as pairs with their representative (its first slug), and
    pairs of different classes as pairs of representatives.

    An exact set-similarity join. Targets are ordered by how many classes link to them, rare ones first. Two sets that
    share enough have a target in common among the first of both (all but the last ``min_shared - 1``, fewer if
    ``min_jaccard`` asks for more), so hubs, which come last, hardly ever make a candidate. A candidate needs enough
    targets behind the common one in both, and a size near the other's. Sets of up to REST_TARGETS take hashes of the
    targets behind along, and where both have them, enough must be the same: at the first common target they are, so
    pairs that share too little end in the task where they meet. What is left is counted on the whole sets.
    The pages of a target that still has more than ``block_rows`` meet block by block, each pair of blocks in its own
    group.
    """
    if min_shared < 1:
        raise ValueError("min_shared must be at least 1")
    classes = target_classes(links, link_type).where(F.size("targets") >= min_shared)
    single = classes.where("slug = representative").select("slug", "targets")
    edges = single.select("slug", F.size("targets").alias("size"), F.explode("targets").alias("target"))
    counts = written(edges.groupBy("target").agg(F.count("*").alias("n")).where("n > 1"), "target-counts")
    ranked = salted_join(edges, counts, "target", "inner", _hot_of(counts, "target"))
    # Moved row by row: lists made before the shuffle, which could not combine, take more.
    ordered = F.sort_array(F.collect_list(F.struct("n", "target"))).alias("_in_order")
    sets = ranked.repartition("slug").groupBy("slug", "size").agg(ordered)
    sets = written(sets.select("slug", "size", F.col("_in_order.target").alias("targets")), "sets")

    def needed(size: Column) -> Column:
        return F.greatest(F.lit(min_shared), F.ceil(F.lit(min_jaccard) * size - 1e-9)).cast("int")

    # Hashes may say that more is shared than is, never less: a set with two targets of one hash goes without.
    hashes = F.transform("targets", lambda t: (F.pmod(F.hash(t), F.lit(1 << 16)) - (1 << 15)).cast("short"))
    hashed = sets.select("*", F.when(F.size("targets") <= REST_TARGETS, hashes).alias("hashes"))
    hashed = hashed.withColumn("hashes", F.when(F.size(F.array_distinct("hashes")) == F.size("targets"), F.col("hashes")))
    prefixes = hashed.select("slug", "size", "hashes", F.size("targets").alias("m"), F.posexplode("targets").alias("pos", "target"))
    prefixes = prefixes.select(
        "slug", "size", (F.col("m") - F.col("pos")).alias("left"), "target", F.slice("hashes", F.col("pos") + 2, F.col("m")).alias("rest")
    ).where(F.col("left") >= needed(F.col("size")))
    crowds = written(prefixes.groupBy("target").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    blocks = crowds.select("target", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    rows = salted_join(prefixes, blocks, "target", "inner", _hot_of(crowds, "target"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("slug"), F.col("blocks")).cast("int"))
    # A row goes once to every pair of blocks that its own is in. Both sides of the join are the same rows, which Spark
    # shuffles once, as long as no condition is about one side alone.
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "target", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "slug", "size", "left", "rest"
    )
    one = lambda c: F.col(f"a.{c}")
    two = lambda c: F.col(f"b.{c}")
    same_cell = (one("target") == two("target")) & (one("low") == two("low")) & (one("high") == two("high"))
    enough = F.least(one("left"), two("left")) >= F.greatest(needed(one("size")), needed(two("size")))
    near = F.least(one("size"), two("size")) >= F.lit(min_jaccard) * F.greatest(one("size"), two("size")) - 1e-9
    within = (one("block") == two("block")) & (one("low") == two("high")) & (one("slug") < two("slug"))
    once = (one("block") < two("block")) | within
    behind = F.size(F.array_intersect(one("rest"), two("rest"))) + 1 >= F.greatest(needed(one("size")), needed(two("size")))
    common = one("rest").isNull() | two("rest").isNull() | behind
    met = cells.alias("a").join(cells.alias("b"), same_cell).where(once & enough & near & common)
    pairs = met.select(F.least(one("slug"), two("slug")).alias("slug_a"), F.greatest(one("slug"), two("slug")).alias("slug_b")).distinct()
    pairs = written(pairs, "candidates")
    asked = pairs.select(F.explode(F.array("slug_a", "slug_b")).alias("slug"))
    few_sets = maybe_in(sets, "slug", asked)

    def with_set(found: DataFrame, name: str) -> DataFrame:
        own = few_sets.select(*[F.col(c).alias(f"{c}_{name}") for c in ("slug", "size", "targets")])
        return salted_join(found, own, f"slug_{name}", "inner")

    n_shared = F.size(F.array_intersect("targets_a", "targets_b"))
    checked = with_set(with_set(pairs, "a"), "b").withColumn("n_shared", n_shared.cast("long"))
    whole = F.col("size_a") + F.col("size_b") - F.col("n_shared")
    checked = checked.where((F.col("n_shared") >= min_shared) & (F.col("n_shared") / whole >= min_jaccard))
    same = classes.where("slug != representative").select(
        F.col("representative").alias("slug_a"), F.col("slug").alias("slug_b"), F.size("targets").cast("long").alias("n_shared")
    )
    return checked.select("slug_a", "slug_b", "n_shared").unionByName(same)


def link_view(links: DataFrame) -> DataFrame:
    """Links as result text shows them: ``Plain`` or ``Custom("type")``."""
    shown = F.when(F.col("link_type") == "plain", F.lit("Plain")).otherwise(
        F.concat(F.lit('Custom("'), F.col("link_type"), F.lit('")'))
    )
    return links.withColumn("link_type", shown)
