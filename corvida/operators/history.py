"""Commit graphs: walks, closures, introductions, deletions, status and diff."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvida.session import discard, written

MOST_COMMITS, MOST_ENTRIES, MOST_BYTES = 100_000, 10_000_000, 4 << 30  # Fixed values: ceilings of one history


def edges(commits: DataFrame) -> DataFrame:
    """child, parent, n (place among the parents) of every known commit."""
    return commits.dropDuplicates(["commit_hash"]).select(F.col("commit_hash").alias("child"), F.posexplode("parents").alias("n", "parent"))


def first_parents(commits: DataFrame) -> DataFrame:
    return edges(commits).where("n = 0")


def places(links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """node, chain, place: the first-parent forest cut into chains; written.

    ``place`` counts first-parent steps to the root. ``chain`` names the deepest tip above a node, so each node carries
    on the chain of one child only, and what is reached at a place of a chain reaches all lower places. Pointer
    doubling: rounds grow with the logarithm of the longest line, and every round holds one row a node. A
    first-parent line that comes back to itself is an error.
    """
    nodes = links.select(F.col("child").alias("node")).union(links.select("parent"))
    if starts is not None:
        nodes = nodes.union(starts.select("commit_hash"))
    first = links.where("n = 0").select(F.col("child").alias("node"), F.col("parent").alias("jump"))
    tip = F.struct(F.lit(0).cast("bigint").alias("far"), F.col("node").alias("tip"))
    at, left, every = _counted(nodes.distinct().join(first, "node", "left").select("node", "jump", F.col("jump").isNotNull().cast("bigint").alias("place"), tip.alias("tip")), F.col("jump").isNotNull(), "places")
    step = 1
    while left:
        if step > 2 * every:
            raise ValueError("a first-parent line comes back to itself")
        up = at.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.max(F.struct((F.col("tip.far") + step).alias("far"), F.col("tip.tip").alias("tip"))).alias("up"))
        far = at.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("place").alias("more"))
        wider = at.join(up, "node", "left").join(far, "jump", "left").select("node", F.col("next").alias("jump"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.greatest("tip", F.coalesce("up", "tip")).alias("tip"))
        last = at
        at, left, _ = _counted(wider, F.col("jump").isNotNull(), "places")
        discard(last)
        step *= 2
    return at.select("node", F.col("tip.tip").alias("chain"), "place")


def _counted(df: DataFrame, test: Column, name: str) -> tuple[DataFrame, int, int]:
    """``df`` written, how many of its rows pass the test, and how many there are, counted while it is written."""
    seen = Observation()
    out = written(df.observe(seen, F.count_if(test).alias("n"), F.count("*").alias("every")), name)
    return out, seen.get["n"], seen.get["every"]


def crossings(links: DataFrame, at: DataFrame, first_only: bool = False) -> DataFrame:
    """chain, place, to_chain, to_place of the parent links that leave their chain; written."""
    e = (links.where("n = 0") if first_only else links).select("child", "parent")
    child, parent = at.select(F.col("node").alias("child"), "chain", "place"), at.select(F.col("node").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    return written(e.join(child, "child").join(parent, "parent").where("chain <> to_chain").groupBy("chain", "place", "to_chain").agg(F.max("to_place").alias("to_place")), "crossings")


def reached(starts: DataFrame, links: DataFrame, at: DataFrame, first_only: bool = False) -> DataFrame:
    """start, chain, upto: the chains each start reaches and the highest place in each; written.

    Only chains are visited, all merges of a chain in one round, so the rounds grow with how deep branches nest.
    """
    cross = crossings(links, at, first_only)
    s = starts.select(F.col("commit_hash").alias("start")).distinct().join(at.withColumnRenamed("node", "start"), "start")
    more = F.col("upto") > F.col("old")
    state, left, _ = _counted(s.select("start", "chain", F.col("place").alias("upto"), F.lit(-1).cast("bigint").alias("old")), more, "reached")
    while left:
        fresh = state.where(more).join(cross, "chain").where("place <= upto and place > old").groupBy("start", F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("new"))
        last = state
        state, left, _ = _counted(state.join(fresh, ["start", "chain"], "full_outer").select("start", "chain", F.greatest("upto", "new").alias("upto"), F.coalesce("upto", F.lit(-1)).alias("old")), more, "reached")
        discard(last)
    return state.select("start", "chain", "upto")


def closure(starts: DataFrame, links: DataFrame) -> DataFrame:
    """start, commit: everything reachable over the parent links, the start included, each once.

    Parents outside the archive (shallow) are members without further links.
    """
    at = places(links, starts)
    return reached(starts, links, at).join(at, "chain").where("place <= upto").select("start", F.col("node").alias("commit"))


def walk(starts: DataFrame, links: DataFrame) -> DataFrame:
    """start, commit, depth along the first parents, the start at depth 0; a line that comes back to itself is an error."""
    first = links.where("n = 0")
    at = places(first, starts)
    own = starts.select(F.col("commit_hash").alias("start")).distinct().join(at.select(F.col("node").alias("start"), F.col("place").alias("top")), "start")
    on = reached(starts, first, at, first_only=True).join(at, "chain").where("place <= upto")
    return on.join(own, "start").select("start", F.col("node").alias("commit"), (F.col("top") - F.col("place")).alias("depth"))


def is_ancestor(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs (ancestor, descendant) with ``is_ancestor``; a commit is its own, an unknown one is nobody's."""
    starts = pairs.select(F.col("descendant").alias("commit_hash")).distinct()
    at = places(links)
    r = reached(starts, links, at).withColumnRenamed("start", "descendant")
    a = pairs.join(at.select(F.col("node").alias("ancestor"), "chain", "place"), "ancestor", "left")
    return a.join(r, ["descendant", "chain"], "left").select("ancestor", "descendant", F.coalesce(F.col("place") <= F.col("upto"), F.lit(False)).alias("is_ancestor"))


def shallow(links: DataFrame, commits: DataFrame) -> DataFrame:
    """commit_hash of parents outside the archive: a tolerant walk skips and reports them."""
    return links.select(F.col("parent").alias("commit_hash")).distinct().join(commits.select("commit_hash"), "commit_hash", "left_anti")


def layers(links: DataFrame, commits: DataFrame) -> tuple[int, int]:
    """(commits that a topological order can place, all commits): fewer of the former mean a cycle.

    Chains make one round enough for a whole line: a chain is placed up to its first crossing to what is not yet placed.
    """
    at = places(links)
    cross = crossings(links, at)
    low = written(at.groupBy("chain").agg(F.max("place").alias("top"), F.min("place").alias("bottom")).withColumn("done", F.col("bottom") - 1), "layers")
    while True:
        ahead = cross.join(low.select(F.col("chain").alias("to_chain"), F.col("done").alias("to_done")), "to_chain").where("to_place > to_done").groupBy("chain").agg(F.min("place").alias("stop"))
        new = written(low.join(ahead, "chain", "left").select("chain", "top", "bottom", "done", F.least("top", F.coalesce(F.col("stop") - 1, "top")).alias("now")), "layers")
        if not new.where("now > done").limit(1).count():
            break
        low = new.select("chain", "top", "bottom", F.greatest("now", "done").alias("done"))
    r = low.agg(F.sum(F.col("done") - F.col("bottom") + 1), F.sum(F.col("top") - F.col("bottom") + 1)).first()
    return int(r[0] or 0), int(r[1] or 0)


def introductions(bindings: DataFrame, links: DataFrame) -> DataFrame:
    """commit_hash, path, raw_hash present in a commit and absent, as the same bytes at the same path, in all its known parents."""
    b = bindings.select("commit_hash", "path", "raw_hash").distinct()
    in_parent = links.join(b, F.col("parent") == F.col("commit_hash")).select(F.col("child").alias("commit_hash"), "path", "raw_hash").distinct()
    return b.join(in_parent, ["commit_hash", "path", "raw_hash"], "left_anti")


def _lines(commits: DataFrame) -> DataFrame:
    """commit_hash, parents, part: scopes joined by a parent link are one part, so all ancestors of a commit lie in its part."""
    c = commits.dropDuplicates(["commit_hash"]).select("commit_hash", "parents", F.coalesce("scope_id", F.lit("")).alias("part"))
    ends = c.select(F.col("part").alias("a"), F.explode("parents").alias("parent")).join(c.select(F.col("commit_hash").alias("parent"), F.col("part").alias("b")), "parent")
    least: dict[str, str] = {}

    def root(x: str) -> str:
        while x in least:
            x = least[x]
        return x

    for r in ends.where("a <> b").select("a", "b").distinct().collect():  # pairs of scopes, not commits
        a, b = sorted((root(r.a), root(r.b)))
        if a != b:
            least[b] = a
    if not least:
        return c
    merged = commits.sparkSession.createDataFrame([(x, root(x)) for x in least], "part string, whole string")
    return c.join(merged, "part", "left").select("commit_hash", "parents", F.coalesce("whole", "part").alias("part"))


def ancestor_most(candidates: DataFrame, commits: DataFrame) -> DataFrame:
    """Candidates (commit_hash, path, raw_hash) without another candidate of the same path and raw_hash among their ancestors.

    One pass over each part of the graph, parents first; a commit carries one bit for each binding that an ancestor
    introduced. Parents outside the archive do not count; candidates of unknown commits stay.
    """
    nodes = _lines(commits)
    placed = written(candidates.select("commit_hash", "path", "raw_hash").join(nodes.select("commit_hash", "part"), "commit_hash", "left"), "placed")

    def keep(graph: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found):
            return found[["commit_hash", "path", "raw_hash"]]
        code = found.groupby(["path", "raw_hash"], sort=False).ngroup().tolist()
        own: dict[str, int] = {}
        for commit, bit in zip(found["commit_hash"], code):
            own[commit] = own.get(commit, 0) | 1 << bit
        known = set(graph["commit_hash"])
        parents = {c: {p for p in (ps if ps is not None else ()) if p in known} for c, ps in zip(graph["commit_hash"], graph["parents"])}
        children: dict[str, list[str]] = {}
        for c, ps in parents.items():
            for p in ps:
                children.setdefault(p, []).append(c)
        waiting = {c: len(ps) for c, ps in parents.items()}
        ready, above, clash, done = [c for c, n in waiting.items() if not n], {}, {}, 0
        while ready:
            c = ready.pop()
            done += 1
            inherited = above.pop(c, 0)
            if c in own:
                clash[c] = inherited & own[c]
            below = inherited | own.get(c, 0)
            for child in children.get(c, ()):
                above[child] = above.get(child, 0) | below
                waiting[child] -= 1
                if not waiting[child]:
                    ready.append(child)
        if done < len(parents):
            raise ValueError("the commit graph has a cycle")
        first = [not clash[c] >> bit & 1 for c, bit in zip(found["commit_hash"], code)]
        return found.loc[first, ["commit_hash", "path", "raw_hash"]]

    inside = nodes.groupBy("part").cogroup(placed.where("part is not null").groupBy("part")).applyInPandas(keep, "commit_hash string, path string, raw_hash string")
    return inside.unionByName(placed.where("part is null").drop("part"))


def newest_bindings(bindings: DataFrame, line: DataFrame) -> DataFrame:
    """The newest binding of each path along a first-parent line (start, commit, depth): smallest depth, then raw_hash."""
    at = line.join(bindings, F.col("commit") == F.col("commit_hash"))
    w = Window.partitionBy("start", "path").orderBy("depth", "raw_hash")
    return at.withColumn("r", F.row_number().over(w)).where("r = 1").select("start", "path", "raw_hash", "commit_hash", "depth")


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two trees (keys + raw_hash): added, deleted, modified, unchanged."""
    o, n = old.select(*keys, F.col("raw_hash").alias("old_hash")), new.select(*keys, F.col("raw_hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return o.join(n, keys, "full_outer").select(*keys, "old_hash", "new_hash", state.alias("state"))


def content_bindings(tree: DataFrame, keys: list[str]) -> DataFrame:
    """One live binding per content (keys): the smallest path."""
    return tree.groupBy(*keys).agg(F.min_by(F.struct("path", "commit_hash"), F.struct("path", "commit_hash")).alias("b")).select(*keys, "b.path", "b.commit_hash")


def plan(bindings: DataFrame, commits: DataFrame, selector: str, snapshots: DataFrame) -> DataFrame:
    """Eligible bindings of a time selector: snapshot, raw_hash, tool_profile_hash, gen, path, commit_hash, is_live.

    bindings: commit_hash, path, raw_hash, tool_profile_hash, gen (a null profile means not normalised); snapshots:
    commit_hash, one per scope. ``current`` and ``at`` take the snapshot's own tree; ``all_history`` and ``since``
    every distinct binding an ancestor holds, pointing at its canonical introduction; ``include_deleted`` the live
    ones and, where no live one has the content, the last binding of each deleted path on the first-parent line,
    taken from the newest commit where the same bytes at the same path were normalised.
    """
    keys = ["snapshot", "raw_hash", "tool_profile_hash", "gen"]
    known = bindings.where("tool_profile_hash is not null")
    here = known.join(snapshots, "commit_hash", "left_semi").withColumn("snapshot", F.col("commit_hash"))
    live = content_bindings(here, keys).withColumn("is_live", F.lit(True))
    columns = ["snapshot", "raw_hash", "tool_profile_hash", "gen", "path", "commit_hash", "is_live"]
    if selector in ("current", "at"):
        return live.select(*columns)
    links = edges(commits)
    if selector in ("all_history", "since"):
        reach = closure(snapshots, links).select(F.col("start").alias("snapshot"), F.col("commit").alias("commit_hash"))
        canonical = ancestor_most(introductions(bindings, links), commits)
        first = canonical.join(reach, "commit_hash").groupBy("snapshot", "path", "raw_hash").agg(F.min("commit_hash").alias("canonical"))
        every = known.join(reach, "commit_hash").select("snapshot", "path", "raw_hash", "tool_profile_hash", "gen").distinct()
        now = here.select("snapshot", "path", "raw_hash", "tool_profile_hash", "gen").distinct().withColumn("now", F.lit(True))
        return every.join(first, ["snapshot", "path", "raw_hash"]).join(now, ["snapshot", "path", "raw_hash", "tool_profile_hash", "gen"], "left").select("snapshot", "raw_hash", "tool_profile_hash", "gen", "path", F.col("canonical").alias("commit_hash"), F.coalesce("now", F.lit(False)).alias("is_live"))
    if selector != "include_deleted":
        raise ValueError(f"unknown selector {selector}")
    line = written(walk(snapshots, links), "line")
    last = newest_bindings(bindings, line)
    gone = last.where("depth > 0").join(last.where("depth = 0").select("start", "path"), ["start", "path"], "left_anti").select("start", "path", "raw_hash")
    on = known.join(line.withColumnRenamed("commit", "commit_hash"), "commit_hash")
    newest = gone.join(on.groupBy("start", "path", "raw_hash").agg(F.min_by(F.struct("tool_profile_hash", "gen", "commit_hash"), F.struct("depth", "tool_profile_hash", "gen")).alias("n")), ["start", "path", "raw_hash"])
    deleted = newest.select(F.col("start").alias("snapshot"), "raw_hash", "n.tool_profile_hash", "n.gen", "path", "n.commit_hash", F.lit(False).alias("is_live"))
    return live.select(*columns).unionByName(deleted.join(live.select(*keys), keys, "left_anti"))


def aliases(ranked: DataFrame, bindings: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked rows with every binding of their content, in path and commit order; ranks stay and are not capped again."""
    w = Window.partitionBy("query_id", "rank").orderBy("path", "commit_hash")
    return ranked.join(bindings.select(*keys, "path", "commit_hash").distinct(), keys).withColumn("alias_no", F.row_number().over(w))


def snapshot_commit(previous_tree: DataFrame, new_tree: DataFrame) -> DataFrame:
    """scope_id, tree_hash and whether a snapshot makes a commit: none where the tree is what it was."""
    digest = lambda t, name: t.groupBy("scope_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "raw_hash"))), lambda e: F.concat_ws("\x00", e["path"], e["raw_hash"])), "\n"), 256).alias(name))
    both = digest(previous_tree, "old").join(digest(new_tree, "tree_hash"), "scope_id", "full_outer")
    return both.select("scope_id", "tree_hash", (~F.col("old").eqNullSafe(F.col("tree_hash"))).alias("commits"))


def log_of(start: DataFrame, commits: DataFrame) -> DataFrame:
    """start, depth, commit, message, known: the first-parent log; it ends at the first commit outside the archive."""
    line = walk(start, edges(commits))
    return line.join(commits.select(F.col("commit_hash").alias("commit"), "message", F.lit(True).alias("here")), "commit", "left").select("start", "depth", "commit", "message", F.coalesce("here", F.lit(False)).alias("known"))


def resolve_refs(asked: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """name, commit_hash: a ref by name (HEAD and tags), else a full commit hash, else null."""
    r = asked.join(refs.withColumnRenamed("commit_hash", "by_name"), "name", "left")
    c = commits.select(F.col("commit_hash").alias("name"), F.col("commit_hash").alias("by_hash")).distinct()
    return r.join(c, "name", "left").select("name", F.coalesce("by_name", "by_hash").alias("commit_hash"))


# Commit types whose tree retention may discard; the others are protected.
SHALLOW_TYPES = ["auto", "migrated", "repaired"]


def gc_policy(commit_type: Column) -> Column:
    """'shallow' for types whose tree may go, 'none' for protected ones, null for unknown types."""
    return F.when(commit_type.isin(SHALLOW_TYPES), "shallow").when(commit_type.isin("manual", "imported", "merged", "purged"), "none")


def history_statistics(reach: DataFrame, bindings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per start: commits, entries and bytes of its history, and whether they stay within the ceilings."""
    entries = bindings.select(F.col("commit_hash").alias("commit"), "path", "raw_hash").distinct().join(sizes.select("raw_hash", "byte_size"), "raw_hash", "left")
    per = entries.groupBy("commit").agg(F.count("*").alias("e"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("b"))
    g = reach.join(per, "commit", "left").groupBy("start").agg(F.count("*").alias("commits"), F.coalesce(F.sum("e"), F.lit(0)).alias("entries"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
    return g.withColumn("within", (F.col("commits") <= MOST_COMMITS) & (F.col("entries") <= MOST_ENTRIES) & (F.col("bytes") <= MOST_BYTES))


def republications(gone: DataFrame, bindings: DataFrame, commits: DataFrame) -> DataFrame:
    """raw_hash, in_commit, commit_hash: the smallest strict descendant of the removing commit that holds the raw hash again."""
    links = edges(commits)
    holders = bindings.select("raw_hash", F.col("commit_hash").alias("descendant")).distinct()
    pairs = gone.select("raw_hash", F.col("in_commit").alias("ancestor")).distinct().join(holders, "raw_hash").where("ancestor <> descendant")
    yes = is_ancestor(pairs.select("ancestor", "descendant").distinct(), links).where("is_ancestor")
    return pairs.join(yes, ["ancestor", "descendant"]).groupBy("raw_hash", F.col("ancestor").alias("in_commit")).agg(F.min("descendant").alias("commit_hash"))


def unit_mapping(old: DataFrame, new: DataFrame, key: str = "doc", most_cells: int = 2_000_000) -> DataFrame:
    """key, unit_key, state (unchanged, changed, added, removed) of the units of two versions.

    Units (key, n, unit_key, fingerprint) are paired by the longest common subsequence of fingerprints; between two
    pairs the leftovers are changed in order, the rest added or removed. Documents over ``most_cells`` table cells are
    all changed, as the rule says.
    """

    def place(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        doc = (a if len(a) else b)[key].iloc[0]
        a, b = (v.sort_values("n") if len(v) else pd.DataFrame({"fingerprint": [], "unit_key": []}) for v in (a, b))
        x, y, ax, by = a["fingerprint"].to_numpy(), b["fingerprint"].to_numpy(), a["unit_key"].tolist(), b["unit_key"].tolist()
        pairs = []
        if len(x) * len(y) <= most_cells:
            t = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
            for i in range(len(x) - 1, -1, -1):
                for j in range(len(y) - 1, -1, -1):
                    t[i, j] = 1 + t[i + 1, j + 1] if x[i] == y[j] else max(t[i + 1, j], t[i, j + 1])
            i = j = 0
            while i < len(x) and j < len(y):
                if x[i] == y[j]:
                    pairs.append((i, j))
                    i, j = i + 1, j + 1
                elif t[i + 1, j] >= t[i, j + 1]:
                    i += 1
                else:
                    j += 1
        rows, at = [], (0, 0)
        for i, j in [*pairs, (len(x), len(y))]:
            olds, news = ax[at[0] : i], by[at[1] : j]
            both = min(len(olds), len(news))
            rows += [(doc, u, "changed") for u in news[:both]] + [(doc, u, "added") for u in news[both:]] + [(doc, u, "removed") for u in olds[both:]]
            if j < len(y):
                rows.append((doc, by[j], "unchanged"))
            at = (i + 1, j + 1)
        return pd.DataFrame(rows, columns=[key, "unit_key", "state"])

    kind = dict(new.dtypes)[key]
    old, new = (v.select(*[F.col(c).alias(c) for c in (key, "n", "unit_key", "fingerprint")]) for v in (old, new))  # both may come from one table
    return old.groupBy(key).cogroup(new.groupBy(key)).applyInPandas(place, f"{key} {kind}, unit_key string, state string")


def update_mode(has_previous, only_raw_changed, capable, change_rate, consecutive, threshold: float = 0.3, most_consecutive: int = 10) -> Column:
    """Why a document is processed in full, by the first reason that holds; null where an incremental run will do."""
    return (
        F.when(~has_previous, "no_previous_done_run")
        .when(~only_raw_changed, "identity_changed")
        .when(~capable, "adapter_lacks_incremental_update")
        .when(change_rate >= threshold, "change_rate_threshold")
        .when(consecutive >= most_consecutive, "max_consecutive_incremental")
    )


def change_rate(changed: Column, added: Column, removed: Column, new_units: Column) -> Column:
    return (changed + added + removed) / F.greatest(new_units, F.lit(1))
