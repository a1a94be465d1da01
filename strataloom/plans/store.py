"""The store: versions of a snapshot in Parquet, with branches, time travel, diffs and merges."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buzhash import ChunkSizes
from ..functions.codec import decode_commit, encode_commit, encode_leaf, sha256
from ..model import COMMITS, DEFAULT_BRANCH, KV, LEAF_PAIRS, MANIFEST, NODES, OVERLAY, ZERO_HASH, BranchNotFound, CannotDeleteCurrentBranch, CommitNotFound, ConcurrentUpdate, CorruptedData, HashNotFound, KeyNotFound, MergeConflict
from ..operators import diff as diffs
from ..operators import history, maintenance, merkle, snapshot
from ..sources.files import Files
from ..sources.work import removed, written
from .refs import Head, HeadFile, Refs, check_name

Hook = Callable[["Store", DataFrame], None]
#: Changed keys that a commit reads to the driver, and leaves of a tree that it holds there, to cut only the leaves they touch.
CHANGED_KEYS, CHANGED_LEAVES = 20_000, 2_000


@dataclass(frozen=True)
class WriteStats:
    """Leaves a commit made, those stored anew, and those that other commits had stored."""

    total: int
    actual: int
    deduplicated: int


class Store:
    """A versioned key-value store below one folder of any file system that Spark can write.

    Point puts and deletes are kept on the driver until a commit, bulk ones as DataFrames; a
    snapshot is a lazy DataFrame and is never collected. A commit writes leaves, nodes, manifest and
    commit, in that order, and moves the ref last, so a crash leaves only unreferenced rows. One
    writer at a time: a ref that moved meanwhile raises ConcurrentUpdate.
    """

    def __init__(self, spark: SparkSession, path: str, sizes: ChunkSizes | None = None, clock: Callable[[], int] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.sizes, self.clock = sizes or ChunkSizes(), clock or (lambda: int(time.time()))
        self.files = Files(spark, self.path)
        self.refs, self.tags = Refs(self.files), Refs(self.files, "refs/tags")
        self.head_file = HeadFile(self.files, self.refs)
        self._recover()
        if not self.refs.list():
            self.refs.create(DEFAULT_BRANCH, ZERO_HASH)
        self.head_file.initialise()
        self.pre_commit: list[Hook] = []
        self.post_commit: list[Hook] = []
        self.last_write = WriteStats(0, 0, 0)
        self._load(self.head_file.get().commit_hash)

    # tables

    def table(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self.files.is_folder(name) else self.spark.createDataFrame([], schema)

    def leaf_pairs(self) -> DataFrame:
        return self.table("leaf_pairs", LEAF_PAIRS)

    def manifest(self) -> DataFrame:
        return self.table("tree_leaves", MANIFEST)

    def nodes(self) -> DataFrame:
        return self.table("nodes", NODES)

    def commits(self) -> DataFrame:
        return self.table("commits", COMMITS)

    # working state

    def _load(self, commit: str) -> None:
        self._base = self.snapshot(commit) if commit != ZERO_HASH else self.spark.createDataFrame([], KV)
        self._head = commit
        self._points: dict[bytes, bytes | None] = {}
        self._changes: list[DataFrame] | None = []  # bulk changes since HEAD in order; None if the state came otherwise

    def _replace(self, state: DataFrame) -> None:
        """Another working state, whose changes since HEAD aren't known one by one."""
        self._base, self._points, self._changes = state, {}, None

    def _change(self, overlay: DataFrame) -> None:
        """Put rows (key, value) and delete those whose value is null."""
        if self._changes is not None:
            self._changes += [self._overlay()] * bool(self._points) + [overlay]
        self._base, self._points = snapshot.overlaid(self.working(), overlay), {}

    def _overlay(self) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in self._points.items()], OVERLAY)

    def working(self) -> DataFrame:
        """The uncommitted state."""
        return snapshot.overlaid(self._base, self._overlay()) if self._points else self._base

    def put(self, key: bytes, value: bytes) -> None:
        self._points[snapshot.check_key(key)] = bytes(value)

    def get(self, key: bytes) -> bytes:
        key = snapshot.check_key(key)
        if key in self._points:
            found = self._points[key]
        else:
            rows = snapshot.get(self._base, key).select("value").head(1)
            found = bytes(rows[0][0]) if rows else None
        if found is None:
            raise KeyNotFound(key)
        return found

    def delete(self, key: bytes) -> None:
        self.get(key)
        self._points[bytes(key)] = None

    def put_all(self, pairs: DataFrame) -> None:
        """Put every row of pairs (key, value); of equal keys the greatest value stays."""
        rows = snapshot.require_keys(pairs.select("key", "value")).groupBy("key").agg(F.max("value").alias("value"))
        self._change(rows)

    def delete_all(self, keys: DataFrame) -> None:
        self._change(keys.select("key").distinct().withColumn("value", F.lit(None).cast("binary")))

    def close(self) -> None:
        """Uncommitted changes are lost."""
        self._load(self._head)

    @property
    def head(self) -> str:
        return self._head

    # commits

    def commit(self, message: str, merged: str | None = None) -> str:
        """Store the working state. An unchanged or empty state is a commit too. merged is a merge's other parent."""
        where = self.head_file.get()
        if where.commit_hash != self._head:
            raise ConcurrentUpdate(f"HEAD moved to {where.commit_hash[:12]}")
        grown = self._grown()
        if grown is None or self.pre_commit:
            state, at_state = written(self.working(), "state")
            for hook in self.pre_commit:
                hook(self, diffs.diff(self.snapshot(self._head), state))
        if grown is None:
            tree = merkle.build(state, self.sizes)
            self._store(tree)
            root = tree.root
        else:
            self._store_grown(grown)
            root = grown.root
        if grown is None or self.pre_commit:
            removed(self.spark, at_state)
        ts = self.clock()
        body = encode_commit(root, message, self._head, ts)
        commit = sha256(body)
        if self.files.read(self._commit_file(commit)) is None:
            depth = self.depth(self._head) + 1
            self.spark.createDataFrame([(commit, root, message, self._head, ts, depth)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
            self.files.write(self._commit_file(commit), body)
        if merged:
            # The commit's bytes have one parent; the other is kept beside them, for later merge bases.
            self.files.write(f"merges/{commit}", merged.encode())
        before = self._head
        if where.is_detached:
            self.head_file.detach(commit)
        else:
            self.refs.update(where.branch, commit, expected=before)
        self._load(commit)
        for hook in self.post_commit:
            hook(self, self.diff(before, commit))
        return commit

    def _grown(self) -> merkle.Grown | None:
        """The working state's tree out of HEAD's, if few keys changed and HEAD's leaves fit on the driver."""
        if self._changes is None or self._head == ZERO_HASH:
            return None
        leaves = self._leaves(self._head).select("first_key", "last_key", "leaf_hash", "n_pairs", "n_bytes").limit(merkle.DRIVER_REFS + 1).collect()
        if not merkle.FEW_LEAVES <= len(leaves) <= merkle.DRIVER_REFS:
            return None
        changes: dict[bytes, bytes | None] = {}
        for overlay in [*self._changes, self._overlay()] if self._points else self._changes:
            rows = overlay.select("key", "value").limit(CHANGED_KEYS + 1).collect()
            if len(rows) > CHANGED_KEYS:
                return None
            changes |= {bytes(k): None if v is None else bytes(v) for k, v in rows}
        old = sorted((merkle.OldLeaf(bytes(a), bytes(b), *rest) for a, b, *rest in leaves), key=lambda x: x.first)

        def read(wanted: list[merkle.OldLeaf]) -> dict[str, list[tuple[bytes, bytes]]]:
            found: dict[str, list[tuple[bytes, bytes]]] = {x.name: [] for x in wanted}
            for name, k, v in self._named([x.name for x in wanted]).select("leaf_hash", "key", "value").collect():
                found[name].append((bytes(k), bytes(v)))
            return found

        return merkle.grown(old, changes, read, self.sizes, CHANGED_LEAVES)

    def _named(self, names: list[str]) -> DataFrame:
        """Stored pairs of leaves by name: the names reach the scan."""
        return self.leaf_pairs().filter(F.col("fan").isin(sorted({n[:2] for n in names})) & F.col("leaf_hash").isin(names))

    def _store_grown(self, tree: merkle.Grown) -> None:
        names = list(tree.fresh)
        known = {r[0] for r in self.manifest().filter(F.col("leaf_hash").isin(names)).select("leaf_hash").distinct().collect()} if names else set()
        new = {n: rows for n, rows in tree.fresh.items() if n not in known}
        self.last_write = WriteStats(len(tree.leaves), len(new), len(tree.leaves) - len(new))
        if new:
            rows = self.spark.createDataFrame([(n, bytearray(k), bytearray(v), n[:2]) for n, pairs in sorted(new.items()) for k, v in pairs], LEAF_PAIRS)
            rows.coalesce(1).write.mode("append").partitionBy("fan").parquet(f"{self.path}/leaf_pairs")
        stored = {r[0] for r in self.nodes().filter(F.col("node_hash").isin([n[0] for n in tree.nodes])).select("node_hash").collect()}
        fresh = {n[0]: n for n in tree.nodes if n[0] not in stored}
        if fresh:
            self.spark.createDataFrame(list(fresh.values()), NODES).coalesce(1).write.mode("append").parquet(f"{self.path}/nodes")
        if self.manifest().filter(F.col("root_hash") == tree.root).isEmpty():
            rows = [(tree.root, x.name, bytearray(x.first), bytearray(x.last), x.n_pairs, x.n_bytes) for x in tree.leaves]
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/tree_leaves")

    def _store(self, tree: merkle.Tree) -> None:
        manifest = self.manifest()
        known = manifest.select("leaf_hash").distinct()
        new = tree.leaves.select("leaf_hash").distinct().join(known, "leaf_hash", "left_anti")
        total, actual = tree.leaves.count(), new.count()
        self.last_write = WriteStats(total, actual, total - actual)
        if actual:
            rows = tree.pairs.join(new, "leaf_hash").select("leaf_hash", "key", "value", F.substring("leaf_hash", 1, 2).alias("fan"))
            rows.repartition("fan").sortWithinPartitions("leaf_hash", "key").write.mode("append").partitionBy("fan").parquet(f"{self.path}/leaf_pairs")
        stored = self.nodes().select("node_hash").distinct()
        tree.nodes.dropDuplicates(["node_hash"]).join(stored, "node_hash", "left_anti").write.mode("append").parquet(f"{self.path}/nodes")
        if tree.root != merkle.EMPTY_ROOT and manifest.filter(F.col("root_hash") == tree.root).isEmpty():
            numbered = tree.leaves.select(F.lit(tree.root).alias("root_hash"), "leaf_hash", "first_key", "last_key", "n_pairs", "n_bytes")
            numbered.sortWithinPartitions("first_key").write.mode("append").parquet(f"{self.path}/tree_leaves")

    def _commit_file(self, commit: str) -> str:
        return f"objects/{commit[:2]}/{commit[2:]}"

    def read_commit(self, commit: str) -> tuple[str, str, str, int]:
        """(root, message, parent, seconds) of a commit."""
        raw = self.files.read(self._commit_file(commit))
        if raw is None:
            raise CommitNotFound(commit)
        return decode_commit(raw)

    # objects

    def read_object(self, name: str) -> bytes:
        """The bytes of a commit, an internal node or a leaf by its hash, which they are checked against."""
        body = self.files.read(self._commit_file(name))
        if body is None:
            found = self.nodes().filter(F.col("node_hash") == name).select("body").head(1)
            body = bytes(found[0][0]) if found else None
        if body is None:
            pairs = sorted((bytes(k), bytes(v)) for k, v in self._named([name]).select("key", "value").distinct().collect())
            body = encode_leaf(pairs) if pairs else None
        if body is None:
            raise HashNotFound(name)
        if sha256(body) != name:
            raise CorruptedData(f"what is stored as {name} has another hash")
        return body

    def exists(self, name: str) -> bool:
        if self.files.is_file(self._commit_file(name)):
            return True
        return not (self.nodes().filter(F.col("node_hash") == name).isEmpty() and self._named([name]).isEmpty())

    def reset_stats(self) -> None:
        self.last_write = WriteStats(0, 0, 0)

    def depth(self, commit: str) -> int:
        if commit == ZERO_HASH:
            return 0
        row = self.commits().filter(F.col("commit_hash") == commit).select("depth").head()
        return row[0] if row else 0

    def log(self, head: str | None = None) -> DataFrame:
        """Commits from head back to the first, newest first."""
        head = head or self._head
        return history.log(self.commits(), head)

    # snapshots

    def _leaves(self, commit: str) -> DataFrame:
        root = merkle.EMPTY_ROOT if commit == ZERO_HASH else self.read_commit(commit)[0]
        return self.manifest().filter(F.col("root_hash") == root)

    def _pairs_of(self, leaves: DataFrame) -> DataFrame:
        return self.leaf_pairs().join(leaves.select("leaf_hash", F.substring("leaf_hash", 1, 2).alias("fan")), ["fan", "leaf_hash"]).select("key", "value")

    def snapshot(self, commit: str) -> DataFrame:
        """The pairs of a commit, lazily."""
        if commit == ZERO_HASH:
            return self.spark.createDataFrame([], KV)
        return self._pairs_of(self._leaves(commit))

    def at(self, ref: str) -> DataFrame:
        """The snapshot of a branch, tag or commit."""
        return self.snapshot(self.resolve(ref))

    def resolve(self, ref: str) -> str:
        for refs in (self.refs, self.tags):
            try:
                return refs.get(ref)
            except (BranchNotFound, ValueError):
                continue
        self.read_commit(ref)
        return ref

    def get_at(self, key: bytes, commit: str) -> bytes:
        """A key's value at a commit: the manifest's bounds pick the one leaf to read."""
        key = snapshot.check_key(key)
        leaf = self._leaves(commit).filter((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).select("leaf_hash").head(1)
        rows = snapshot.get(self._named([leaf[0][0]]), key).select("value").head(1) if leaf else []
        if not rows:
            raise KeyNotFound(key)
        return bytes(rows[0][0])

    def get_range(self, low: bytes | None, high: bytes | None, commit: str | None = None) -> DataFrame:
        """Pairs with keys in [low, high): of the working state, or of a commit by the leaves that overlap."""
        if commit is None:
            return snapshot.range_scan(self.working(), low, high)
        leaves = self._leaves(commit)
        if low is not None:
            leaves = leaves.filter(F.col("last_key") >= F.lit(low))
        if high is not None:
            leaves = leaves.filter(F.col("first_key") < F.lit(high))
        return snapshot.range_scan(self._pairs_of(leaves), low, high)

    def get_prefix(self, prefix: bytes, commit: str | None = None) -> DataFrame:
        return self.get_range(prefix, snapshot.after_prefix(prefix), commit)

    def diff(self, a: str, b: str) -> DataFrame:
        """What changed from commit a to b, from the leaves that one of them lacks."""
        root = lambda c: merkle.EMPTY_ROOT if c == ZERO_HASH else self.read_commit(c)[0]
        if root(a) == root(b):
            return diffs.diff(self.spark.createDataFrame([], KV), self.spark.createDataFrame([], KV))
        return diffs.pruned(self.leaf_pairs(), self._leaves(a), self._leaves(b))

    # branches

    def create_branch(self, name: str, commit: str | None = None) -> None:
        """A branch at HEAD or at a commit, which must exist; HEAD stays."""
        commit = commit or self._head
        if commit != ZERO_HASH:
            self.read_commit(commit)
        self.refs.create(name, commit)

    def switch_branch(self, name: str) -> None:
        """Go to a branch. Uncommitted changes are lost; HEAD moves once the snapshot is found."""
        commit = self.refs.get(name)
        self._load(commit)
        self.head_file.attach(name)

    def checkout(self, commit: str) -> None:
        """Go to a commit with HEAD detached. Uncommitted changes are lost."""
        self.read_commit(commit)
        self._load(commit)
        self.head_file.detach(commit)

    detach_head = checkout

    def current_branch(self) -> Head:
        return self.head_file.get()

    def delete_branch(self, name: str) -> None:
        now = self.head_file.get()
        if not now.is_detached and now.branch == name:
            raise CannotDeleteCurrentBranch(name)
        self.refs.delete(name)

    def list_branches(self) -> DataFrame:
        return self.spark.createDataFrame(self.refs.list(), "name string, commit_hash string")

    # beyond

    def tag(self, name: str, commit: str | None = None) -> None:
        commit = commit or self._head
        self.read_commit(commit)
        self.tags.create(name, commit)

    def stash(self, name: str) -> None:
        """Put the working state aside under a name and go back to HEAD's."""
        self.working().write.mode("errorifexists").parquet(f"{self.path}/stash/{check_name(name)}")
        self._load(self._head)

    def unstash(self, name: str) -> None:
        """Take a stashed state as the working state; the stash goes."""
        state, _ = written(self.spark.read.schema(KV).parquet(f"{self.path}/stash/{check_name(name)}"), "stash")
        self._replace(state)
        self.files.delete(f"stash/{name}")

    def rollback(self) -> None:
        self._load(self._head)

    def merge_base(self, a: str, b: str) -> str:
        """The commit that a merge of a and b starts from: of those that both come from, by all parents, the deepest."""
        found, depth = [], {r[0]: (r[1], r[2]) for r in self.commits().select("commit_hash", "depth", "parent").limit(history.DRIVER_COMMITS).collect()}
        second = {f.rsplit("/", 1)[1]: (self.files.read(f) or b"").decode() for f in self.files.walk("merges")}
        for head in (a, b):
            seen: set[str] = set()
            todo = [head]
            while todo:
                c = todo.pop()
                if c in depth and c not in seen:
                    seen.add(c)
                    todo += [depth[c][1], second.get(c, ZERO_HASH)]
            found.append(seen)
        return max(found[0] & found[1], key=lambda c: (depth[c][0], c), default=ZERO_HASH)

    def merge(self, name: str, message: str, prefer: str | None = None) -> str:
        """Merge a branch into the working state and commit; conflicts raise MergeConflict unless a side is preferred."""
        theirs = self.refs.get(name)
        base = self.merge_base(self._head, theirs)
        outcomes, _ = written(diffs.merge(self.snapshot(base), self.working(), self.snapshot(theirs)), "merge")
        if not prefer and not (clash := diffs.conflicts(outcomes)).isEmpty():
            raise MergeConflict([bytes(r[0]) for r in clash.select("key").limit(20).collect()])
        self._replace(diffs.merged(outcomes, prefer))
        return self.commit(message, theirs)

    def cherry_pick(self, commit: str, message: str | None = None) -> str:
        """Put one commit's changes on the working state and commit."""
        _, text, parent, _ = self.read_commit(commit)
        self._change(self.diff(parent, commit).select("key", F.col("new_value").alias("value")))
        return self.commit(message or text)

    def rebase(self, onto: str) -> str:
        """Put the current branch's own commits, oldest first, on another branch, and move it there."""
        where, target = self.head_file.get(), self.refs.get(onto)
        base = history.merge_base(self.commits(), self._head, target).select("commit_hash").head()
        own = self.log().select("commit_hash").collect()
        chain = [r[0] for r in own]
        chain = chain[: chain.index(base[0])] if base else chain
        before = self._head
        self._load(target)
        if where.is_detached:
            self.head_file.detach(target)
        else:
            self.refs.update(where.branch, target, expected=before)
        for c in reversed(chain):
            self.cherry_pick(c)
        return self._head

    def feed(self, head: str | None = None) -> DataFrame:
        """(version, commit_hash, change_type, key, old_value, new_value) of every commit up to head."""
        chain = [(r["depth"], r["commit_hash"], r["parent"]) for r in self.log(head).select("depth", "commit_hash", "parent").collect()]
        out = None
        for depth, commit, parent in chain:
            rows = self.diff(parent, commit).select(F.lit(depth).alias("version"), F.lit(commit).alias("commit_hash"), "change_type", "key", "old_value", "new_value")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "version int, commit_hash string, change_type string, key binary, old_value binary, new_value binary")

    def blame(self) -> DataFrame:
        return history.blame(self.feed())

    def heads(self) -> DataFrame:
        rows = [(h,) for _, h in [*self.refs.list(), *self.tags.list()]] + [(self._head,)]
        return self.spark.createDataFrame([r for r in rows if r[0] != ZERO_HASH], "commit_hash string")

    def garbage(self) -> DataFrame:
        """(kind, hash) of commits, and of leaves and roots, that no branch, tag or HEAD leads to."""
        dead = maintenance.unreachable(self.commits(), self.heads())
        live_roots = maintenance.reachable(self.commits(), self.heads()).join(self.commits(), "commit_hash").select("root_hash").distinct()
        live = self.manifest().join(live_roots, "root_hash", "left_semi").select("leaf_hash").distinct()
        leaves = self.leaf_pairs().select("leaf_hash").distinct().join(live, "leaf_hash", "left_anti")
        roots = self.manifest().select("root_hash").distinct().join(live_roots, "root_hash", "left_anti")
        row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("hash"))
        return row(dead, "commit", "commit_hash").unionByName(row(leaves, "leaf", "leaf_hash")).unionByName(row(roots, "root", "root_hash"))

    def collect_garbage(self) -> None:
        """Rewrite the tables without garbage: each into a new folder, which then takes the old one's name."""
        dead, _ = written(self.garbage(), "garbage")
        of = lambda kind, c: dead.filter(F.col("kind") == kind).select(F.col("hash").alias(c))
        for name, table, kind, c in (("leaf_pairs", self.leaf_pairs(), "leaf", "leaf_hash"), ("tree_leaves", self.manifest(), "root", "root_hash"), ("commits", self.commits(), "commit", "commit_hash")):
            if self.files.is_folder(name):
                writer = table.join(of(kind, c), c, "left_anti").write.mode("overwrite")
                (writer.partitionBy("fan") if name == "leaf_pairs" else writer).parquet(f"{self.path}/{name}.new")
                # A crash between the two renames leaves the old table as name.old, which opening a store puts back.
                self.files.rename(name, f"{name}.old")
                self.files.rename(f"{name}.new", name)
                self.files.delete(f"{name}.old")
        for (commit,) in of("commit", "commit_hash").collect():
            self.files.delete(self._commit_file(commit))
            self.files.delete(f"merges/{commit}")
        self._load(self._head)

    def _recover(self) -> None:
        for name in ("leaf_pairs", "tree_leaves", "commits"):
            if self.files.is_folder(f"{name}.old"):
                if self.files.is_folder(name):
                    self.files.delete(f"{name}.old")
                else:
                    self.files.rename(f"{name}.old", name)

    def fsck(self) -> DataFrame:
        return maintenance.fsck(self.leaf_pairs(), self.manifest(), self.commits(), merkle.EMPTY_ROOT)

    def inspect(self, commit: str | None = None) -> DataFrame:
        """Leaves and their sizes by level, of a commit's tree."""
        return maintenance.tree_shape(self._leaves(commit or self._head), self.nodes())

    def pull(self, other: Store, branch: str) -> str:
        """Copy what another store's branch has and this one lacks; the branch here is made or moved forward."""
        commit = other.refs.get(branch)
        chain = other.log(commit).drop("distance")
        missing, _ = written(chain.join(self.commits().select("commit_hash"), "commit_hash", "left_anti"), "pull")
        leaves = other.manifest().join(missing.select("root_hash").distinct(), "root_hash", "left_semi")
        new_leaves = leaves.select("leaf_hash").distinct().join(self.manifest().select("leaf_hash").distinct(), "leaf_hash", "left_anti")
        other.leaf_pairs().join(new_leaves, "leaf_hash", "left_semi").select("leaf_hash", "key", "value", F.substring("leaf_hash", 1, 2).alias("fan")).write.mode("append").partitionBy("fan").parquet(f"{self.path}/leaf_pairs")
        other.nodes().join(self.nodes().select("node_hash"), "node_hash", "left_anti").write.mode("append").parquet(f"{self.path}/nodes")
        leaves.join(self.manifest().select("root_hash").distinct(), "root_hash", "left_anti").select(*MANIFEST.names).write.mode("append").parquet(f"{self.path}/tree_leaves")
        missing.select(*COMMITS.names).write.mode("append").parquet(f"{self.path}/commits")
        for r in missing.select("commit_hash", "root_hash", "message", "parent", "ts").collect():
            self.files.write(self._commit_file(r[0]), encode_commit(*r[1:]))
        if self.refs.exists(branch):
            now = self.refs.get(branch)
            if now != ZERO_HASH and chain.filter(F.col("commit_hash") == now).isEmpty():
                raise ConcurrentUpdate(f"{branch} has commits of its own")
            self.refs.update(branch, commit)
        else:
            self.refs.create(branch, commit)
        return commit
