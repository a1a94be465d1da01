import hashlib

import pytest
from pyspark.sql import functions as F

from strataloom import model
from strataloom.functions.buzhash import ChunkSizes
from strataloom.operators import history, maintenance
from strataloom.plans.refs import check_name
from strataloom.plans.store import Store
from strataloom.sources import versioned
from strataloom.streaming import feed

SIZES = ChunkSizes(256, 64, 1024)


@pytest.fixture
def store(spark, tmp_path):
    ticks = iter(range(1, 1000))
    return Store(spark, f"{tmp_path}/s", SIZES, clock=lambda: next(ticks))


def one_leaf(*found):
    """The hash of a leaf by hand: its kind, how many pairs, and each part after its length."""
    sized = lambda b: len(b).to_bytes(4, "big") + b
    return hashlib.sha256(b"\x01" + len(found).to_bytes(4, "big") + b"".join(sized(k) + sized(v) for k, v in found)).hexdigest()


def pairs(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_puts_gets_and_deletes(store):
    store.put(b"k", b"v")
    store.put(b"e", b"")
    assert store.get(b"k") == b"v" and store.get(b"e") == b""
    store.delete(b"k")
    for missing in (b"k", b"nope"):
        with pytest.raises(model.KeyNotFound):
            store.get(missing)
        with pytest.raises(model.KeyNotFound):
            store.delete(missing)
    for f in (lambda: store.put(b"", b"x"), lambda: store.get(b""), lambda: store.delete(b""), lambda: store.get_at(b"", "0" * 64)):
        with pytest.raises(model.InvalidKey):
            f()


def test_versions_branches_and_restart(spark, store, tmp_path):
    assert store.log().collect() == [] and store.head == model.ZERO_HASH
    for k, v in ((b"moon:io", b"Jupiter"), (b"moon:mimas", b"Saturn"), (b"moon:triton", b"Uranus")):
        store.put(k, v)
    one = store.commit("first <1>")
    store.put(b"moon:triton", b"Neptune")
    store.put(b"moon:ariel", b"Uranus")
    store.delete(b"moon:mimas")
    two = store.commit("second")
    assert store.read_commit(one)[0] == one_leaf((b"moon:io", b"Jupiter"), (b"moon:mimas", b"Saturn"), (b"moon:triton", b"Uranus"))
    assert store.read_commit(two)[0] == one_leaf((b"moon:ariel", b"Uranus"), (b"moon:io", b"Jupiter"), (b"moon:triton", b"Neptune"))
    assert [(r.commit_hash, r.message, r.parent) for r in store.log().collect()] == [(two, "second", one), (one, "first <1>", model.ZERO_HASH)]
    assert {(r.change_type, bytes(r.key)) for r in store.diff(one, two).collect()} == {("added", b"moon:ariel"), ("modified", b"moon:triton"), ("deleted", b"moon:mimas")}
    assert store.diff(one, one).collect() == [] and store.get_at(b"moon:mimas", one) == b"Saturn"
    with pytest.raises(model.KeyNotFound):
        store.get_at(b"moon:mimas", two)
    with pytest.raises(model.CommitNotFound):
        store.get_at(b"moon:mimas", "f" * 64)

    store.create_branch("orbit/far")
    store.put(b"lost", b"1")
    store.switch_branch("orbit/far")
    store.put(b"ring:e", b"f")
    three = store.commit("feature")
    again = Store(spark, f"{tmp_path}/s", SIZES)
    assert again.current_branch().branch == "orbit/far" and pairs(again.working()) == pairs(store.working()) and b"lost" not in pairs(again.working())
    assert {r.name: r.commit_hash for r in store.list_branches().collect()} == {"main": two, "orbit/far": three}
    with pytest.raises(model.CannotDeleteCurrentBranch):
        store.delete_branch("orbit/far")
    store.checkout(one)
    assert store.current_branch() == type(store.current_branch())("", True, one) and store.get(b"moon:mimas") == b"Saturn"
    store.put(b"d", b"1")
    four = store.commit("detached")
    assert store.refs.get("main") == two and store.head_file.get().commit_hash == four
    store.switch_branch("main")
    assert {r.hash for r in store.garbage().filter("kind = 'commit'").collect()} == {four}
    store.collect_garbage()
    assert store.garbage().collect() == [] and store.fsck().collect() == []

    merged = store.merge("orbit/far", "merge")
    assert pairs(store.snapshot(merged)) == {b"moon:triton": b"Neptune", b"moon:io": b"Jupiter", b"moon:ariel": b"Uranus", b"ring:e": b"f"}
    assert {bytes(r.key): r.version for r in store.blame().collect()}[b"moon:io"] == 1
    assert pairs(store.get_prefix(b"moon:", merged)).keys() == {b"moon:ariel", b"moon:io", b"moon:triton"} and pairs(store.get_range(b"moon:b", b"moon:t")) == {b"moon:io": b"Jupiter"}

    assert pairs(versioned.read_version(spark, store.path, as_of=one))[b"moon:mimas"] == b"Saturn"
    versioned.register_views(spark, store.path, "kv", old=one, main="main")
    assert spark.sql("SELECT count(*) FROM kv_old JOIN kv_main USING (key)").head()[0] == 2
    spark.dataSource.register(versioned.VersionedSource)
    source = spark.read.format("strataloom").option("path", store.path).option("root", store.read_commit(one)[0]).load()
    assert pairs(source) == pairs(store.snapshot(one))
    other = Store(spark, f"{tmp_path}/copy", SIZES)
    other.switch_branch("main")
    other.pull(store, "orbit/far")
    assert pairs(other.at("orbit/far")) == pairs(store.at("orbit/far")) and other.fsck().collect() == []


def test_conflicts_picks_and_rebase(store):
    store.put(b"a", b"1")
    store.commit("base")
    store.create_branch("b")
    store.put(b"a", b"2")
    store.commit("ours")
    store.switch_branch("b")
    store.put(b"a", b"3")
    store.put(b"n", b"3")
    theirs = store.commit("theirs")
    store.switch_branch("main")
    with pytest.raises(model.MergeConflict):
        store.merge("b", "no")
    store.rollback()
    store.merge("b", "yes", prefer="ours")
    assert pairs(store.working()) == {b"a": b"2", b"n": b"3"}
    store.cherry_pick(theirs)
    assert store.get(b"a") == b"3"
    store.switch_branch("b")
    store.put(b"own", b"1")
    store.commit("own")
    store.rebase("main")
    assert pairs(store.working()) == {b"a": b"3", b"n": b"3", b"own": b"1"} and store.log().count() == 6


def test_bulk_sharing_stash_hooks_and_stream(spark, store, tmp_path):
    folder, got = f"{tmp_path}/feed", []
    store.post_commit.append(feed.publish_to(folder))
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).cast("binary").alias("key"), F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary").alias("value"))
    store.put_all(rows)
    one = store.commit("bulk")
    assert store.last_write.actual > 50
    store.put(b"k001500", b"changed")
    store.commit("one")
    assert store.last_write.actual <= 3 and store.last_write.deduplicated == store.last_write.total - store.last_write.actual
    assert store.inspect().agg(F.max("level")).head()[0] >= 1
    store.put(b"z", b"1")
    store.stash("later")
    with pytest.raises(model.KeyNotFound):
        store.get(b"z")
    store.unstash("later")
    assert store.get(b"z") == b"1"
    store.tag("v1", one)
    assert store.at("v1").count() == 3000

    def refuse(_, changes):
        if not changes.filter(F.col("key") == F.lit(b"z")).isEmpty():
            raise ValueError("no z")

    store.pre_commit.append(refuse)
    with pytest.raises(ValueError):
        store.commit("refused")
    with pytest.raises(Exception, match="empty key"):
        store.put_all(spark.createDataFrame([(bytearray(b""), bytearray(b"x"))], "key binary, value binary"))
        store.working().collect()
    q = feed.subscribe(feed.changes(spark, folder), lambda df, n: got.append(df.count()), f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    assert sum(got) == 3001
    rates = feed.rates(feed.changes(spark, folder)).writeStream.format("memory").outputMode("complete").queryName("rates").start()
    rates.processAllAvailable()
    rates.stop()
    assert {(r.change_type, r.n) for r in spark.table("rates").collect()} == {("added", 3000), ("modified", 1)}


def test_a_moved_ref_is_noticed(spark, store):
    store.put(b"a", b"1")
    other = Store(spark, store.path, SIZES, clock=lambda: 5)
    other.put(b"b", b"2")
    other.commit("first")
    with pytest.raises(model.ConcurrentUpdate):
        store.commit("second")


def test_refs(store):
    refs = store.refs
    refs.create("foo/bar", "a" * 64)
    for name in ("foo", "foo/bar/baz"):
        with pytest.raises(model.BranchPathConflict):
            refs.create(name, "a" * 64)
    with pytest.raises(model.BranchExists):
        refs.create("foo/bar", "a" * 64)
    with pytest.raises(model.BranchNotFound):
        refs.get("nope")
    with pytest.raises(model.CommitNotFound):
        store.create_branch("x", "b" * 64)
    refs.delete("foo/bar")
    refs.create("foo", "a" * 64)
    assert [n for n, _ in refs.list()] == ["foo", "main"]
    store.files.write("refs/heads/bad", b"xyz\n")
    with pytest.raises(model.CorruptedData):
        refs.get("bad")


@pytest.mark.parametrize("text", ["\n", "ref:main", "ref: refs/tags/one", "0f" * 31, "g" + "0" * 63, "A" * 64 + "!", "deadbeef"])
def test_bad_heads(store, text):
    store.files.write("HEAD", text.encode())
    with pytest.raises(model.InvalidHeadFormat):
        store.head_file.get()


@pytest.mark.parametrize("name", ["x", "trunk", "2024-plan", "team_1/orbit.v2", "a/b/c/d", "locks", "head", "é"])
def test_valid_names(name):
    assert check_name(name) == name


@pytest.mark.parametrize(
    ("name", "error"),
    [("", model.BranchNameEmpty), ("HEAD", model.BranchNameReserved), *((n, model.InvalidBranchName) for n in ("-x", ".x", "x.lock", "a..b", "a//b", "a b", "a~b", "a^b", "a:b", "a?b", "a*b", "a[b", "a\\b", "a/", "/a", "a/.b", "a/./b"))],
)
def test_invalid_names(name, error):
    with pytest.raises(error):
        check_name(name)


@pytest.mark.parametrize("on_driver", [True, False])
def test_long_histories(spark, monkeypatch, on_driver):
    monkeypatch.setattr(history, "DRIVER_COMMITS", 1000 if on_driver else 5)
    chain = [(f"m{i}", f"m{i - 1}" if i else model.ZERO_HASH) for i in range(37)] + [(f"f{i}", f"f{i - 1}" if i else "m20") for i in range(4)]
    commits = spark.createDataFrame(chain, "commit_hash string, parent string")
    assert [(r.commit_hash, r.distance) for r in history.log(commits, "m36").collect()] == [(f"m{36 - d}", d) for d in range(37)]
    assert history.merge_base(commits, "m36", "f3").head().asDict() == {"commit_hash": "m20", "from_a": 16, "from_b": 4}
    heads = spark.createDataFrame([("f3",), ("m2",)], "commit_hash string")
    assert {r.commit_hash for r in maintenance.unreachable(commits, heads).collect()} == {f"m{i}" for i in range(21, 37)}
    assert history.log(commits, "nowhere").collect() == []


def test_small_commits_keep_roots_and_merges_remember_both_parents(spark, store):
    rows = spark.range(2000).select(F.format_string("k%06d", "id").cast("binary").alias("key"), F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary").alias("value"))
    store.put_all(rows)
    store.commit("all")
    store.create_branch("b")
    store.put(b"k000100", b"x")
    store.put_all(rows.filter("key = 'k001500'").select("key", F.lit(b"y").alias("value")))
    store.delete_all(rows.filter("key in ('k000007', 'k001999')").select("key"))
    store.put(b"k001500", b"z")
    small = store.commit("small")
    assert 0 < store.last_write.actual < 12 < store.last_write.total
    other = Store(spark, store.path + "2", SIZES)
    other.put_all(store.working())
    assert other.read_commit(other.commit("same"))[0] == store.read_commit(small)[0]
    assert pairs(store.get_range(b"k001500", b"k001501")) == {b"k001500": b"z"} and store.fsck().collect() == []
    store.switch_branch("b")
    store.put(b"k000300", b"b1")
    one = store.commit("b1")
    store.switch_branch("main")
    store.merge("b", "merge")
    store.switch_branch("b")
    store.put(b"k000400", b"b2")
    two = store.commit("b2")
    assert store.merge_base(store.refs.get("main"), two) == one
    store.switch_branch("main")
    store.merge("b", "again")
    assert store.get(b"k000300") == b"b1" and store.get(b"k000400") == b"b2" and store.get(b"k000100") == b"x"


def test_garbage_collection_survives_a_crash(spark, store):
    store.put(b"a", b"1")
    store.commit("one")
    store.files.rename("leaf_pairs", "leaf_pairs.old")  # as between its two renames
    again = Store(spark, store.path, SIZES)
    assert again.get(b"a") == b"1" and again.fsck().collect() == []
    for name in ("../x", "a/../b", "", "HEAD"):
        with pytest.raises(model.InvalidBranchName):
            again.stash(name)


def test_mirror_takes_the_last_commit(spark, store, tmp_path):
    store.clock = lambda: 7  # all in one second
    store.post_commit.append(feed.publish_to(f"{tmp_path}/feed"))
    for v in (b"1", b"2", b"3"):
        store.put(b"k", v)
        store.put(b"n" + v, v)
        store.commit(v.decode())
    store.delete(b"n2")
    store.commit("4")
    target = Store(spark, f"{tmp_path}/mirror", SIZES)
    q = feed.mirror(feed.changes(spark, f"{tmp_path}/feed"), target, f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    assert pairs(Store(spark, target.path).working()) == pairs(store.working())
