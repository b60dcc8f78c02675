import random

from pyspark.sql import functions as F

from tessera.operators import exactly_once
from tessera.operators.exactly_once import MessageStore, repeated_deliveries

SCHEMA = "delivery_id long, batch_no long, stream_name string, message_id string, delivered_at timestamp, url string, _part string, first string"


def rows_of(seed, n=300):
    rng = random.Random(seed)
    return [(i, i // 10, rng.choice(["s", "t", None]), rng.choice([None, *(f"m{k}" for k in range(40))]), None if rng.random() < 0.05 else f"2026-01-{rng.randint(1, 9):02d} 00:00:00", f"u{i}", "x", "y") for i in range(n)]


def frame(make, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    text = ", ".join(f"{n} {'string' if n == 'delivered_at' else f.split()[1]}" for n, f in zip(names, SCHEMA.split(", ")))
    return make(rows, text).withColumn("delivered_at", F.col("delivered_at").cast("timestamp"))


def brute(rows):
    seen, dropped = set(), []
    for r in rows:
        if r[2] is None or r[3] is None:
            continue
        if (r[2], r[3]) in seen:
            dropped.append(r[0])
        seen.add((r[2], r[3]))
    return sorted(dropped)


def test_found_matches_brute_force(make, spark, tmp_path):
    rows = rows_of(1, 120)
    for batches in (1, 2, 12):  # 12: a portion for each batch_no
        store = MessageStore(spark, f"file://{tmp_path}/b{batches}")
        got = sorted(r[0] for r in repeated_deliveries(frame(make, rows), store, batches).collect())
        assert got == brute(rows)
        kept = sorted(r.delivery_id for r in store.messages(frame(make, rows).schema).collect())
        assert kept == sorted({r[0] for r in rows} - set(got))


def test_only_affected_partitions_are_replaced_and_a_repeat_changes_nothing(make, spark, tmp_path):
    store = MessageStore(spark, f"file://{tmp_path}/s")
    base = [(i, 0, "s", f"m{i}", f"2026-01-0{1 + i % 5} 00:00:00", "u", "", "") for i in range(20)]
    store.merge(frame(make, base))
    before = store.manifest()["partitions"]
    late = frame(make, [(99, 1, "s", "m0", "2026-02-01 00:00:00", "again", "", ""), (5, 1, "s", "new", "2026-01-02 00:00:00", "u", "", "")])
    dropped = store.merge(late).collect()
    after = store.manifest()["partitions"]
    assert [r.delivery_id for r in dropped] == [99]
    changed = {p for p in before if before[p] != after.get(p)}
    assert changed == {"20260101", "20260102"}  # where m0 lies, and where the new message goes
    again = sorted(r.delivery_id for r in store.merge(late).collect())
    assert again == [99] and store.messages(late.schema).count() == 21


def test_an_earlier_delivery_that_arrives_later_wins(make, spark, tmp_path):
    store = MessageStore(spark, f"file://{tmp_path}/e")
    store.merge(frame(make, [(7, 0, "s", "m", "2026-01-01 00:00:00", "late", "", "")]))
    dropped = store.merge(frame(make, [(3, 1, "s", "m", "2026-01-05 00:00:00", "early", "", "")])).collect()
    assert [r.delivery_id for r in dropped] == [7]
    assert [r.url for r in store.messages(frame(make, []).schema).collect()] == ["early"]


def test_an_unfinished_version_is_not_seen(make, spark, tmp_path, monkeypatch):
    store = MessageStore(spark, f"file://{tmp_path}/u")
    store.merge(frame(make, [(1, 0, "s", "a", "2026-01-01 00:00:00", "u", "", "")]))
    monkeypatch.setattr(MessageStore, "_commit", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    try:
        store.merge(frame(make, [(2, 1, "s", "b", "2026-01-01 00:00:00", "u", "", "")]))
    except OSError:
        pass
    monkeypatch.undo()
    assert [r.message_id for r in store.messages(frame(make, []).schema).collect()] == ["a"]
    store.merge(frame(make, [(2, 1, "s", "b", "2026-01-01 00:00:00", "u", "", "")]))
    assert store.messages(frame(make, []).schema).count() == 2


def entries(store):
    manifest = store.manifest()
    folders = [f for runs in manifest["index"].values() for f in runs]
    return store._read(folders, "key long").count(), max(map(len, manifest["index"].values()))


def test_the_index_grows_with_the_messages_and_is_compacted(make, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exactly_once, "MOST_RUNS", 3)
    store = MessageStore(spark, f"file://{tmp_path}/i", buckets=2)
    for k in range(8):  # all of one day, which is rewritten each time
        rows = [(10 * k + i, k, "s", f"m{10 * k + i}", "2026-01-01 00:00:00", "u", "", "") for i in range(10)]
        assert store.merge(frame(make, [*rows, (1000 + k, k, "s", "m0", "2026-01-01 00:00:00", "u", "", "")])).count() == 1
        n, runs = entries(store)
        assert n == 10 * (k + 1) and runs <= 4
    assert store.messages(frame(make, []).schema).count() == 80


def test_a_batch_reads_the_buckets_of_its_keys_alone(make, spark, tmp_path):
    store = MessageStore(spark, f"file://{tmp_path}/k", buckets=64)
    store.merge(frame(make, [(i, 0, "s", f"m{i}", f"2026-01-{1 + i % 28:02d} 00:00:00", "u", "", "") for i in range(200)]))
    read = []
    plain = store._read
    store._read = lambda folders, schema: read.append(folders) or plain(folders, schema)
    touched, buckets = store.affected(frame(make, [(900, 1, "s", "m3", "2026-01-04 00:00:00", "u", "", "")]), store.manifest())
    assert touched == ["20260104"] and len(buckets) == 1 and [len(f) for f in read] == [1]


def test_of_two_writers_none_loses_a_batch(make, spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w"
    one, two = MessageStore(spark, path), MessageStore(spark, path)
    one.merge(frame(make, [(1, 0, "s", "a", "2026-01-01 00:00:00", "u", "", "")]))
    commit, waiting = MessageStore._commit, [True]

    def overtaken(self, manifest):
        if self is one and waiting.pop() if waiting else False:
            two.merge(frame(make, [(3, 1, "s", "b", "2026-01-01 00:00:00", "two", "", "")]))
        commit(self, manifest)

    monkeypatch.setattr(MessageStore, "_commit", overtaken)
    dropped = one.merge(frame(make, [(4, 1, "s", "b", "2026-01-02 00:00:00", "one", "", ""), (5, 1, "s", "c", "2026-01-02 00:00:00", "one", "", "")]))
    assert [r.delivery_id for r in dropped.collect()] == [4]
    assert sorted((r.message_id, r.url) for r in one.messages(frame(make, []).schema).collect()) == [("a", "u"), ("b", "two"), ("c", "one")]
    assert one.versions() == [1, 2, 3]


def test_old_versions_are_removed(make, spark, tmp_path):
    store = MessageStore(spark, f"file://{tmp_path}/r")
    for k in range(4):
        store.merge(frame(make, [(k, k, "s", f"m{k}", "2026-01-01 00:00:00", "u", "", "")]))
    assert store.vacuum(keep=1) == []  # all are young
    gone = store.vacuum(keep=1, grace_seconds=0)
    assert store.versions() == [4] and len([g for g in gone if g.startswith("v-")]) == 3
    assert store.messages(frame(make, []).schema).count() == 4
    assert [r.delivery_id for r in store.merge(frame(make, [(9, 5, "s", "m2", "2026-01-03 00:00:00", "u", "", "")])).collect()] == [9]


def test_empty_tables(make, spark, tmp_path):
    store = MessageStore(spark, f"file://{tmp_path}/z")
    empty = frame(make, [])
    assert repeated_deliveries(empty, store).count() == 0
    assert store.messages(empty.schema).count() == 0
